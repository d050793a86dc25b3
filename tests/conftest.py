import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexiscope.session import create

    s = create(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def root():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def oracle(root):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(root).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


OCCURRENCE = "repo_full_name string, artifact_type string, artifact_id string, matched_expression string, category_ubw string, body_text string, created_at timestamp, removed_at timestamp, is_censored int, time_to_event_days bigint, url string, author_name string, primary_language string, n string, name string, bucket string, h string, source string, path string"


@pytest.fixture(scope="session")
def make_occurrences(spark):
    """Rows of the fact table from dicts; missing columns are null, and a few extra columns bear names that operators use."""

    def make(rows):
        names = [c.split()[0] for c in OCCURRENCE.split(", ")]
        return spark.createDataFrame([tuple(r.get(n, "extra" if n in ("n", "name", "bucket", "h", "source", "path") else None) for n in names) for r in rows], OCCURRENCE)

    return make
