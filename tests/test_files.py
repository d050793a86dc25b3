from pyspark.sql import functions as F

from lexiscope.operators import learning, sampling
from lexiscope.sources import files
from lexiscope.streaming import ops


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'line\nbreak, "quoted" and \\ back'), (2, None), (3, "ação 😀")]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "i int, t string").collect())) == rows


def test_jsonl(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{bad\n{"a": "x"}\n')
    rows, broken = files.read_jsonl(spark, str(tmp_path / "v.jsonl"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2] and broken.count() == 2


def test_pages_and_manifest(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"items": [{"name": "a"}, {"name": "b"}]}\n{"items": []}\n{"items": [{"name": "c"}]}\n')
    assert files.read_pages(spark, str(tmp_path / "p.jsonl"), "name string").count() == 3
    assert files.read_pages(spark, str(tmp_path / "p.jsonl"), "name string", 2).count() == 2
    m = files.file_manifest(spark, str(tmp_path / "p.jsonl")).first()
    assert m.name == "p.jsonl" and m.bytes == (tmp_path / "p.jsonl").stat().st_size and len(m.sha256) == 64


def test_append_and_upsert(spark, tmp_path):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.append(a, str(tmp_path / "t"))
    files.append(a, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert sorted(map(tuple, files.upsert(a, spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "z"), (3, "c")]


def test_allocation():
    out = sampling.allocate({"a": 900, "b": 90, "c": 1}, 100)
    assert sum(out.values()) == 100 and out["c"] == 1 and sampling.allocate({}, 10) == {}
    assert sampling.allocate({"a": 2, "b": 1}, 10) == {"a": 2, "b": 1}


def test_pools_are_disjoint(spark, root):
    from lexiscope.plans.sampling import smp_pools_v2

    rows = [tuple(r)[:4] for r in smp_pools_v2(spark, root).collect()]
    assert len(rows) == len(set(rows)) > 0


def test_neighbours_against_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.standard_normal((60, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for q in learning.nearest(df, df.where("vec_id % 20 = 0"), 3).collect():
        got.setdefault(q.query_id, {})[q["rank"]] = q.id
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        assert [found[k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()


def test_compaction_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    for i, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]]):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.parquet(str(folder / f"f{i}"))
    stream = ops.read_files(spark, str(folder / "*"), "k int, t int, v string", per_trigger=1)
    last = ops.run_compacting(stream, ["k"], ["t"], str(tmp_path / "out"), str(tmp_path / "check"))
    assert last == 1
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out" / f"v={last}")).collect()) == [(1, "c"), (2, "b")]


def test_skip_done_and_dead_letters(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (2,)], "k int")
    assert [r.k for r in ops.skip_done(a, a.where("k = 2"), ["k"]).collect()] == [1]
    assert [r.k for r in ops.dead_letters(a, ["k"]).collect()] == [2]
    assert a.agg(F.count("*")).first()[0] == 4
