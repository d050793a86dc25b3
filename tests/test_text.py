import hashlib
import hmac
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiscope.functions import lexicon as L
from lexiscope.functions import text as T
from lexiscope.functions.windows import windows


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,phrase,want", [
    ("a temporary fix here", "temporary fix", True), ("- x_temp\n- fix y", "temp fix", False), ("temporarily fix", "temporary fix", False),
    ("**Band-Aid** fix!", "band-aid fix", True), ("temp\r\nfix", "temp fix", False), ("", "temp fix", False), ("TEMP--FIX", "temp fix", True),
])
def test_phrase(spark, text, phrase, want):
    assert one(spark, T.has_phrase("t", phrase), t=text) is want


def test_phrase_equals_definition(spark):
    rows = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="temp fixTEMP-_.\n\r/é1", max_size=40))
    def collect(t):
        rows.append(t)

    collect()
    plain = lambda line: " " + re.sub(r"[^a-z0-9]+", " ", line.lower()).strip() + " "
    want = [any(" temp fix " in plain(line) for line in re.split(r"\r\n|\r|\n", t)) for t in rows]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(T.has_phrase("t", "temp fix")).collect()]
    assert got == want


@pytest.mark.parametrize("text,want", [("see /Tools/stopGap/x.py", True), ("see /Tools/stopGap/x.py, a stopgap", False), ("nothing", False), ("stopgap.py:3:1)", True), ("", False)])
def test_path_only(spark, text, want):
    assert one(spark, T.path_only("t", "stopgap"), t=text) is want


@pytest.mark.parametrize("path,want", [("a/vendor/x.c", True), ("web/jquery.js", True), ("x.min.js", True), ("lib-1.2.3/a.c", True), ("src/a.py", False), ("redist/x.c", True)])
def test_vendored(spark, path, want):
    assert one(spark, T.is_vendored("p"), p=path) is want


@pytest.mark.parametrize("line,ext,want", [('s = "# no', ".py", False), ('s = "" # yes', ".py", True), ("/* block", ".c", True), ("x = 1", ".py", False), ("// it's", ".js", True)])
def test_comment(spark, line, ext, want):
    assert one(spark, T.is_comment("l", "e"), l=line, e=ext) is want


def test_masking(spark):
    secret = "gh" + "p_" + "a" * 24
    text = "\n".join(["mail ana@corp.org and @someone", f"key {secret}", "https://u:" + "p" + "w@host/x", "@Override", "Co-authored-by: A B <a@b.co>", "Signed-off-by: C D <c@d.co>"])
    df = T.mask_secrets(spark.createDataFrame([(text,), ("plain @property text",), (None,)], "t string"), "t")
    first, second, third = [r["masked"] for r in df.collect()]
    for label in ("EMAIL", "MENTION", "TOKEN_GITHUB_PAT_CLASSIC", "URL_CREDENTIAL", "COAUTHOR_TRAILER", "SIGNEDOFF_TRAILER"):
        assert first.count(f"[PII_{label}_REDACTED]") == 1
    assert "@Override" in first and "corp.org" not in first and secret not in first
    assert second == "plain @property text" and third is None


@pytest.mark.parametrize("key", [b"k", b"x" * 80])
def test_keyed_hash(spark, key):
    for value in ("abc", "ação 😀", ""):
        assert one(spark, T.keyed_hash("v", key), v=value) == hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def test_days_and_windows(spark):
    d = spark.sql("SELECT timestamp'2026-07-20 23:00:00' s, timestamp'2026-07-21 01:00:00' e").select(T.floor_days("s", "e")).first()[0]
    assert d == 0
    assert windows("so ugly but it works, and messy but it works") and windows(None) == [] and windows("") == []


def test_lexicon():
    assert len(L.ENTRIES) == 25 and sum(p for *_, p in L.ENTRIES) == 1


def test_center_window(spark):
    text = "a" * 300 + " temp fix " + "b" * 300
    got = one(spark, T.center_window("t", "p", 100), t=text, p="temp fix")
    assert "temp fix" in got and got.startswith("…") and got.endswith("…") and len(got) == 102
    assert one(spark, T.center_window("t", "p", 100), t="short", p="x") == "short"


def test_nearest_line(spark):
    assert one(spark, T.nearest_line("t", "p", F.col("e")), t="hack\nx\nx\nx\nhack", p="hack", e=4) == 5
    assert one(spark, T.nearest_line("t", "p", F.col("e")), t="x", p="hack", e=4) is None
