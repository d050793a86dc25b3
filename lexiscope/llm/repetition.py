"""Problem 10: repetition inside a single document, as a rule bitmask ledger.

Each document is measured once. Every rule is evaluated once on the measurements, and its failure is one bit of ``mask``;
the ledger keeps mask and measurements. ``stored_ledger`` writes it to the shared folder, under a key of the documents, the
rules and this code, and every later query of the same documents reads it there. Policies are versioned masks over the
rules: applying one, or leaving a rule out of one, is bitwise arithmetic on the ledger and measures no text again.

``repeated`` is the share of words that only repeat: a word counts when it lies in a window of ``WINDOW`` words that stood
earlier in the same text, or in a gap of at most ``GAP`` words between two such windows, so that light changes do not make
a repeat new. Words are compared in lower case with digits as 0; a CJK character is a word. Null, empty and blank texts
have 0 words, shares of 0 and fail no rule.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.session import fingerprint, remembered_table

WINDOW = 6
GAP = 3
WORD = re.compile(r"[㐀-鿿぀-ヿ가-힯]|[^\W_]+(?:[_'’][^\W_]+)*")
SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s*|\n+")
DIGITS = re.compile(r"\d")

MEASURES = "words long, repeated double, sentences double, lines double, paragraphs double, top_phrase double"
#: rule name, measurement, threshold; a rule's bit is its place in this list
RULES = [
    ("repeated_words", "repeated", 0.4),
    ("duplicate_sentences", "sentences", 0.3),
    ("duplicate_lines", "lines", 0.3),
    ("duplicate_paragraphs", "paragraphs", 0.3),
    ("top_phrase", "top_phrase", 0.2),
]
#: policy name and version to the rules any of which rejects a document
POLICIES = {
    ("two_fifths", 1): ["repeated_words"],
    ("strict", 1): ["repeated_words", "duplicate_sentences", "duplicate_paragraphs"],
    ("strict", 2): ["repeated_words", "duplicate_sentences", "duplicate_lines", "duplicate_paragraphs", "top_phrase"],
}


def _repeated_mask(codes: np.ndarray, window: int = WINDOW, gap: int = GAP) -> np.ndarray:
    """Which words only repeat. ``codes`` are hashes of the words."""
    n = len(codes)
    starts = n - window + 1
    if starts < 2:
        return np.zeros(n, bool)
    keys = np.zeros(starts, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + starts]
            keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    again = np.zeros(starts, bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    runs = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    for end, start in zip(runs[1:-1:2], runs[2::2]):
        if start - end <= gap:
            covered[end:start] = True
    return covered


def _duplicate_share(parts: list[str]) -> float:
    """Share of the characters in parts that stood earlier; parts are compared without blanks at the ends and case."""
    seen, total, again = set(), 0, 0
    for part in parts:
        key = " ".join(part.lower().split())
        if key:
            total += len(key)
            if key in seen:
                again += len(key)
            seen.add(key)
    return again / total if total else 0.0


def measure(text: str | None) -> tuple:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = WORD.findall(DIGITS.sub("0", text.lower())) if text else []
    n = len(words)
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    covered = _repeated_mask(codes)
    top = 0.0
    if n >= 6:
        with np.errstate(over="ignore"):
            threes = (codes[:-2] * np.uint64(31) + codes[1:-1]) * np.uint64(31) + codes[2:]
        counts = np.unique(threes, return_counts=True)[1]
        top = 3 * float(counts.max()) / n if counts.max() > 1 else 0.0
    return (n, float(covered.mean()), _duplicate_share(SENTENCE_END.split(text)), _duplicate_share(text.splitlines()),
            _duplicate_share(re.split(r"\n\s*\n", text)), min(1.0, top))


def _measure_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [m.split()[0] for m in MEASURES.split(", ")]
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, mask) of every row; one narrow stage, each rule evaluated once."""
    measured = docs.select(id_col, F.pandas_udf(_measure_all, MEASURES)(F.col(text_col)).alias("m")).select(id_col, "m.*")
    mask = F.lit(0)
    for bit, (_, measurement, limit) in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.col(measurement) >= limit, F.lit(1 << bit)).otherwise(F.lit(0)))
    return measured.withColumn("mask", mask)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anew: bool = False) -> DataFrame:
    """The ledger of these documents, measured by the first call and by those with ``anew``, read by all others."""
    own = docs.select(id_col, text_col)
    code = Path(__file__).read_bytes() if Path(__file__).exists() else b""  # rules and thresholds are in the code; from an archive it is that of the application
    key = hashlib.sha256(repr((fingerprint(own), RULES, WINDOW, GAP)).encode() + code).hexdigest()[:32]
    return remembered_table(docs.sparkSession, f"ledger-{key}", lambda: ledger(own, id_col, text_col), anew)


def policy_mask(policy: tuple[str, int], without: str | None = None) -> int:
    bits = {name: 1 << bit for bit, (name, _, _) in enumerate(RULES)}
    return sum(bits[name] for name in POLICIES[policy] if name != without)


def rejected(book: DataFrame, policy: tuple[str, int] = ("two_fifths", 1)) -> DataFrame:
    """Rows of the ledger that the policy rejects."""
    return book.where(F.col("mask").bitwiseAND(F.lit(policy_mask(policy))) != 0)


def ablations(book: DataFrame) -> DataFrame:
    """For each policy: documents rejected, and rejected when one of its rules is left out (policy, version, without, n)."""
    by_mask = book.groupBy("mask").agg(F.count(F.lit(1)).alias("docs"))  # at most 2^rules rows
    cases = [(p, v, out, policy_mask((p, v), out)) for (p, v), rules in POLICIES.items() for out in [None, *rules]]
    asked = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(w).cast("string").alias("without"), F.lit(m).alias("of")) for p, v, w, m in cases]))
    flat = by_mask.select("mask", "docs", asked.alias("c")).select("mask", "docs", "c.*")
    hit = F.col("mask").bitwiseAND(F.col("of")) != 0
    return flat.groupBy("policy", "version", "without").agg(F.sum(F.when(hit, F.col("docs")).otherwise(F.lit(0))).alias("n_rejected"))
