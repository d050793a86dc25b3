"""The one function that built-in expressions cannot say: overlapping windows around matches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words of judgement before 'but ... works'
ADJECTIVES = "ugly janky hacky messy dirty crude brittle fragile sloppy kludgy kludge hackish gross nasty clunky jury-rigged".split()
#: fixed values: phrases that are looked for literally
LITERALS = [
    "ugly hack", "kludge", "temporary fix", "temp fix", "stopgap", "stopgap fix", "workaround for now",
    "not the best solution but", "i know this is bad but", "not proud of this but",
]
_PASS = r"\b(?:passes?|passed|passing)\b[^.!?\n]{0,20}\b(?:tests?|ci|the\s+suite|the\s+build)\b"
#: fixed values: the structural patterns
TEMPLATES = {
    "but_works": r"\b(?:" + "|".join(map(re.escape, ADJECTIVES)) + r")\b[^.!?\n]{0,25}\bbut\b[^.!?\n]{0,40}\bworks?\b",
    "concessive_works": r"\b(?:although|though|even though|despite|in spite of)\b[^.!?\n]{0,60}\bworks?\b",
    "but_passes_tests": r"\bbut\b[^.!?\n]{0,25}" + _PASS,
    "concessive_passes_tests": r"\b(?:although|though|despite)\b[^.!?\n]{0,50}" + _PASS,
}
PATTERNS = {name: re.compile(rx, re.IGNORECASE) for name, rx in (TEMPLATES | {p: rf"\b{re.escape(p)}\b" for p in LITERALS}).items()}
BUT_WORKS = PATTERNS["but_works"]
AROUND = 30


def windows(text: str | None, pattern: re.Pattern = BUT_WORKS, around: int = AROUND) -> list[str]:
    """Text around every match, without blanks at the ends; windows may overlap. Null gives none."""
    return [text[max(0, m.start() - around) : m.end() + around].strip() for m in pattern.finditer(text)] if text else []


def find_matches(text: Column | str) -> Column:
    """(pattern, n, window) of every match of every structural and literal pattern, n counting within the pattern."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"pattern": p, "n": n, "window": w} for p, rx in PATTERNS.items() for n, w in enumerate(windows(t, rx))] for t in b], dtype=object)

    return F.pandas_udf(run, "array<struct<pattern:string,n:int,window:string>>")(F.col(text) if isinstance(text, str) else text)
