"""Texts are shuffled once, and the short ways say what the long ones do."""

import random

import numpy as np
import pandas as pd

from lexiscope import session
from lexiscope.llm import truncation


def test_counts_are_those_of_the_places():
    r = np.random.default_rng(5)
    hashes, events = r.choice(r.integers(0, 2**63, 50, dtype=np.uint64) << np.uint64(1), 3000), r.random(3000) < 0.3
    keys, seen, found = truncation._counted(hashes | events)
    by = pd.DataFrame({"h": hashes, "e": events}).groupby("h")["e"].agg(["size", "sum"])
    assert keys.tolist() == by.index.tolist() and seen.tolist() == by["size"].tolist() and found.tolist() == by["sum"].tolist()


def test_texts_are_shuffled_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = session.shuffled_once(spark.range(100).mapInPandas(look, "id long").repartition(4, "id"))
    assert df.where("id < 10").count() == 10 and sorted(x.id for x in df.collect()) == [*range(100)]
    assert seen.value == 100


def test_short_ways():
    r = random.Random(6)
    signs = ["a", "B", "0", " ", "\n", "\n\n", "\t", "\x0b", "\xa0", ".", "!", "。", "」", ")", "`", "```", "#", "//", "--", "é", "İ"]
    for _ in range(4000):
        text = "".join(r.choices(signs, k=r.randint(1, 14)))
        for kind in (0, 1):
            assert truncation._last_state(text, kind) == truncation._states(text, kind)[-1]
            stops = set(truncation._stops(kind, text))
            # where a cut can be, that is after a character that is no blank to ``_strip``
            assert all(truncation._stops_at(kind, text, n) == (n in stops) for n in range(1, len(text)) if text[n - 1] not in " \t\r\n\f")


def test_languages_of_many_texts_are_those_of_each():
    texts = ["x", "", "der Hund und die Katze sind nicht mit dem Mann", "漢字 and", "the end of it", "não é uma questão para os outros", "naïve²", "🙂 der"]
    assert truncation.languages(texts * 300) == [truncation.language(t) for t in texts] * 300
    assert truncation.languages(texts)[2:6] == ["de", "cjk", "en", "pt"]
