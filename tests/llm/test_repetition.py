import random

from lexiscope.llm import repetition as R

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def brute(words, window=R.WINDOW):
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - window + 1):
        key = tuple(words[i : i + window])
        if key in seen:
            covered[i : i + window] = [True] * window
        seen.add(key)
    return covered


def test_mask_against_brute_force():
    import numpy as np

    r = random.Random(5)
    for n in (0, 3, 6, 7, 40, 300):
        words = [r.choice("abc") for _ in range(n)]
        codes = np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)
        assert R._repeated_mask(codes, gap=0).tolist() == brute(words)


def test_shares():
    r = random.Random(6)
    base = [sentence(r) for _ in range(6)]
    assert R.measure(" ".join(base))[1] == 0
    assert 0.45 < R.measure(" ".join(base + base))[1] <= 0.5
    changed = [s.replace(s.split()[6], "other", 1) for s in base]
    assert R.measure(" ".join(base + changed))[1] > 0.4  # a light change does not make a repeat new
    assert R.measure(" ".join([*base, base[0]]))[1] < 0.2
    zh = "校验和在模块之前丢失，需要检查传感器的配置。"
    assert R.measure(zh * 4)[1] > 0.6
    assert R.measure(None) == R.measure("") == R.measure(" \n ") == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert R.measure("x " * 200_000)[1] > 0.9


def test_ledger_and_policies(spark):
    r = random.Random(7)
    s = [sentence(r) for _ in range(5)]
    rows = [(1, " ".join(s)), (2, " ".join(s * 3)), (3, None), (4, ""), (4, "\n\n".join(s * 2))]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id bigint, text string, words string, mask int")
    book = R.ledger(df)
    assert book.count() == 5
    assert sorted(x.doc_id for x in R.rejected(book).collect()) == [2, 4]
    ab = {(x.policy, x.version, x.without): x.n_rejected for x in R.ablations(book).collect()}
    assert ab["two_fifths", 1, None] == 2 and ab["two_fifths", 1, "repeated_words"] == 0
    assert ab["strict", 2, None] >= ab["strict", 1, None] >= 2
    assert R.ledger(df.limit(0)).count() == 0


def brute_share(text):
    """Share of words in a window of six that stood earlier, gaps of up to three between two such stretches included."""
    words = R.WORD.findall(R.DIGITS.sub("0", text.lower()))
    covered = [False] * len(words)
    for i in range(len(words) - 5):
        if any(words[j : j + 6] == words[i : i + 6] for j in range(i)):
            covered[i : i + 6] = [True] * 6
    marks = [i for i, c in enumerate(covered) if c]
    for a, b in zip(marks, marks[1:]):
        if 1 < b - a <= 4:
            covered[a:b] = [True] * (b - a)
    return sum(covered) / len(words) if words else 0.0


def test_share_against_every_pair():
    r = random.Random(12)
    for _ in range(60):
        parts = [" ".join(r.choice("a b c d e".split()) for _ in range(r.randint(3, 12))) for _ in range(4)]
        text = ". ".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert abs(R.measure(text)[1] - brute_share(text)) < 1e-9


def test_ledger_is_stored_once(spark, monkeypatch):
    calls = []
    real = R.ledger
    monkeypatch.setattr(R, "ledger", lambda *a: calls.append(1) or real(*a))
    docs = spark.createDataFrame([(1, "so it is " * 30), (2, None), (3, "")], "doc_id bigint, text string")
    books = [R.stored_ledger(docs) for _ in range(2)]
    assert len(calls) == 1 and sorted(map(tuple, books[0].collect())) == sorted(map(tuple, books[1].collect())) == sorted(map(tuple, real(docs).collect()))
    R.stored_ledger(docs.where("doc_id > 1"))
    assert len(calls) == 2
