import random

from lexiscope.llm import consensus as C

WIDE = "item_id string, voto__a boolean, voto__b boolean, voto__c boolean, gold_is_ubw boolean, label string, p string"
LONG = "item_id string, annotator_id string, is_ubw boolean, vote string, total string"


def test_recovers_truth_and_reliability(spark):
    r = random.Random(3)
    truth = {f"i{k}": r.random() < 0.7 for k in range(500)}
    sens = {"good": (0.95, 0.95), "random": (0.5, 0.5), "yes": (0.98, 0.03), "inverted": (0.1, 0.1), "fair": (0.8, 0.8)}
    vote = lambda t, a: r.random() < (sens[a][0] if t else 1 - sens[a][1])
    wide = [(i, vote(t, "good"), vote(t, "fair"), vote(t, "good"), t if k % 20 else not t, "l", "p") for k, (i, t) in enumerate(truth.items())]
    long = [(i, a, vote(t, a), "v", "t") for i, t in truth.items() for a in ("random", "yes", "inverted", "fair") if r.random() < 0.8]
    long += long[:50] + [("i1", None, True, "v", "t"), (None, "yes", True, "v", "t"), ("i2", "random", None, "v", "t"), ("alone", "nobody", None, "v", "t")]
    w, n = spark.createDataFrame(wide, WIDE), spark.createDataFrame(long, LONG)
    m = C.pass_messages(C.vote_edges(w, n))
    labels = {x.item_id: x for x in C.item_labels(m).collect()}
    right = sum(labels[i].label == t for i, t in truth.items())
    assert right >= 0.96 * len(truth) and "alone" not in labels and all(0 <= x.agreement <= 1 for x in labels.values())
    by = {x.annotator: x.informedness for x in C.annotator_reliability(m).collect()}
    assert by["a"] > by["b"] > by["random"] and by["inverted"] < -0.5 and abs(by["yes"]) < 0.2
    wrong = {x.item_id for x in C.wrong_gold(w, C.item_labels(m)).collect()}
    flipped = {f"i{k}" for k in range(0, 500, 20)}
    assert len(wrong & flipped) >= 0.9 * len(flipped) and len(wrong - flipped) <= 0.05 * len(truth)


def test_empty_and_ties(spark):
    w, n = spark.createDataFrame([], WIDE), spark.createDataFrame([], LONG)
    m = C.pass_messages(C.vote_edges(w, n))
    assert C.item_labels(m).count() == 0 and C.annotator_reliability(m).count() == 0 and C.wrong_gold(w, C.item_labels(m)).count() == 0
    w = spark.createDataFrame([("x", None, None, None, True, "l", "p"), ("y", True, True, None, None, "l", "p")], WIDE)
    labels = C.item_labels(C.pass_messages(C.vote_edges(w, n)))
    assert [x.item_id for x in labels.collect()] == ["y"] and C.wrong_gold(w, labels).count() == 0


def by_hand(votes, rounds):
    """The same messages over lists: votes are (item, annotator, vote)."""
    from math import exp, log

    own = {}
    for i, a, v in votes:
        own.setdefault(i, []).append(v)
    p = [1 / (1 + exp(-C.START_SLOPE * ((sum(own[i]) - v + 0.5) / len(own[i]) - 0.5))) for i, a, v in votes]
    for _ in range(rounds):
        share = sum(p) / len(p)
        llr = []
        for k, (_, a, v) in enumerate(votes):
            rest = [(p[m], x[2]) for m, x in enumerate(votes) if x[1] == a and m != k]
            sens = (sum(q for q, x in rest if x) + C.PRIOR_RIGHT) / (sum(q for q, _ in rest) + C.PRIOR_RIGHT + C.PRIOR_WRONG)
            alarm = (sum(1 - q for q, x in rest if x) + C.PRIOR_WRONG) / (sum(1 - q for q, _ in rest) + C.PRIOR_RIGHT + C.PRIOR_WRONG)
            llr.append(log(sens / alarm) if v else log((1 - sens) / (1 - alarm)))
        total = {i: log(share / (1 - share)) + sum(x for x, w in zip(llr, votes) if w[0] == i) for i in own}
        p = [1 / (1 + exp(-(total[i] - x))) for x, (i, _, _) in zip(llr, votes)]
    return {i: 1 / (1 + exp(-t)) for i, t in total.items()}


def test_messages_against_lists(spark, monkeypatch):
    r = random.Random(8)
    votes = sorted({(f"i{r.randint(0, 30)}", f"a{r.randint(0, 5)}", r.random() < 0.6) for _ in range(120)})
    monkeypatch.setattr(C, "MAX_ROUNDS", 3)
    monkeypatch.setattr(C, "TOLERANCE", 0.0)
    got = {x.item_id: x for x in C.item_labels(C.pass_messages(spark.createDataFrame(votes, "item_id string, annotator string, vote boolean"))).collect()}
    want = by_hand(votes, 3)
    assert got.keys() == want.keys() and all(abs(got[i].probability - want[i]) < 1e-9 for i in want)
    assert not any(x.converged for x in got.values())  # rounds that end early are told
