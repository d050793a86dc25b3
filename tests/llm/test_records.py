"""Operators on occurrences: hand-written source, truncation, personal data, sampling, splits."""

import random
from collections import Counter

import pytest

from lexiscope.llm import handwritten, pii, quota_sample, splits, truncation

WORDS = "lazy buffer cursor vault router shard widget digest index pool tracer lease modal ruler".split()


def code(r, n=7):
    return "\n".join(f"{r.choice(WORDS)}_{r.choice(WORDS)}({r.choice(WORDS)}, {r.randint(1, 999)});" for _ in range(n))


def test_hand_written(spark, make_occurrences):
    r = random.Random(1)
    copy = code(r)
    rows = [dict(repo_full_name=f"o{i}/p{i}", artifact_type="Code_Comment ", artifact_id=f"src/{WORDS[i]}/lib.c:{i}", body_text=f"// note {i}\n" + copy) for i in range(5)]
    rows += [dict(repo_full_name=f"f{i}/same", artifact_type="code_comment", artifact_id="src/fork.c:9", body_text=code(random.Random(9))) for i in range(5)]  # forks hold the same path
    own = [dict(repo_full_name=f"q{i}/w{i}", artifact_type="code_comment", artifact_id=f"src/own{i}.c:4", body_text=code(r)) for i in range(20)]
    one = lambda a, b: dict(repo_full_name="a/b", artifact_type="code_comment", artifact_id=a, body_text=b)
    bad = [one("third_party/x/a.c:1", code(r)), one("x/a.pb.go:1", code(r)), one("y/z.c:1", "// Code generated by t. DO NOT EDIT.\n" + code(r)), one("t.c:1", "0x01, 0x02, 0xff,\n" * 20), one("m.js:1", "var a={b:1,c:function(d){d.e(f)}};" * 12)]
    good = [one("vendor_portal/a.c:1", code(r)), one("s/minified_x.c:1", "// keep in sync with the minified build\n" + code(r)), one("p.c:1", 'call("' + "the cache is cold and nobody knows why it is so. " * 8 + '");'), one("e.c:1", ""), one("n.c:1", None)]
    odd = [dict(repo_full_name=None, artifact_type="code_comment", artifact_id="vendor/a.c:1", body_text="x"), dict(repo_full_name="a/b", artifact_type="code_comment", artifact_id=None, body_text="x"), dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id="vendor/x:1", body_text=copy)]
    df = make_occurrences(rows + own + bad + good + odd + bad)
    found = {(x.repo_full_name, x.artifact_id) for x in handwritten.found_records(df).collect()}
    assert found == {(x["repo_full_name"], x["artifact_id"]) for x in rows[:5] + bad}
    assert handwritten.hand_written(df).count() == df.count() - 5 - 2 * len(bad)
    assert handwritten.found_records(df.limit(0)).count() == 0


def test_copies_need_no_path_lists(spark, make_occurrences):
    r = random.Random(21)
    libs = [code(r, 9) for _ in range(12)]
    rows = [dict(repo_full_name=f"o{k}-{i}/p{k}{i}", artifact_type="code_comment", artifact_id=f"{WORDS[i]}/lib{k}.c:{i}", body_text=f"  // note {i}\n" + lib) for k, lib in enumerate(libs) for i in range(4)]
    own = [dict(repo_full_name=f"q{i}/w{i}", artifact_type="code_comment", artifact_id=f"vendor/own{i}.c:4", body_text=code(r, 9)) for i in range(30)]
    df = make_occurrences(rows + own + rows)
    got = {(x.repo_full_name, x.path) for x in handwritten.classify(df, ["copy"]).collect()}
    assert got == {(x["repo_full_name"], x["artifact_id"].rsplit(":", 1)[0]) for x in rows}
    assert handwritten.classify(df, ["copy", "text"]).count() == len(rows) and handwritten.classify(df).count() == len(rows) + len(own)
    assert sorted((x.path_class, x.copy, x.files) for x in handwritten.evidence_report(df).collect() if x.path_class) == [("vendored", False, 30)]


def test_winnowing_finds_shifted_copies():
    r = random.Random(2)
    text = code(r, 12)
    a, b = set(handwritten.winnow(text)), set(handwritten.winnow("  " + text.replace("\n", "\n\t")))
    assert a == b and handwritten.winnow(None) == [] == handwritten.winnow("a b")


def prose(r, n):
    return " ".join(f"the {r.choice(WORDS)} {r.choice(WORDS)} resets after midnight." for _ in range(n))


def test_truncation(spark, make_occurrences):
    r = random.Random(3)
    rows, cut = [], set()
    for i in range(900):
        t = prose(r, r.randint(4, 9))
        if i % 30 == 0:
            t = t[: -r.randint(3, 30)]  # inside the last sentence
            cut.add(str(i))
        rows.append(dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id=str(i), matched_expression="x", body_text=t))
    fence = [dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id="fence", matched_expression="x", body_text="so\n```\nx = 1;")]
    rows += [dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id=f"whole{k}", matched_expression="x", body_text=f"{prose(r, 3)}\n```\nx = {k};\ny = 2;\n```\n{prose(r, 2)}") for k in range(60)]
    odd = [dict(repo_full_name=None, artifact_type=None, artifact_id=f"odd{k}", matched_expression=None, body_text=b) for k, b in enumerate([None, "", " \n", "ok."])]
    df = make_occurrences(rows + rows[:3] + fence + odd)
    got = {x.artifact_id for x in truncation.detect(df).where("is_cut").collect()}
    assert "fence" in got and not {f"odd{k}" for k in range(4)} & got
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut - {"fence"}) <= 3
    rates = {x.source: x for x in truncation.cut_rates(truncation.detect(df)).collect()}
    assert rates["pr_body"].n_cut >= len(got) - 1
    assert truncation.detect(df.limit(0)).count() == 0


def test_length_spikes(spark, make_occurrences):
    r = random.Random(4)
    rows = [dict(artifact_type="Pr_Body", artifact_id=str(i), body_text="x" * r.randint(150, 600)) for i in range(600)] + [dict(artifact_type="pr_body", artifact_id=f"c{i}", body_text="y" * 300) for i in range(40)]
    assert [(x.source, x.n_chars) for x in truncation.length_spikes(make_occurrences(rows)).collect()] == [("pr_body", 300)]


BACKGROUND = [" ".join(f"the {w} {v} drops the {u} again." for w, v, u in zip(WORDS, WORDS[k:], WORDS[2 * k :])) for k in range(1, 6)]


@pytest.fixture(scope="module")
def tagger():
    rows = [("Ana Silva", "ana.silva@mail.example", None, b) for b in BACKGROUND * 8] + [("", "", "", ""), (None, None, None, None)]
    return pii.train(rows, steps=(250, 250, 500), inserted=5000)


def test_held_out_accuracy(tagger):
    held = pii.generated(700, BACKGROUND, pii.Words(), seed=99)
    spans = pii.find_spans([t for t, _ in held], tagger)
    right = missed = wrong = 0
    for (_, want), got in zip(held, spans):
        w, g = {k for *_, k in want}, {k for *_, k in got}
        right, missed, wrong = right + len(w & g), missed + len(w - g), wrong + len(g - w)
    assert right / (right + missed) > 0.8 and right / (right + wrong) > 0.8


def test_no_form_decides():
    """A tagger that labels every character finds something in any stretch: nothing behind it rejects a span."""

    class Everything:
        def decode(self, codes, bias=None):
            return (codes != 0).astype("int8")

    assert pii.find_spans(["The Leandro Gateway is fine.", "nothing here"], Everything())[0]


def test_masking_keeps_the_rest(tagger):
    text = "the lazy cursor drops. Mail ana.silva@mail.example if it breaks.\nthe vault drops the cursor again."
    spans = pii.find_spans([text, "", "x" * 100_000], tagger)
    assert pii.mask(text, spans[0]) == text.replace("ana.silva@mail.example", "[EMAIL]")
    assert spans[1] == spans[2] == [] and pii.mask(None, []) is None


def test_long_texts_are_read_whole(tagger):
    text = "the lazy buffer resets. " * 4000 + "\nMail ana.silva@mail.example if it breaks.\n" + "for x in y(1):\n" * 3000
    assert [k for *_, k in pii.find_spans([text], tagger)[0]] == ["email"]


def test_signs_cover_generated_values():
    """Every type of value lies whole in the stretches that the tagger reads, in at least 97 of 100 cases."""
    r, w = random.Random(4), pii.Words()
    for kind, make in pii.VALUES.items():
        whole = 0
        for _ in range(600):
            value = make(r, w)
            read = {k for s, e in pii.windows_of(f"the slow cache of {value} is not") for k in range(s, e)}
            whole += set(range(18, 18 + len(value))) <= read
        assert whole >= 0.97 * 600, (kind, whole)


def test_windows_cover_stretches():
    text = "Ana Silva, Bruno Costa, " * 40
    covered = set()
    for s, e in pii.windows_of(text):
        assert e - s <= pii.MAX_WINDOW
        covered |= set(range(s, e))
    for s, e in pii.stretches(text):
        assert set(range(s, e)) <= covered


def test_spans_grow_to_words_and_join():
    own = {k: (9, v) for k, v in [(1, 9), (2, 10), (3, 10), (5, 9), (6, 10)]}
    assert pii._spans("(Ana Sil) x", own) == [(1, 8, "person_name")]


def test_found_types(spark, make_occurrences, tagger):
    rows = [
        dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id="1", matched_expression="x", body_text="the cursor drops. Mail ana.silva@mail.example if it breaks. the vault drops. Mail ana.silva@mail.example if it breaks."),
        dict(repo_full_name="a/b", artifact_type="commit_message", artifact_id="2", matched_expression="x", body_text=None, author_name="Ana Silva <ana.silva@mail.example>"),
        dict(repo_full_name=None, artifact_type=None, artifact_id="3", matched_expression=None, body_text="", author_name="Ana Silva"),
    ]
    df = make_occurrences(rows + rows)
    got = {(x.artifact_id, x.field_name, x.pii_type) for x in pii.found_types(df, tagger, ["repo_full_name", "artifact_type", "artifact_id", "matched_expression"]).collect()}
    assert got == {("1", "body_text", "email"), ("2", "author_name", "email")}
    masked = {x.artifact_id: x for x in pii.masked_table(df, tagger).collect()}
    assert masked["2"].author_name == "Ana Silva <[EMAIL]>" and masked["2"].body_text is None and masked["3"].author_name == "Ana Silva" and masked["1"].n == "extra"
    assert pii.found_types(df.limit(0), tagger, ["artifact_id"]).count() == 0


def test_fit_is_remembered(spark, make_occurrences, monkeypatch):
    calls = []
    monkeypatch.setattr(pii, "_train_in_task", lambda sample: calls.append(1) or pii.Tagger(len(pii.LABELS)).to_bytes())
    df = make_occurrences([dict(artifact_id=str(k), body_text=b) for k, b in enumerate(BACKGROUND)])
    a, b = pii.fit(df), pii.fit(df)
    assert len(calls) == 1 and (a.w["E"] == b.w["E"]).all() and pii.fit(df.limit(0)) is not None


def test_crf_gradient():
    import numpy as np

    from lexiscope.llm.tagger import Tagger, pad

    r = np.random.default_rng(0)
    t = Tagger(5, embed=6, hidden=4)
    t.w["T"] = r.standard_normal((5, 5)).astype(np.float32)
    codes = pad([r.integers(1, 90, 7).astype(np.int32), r.integers(1, 90, 4).astype(np.int32)])
    gold = pad([r.integers(0, 5, 7), r.integers(0, 5, 4)]).astype(np.int64)
    e = r.standard_normal((7, 2, 5)).astype(np.float64)
    live = codes != 0

    def loss(e):
        total = 0.0
        for b in range(2):
            n = int(live[:, b].sum())
            a = e[0, b].copy()
            for k in range(1, n):
                a = np.log(np.exp(a[:, None] + t.w["T"]).sum(0)) + e[k, b]
            path = sum(e[k, b, gold[k, b]] for k in range(n)) + sum(t.w["T"][gold[k, b], gold[k + 1, b]] for k in range(n - 1))
            total += np.log(np.exp(a).sum()) - path
        return total / 2

    d_e, _ = t._crf(e.astype(np.float32), gold, live)
    for at in [(0, 0, 1), (3, 1, 2), (6, 0, 4), (2, 0, 0)]:
        up, down = e.copy(), e.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - d_e[at]) < 1e-3


def sampling_rows(r, n=4000):
    return [dict(repo_full_name=f"o/{i % 50}", artifact_type=r.choice(["pr_body", "PR_BODY ", "commit_message", None]), artifact_id=str(i), matched_expression=r.choice(["temp fix"] * 6 + ["Ugly Hack", "stopgap", None])) for i in range(n)]


def test_quota_sample(spark, make_occurrences, monkeypatch):
    monkeypatch.setattr(quota_sample, "BUCKET_UNITS", 300)
    monkeypatch.setattr(quota_sample, "FAN_IN", 3)
    rows = sampling_rows(random.Random(8))
    df = make_occurrences(rows + rows[:200])
    targets = spark.createDataFrame([("pr_body", "temp fix", 0.5, 0), ("pr_body", "ugly hack", 0.125, 3), ("commit_message", "stopgap", 0.25, 0), ("commit_message", "temp fix", 0.125, 700), ("pr_body", "absent", 0.0, 1), ("pr_body", "stopgap", None, None)], "artifact_type string, matched_expression string, target_share double, min_rows int")
    sample, report = quota_sample.draw(df, targets)
    keys = {(x["repo_full_name"], (x["artifact_type"] or "").strip().lower() or None, x["artifact_id"], (x["matched_expression"] or "").lower() or None) for x in rows}
    size, have = len(keys) // 10, Counter((k[1], k[3]) for k in keys)
    for x in report.collect():
        n = have[x.artifact_type, x.matched_expression]
        want = max(x.min_rows, -int(-x.target_share * size // 1))
        assert (x.available, x.wanted, x.drawn, x.is_met) == (n, want, min(n, want), n >= want)
    drawn = [tuple(x) for x in sample.collect()]
    assert len(drawn) == len(set(drawn)) and set(drawn) <= keys
    assert sorted(drawn, key=str) == sorted((tuple(x) for x in quota_sample.draw(df, targets)[0].collect()), key=str)
    empty_sample, empty_report = quota_sample.draw(df.limit(0), targets)
    assert empty_sample.count() == 0 and empty_report.count() == 6 and quota_sample.draw(df, targets.limit(0))[0].count() == 0


def test_flight_keeps_sums_and_probabilities():
    import numpy as np

    r = np.random.default_rng(0)
    pi, cat = np.full(60, 0.3), np.array([0, 1, 2] * 20)
    hits = np.zeros(60)
    for _ in range(600):
        out = quota_sample.fly(pi, cat, r)
        assert all(abs(out[cat == c].sum() - 6) < 1e-6 for c in range(3))
        assert all(((out > 0) & (out < 1))[cat == c].sum() <= 1 for c in range(3))
        hits += out
    assert abs(hits / 600 - 0.3).max() < 0.1


REPOS = "repo_full_name string, html_url string, clone_url string, name string"


def test_same_repository_and_splits(spark, make_occurrences):
    names = ["acme/tool", " ACME/tool", "acme%2Ftool", "https://forge.example/acme/tool/tree/main", "git@forge.example:acme/tool.git", "acme / tool", "forge.example/acme/tool.git", "acme/tool/", "old/tool", "older/tool", "acme/tool.js", "acme-fork1/tool", "url/new", "url/old", None, ""]
    rows = [dict(repo_full_name=n, artifact_type="pr_body", artifact_id=str(i)) for i, n in enumerate(names)]
    rows[13]["url"] = "https://forge.example/url/new/pull/3"
    rows += [dict(repo_full_name=f"many/{i}", artifact_type="commit_message", artifact_id="x") for i in range(200)] + [dict(repo_full_name="many/0", artifact_type="commit_message", artifact_id=str(i)) for i in range(60)]
    df = make_occurrences(rows)
    repos = spark.createDataFrame([("old/tool", "https://forge.example/acme/tool", None, "n"), ("older/tool", None, "https://forge.example/old/tool.git", "n"), ("acme-fork1/tool", "https://forge.example/acme-fork1/tool", None, "n"), (None, None, None, None)], REPOS)
    pairs = {(x.repo_a, x.repo_b) for x in splits.same_repository(df, repos).collect()}
    group = names[:10]
    want = {(a, b) for a in group for b in group if a.encode() < b.encode()} | {("url/new", "url/old")}
    assert pairs == want
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    out = splits.split_records(df, repos, shares).collect()
    assert len(out) == len(rows)
    of = {}
    for x in out:
        of.setdefault(x.repository, set()).add(x.split_name)
    assert all(len(v) == 1 for v in of.values()) and len({x.split_name for x in out if x.repo_full_name in group}) == 1
    share = sum(x.split_name == "train" for x in out) / len(out)
    assert abs(share - 0.8) < 0.02
    assert splits.same_repository(df.limit(0), repos).count() == 0 and splits.assign(df.limit(0), repos, shares).count() == 0 and splits.assign(df, repos, shares.limit(0)).count() == 0


def test_components_against_union_find(spark):
    r = random.Random(11)
    edges = {tuple(sorted((f"n{r.randint(0, 90):02d}", f"n{r.randint(0, 90):02d}"))) for _ in range(70)} | {(f"n{i:03d}x", f"n{i + 1:03d}x") for i in range(40)}
    edges = {e for e in edges if e[0] != e[1]}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.name: x.root for x in splits.components(spark.createDataFrame(sorted(edges), "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_flow_meets_quotas():
    import numpy as np

    rows = np.array([[500.0, 0], [90, 0], [0, 10], [0, 1]])
    flow = splits.Flow(rows, np.array([1, 3, 20, 330]), np.array([0.8, 0.1, 0.1]))
    assert flow.x.min() >= 0 and flow.x.sum(1).tolist() == [1, 3, 20, 330]
    got = flow.x.T @ rows.sum(1)
    assert got.sum() == 1300 and all(abs(g - 1300 * s) <= 10 for g, s in zip(got, (0.8, 0.1, 0.1)))


def test_flow_against_every_assignment():
    """On small cases: no split is off by more than the largest component, and the best of all assignments is met in most."""
    import itertools

    import numpy as np

    r, best_of = np.random.default_rng(3), 0
    share = np.array([0.6, 0.25, 0.15])
    for _ in range(40):
        rows = r.integers(0, 30, (7, 2)).astype(float)
        flow = splits.Flow(rows, np.ones(7, int), share)
        v = np.column_stack([rows.sum(1), rows])
        want = share[:, None] * v.sum(0)
        w = np.array([1.0, splits.LABEL_WEIGHT, splits.LABEL_WEIGHT])
        least = min(float((w * (np.array([v[[i for i, k in enumerate(c) if k == j]].sum(0) for j in range(3)]) - want) ** 2).sum()) for c in itertools.product(range(3), repeat=7))
        assert abs(flow.cost() - float((w * (flow.x.T @ v - want) ** 2).sum())) < 1e-6
        assert np.abs(flow.dev).max() <= v[:, 0].max()
        best_of += flow.cost() <= least + 1e-6
    assert best_of >= 20


def test_labels_keep_their_shares(spark, make_occurrences):
    r = random.Random(6)
    rows = [dict(repo_full_name=f"o/{i}", artifact_type=t, artifact_id=str(k)) for i in range(400) for t in r.sample(["pr_body", "commit_message", "code_comment"], 2) for k in range(r.choice([1, 1, 2, 5]))]
    shares = spark.createDataFrame([("train", 0.7), ("test", 0.3)], "split_name string, target_share double")
    repos = spark.createDataFrame([], REPOS)
    for x in splits.label_shares(make_occurrences(rows), repos, shares).collect():
        assert abs(x.share - {"train": 0.7, "test": 0.3}[x.split_name]) < 0.02


def test_caps_are_errors(spark, make_occurrences, monkeypatch):
    df = make_occurrences([dict(repo_full_name="a/b", artifact_type="pr_body", artifact_id="1")])
    repos = spark.createDataFrame([], REPOS)
    monkeypatch.setattr(splits, "MAX_SPLITS", 1)
    with pytest.raises(ValueError):
        splits.assign(df, repos, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "split_name string, target_share double"))
    monkeypatch.setattr(splits, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        splits.components(spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "a string, b string"))
