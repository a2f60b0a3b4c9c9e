"""Items by hashes and near-equal snippets against the sequential rule."""

import hashlib
import random
from difflib import SequenceMatcher

from provena import plans
from provena.operators import dedupe

SF = "/root/testdata/sf0.001"


def _kept(rows, n_keys):
    """The sequential rule over (run, seq, *keys, snippet)."""
    out = set()
    for run in {r[0] for r in rows}:
        kept = []
        for r in sorted(x for x in rows if x[0] == run):
            keys, snippet = r[2 : 2 + n_keys], r[-1]
            if any(k is not None and k == q[2 + i] for q in kept for i, k in enumerate(keys)):
                continue
            if any(snippet and q[-1] and (snippet == q[-1] or SequenceMatcher(None, snippet, q[-1]).ratio() >= 0.92) for q in kept):
                continue
            kept.append(r)
            out.add(r[:2])
    return out


def _changed(rng, t):
    t = list(t)
    for _ in range(rng.randrange(1, 1 + max(1, len(t) // 20))):
        i = rng.randrange(len(t))
        if rng.random() < 0.5:
            t[i] = rng.choice("abcdefgh ")
        else:
            t[i : i + rng.randrange(2)] = rng.choice("abcdefgh ")
    return "".join(t)


def test_items_are_those_of_the_sequential_rule(spark):
    rng = random.Random(11)
    rows = []
    for run in range(6):
        texts = ["".join(rng.choice("abcdefgh      ") for _ in range(rng.choice([6, 7, 9, 14, 30, 60, 150, 260]))) for _ in range(10)]
        for i in range(90):
            texts.append(_changed(rng, rng.choice(texts)))  # chains of changes of changes
            rows.append((run, i, None if rng.random() < 0.2 else rng.randrange(70), rng.randrange(80), rng.choice([None, "", texts[-1], texts[-1], rng.choice(texts)])))
    d = spark.createDataFrame(rows, "run_id long, id long, a long, b long, snippet string")
    got = {(r["run_id"], r["id"]) for r in dedupe.items(d, ["run_id"], ["a", "b"], "id", "snippet").collect()}
    want = _kept(rows, 2)
    assert got == want and 100 < len(want) < 500
    assert dedupe.items(d.limit(0), ["run_id"], ["a", "b"], "id", "snippet").count() == 0


def test_like_finds_every_near_pair(spark):
    rng = random.Random(2)
    texts = ["", "ab", "abcdef", "abcdefg", "abcdeg"]
    for n in (6, 8, 13, 25, 26, 40, 90, 199, 200, 210, 400):
        base = "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))
        texts += [base, *(_changed(rng, base) for _ in range(8))]
        texts += ["".join(c if i % 13 else "#" for i, c in enumerate(base)), "".join(c + ("+" if i % 12 == 0 else "") for i, c in enumerate(base))]  # changes spread as evenly as they can be
    texts = sorted(set(texts))
    d = spark.createDataFrame([(1, f"n{i:03}", t) for i, t in enumerate(texts)], "run long, name string, text string")
    got = {(r["name"], r["kept"]) for r in dedupe.like(d, ["run"], "name", "text").collect()}
    want = {(f"n{i:03}", f"n{j:03}") for i, x in enumerate(texts) for j, y in enumerate(texts) if i != j and x and y and SequenceMatcher(None, x, y).ratio() >= 0.92}
    assert got == want and len(want) > 100


def test_chain_of_like_snippets(spark):
    """Each is near its neighbours alone, so that every second stays."""
    rng = random.Random(1)
    rows, t = [], [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)]
    for i in range(20):
        t[5 * i : 5 * i + 5] = "#####"
        rows.append((1, i, "".join(t)))
    want = _kept(rows, 0)
    assert want == {(1, i) for i in range(0, 20, 2)}
    got = dedupe.items(spark.createDataFrame(rows, "run_id long, id long, snippet string"), ["run_id"], [], "id", "snippet").collect()
    assert {(r["run_id"], r["id"]) for r in got} == want


def test_rows_much_alike_meet_those_that_stay_alone(spark, monkeypatch):
    """Their pairs are never listed: 400 rows of one template leave a few."""

    def listed(*_):
        raise AssertionError("all pairs of rows much alike")

    monkeypatch.setattr(dedupe, "like", listed)
    rows = [(run, i, i // 3, f"Part BQ{i * 7654321 % 9999991}A is superseded by TX{i * 3333337 % 9999973}B. Delivery 14 days, 5% discount") for run in range(2) for i in range(400)]
    got = {(r["run_id"], r["id"]) for r in dedupe.items(spark.createDataFrame(rows, "run_id long, id long, a long, snippet string"), ["run_id"], ["a"], "id", "snippet").collect()}
    want = _kept(rows, 1)
    assert got == want and 10 < len(want) < 400


def test_blocks_settle_rows_in_their_order(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BLOCK", 7)
    rng = random.Random(5)
    rows = []
    for run in range(4):
        texts = ["".join(rng.choice("abcdefgh      ") for _ in range(rng.choice([9, 30, 60, 220]))) for _ in range(3)]
        for i in range(60):
            texts.append(_changed(rng, rng.choice(texts)))
            rows.append((run, i, None if rng.random() < 0.3 else rng.randrange(50), rng.choice([None, "", texts[-1], rng.choice(texts)])))
    for share in (0.1, 1.1):  # blocks to the end, or pairs and rounds after the first block
        monkeypatch.setattr(dedupe, "SHARE", share)
        got = {(r["run_id"], r["id"]) for r in dedupe.items(spark.createDataFrame(rows, "run_id long, id long, a long, snippet string"), ["run_id"], ["a"], "id", "snippet").collect()}
        assert got == _kept(rows, 1)
    # Of rows equal in seq all are first at once, wherever a block ends.
    same = [(1, i // 5, 1, f"row {i} " + "abcdefghij"[i] * 30) for i in range(10)]
    got = dedupe.items(spark.createDataFrame(same, "run_id long, id long, a long, snippet string"), ["run_id"], ["a"], "id", "snippet").collect()
    assert sorted(r["snippet"] for r in got) == [r[3] for r in same[:5]]


def test_turns_of_conversations(spark):
    plans.load()
    rows = [(r["conv_id"], r["turn"], r["text"], (r["text"] or "").split("\n")[0].split(".")[0]) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = {(r["conv_id"], r["turn"]) for r in plans.QUERIES["dedupe_turns"](spark, SF).collect()}
    assert got == _kept(rows, 1)


def test_near_texts_of_conversations(spark):
    plans.load()
    texts = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        texts.setdefault(r["conv_id"], set()).add((r["text"] or "").split("\n")[0].split(".")[0])
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = {(c, md5(a), md5(b)) for c, ts in texts.items() for a in ts for b in ts if a and b and a != b and SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert {tuple(r) for r in plans.QUERIES["near_texts"](spark, SF).collect()} == want
