"""Proofs, limits, ingestion and retrieval against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from provena.operators import graph, integrity, limits


def _mth(leaves):
    if len(leaves) == 1:
        return hashlib.sha256(b"\x00" + leaves[0]).digest()
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + _mth(leaves[:k]) + _mth(leaves[k:])).digest()


def _proof(m, leaves, whole=True):
    """The nodes that the definition of a consistency proof names."""
    n = len(leaves)
    if m == n:
        return [] if whole else [_mth(leaves)]
    k = 1
    while k * 2 < n:
        k *= 2
    if m <= k:
        return [*_proof(m, leaves[:k], whole), _mth(leaves[k:])]
    return [*_proof(m - k, leaves[k:], False), _mth(leaves[:k])]


def test_consistency_proofs(spark):
    trees = {n: [f"d{n}-{i}" for i in range(n)] for n in (1, 2, 3, 5, 7, 8, 13, 16)}
    rows = spark.createDataFrame([(n, i, d) for n, ds in trees.items() for i, d in enumerate(ds)], "run_id long, seq long, digest string")
    sizes = spark.createDataFrame([(n, m) for n in trees for m in range(0, n + 2)], "run_id long, first long")
    got = integrity.consistency_proofs(rows, ["run_id"], "digest", sizes).collect()
    assert len(got) == sum(trees)
    for r in got:
        leaves = [d.encode() for d in trees[r["run_id"]]]
        assert [x["hash"] for x in r["path"]] == [h.hex() for h in _proof(r["first"], leaves)], (r["run_id"], r["first"])
    roots = [(n, m, _mth([d.encode() for d in ds[:m]]).hex(), _mth([d.encode() for d in ds]).hex()) for n, ds in trees.items() for m in range(1, n + 1)]
    table = spark.createDataFrame([(r["run_id"], r["first"], r["size"], r["path"]) for r in got], "run_id long, first long, size long, path array<struct<side:string,hash:string>>").join(spark.createDataFrame(roots, "run_id long, first long, early string, root string"), ["run_id", "first"])
    ok = lambda early, root: integrity.consistent(F.col("first"), F.col("size"), early, root, F.col("path"))
    fake = F.sha2(F.lit(b"x"), 256)
    for r in table.select(ok(F.col("early"), F.col("root")).alias("a"), ok(fake, F.col("root")).alias("b"), ok(F.col("early"), fake).alias("c")).collect():
        assert (r["a"], r["b"], r["c"]) == (True, False, False)


def test_token_buckets(spark):
    rng = random.Random(3)
    calls = [(k, rng.randrange(0, 900) / 2, i) for k in range(3) for i in range(300 if k == 1 else 20)]
    want = {}
    for k in range(3):
        tokens, last = 5.0, None
        for _, t, i in sorted((x for x in calls if x[0] == k), key=lambda x: x[1:]):
            last = t if last is None else last
            now = max(t, last)
            tokens = min(5.0, tokens + (now - last) * (5 / 60))
            wait = 0.0 if tokens >= 1 else (1 - tokens) / (5 / 60)
            tokens, last = max(0.0, tokens - 1), now + wait
            want[k, i] = now + wait - t
    got = {(r["key"], r["seq"]): r["wait"] for r in limits.buckets(spark.createDataFrame(calls, "key long, at double, seq long"), ["key"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_ingested_edges_close(spark):
    rows = [(1, "AB12C is superseded by CD34E."), (2, "AB12C cross-references ZZ99. Also AB12C is superseded by CD34E."), (3, "Now AB12C is superseded by EF56G."), (4, "AB12C is superseded by CD34E again."), (5, None), (6, "Nothing here.")]
    got = sorted((r["seq"], r["rel"], r["dst"], r["valid_to"]) for r in graph.ingest(spark.createDataFrame(rows, "id long, text string")).collect())
    assert got == [(1, "SUPERSEDED_BY", "part:cd34e", 3), (2, "CROSS_REFERENCE", "part:zz99", None), (2, "SUPERSEDED_BY", "part:cd34e", 3), (3, "SUPERSEDED_BY", "part:ef56g", 4), (4, "SUPERSEDED_BY", "part:cd34e", None)]


def _ranks(edges, seeds, rounds=30):
    out, nodes = {}, set(seeds)
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
        nodes |= {s, d}
    r = {n: (1 / len(seeds) if n in seeds else 0.0) for n in nodes}
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 0.0)
        for n in nodes:
            total = sum(w for _, w in out.get(n, []))
            for d, w in out.get(n, []):
                new[d] += 0.85 * r[n] * w / total
            if not total:
                for s in seeds:
                    new[s] += 0.85 * r[n] / len(seeds)
        for s in seeds:
            new[s] += 0.15 / len(seeds)
        r = new
    return r


def test_graph_retrieval(spark):
    rng = random.Random(6)
    names = [f"part:x{i}y" for i in range(10, 35)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice([0.5, 0.7, 0.9])) for _ in range(60)]
    edges = list({(s, d): (s, d, w) for s, d, w in edges if s != d}.values())
    d = spark.createDataFrame([(*e, "CROSS_REFERENCE", 0.85, None) for e in edges], "src string, dst string, confidence double, rel string, reliability double, valid_to string")
    seeds = [edges[0][0], edges[5][0]]
    query = f"replace {seeds[0][5:].upper()} and {seeds[1][5:]} or Q9Q9"
    asked = spark.createDataFrame([(1, query), (2, "no part here")], "query_id int, text string")
    got = sorted(graph.retrieve(d, asked).collect(), key=lambda r: (-r["score"], r["id"]))
    want = _ranks([(s, t, w * 0.85) for s, t, w in edges], sorted(set(seeds)))
    best = sorted(((-v, n) for n, v in want.items() if n not in seeds and v > 0))[:5]
    assert [(r["id"], r["score"]) for r in got] == [(n, round(-v, 6)) for v, n in best]
    near = {s: 0 for s in seeds}
    for depth in (1, 2, 3):
        near |= {t: depth for s, t, _ in edges if near.get(s) == depth - 1 and t not in near}
    assert all(r["depth"] == near.get(r["id"], 0) and (r["path"] == "") == (r["id"] not in near) for r in got)
    assert {r["query_id"] for r in got} == {1}


def test_recall_of_multi_hop_substitutes(spark):
    """Ten questions whose answers are two hops away, among edges to unrelated parts: at least nine of ten in the best five."""
    rows, answers = [], {}
    for q in range(10):
        seed, mid, answer = f"part:s{q}a1", f"part:m{q}b2", f"part:t{q}c3"
        rows += [(seed, mid, 0.9), (mid, answer, 0.9), (seed, f"part:u{q}d4", 0.2), (f"part:v{q}e5", seed, 0.9)]
        answers[f"s{q}a1"] = answer
    d = spark.createDataFrame([(*e, "CROSS_REFERENCE", 0.85, None) for e in rows], "src string, dst string, confidence double, rel string, reliability double, valid_to string")
    asked = spark.createDataFrame([(q, f"substitute for {q}") for q in answers], "query_id string, text string")
    found = sum(answers[r["query_id"]] == r["id"] for r in graph.retrieve(d, asked).collect())
    assert found >= 9


def test_lexical_rank_is_difflib(spark):
    from difflib import SequenceMatcher

    from provena import plans

    plans.load()
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES["lexical_rank"](spark, sf).collect()
    ids = [r["id"] for r in plans.records._named_edges(spark, sf).select(F.col("src").alias("id")).distinct().collect()]
    want = sorted((-SequenceMatcher(None, "replacement for bq1 or bq2", i).ratio(), i) for i in ids)[:5]
    assert [(r["id"], round(r["score"], 9)) for r in got] == [(i, round(-s, 9)) for s, i in want]


def test_versions_in_blocks(spark):
    import datetime

    from provena.operators import temporal

    rng = random.Random(1)
    t = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=d)
    rows = [(k, i, t(rng.randrange(60))) for k in ("a", "b") for i in range(70)] + [("c", 0, None), ("c", 1, t(1))]
    d = spark.createDataFrame(rows, "key string, seq long, event_ts timestamp")
    want = {(k, i): next((u for kk, j, u in rows if kk == k and j > i and ts is not None and u is not None and u > ts), None) for k, i, ts in rows}
    assert {(r["key"], r["seq"]): r["valid_to"] for r in temporal.versions(d, ["key"], block=8).collect()} == want


def test_nearest_in_blocks(spark):
    import numpy as np

    from provena.operators import nearest

    v = np.random.default_rng(0).integers(0, 4, (60, 3)).astype(float)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["rank"]): r["near_id"] for r in nearest.exact(d, d.where("vec_id % 7 = 0"), 3, block=8).collect()}
    for q in range(0, 60, 7):
        best = sorted((float(np.sqrt(((v[i] - v[q]) ** 2).sum())), i) for i in range(60) if i != q)[:3]
        assert [got[q, r] for r in (1, 2, 3)] == [i for _, i in best]


def test_cards_without_a_head(spark, tmp_path):
    from provena.sources import cards

    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "SKILL.md").write_text("# Title\n\nDoes a thing.\n\n## examples\nOne.\n")
    r = cards.read(spark, str(tmp_path)).first()
    assert (r["name"], r["description"], r["keywords"], r["examples"]) == ("plain", "Does a thing.", [], "One.") and r["instructions"].startswith("# Title")


def test_cards_by_lines(spark):
    from provena.sources import cards

    head = "---\nname: 'A card'\nkeywords: [one, \"two\"]\nallowed_tools:\n  - search\n  - fetch\n---\n"
    texts = {
        "full": head + "Intro.\n# Steps\nno\n### instructions\n\nDo this.\n#hashtag\nThen that.\n\n## Examples\nOne.\n#\n",
        "open": "---\nname: x\nNo second line of dashes.\n## Instructions",
        "empty": "", "bare": "---\n---\nBody", "late": "\n---\nname: y\n---\n",
    }
    got = {r["source"]: r for r in cards.parsed(spark.createDataFrame(list(texts.items()), "source string, text string")).collect()}
    f = got["full"]
    assert (f["name"], f["description"], f["keywords"], f["allowed_tools"], f["instructions"], f["examples"]) == ("A card", "Intro.", ["one", "two"], ["search", "fetch"], "Do this.\n#hashtag\nThen that.", "One.\n#")
    assert got["open"]["name"] == "open" and got["open"]["instructions"].startswith("---") and got["empty"]["instructions"] == "" and got["bare"]["instructions"] == "Body" and got["late"]["name"] == "late"
