"""Budgeted walks against a plain recursion, signatures against the vectors of RFC 8032, and graphs of files of two ages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provena.functions import ed25519
from provena.operators import ledger, walk
from provena.operators.iterate import written
from provena.sources import graphs

NAMES = "abcde"


def _plain(query, width, depth, budget, verdicts):
    """Visit the nodes one by one: whoever comes first takes from what is left."""
    left = {"expansions": budget.expansions, "fetches": budget.discovery}
    edges, leaves = [], []
    short = lambda t: hashlib.sha256(t.encode()).hexdigest()[:12]

    def visit(node, text, level):
        if level == depth or not left["expansions"] or not left["fetches"]:
            leaves.append((node, text, level))
            return
        left["expansions"] -= 1
        n = min(width, left["fetches"])
        left["fetches"] -= n
        kids = [(short(f"{node}:{level + 1}:{text}{x}"), text + x) for x in NAMES[:n]]
        edges.extend((node, k, level + 1, t) for k, t in kids)
        for k, t in reversed(kids):
            visit(k, t, level + 1)

    visit(short(query), query, 0)
    rest, out = budget.fetches - len(edges), []
    for node, text, level in leaves:
        told = [verdicts.get((text, x), "active") for x in budget.lenses] if rest >= len(budget.lenses) else None
        rest -= len(budget.lenses) if told else 0
        out.append((node, text, level, told is not None, told, None if told is None else len(set(told)) == 1))
    return edges, out


@pytest.mark.parametrize(("width", "depth", "expansions", "fetches"), [(5, 3, 25, 45), (2, 1, 5, 20), (5, 3, 4, 45), (3, 3, 25, 33), (2, 4, 25, 60), (5, 2, 0, 45), (5, 3, 25, 7), (4, 0, 9, 45)])
def test_walks_are_those_of_a_recursion(spark, width, depth, expansions, fetches):
    budget = walk.Budget(expansions, fetches)
    spread = lambda q: F.array(*(F.struct(F.lit(x).alias("category"), F.concat(q, F.lit(x)).alias("text")) for x in NAMES[:width]))
    roots = {1: "q", 2: "another "}
    said = [("qe", "wayback", "gone"), ("qeee", "refetch", "gone"), ("qeed", "refetch", "active"), ("another ", "refetch", "x")]
    args = (spark.createDataFrame(list(roots.items()), "root long, query string"), budget, width, depth, spread, spark.createDataFrame(said, "query string, lens string, verdict string"))
    if depth == 0:
        with pytest.raises(ValueError, match="depth"):
            walk.walk(*args)
        return
    edges, leaves = (x.collect() for x in walk.walk(*args))
    for root, query in roots.items():
        want_edges, want_leaves = _plain(query, width, depth, budget, {(q, x): v for q, x, v in said})
        assert sorted((r["parent"], r["child"], r["depth"], r["query"]) for r in edges if r["root"] == root) == sorted(want_edges)
        mine = sorted((r for r in leaves if r["root"] == root), key=lambda r: r["place"])
        assert [(r["node"], r["query"], r["depth"], r["verified"], r["verdicts"], r["agree"]) for r in mine] == want_leaves
        assert len(want_edges) + 3 * sum(x[3] for x in want_leaves) <= fetches
    assert all(r["confidence"] == round(0.85 ** r["depth"], 4) for r in edges)


def test_trajectories_cover_all_categories(spark):
    got = spark.range(1).select(walk.trajectories(F.lit("16-pin op amp TI NE5532")).alias("t")).first()["t"]
    assert [r["category"] for r in got] == ["synonym", "broader_class", "broker_operator", "sea_local_language", "mfr_alt_pn"]
    assert all(r["text"] for r in got) and got[3]["text"].startswith("16-pin op amp TI NE5532 ") and "operational amplifier" in got[1]["text"]


VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize(("key", "public", "message", "signature"), VECTORS)
def test_vectors_of_the_rfc(key, public, message, signature):
    key, public, message, signature = map(bytes.fromhex, (key, public, message, signature))
    assert ed25519.public_key(key) == public and ed25519.sign(key, message) == signature and ed25519.verify(public, message, signature)
    for i in (0, 31, 32, 63):
        assert not ed25519.verify(public, message, signature[:i] + bytes([signature[i] ^ 1]) + signature[i + 1 :])
    assert not ed25519.verify(public, message + b"x", signature) and not ed25519.verify(public, message, signature[:63]) and not ed25519.verify(b"\xff" * 32, message, signature)
    late = int.from_bytes(signature[32:], "little") + ed25519.ORDER
    assert late >= 2**256 or not ed25519.verify(public, message, signature[:32] + late.to_bytes(32, "little"))
    with pytest.raises(ValueError, match="32 bytes"):
        ed25519.sign(b"short", message)


def test_signed_heads(spark):
    key = bytes(range(32))
    heads = spark.createDataFrame([(i, 3 + i, "ab" * 32, "t") for i in range(4)], "run_id long, tree_size long, root string, published_at string")
    put = ledger.signed(heads, ["run_id"], key)
    bad = F.when(F.col("run_id") == 1, "cd" * 32).otherwise(F.col("root"))
    text = F.when(F.col("run_id") == 2, "no hex").when(F.col("run_id") == 3, None).otherwise(F.col("signature"))
    got = ledger.signatures_hold(written(put, "signed").withColumns({"root": bad, "signature": text}), ["run_id"], ed25519.public_key(key))
    assert {r["run_id"]: r["valid"] for r in got.collect()} == {0: True, 1: False, 2: False, 3: False}
    assert not ledger.signatures_hold(put, ["run_id"], ed25519.public_key(b"k" * 32)).where("valid").count()


def test_edges_of_two_ages(spark, tmp_path):
    path = str(tmp_path / "edges")
    first = "src string, dst string, rel string, confidence double, reliability double, claim string, event_ts timestamp, seq long"
    with pytest.raises(ValueError, match="no edges"):
        graphs.read_edges(spark, path)
    old = spark.createDataFrame([("a", "b", "R", 0.5, 0.8, "c1", None, 1), ("a", "c", "R", 0.5, 0.8, "c1", None, 2)], first)
    graphs.append_edges(old, path)
    assert graphs.read_edges(spark, path).where("valid_to is null and grade is null").count() == 2
    new = spark.createDataFrame([("a", "b", "R", 0.9, 0.8, "c1", None, 3), ("d", "e", "R", 0.9, 0.8, "c2", None, 4)], first).withColumn("valid_to", F.when(F.col("seq") == 3, F.timestamp_seconds(F.lit(9))))
    graphs.append_edges(new, path)
    got = {(r["src"], r["dst"]): (r["seq"], r["confidence"], r["valid_to"] is None) for r in graphs.read_edges(spark, path).collect()}
    assert got == {("a", "b"): (3, 0.9, False), ("a", "c"): (2, 0.5, True), ("d", "e"): (4, 0.9, True)}
    for wrong, what in ((old.withColumn("claim", F.lit("")), "claim"), (old.drop("rel"), "rel")):
        with pytest.raises(ValueError, match=what):
            graphs.append_edges(wrong, path)
