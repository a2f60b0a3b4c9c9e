"""Rules held against values worked out by hand from their definitions."""

from pyspark.sql import functions as F

from provena.functions import scores
from provena.functions import text as T


def _one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_geo_score(spark):
    g = lambda c, t, x: scores.geo_score(F.lit(c), t, F.lit(x))
    got = _one(spark, g("Japan", "Singapore", "serving Malaysia"), g("Japan", "Singapore", ""), g("Japan", None, ""), g("Malaysia", "Singapore", ""), g("Singapore", "Singapore", ""), g(None, "Singapore", "offices in Brunei"), g(None, "Singapore", None))
    assert got == (6.0, -10.0, 0.0, 12.0, 20.0, 6.0, 0.0)


def test_last_time_buy(spark):
    q = lambda *x: scores.ltb_quantity(*(F.lit(float(v)) for v in x))
    assert _one(spark, q(1000, 5, 0.15, 0, 1), q(1000, 5, 0.15, 3, 1), q(-5, 5, 0.15, 3, 1)) == (5150, 5188, 0)


def test_skeleton(spark):
    assert _one(spark, T.skeleton(F.lit("global  sea freight China 20 to Taiwan 7"))) == ("global sea freight {region} {number} to {region} {number}",)


def test_same_vendor_is_substring(spark):
    from provena.operators import verification

    a = spark.createDataFrame([(1, "Acme", "x"), (2, "Hi", "x"), (3, "Acmetal Tools Pte Ltd", "x"), (4, "Zed", "x"), (5, "Ltd", "x")], "id long, vendor string, t string")
    b = spark.createDataFrame([(10, "Acmetal Tools", "x"), (11, "ACME Inc", "x"), (12, "Chin Hing", "x"), (13, "Co", "x")], "seq long, vendor string, t string")
    assert {(r["id"], r["seq"]) for r in verification.same_vendor(a, b, ["t"]).collect()} == {(1, 10), (2, 12), (3, 10)}


def test_linked_notes_is_brute_force(spark):
    import random

    from provena.operators import graph

    rng = random.Random(2)
    rows = [(i, *(rng.choice([None, *"abcdefgh"]) for _ in range(3))) for i in range(150)]
    weights = {"entity": 3, "stage": 1, "geo": 1}
    want = set()
    for i, *tags in rows:
        scored = sorted((-sum(w for w, x, y in zip(weights.values(), tags, other) if x is not None and x == y), j) for j, *other in rows if j < i)
        want |= {(i, j, -s) for s, j in [x for x in scored if x[0] < 0][:3]}
    got = graph.linked(spark.createDataFrame(rows, "seq long, entity string, stage string, geo string"), "seq", weights).collect()
    assert {(r["seq"], r["other"], r["score"]) for r in got} == want


def test_plans_of_any_depth(spark):
    from provena.operators import verification

    n = spark.range(30).select("id")
    got = verification.levels(spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dst long"), n)
    assert {r["id"]: r["level"] for r in got.collect()} == {i: i for i in range(30)}


def test_vendor_of_a_title(spark):
    v = lambda u, t: T.vendor(F.lit(u), F.lit(t))
    got = _one(spark, v("https://www.digi-key2go.com.sg/x", "Acme – Contact Us today"), v("https://www.digi-key2go.com.sg/x", " | Home"), v("", None), v("http://Ab.my", "About: Widgets\u00a0"), v(None, "Co-op Home"))
    assert [tuple(x) for x in got] == [("Acme", "https://digi-key2go.com.sg"), ("Digi Key2Go", "https://digi-key2go.com.sg"), ("Unknown Vendor", None), ("About: Widgets", "https://ab.my"), ("Co-op Home", None)]


def test_search_templates(spark):
    from provena.functions import searches

    t = lambda q, m, r, c: searches.templates(F.lit(q), F.lit(m), F.lit(r), F.lit(c))
    a, b, c, d = _one(spark, t(" bolts ", "product_exact_price", "global", "Japan"), t("bolts", "revalidation", "SEA", "Vietnam"), t("bolts", None, "SEA", None), t("bolts", "contact_enrichment_only", "global", ""))
    assert a == ["bolts price", "bolts public pricing", "bolts supplier price", "bolts MOQ price"] and d == ["bolts official contact", "bolts email", "bolts phone", "bolts contact page"]
    assert b == ["bolts Vietnam official contact", "bolts Vietnam email", "bolts Vietnam phone", "bolts Vietnam contact page", "bolts Southeast Asia contact"]
    assert len(c) == 9 and c[0] == "bolts Singapore request quotation" and c[7:] == ["bolts Malaysia contact sales", "bolts Southeast Asia vendor"]


def test_note_tags(spark):
    n = lambda *x: T.note_tags(*(F.lit(v) for v in x))
    got = _one(spark, n("Acme SG", "price", "12", False), n("Acme", "contact_phone", "Hanoi, Jakarta", None), n("x", "size", "now EOL", False), n(None, "moq", None, True))
    assert [tuple(x) for x in got] == [("Singapore", "pricing", False), ("Indonesia", "contact", False), (None, "general", True), (None, "pricing", True)]


def test_trust_summary(spark):
    s = lambda *x: scores.trust_summary(*(F.lit(v) for v in x))
    none = F.lit(None)
    got = _one(spark, s(True, 3, "high", "", 0.5, 0.9, True, 0.9, 0), scores.trust_summary(F.lit(False), none, none, none, none, none, none.cast("boolean"), none, F.lit(2)), scores.trust_summary(F.lit(True), none, none, none, none, none, F.lit(False), none, F.lit(0)))
    assert got == ("3 verified claim(s), grade high, decision n/a; quote-channel belief [0.5, 0.9]; conformal coverage >= 0.9; no disputed facts.", "claim verification disabled for this run; 2 disputed fact(s) flagged.", "conformal guarantee unavailable (uncalibrated); no disputed facts.")


def test_nearest_substitutes(spark):
    from provena.operators import graph

    rows = [("part:ab12", "part:cd34", 0.9), ("part:ab12", "part:ef56", 0.3), ("part:cd34", "part:gh78", 0.9), ("part:ef56", "part:cd34", 0.8), ("part:zz99", "part:cd34", 0.9)]
    e = spark.createDataFrame([(*r, "CROSS_REFERENCE", 1.0, None) for r in rows], "src string, dst string, confidence double, rel string, reliability double, valid_to string")
    asked = spark.createDataFrame([(1, "instead of AB12"), (2, "like ZZ99?"), (3, "nothing")], "query_id int, text string")
    got = {(r["query_id"], r["id"]): (r["depth"], r["score"]) for r in graph.nearest_substitutes(e, asked).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "part:cd34"): 1, (1, "part:ef56"): 1, (1, "part:gh78"): 2, (2, "part:cd34"): 1, (2, "part:gh78"): 2}
    one = {k[1]: v[1] for k, v in got.items() if k[0] == 1}
    # From the seed 0.85 of the mass goes on: a quarter of it to ef56, the rest and what ef56 passes on to cd34.
    assert one["part:cd34"] > one["part:gh78"] > one["part:ef56"] and abs(one["part:ef56"] / one["part:cd34"] - 0.25 / (0.75 + 0.85 * 0.25)) < 1e-6
