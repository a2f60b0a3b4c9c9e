"""Grounding and search rules held against values worked out by hand."""

from pyspark.sql import functions as F

from provena.functions import grounding, searches


def _table(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} string" for n in names))


def test_verdicts_worked_out_by_hand(spark):
    near, far = "Acme Metal has bolts. Price 12.50 each.", "Price 12.50 each. Nothing here. Acme Metal"
    rows = [
        # claim, value, span, subject; supported, score, method
        ("", "12.5", None, "Acme Metal Pte Ltd", False, 0.0, "no_evidence"),
        ("", "", " ", "", False, 0.0, "no_evidence"),
        ("", "12.5", near, "Acme Metal Pte Ltd", True, 1.0, "relation_grounded"),  # the sentence after the name
        ("", "12.5", far, "Acme Metal Pte Ltd", False, 0.0, "subject_ungrounded"),  # the name comes later
        ("", "12.5", far, "", True, 1.0, "value_grounded"),
        ("", "1250", "Acme sells units at 1,250 per pack", "", True, 1.0, "value_grounded"),
        ("", "1250", "Acme sells units at 1,250 per pack", "Acme Metal Pte Ltd", True, 1.0, "relation_grounded"),  # one of two words
        ("", "125", "Acme Metal sells at S$125.00 only.", "Acme Metal", True, 1.0, "relation_grounded"),
        ("", "12.5", "Acme Metal sells at S$125.00 only.", "Acme Metal", False, 0.0, "token_overlap"),  # 12.5 is not in 125
        ("", "30", "3M tape price 30 per unit", "3M", True, 1.0, "relation_grounded"),  # a name of two letters
        ("", "30", "3M tape price 30 per unit", "Zed", False, 0.0, "subject_ungrounded"),
        ("", "sales@acme.sg", "mail sales@acme.sg for Acme Metal quotes", "Acme Metal", True, 1.0, "relation_grounded"),
        ("", "good steel bolts", "Metal bolts of good quality and steel", "", True, 1.0, "token_overlap"),  # three of three words
        ("", "good steel bolts", "Metal bolts of good quality and steel", "Acme Metal", False, 0.0, "token_overlap"),  # words alone tie no subject
        ("", "good steel bolts", "good bread", "", False, 0.3333, "token_overlap"),
        ("", "good steel bolts", "good bread", "Acme Metal", False, 0.3333, "token_overlap"),
        ("Acme sells good bolts", "", "Acme Metal has bolts and sells them", "Acme Metal", True, 0.75, "token_overlap"),  # three of four
        ("Acme sells good bolts", "", "Zed sells good bolts", "Acme Metal", False, 0.0, "token_overlap"),  # the subject is not there
        ("Acme sells good bolts", "", "Zed sells good bolts", "", True, 0.75, "token_overlap"),
        ("Acme sells good bolts", "", "Zed sells bread", "Acme Metal", False, 0.25, "token_overlap"),
        ("", "", "some text", "", False, 0.0, "token_overlap"),  # nothing is claimed
    ]
    d = _table(spark, [r[:4] for r in rows], ["claim", "value", "span", "subject"])
    got = d.orderBy("i").select(grounding.check(*map(F.col, ("claim", "value", "span", "subject"))).alias("r")).collect()
    for want, r in zip(rows, got, strict=True):
        assert tuple(r["r"]) == want[4:], want


def test_contradictions_worked_out_by_hand(spark):
    rows = [
        # subject, value, span; contradicted
        ("Acme Metal", "12.5", "Acme Metal bolts price 14 each", True),
        ("Acme Metal", "12.5", "Acme Metal bolts price 12.50 or 14 each", False),  # the claimed number is there, too
        ("Acme Metal", "12.5", "Acme Metal price 12.5 each. Acme Metal price 14 each", False),
        ("Acme Metal", "12.5", "Zed bolts price 14 each", False),  # not on the subject
        ("", "12.5", "Zed bolts price 14 each", True),  # no subject: any sentence
        ("Acme Metal", "12.5", "Acme Metal was founded in 1990", False),  # no price, no quantity
        ("Acme Metal", "12.5", "Acme Metal " + "x" * 30 + " 77 " + "y" * 30 + " price", False),  # the price is not beside it
        ("Acme Metal", "12.5", "Acme Metal has bolts. Price 14 each.", False),  # the sentence with the number does not name it
        ("Acme Metal", "sales@acme.sg", "Acme Metal price 14 each", False),  # no number is claimed
        ("Acme Metal", "1,250", "Acme Metal costs 1,250 per pack", False),
        ("Acme Metal", "1,250", "Acme Metal costs 1,350 per pack", True),
        ("3M", "30", "3M tape price 31 per unit", True),
        ("3M", "30", "3M tape price 30 per unit", False),
        ("Acme Metal", "12.5", None, False),
        ("Acme Metal", "", "Acme Metal price 14 each", False),
    ]
    d = _table(spark, [r[:3] for r in rows], ["subject", "value", "span"])
    got = d.orderBy("i").select(grounding.contradicted(F.col("subject"), F.col("value"), F.col("span")).alias("r")).collect()
    for want, r in zip(rows, got, strict=True):
        assert r["r"] == want[3], want


def test_models_only_tighten(spark):
    base = F.struct(F.lit(True).alias("supported"), F.lit(1.0).alias("score"), F.lit("value_grounded").alias("method"))
    m = lambda score, value, span, subject: grounding.with_model(base, F.lit(score).cast("double"), F.lit(value), F.lit(span), F.lit(subject))
    got = spark.range(1).select(m(None, "x", "x", "").alias("a"), m(7.0, "12", "12", "").alias("b"), m(0.9, "12", "12. Acme Metal", "Zed Corp").alias("c"), m(0.9, "13", "12", "Zed Corp").alias("d"), m(0.2, "12", "12", "").alias("e")).first()
    assert [tuple(x) for x in got] == [(True, 1.0, "value_grounded"), (True, 1.0, "model"), (False, 0.0, "subject_ungrounded"), (False, 0.9, "model"), (False, 0.2, "model")]
    pages = [("accept", "reject"), ("reject", "accept"), ("flag", None), ("flag", "nonsense"), ("accept", "flag")]
    got = _table(spark, pages, ["v", "o"]).orderBy("i").select(grounding.tightened(F.col("v"), F.col("o")).alias("r")).collect()
    assert [r["r"] for r in got] == ["reject", "reject", "flag", "flag", "flag"]


def test_search_variants(spark):
    rows = [("find  TI op amp bq2057 in 1990s",), ("bolts",), (" ",), (None,), ("molex connector",)]
    d = _table(spark, rows, ["q"]).orderBy("i")
    got = [[(v["kind"], v["text"]) for v in r["v"]] for r in d.select(searches.variants(F.col("q")).alias("v")).collect()]
    assert [k for k, _ in got[0]] == ["original", "step_back", "hyde", "query2doc", "obsolescence", "mpn_pattern", "broker_operator"]
    assert dict(got[0])["step_back"] == "operational amplifier equivalent replacement cross reference" and dict(got[0])["mpn_pattern"] == "bq2057 cross reference equivalent datasheet"
    assert dict(got[0])["original"] == "find TI op amp bq2057 in 1990s" and all(len(t) <= 200 for k, t in got[0])
    assert dict(got[1])["step_back"] == "bolts alternative supplier" and dict(got[1])["mpn_pattern"] == "series part cross reference equivalent" and got[2] == got[3] == []
    assert dict(got[4])["mpn_pattern"] == "Molex DF13 connector cross reference equivalent"
    k = d.where("i = 1").select(searches.corrective(F.col("q"), F.lit("1. new bolts\n- Bolts\n* third\nfourth")).alias("k")).first()["k"]
    assert [x["kind"] for x in k] == ["broker_operator", "step_back", "obsolescence", "pivot"] and k[3]["text"] == "new bolts"


def test_spine_is_a_plain_loop(spark):
    from provena.operators import spine

    pages = [(1, 10, "https://ti.com/a", "Acme Metal sells bolts. Price S$12.50 each."), (1, 11, "https://x.my", "Acme Metal bolts at 12.5 per unit"), (1, 12, "https://y.my", "Acme Metal bolts price 14 each"), (1, 13, "https://z.my", ""), (2, 10, "https://q.my", "Acme Metal 12.5 price"), (1, 14, "https://w.my", None), (1, 15, "https://v.my", "Acme Metal asks 12.50 for good steel bolts")]
    claims = [(1, "a", "Acme Metal", "price", "12.5", 10), (1, "b", "Acme Metal", "price", "12.5", 12), (1, "c", "Acme Metal", "price", "99", 12), (1, "d", "Acme Metal", "price", "12.5", 13), (1, "e", "", "kind", "good steel bolts", 15), (1, "f", "Zed", "price", "77", 99), (2, "a", "Acme Metal", "price", "12.5", 10), (1, "g", "", "kind", "good steel plates now", 10)]
    p = spark.createDataFrame(pages, "run_id long, id long, url string, text string")
    c = spark.createDataFrame(claims, "run_id long, claim_id string, subject string, predicate string, value string, page long")
    got = {(r["run_id"], r["claim_id"]): r for r in spine.verify(c, p, ["run_id"]).collect()}
    checks = c.select("run_id", "claim_id", "subject", "predicate", "value", F.col("page").alias("cited")).join(p, "run_id")
    checks = checks.select("run_id", "claim_id", "cited", "id", grounding.check(F.col("predicate"), F.col("value"), F.col("text"), F.col("subject")).alias("r")).collect()
    assert len(got) == len(claims)
    for run, claim, *_, page in claims:
        mine = [x["r"] for x in checks if (x["run_id"], x["claim_id"]) == (run, claim) and x["id"] == page]
        other = [x["r"] for x in checks if (x["run_id"], x["claim_id"]) == (run, claim) and x["id"] != page]
        cited, r = bool(mine and mine[0]["supported"]), got[run, claim]
        assert r["verified"] == (cited or any(x["supported"] for x in other)) and r["stage"] == ("cited" if cited else "corpus")
        assert r["corroborations"] == min(3, sum(x["supported"] for x in other))
        if cited or r["verified"]:
            assert r["label"] == ("grounded" if cited else "complementary")
    assert got[1, "c"]["label"] == "contradicted" and got[1, "c"]["decision"] == "replan" and got[1, "f"]["label"] == "ungrounded"
    assert got[1, "a"]["grade"] == "high" and got[1, "d"]["label"] == "complementary"


def test_spans_of_claims(spark):
    from provena.operators import spine

    text = "x" * 200 + " The Price is 12.50 today " + "y" * 300
    d = spark.createDataFrame([(1, text, "price is 12.50"), (2, text, "gone"), (3, text, "missing entirely"), (4, None, "a")], "id long, text string, m string")
    got = {r["id"]: r["x"] for r in d.select("id", spine.span(F.col("text"), F.col("m"), ("nothing", "today")).alias("x")).collect()}
    assert tuple(got[1])[:3] == (205, 219, "Price is 12.50") and got[1]["snippet"] == text[25:399].strip() and got[2]["span"] == "today"
    assert tuple(got[4]) == (-1, -1, "a", "a")
