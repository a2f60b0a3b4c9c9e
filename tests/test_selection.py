"""Thresholds by selection, conflicts in blocks and the faults of spans against plain definitions."""

import hashlib
import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from provena.operators import belief, temporal, verification


def test_thresholds_are_those_of_sorted_scores(spark):
    rng = random.Random(3)
    rows = [("few", rng.random(), True) for _ in range(5)] + [("one", 0.25, True)] * 300 + [("wrong", 0.5, False)] * 30 + [(None, rng.random(), True) for _ in range(40)]
    rows += [("many", rng.choice([rng.random(), 0.0, 1.0, 1 - 2**-53, 2**-53, 1.5, -2.0]), rng.random() < 0.7) for _ in range(3000)] + [("close", 0.5 + i * 2**-52, True) for i in range(500)] + [("many", None, True)]
    got = {r["g"]: (r["n"], r["threshold"]) for r in belief.conformal(spark.createDataFrame(rows, "g string, score double, correct boolean"), ["g"]).collect()}
    want = {}
    for g in {r[0] for r in rows if r[2] and r[1] is not None}:
        nc = sorted(1 - min(1.0, max(0.0, s)) for x, s, ok in rows if x == g and ok and s is not None)
        k = math.ceil((len(nc) + 1) * 0.9)
        want[g] = (len(nc), round(1 - nc[k - 1], 6) if k <= len(nc) else None)
    assert got == want and want["few"][1] is None


def test_conflicts_are_those_of_a_loop(spark):
    rng = random.Random(1)
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(k, i, None if rng.random() < 0.05 else t(rng.randrange(40)), rng.choice(["x", "x", "x", "y", None])) for k in ("a", "b") for i in range(120)]
    rows += [("c", i, t(i), "x") for i in range(30)] + [("c", 30, t(90), "y")]
    got = {(r["key"], r["seq"]): r["valid_to"] for r in temporal.conflicts(spark.createDataFrame(rows, "key string, seq long, event_ts timestamp, v string"), ["key"], "v", block=8).collect()}
    want = {(k, i): next((u for kk, j, u, w in rows if kk == k and j > i and None not in (ts, u, v, w) and u > ts and v != w), None) for k, i, ts, v in rows}
    assert got == want and got["c", 0] == t(90)


def test_one_hot_key_of_conflicts(spark):
    n = 20_000
    d = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 7919 % 10007).alias("event_ts"), (F.col("id") % 3 == 0).alias("v"))
    assert temporal.conflicts(d, ["key"], "v").where("valid_to is null").count() < 100


def test_faults_of_spans(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = "The price is 12.50 a piece."
    pages = spark.createDataFrame([("p", text), ("q", None), ("e", "")], "id string, text string")
    rows = [
        ("plain", "p", 4, 18, sha(text[4:18]), "price is 12.50", sha("price is 12.50"), "ok"),
        ("whole", "p", 4, 18, sha(text[4:18]), text, sha(text), "ok"),  # the snippet holds the span
        ("part", "p", 4, 18, sha(text[4:18]), " 12.50 \n", sha(" 12.50 \n"), "ok"),
        ("blank", "p", 4, 18, sha(text[4:18]), "  ", sha("  "), "ok"),
        ("empty span", "p", 4, 4, sha(""), "anything", sha("anything"), "ok"),
        ("past the end", "p", 20, 900, sha(text[20:]), text[20:], sha(text[20:]), "ok"),
        ("empty text", "e", 0, 3, sha(""), "", sha(""), "ok"),
        ("no offsets", None, None, None, None, "x", "y", "unchecked"),
        ("no parent", None, 0, 3, sha("The"), "The", sha("The"), "no_parent_id"),
        ("blank parent", "", 0, 3, sha("The"), "The", sha("The"), "no_parent_id"),
        ("unknown", "z", 0, 3, sha("The"), "The", sha("The"), "no_parent"),
        ("null text", "q", 0, 3, sha("The"), "The", sha("The"), "no_text"),
        ("before", "p", -1, 3, sha("The"), "The", sha("The"), "bad_offsets"),
        ("turned", "p", 5, 3, sha("The"), "The", sha("The"), "bad_offsets"),
        ("half", "p", 0, None, sha("The"), "The", sha("The"), "bad_offsets"),
        ("other span", "p", 0, 3, sha("the"), "The", sha("The"), "span_hash"),
        ("no hash", "p", 0, 3, None, "The", sha("The"), "span_hash"),
        ("other snippet", "p", 0, 3, sha("The"), "The", sha("the"), "snippet_hash"),
        ("elsewhere", "p", 0, 3, sha("The"), "piece", sha("piece"), "not_aligned"),
    ]
    d = spark.createDataFrame([r[:-1] for r in rows], "claim string, parent string, start int, end int, span_hash string, snippet string, snippet_hash string")
    assert {r["claim"]: r["fault"] for r in verification.spans(d, pages, []).collect()} == {r[0]: r[-1] for r in rows}
