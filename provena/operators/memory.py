"""Recall of facts for queries within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import scores
from provena.operators import ranking

TOP, BUDGET, EXTRA = 5, 1200, 16


def terms(text: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def recall(facts: DataFrame, queries: DataFrame, now: Column, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(query_id, seq, overlap, score, place): for each query (query_id, query) the best active facts that fit the budget.

    ``facts``: seq, entity, field, value, confidence, event_ts, reinforced, disputes, citations. They meet queries on
    words. A score is the decayed confidence, raised by the overlap and by citations. Of the ``top`` best, in order,
    one that alone exceeds the budget is passed over while nothing is taken; the first that no longer fits ends the list.
    """
    held = facts.withColumn("_w", F.explode(terms(F.concat_ws(" ", "entity", "field", "value"))))
    hits = queries.select("query_id", F.explode(terms(F.col("query"))).alias("_w")).join(held, "_w").groupBy("query_id", "seq").agg(F.count("*").alias("overlap"))
    fact = facts.select("seq", (F.length("entity") + F.length("field") + F.length("value") + EXTRA).alias("_size"), scores.decayed(F.col("confidence"), scores.age_days(F.col("event_ts"), now), F.col("reinforced"), F.col("disputes")).alias("_decayed"), "citations")
    score = F.round(F.col("_decayed") * (1 + F.least(F.col("overlap"), F.lit(4)) * 0.1) * scores.citation_multiplier(F.col("citations")), 4)
    best = ranking.top_k(hits.join(fact, "seq").withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("seq")], top, "place")
    listed = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "seq", "overlap", "score", "_size"))).alias("x"))

    def step(a: Column, r: Column) -> Column:
        over, alone = a["used"] + r["_size"] > budget, r["_size"] > budget
        ends, skips = a["ended"] | ((F.size(a["out"]) > 0) & over), alone
        take = ~ends & ~skips
        return F.struct(F.when(take, a["used"] + r["_size"]).otherwise(a["used"]).cast("int").alias("used"), ends.alias("ended"), F.when(take, F.concat(a["out"], F.array(r["place"].cast("int")))).otherwise(a["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("out"))
    kept = listed.withColumn("_kept", F.aggregate("x", start, step, lambda a: a["out"])).select("query_id", "_kept", F.explode("x").alias("r"))
    return kept.where(F.array_contains("_kept", F.col("r.place").cast("int"))).select("query_id", "r.seq", "r.overlap", "r.score", F.col("r.place").cast("long").alias("place"))


#: Names that an insight on stale facts lists.
NAMED = 20


def reflect(facts: DataFrame, runs: DataFrame, now: Column, cap: int = 10) -> DataFrame:
    """(place, kind, insight): what memory says about itself, at most ``cap`` rows: disputes by ``seq`` first, then what is
    stale, the best-corroborated fact, what is tracked, and how many runs succeeded.

    ``facts``: seq, entity, kind, field, value, alternatives, status, confidence, event_ts, reinforced, disputes;
    ``runs``: outcome. Each insight is an aggregate; only ``cap`` disputes and NAMED names come together in one row.
    The best-corroborated is the active fact with the most observations, then the greatest decayed confidence, then the
    earliest; one that was seen once says nothing.
    """
    row = lambda place, kind, text: (F.lit(place).alias("_a"), F.lit(0).cast("long").alias("_b"), F.lit(kind).alias("kind"), text.alias("insight"))
    age = scores.age_days(F.col("event_ts"), now)
    values = F.array_join(F.filter(F.concat(F.array("value"), F.coalesce("alternatives", F.array().cast("array<string>"))), lambda v: F.coalesce(v, F.lit("")) != ""), ", ")
    disputed = facts.where("status = 'disputed'").orderBy("seq").limit(cap)
    disputed = disputed.select(F.lit(1).alias("_a"), F.col("seq").cast("long").alias("_b"), F.lit("dispute").alias("kind"), F.concat(F.lit("Disputed: "), "entity", F.lit(" "), "field", F.lit(" has conflicting values ("), values, F.lit("); revalidate before use.")).alias("insight"))
    old = facts.where((F.col("status") == "stale") | (age >= 180.0)).select("entity")
    names = old.distinct().orderBy("entity").limit(NAMED + 1)
    both = old.groupBy().agg(F.count("*").alias("n")).select("n", F.lit(None).cast("string").alias("entity")).unionByName(names.select(F.lit(0).cast("long").alias("n"), "entity"))
    stale = both.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("entity")).alias("e")).where("n > 0")
    listed = F.concat(F.array_join(F.slice("e", 1, NAMED), ", "), F.when(F.size("e") > NAMED, " and others").otherwise(""))
    stale = stale.select(*row(2, "staleness", F.concat(F.col("n").cast("string"), F.lit(" fact(s) are stale and need revalidation: "), listed, F.lit("."))))
    faded = scores.decayed(F.col("confidence"), age, F.col("reinforced"), F.col("disputes"))
    best = facts.where("status = 'active'").agg(F.max(F.struct("reinforced", faded.alias("d"), (-F.col("seq")).alias("s"), "entity", "field")).alias("b")).select("b.*").where("reinforced > 0")
    best = best.select(*row(3, "corroboration", F.concat("entity", F.lit(" "), "field", F.lit(" corroborated across "), (F.col("reinforced") + 1).cast("string"), F.lit(" observations; safe to reuse."))))
    kinds = facts.groupBy(F.col("kind").alias("k")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("x")).where(F.size("x") > 0)
    kinds = kinds.select(*row(4, "coverage", F.concat(F.lit("Tracking "), F.array_join(F.transform("x", lambda i: F.concat(i["n"].cast("string"), F.lit(" "), i["k"], F.lit("(s)"))), ", "), F.lit("."))))
    ended = runs.agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("ok")).where("n > 0")
    ended = ended.select(*row(5, "outcome", F.concat(F.col("ok").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" recent run(s) succeeded."))))
    rows = disputed.unionByName(stale).unionByName(best).unionByName(kinds).unionByName(ended)
    from pyspark.sql import Window

    # At most ``cap`` and four rows.
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_a", "_b"))).where(F.col("place") <= cap).select("place", "kind", "insight")
