"""Queries over similarity, co-location and explanation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import similar
from provena.functions import text as T
from provena.operators import dedupe, ranking
from provena.operators.iterate import dealt, written
from provena.plans import query
from provena.plans.inputs import duck, table, view


@query(duck("part_pages") + "SELECT id, cast(size * 10 AS bigint) AS moq FROM part_pages")
def extract_moq(spark, sf_dir):
    """EX7: minimum order quantities."""
    p = view(spark, sf_dir, "part_pages")
    return p.select("id", T.moq(F.concat(F.lit("Steel bolts, minimum order quantity: "), (F.col("size") * 10).cast("string"), F.lit(" pcs"))).alias("moq"))


@query()
def near_duplicate_pages(spark, sf_dir):
    """DD3: pages near the one before them of their group; lengths decide first; tests hold the ratio against difflib."""
    p = view(spark, sf_dir, "part_pages").where("text <> ''")
    p = p.withColumn("before", F.lag("text").over(Window.partitionBy("run_id").orderBy("id"))).where(similar.can_reach(F.col("text"), F.col("before"), 0.92))
    return p.select("run_id", "id", similar.ratio("text", "before").alias("ratio")).where("ratio >= 0.92")


@query()
def near_texts(spark, sf_dir):
    """DD3: every pair of different first sentences of a conversation of which one is near the other; tests hold the pairs against difflib."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.regexp_extract("text", r"^[^.\n]*", 0).alias("sentence"))
    t = t.where("sentence <> ''").distinct().withColumn("name", F.md5(F.col("sentence").cast("binary")))
    return dedupe.like(t, ["conv_id"], "name", "sentence").select("conv_id", "name", F.col("kept").alias("near"))


@query()
def rank_novelty(spark, sf_dir):
    """RNK6: 1 less the greatest similarity to the run's first three; the same domain counts .7."""
    p = view(spark, sf_dir, "part_pages").select("run_id", "id", F.lower(F.concat_ws(" ", "vendor_name", "url")).alias("me"), T.registrable(F.col("url")).alias("domain"))
    base = ranking.top_k(p, ["run_id"], [F.asc("id")], 3).select("run_id", F.col("id").alias("o"), F.col("me").alias("other"), F.col("domain").alias("theirs"))
    # Each text of a run is held against the other once, whatever the number of its pages, and over all cores.
    texts = p.select("run_id", "me").distinct().join(base.select("run_id", "other").distinct(), "run_id")
    told = written(dealt(texts).withColumn("s", similar.ratio("me", "other")), "told")
    pairs = p.join(base, "run_id").where("id <> o").join(told.hint("merge"), ["run_id", "me", "other"])
    best = pairs.groupBy("run_id", "id").agg(F.max(F.greatest("s", F.when(F.col("domain") == F.col("theirs"), 0.7).otherwise(0.0))).alias("s"))
    return best.select("run_id", "id", F.round(1 - F.col("s"), 4).alias("novelty"))


@query(duck("part_pages") + "SELECT id, id % 3 = 0 AS grounded FROM part_pages")
def colocated_claims(spark, sf_dir):
    """EX35: whether value and vendor stand together."""
    p = view(spark, sf_dir, "part_pages")
    k = F.col("id") % 3
    text = F.when(k == 0, F.concat(F.lit("Acme Metal has bolts. Price 12.50 each.\nOther")).cast("string")).when(k == 1, "Price 12.50 each. Nothing else here. Acme Metal").otherwise("Acme Metal sells at 125.00 only.")
    return p.select("id", T.relation_grounded(F.lit("Acme Metal Pte Ltd"), F.lit("12.5"), text).alias("grounded"))


@query(duck("part_pages") + "SELECT id, CASE id % 3 WHEN 0 THEN 'eol' WHEN 1 THEN 'unknown' ELSE 'nrnd' END AS state FROM part_pages")
def local_lifecycle(spark, sf_dir):
    """EX30: the lifecycle of the part itself, not of the one it replaces."""
    k = F.col("id") % 3
    text = F.when(k == 0, "NE5532A is obsolete. Buy now.").when(k == 1, "Obsolete NE5532 is superseded by NE5532A.").otherwise("NE5532 is active. The NE5532A is NRND.")
    return view(spark, sf_dir, "part_pages").select("id", T.lifecycle_of(text, F.lit("NE5532A")).alias("state"))


@query(duck("candidates") + ", m AS (SELECT run_id, seq, unnest(['match', 'complete', 'sure']) AS k, unnest([match_score, completeness, confidence]) AS v FROM candidates), b AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY match_score + completeness + confidence DESC, seq) AS rank FROM candidates), r AS (SELECT m.*, row_number() OVER (PARTITION BY m.run_id ORDER BY v DESC, k) AS n FROM m JOIN b USING (run_id, seq) WHERE b.rank = 1 AND v > 0) SELECT run_id, string_agg(k, ', ' ORDER BY n) AS won_on FROM r WHERE n <= 2 GROUP BY run_id")
def explain_winners(spark, sf_dir):
    """RNK16: what a run's winner won on."""
    c = view(spark, sf_dir, "candidates").withColumn("total", F.col("match_score") + F.col("completeness") + F.col("confidence"))
    best = ranking.top_k(c, ["run_id"], [F.desc("total"), F.asc("seq")], 1)
    m = best.select("run_id", F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(v).alias("v")) for n, v in (("match", "match_score"), ("complete", "completeness"), ("sure", "confidence"))))).alias("x")).select("run_id", "x.*").where("v > 0")
    top = ranking.top_k(m, ["run_id"], [F.desc("v"), F.asc("k")], 2)
    return top.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "k"))), lambda x: x["k"]), ", ").alias("won_on"))
