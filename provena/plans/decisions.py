"""Queries over decisions: intervals by side, promotion, parity, state, composed verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import fixed, scores
from provena.operators import belief, temporal
from provena.plans import query
from provena.plans.inputs import duck, table, view

_SIDES = ", s AS (SELECT entity, field, value AS side FROM facts GROUP BY entity, field, value), src AS (SELECT entity, field, value, max(least(1.0, score)) AS r FROM facts GROUP BY entity, field, value), m AS (SELECT s.entity, s.field, s.side, least(0.99, greatest(0.0, r)) AS r, src.value = s.side AS sup FROM s JOIN src USING (entity, field)), p AS (SELECT entity, field, side, product(CASE WHEN sup THEN r ELSE 0.0 END + round(1 - r, 6)) AS pt, product(CASE WHEN sup THEN 0.0 ELSE r END + round(1 - r, 6)) AS pf, product(round(1 - r, 6)) AS pu, count(*) AS n FROM m GROUP BY entity, field, side), k AS (SELECT *, greatest(0.0, pt - pu) AS qt, greatest(0.0, pf - pu) AS qf FROM p), c AS (SELECT *, CASE WHEN n = 1 THEN 0.0 ELSE greatest(0.0, 1 - qt - qf - pu) END AS k FROM k), z AS (SELECT *, CASE WHEN k > 0.8 OR n = 1 THEN 1.0 ELSE 1 - k END AS z FROM c)"


@query(duck("facts") + _SIDES + " SELECT entity, field, side, round(qt / z, 6) AS belief, round(qt / z + (pu + CASE WHEN k > 0.8 THEN k ELSE 0.0 END) / z, 6) AS plausibility, k > 0.8 AS severe FROM z")
def fuse_disputed(spark, sf_dir):
    """UNC3, UNC4, RNK7: each side of a disputed fact against all sources."""
    f = view(spark, sf_dir, "facts")
    sources = f.groupBy("entity", "field", "value").agg(F.max(F.least(F.lit(1.0), F.col("score"))).alias("reliability"))
    sides = sources.select("entity", "field", F.col("value").alias("side"))
    rows = sides.join(sources, ["entity", "field"]).withColumn("supports", F.col("side") == F.col("value"))
    return belief.fuse(rows, ["entity", "field", "side"]).select("entity", "field", "side", "belief", "plausibility", (F.col("rule") == "yager").alias("severe"))


@query(duck("facts") + ", c AS (SELECT field, 1 - least(1.0, greatest(0.0, score)) AS nc FROM facts WHERE reinforced > 0), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY nc) AS i, count(*) OVER (PARTITION BY field) AS n FROM c), t AS (SELECT field, round(1 - max(CASE WHEN i = ceil((n + 1) * (1 - 0.1::double)) THEN nc END), 6) AS threshold FROM r GROUP BY field) SELECT f.field, count(*) FILTER (WHERE threshold IS NULL OR score < threshold) AS abstained, count(*) AS n FROM facts f LEFT JOIN t USING (field) GROUP BY f.field")
def conformal_decisions(spark, sf_dir):
    """UNC6: abstention under the fitted thresholds, always without one."""
    f = view(spark, sf_dir, "facts")
    t = belief.conformal(f.select("field", "score", (F.col("reinforced") > 0).alias("correct")), ["field"]).select("field", "threshold")
    return f.join(t, "field", "left").groupBy("field").agg(F.count_if(belief.calibrated(F.col("score"), F.col("threshold"))).alias("abstained"), F.count("*").alias("n"))


@query(duck("facts") + "SELECT entity, count(DISTINCT value) >= 2 OR (count(DISTINCT value) >= 1 AND max(score) >= 0.8 AND bool_or(field = 'signup')) AS promoted FROM facts GROUP BY entity")
def promote_contacts(spark, sf_dir):
    """MEM4: two distinct references, or one that is sure and of the vendor's domain."""
    refs = F.count_distinct("value")
    return view(spark, sf_dir, "facts").groupBy("entity").agg(((refs >= 2) | ((refs >= 1) & (F.max("score") >= 0.8) & F.bool_or(F.col("field") == "signup"))).alias("promoted"))


@query("WITH base AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), own AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_discount > 0.05) SELECT count(*) AS baseline, round(avg(CASE WHEN own.k IS NULL THEN 0.0 ELSE 1.0 END), 4) AS matched FROM base LEFT JOIN own USING (k)")
def baseline_parity(spark, sf_dir):
    """JN12: the share of a baseline's vendors that are found."""
    l = table(spark, sf_dir, "lineitem")
    base = l.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).distinct()
    own = l.where("l_returnflag = 'A' and l_discount > 0.05").select(F.col("l_suppkey").alias("k")).distinct().withColumn("hit", F.lit(1.0))
    return base.join(own, "k", "left").agg(F.count("*").alias("baseline"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias("matched"))


@query(duck("facts") + ", v AS (SELECT entity, field, seq, value, event_ts, lead(event_ts) OVER (PARTITION BY entity, field ORDER BY event_ts, seq) AS valid_to FROM facts) SELECT entity, field, seq, value FROM v WHERE valid_to IS NULL")
def current_facts(spark, sf_dir):
    """TMP3: the open version of each fact."""
    return temporal.versions_in_order(view(spark, sf_dir, "facts"), ["entity", "field"]).where("valid_to is null").select("entity", "field", "seq", "value")


@query(duck("facts") + ", f AS (SELECT entity AS src, field AS rel, value AS dst, event_ts, seq FROM facts), p AS (SELECT a.src, a.rel, a.seq, min_by(b.event_ts, b.seq) AS valid_to FROM f a JOIN f b ON a.src = b.src AND a.rel = b.rel AND a.dst <> b.dst AND b.seq > a.seq AND b.event_ts > a.event_ts GROUP BY a.src, a.rel, a.seq) SELECT f.src, f.rel, f.seq, p.valid_to FROM f LEFT JOIN p USING (src, rel, seq)")
def invalidate_conflicts(spark, sf_dir):
    """TMP2: a functional relation is closed by the first later fact with another object."""
    f = view(spark, sf_dir, "facts").select(F.col("entity").alias("src"), F.col("field").alias("rel"), F.col("value").alias("dst"), "event_ts", "seq")
    return temporal.conflicts(f, ["src", "rel"], "dst").select("src", "rel", "seq", "valid_to")


@query(duck("candidates") + f""", g AS (SELECT supp, max(completeness) AS done, count(DISTINCT part) FILTER (WHERE status = 'CONFLICTING') AS bad, count(*) FILTER (WHERE refs > 0) AS backed, round(least({fixed.MAX_RELIABILITY}::double, max(confidence)::double), 6) AS r, count(channel) AS channels FROM candidates GROUP BY supp),
v AS (SELECT *, CASE WHEN backed = 0 THEN 'blocked' WHEN bad > 0 THEN 'review' WHEN done < 0.65 THEN 'incomplete' ELSE 'draft' END AS verdict, CASE WHEN backed >= 20 THEN 'high' WHEN backed >= 5 THEN 'medium' END AS grade FROM g)
SELECT supp, backed, bad > 0 AS disputed, verdict, concat(backed, ' verified claim(s), grade ', coalesce(grade, 'n/a'), ', decision ', verdict, '; ', CASE WHEN channels > 0 THEN concat('quote-channel belief [', CASE WHEN bad > 0 THEN 0.0::double ELSE r END, ', ', CASE WHEN bad > 0 THEN round(1 - r, 6) ELSE 1.0::double END, ']; ') ELSE '' END,
  CASE WHEN backed >= 10 THEN 'conformal coverage >= 0.9' ELSE 'conformal guarantee unavailable (uncalibrated)' END, '; ', CASE WHEN bad > 0 THEN concat(bad, ' disputed fact(s) flagged') ELSE 'no disputed facts' END, '.') AS summary FROM v""")
def trust_verdicts(spark, sf_dir):
    """CTL6, CTL7: a vendor's verdict and the sentence that composes its grade, interval, guarantee and disputes."""
    c = view(spark, sf_dir, "candidates")
    g = c.groupBy("supp").agg(F.max("completeness").alias("done"), F.count_distinct(F.when(F.col("status") == "CONFLICTING", F.col("part"))).alias("bad"), F.count_if(F.col("refs") > 0).alias("backed"), F.max(F.col("confidence").cast("double")).alias("reliability"), F.count("channel").alias("channels"))
    # One source on each vendor's channel, for it unless its prices conflict.
    held = belief.fuse(g.where("channels > 0").select("supp", "reliability", (F.col("bad") == 0).alias("supports")), ["supp"])
    g = g.join(held, "supp", "left").withColumn("verdict", F.when(F.col("backed") == 0, "blocked").when(F.col("bad") > 0, "review").when(F.col("done") < 0.65, "incomplete").otherwise("draft"))
    grade = F.when(F.col("backed") >= 20, "high").when(F.col("backed") >= 5, "medium")
    summary = scores.trust_summary(F.lit(True), F.col("backed"), grade, F.col("verdict"), F.col("belief"), F.col("plausibility"), F.col("backed") >= 10, F.lit(0.9), F.col("bad"))
    return g.select("supp", "backed", (F.col("bad") > 0).alias("disputed"), "verdict", summary.alias("summary"))


@query(duck("candidates") + "SELECT run_id, seq, coalesce(channel, CASE WHEN s_acctbal >= 0 THEN 'contact_email' WHEN s_suppkey IS NOT NULL THEN 'phone' END) AS channel, CASE WHEN channel IS NULL AND s_suppkey IS NOT NULL THEN greatest(completeness, 0.75::double) ELSE completeness END AS completeness FROM candidates LEFT JOIN supplier ON s_suppkey = supp")
def fill_from_memory(spark, sf_dir):
    """MEM14: a candidate without a channel takes the recalled one, and counts as three quarters complete."""
    recalled = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), F.when(F.col("s_acctbal") >= 0, "contact_email").otherwise("phone").alias("recalled"))
    c = view(spark, sf_dir, "candidates").join(recalled, "supp", "left")
    filled = F.col("channel").isNull() & F.col("recalled").isNotNull()
    return c.select("run_id", "seq", F.coalesce("channel", "recalled").alias("channel"), F.when(filled, F.greatest(F.col("completeness"), F.lit(0.75))).otherwise(F.col("completeness")).alias("completeness"))


@query(duck("facts") + "SELECT entity, seq, left(value || ' ' || field, 200) AS snippet FROM facts WHERE field NOT IN ('purchase') AND disputes = 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = entity AND s_acctbal < 0)")
def fact_views(spark, sf_dir):
    """FLT10, FLT12, SET6: facts by status, cut to a snippet, without those of excluded vendors."""
    out = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"))
    f = view(spark, sf_dir, "facts").where((F.col("field") != "purchase") & (F.col("disputes") == 0)).join(out, "entity", "left_anti")
    return f.select("entity", "seq", F.left(F.concat_ws(" ", "value", "field"), F.lit(200)).alias("snippet"))


@query(duck("candidates") + "SELECT run_id, seq, round((0.30 * match_score + 0.20 * completeness + 0.15 * confidence + 0.15 * 1.0 + 0.10 * 0.5 + 0.10 * 0.0)::double, 3) AS about, status = 'CONFLICTING' AS risky FROM candidates")
def electronics_rewards(spark, sf_dir):
    """RNK8: electronics' weights, to three places, and the risk that goes with a conflict."""
    w = fixed.ELECTRONICS_WEIGHTS
    c = view(spark, sf_dir, "candidates")
    total = w["fff_similarity"] * F.col("match_score") + w["lifecycle_safety"] * F.col("completeness") + w["authorized_source"] * F.col("confidence") + w["stock"] * F.lit(1.0) + w["datasheet_evidence"] * F.lit(0.5)
    return c.select("run_id", "seq", F.round(total, 3).alias("about"), (F.col("status") == "CONFLICTING").alias("risky"))
