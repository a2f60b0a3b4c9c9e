"""Queries over candidates: scores, order, summaries, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import fixed, scores
from provena.operators import ranking
from provena.plans import query
from provena.plans.extraction import _case
from provena.plans.inputs import duck, table, view

_GEO = "CASE WHEN country = 'Singapore' THEN 20.0 WHEN country IN ('Malaysia') THEN 12.0 WHEN country IS NOT NULL THEN -10.0 ELSE 0.0 END"
_PRODUCT = f"round((30 * {_case('status', fixed.PRICE_QUALITY, 0.0)} + CASE WHEN quantity > 25 THEN 15.0 ELSE 0.0 END + CASE WHEN refs > 1 THEN 20.0 ELSE 10.0 END + greatest(0.0, {_GEO}) / 20 * 15 + 20 * completeness)::double, 2)"


def _geo():
    return scores.geo_score(F.col("country"), "Singapore", F.lit(""))


def _scored(spark, sf_dir):
    c = view(spark, sf_dir, "candidates").where("refs > 0")
    return c.withColumn("score", scores.product_score(F.col("status"), F.col("quantity") > 25, F.lit(True), F.col("refs") > 1, _geo(), F.col("completeness")))


@query(duck("candidates") + f", s AS (SELECT *, {_PRODUCT} AS score FROM candidates WHERE refs > 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS rank FROM s) SELECT run_id, seq, part, score, rank FROM r WHERE rank <= 5")
def rank_products(spark, sf_dir):
    """RNK1, RNK4, RNK12, FLT2: product candidates with evidence, the best five of a run."""
    return ranking.top_k(_scored(spark, sf_dir), ["run_id"], [F.desc("score"), F.asc("seq")], 5).select("run_id", "seq", "part", "score", F.col("rank").cast("long"))


@query(duck("candidates") + f", s AS (SELECT *, {_PRODUCT} AS score FROM candidates WHERE refs > 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, seq) AS rank FROM s) SELECT run_id, seq, rank, CASE WHEN rank = 1 THEN 'primary' WHEN rank <= 4 THEN 's1' ELSE 's2' END AS slot FROM r")
def rank_slots(spark, sf_dir):
    """WN3: the slot of each ranked candidate."""
    return ranking.slots(_scored(spark, sf_dir), ["run_id"], "score", "seq").select("run_id", "seq", F.col("rank").cast("long"), "slot")


@query(duck("candidates") + f"SELECT run_id, seq, round((25 * least(1.0, match_score) + 25 * coalesce({_case('channel', fixed.CHANNEL_QUALITY)}, 0.0) + greatest(0.0, {_GEO}) / 20 * 20 + CASE WHEN channel = 'contact_email' THEN 15.0 WHEN channel IS NOT NULL THEN 10.0 ELSE 0.0 END + 10 * least(1.0, completeness) + greatest(-20.0, CASE WHEN flagged THEN -5.0 ELSE 0.0 END))::double, 2) AS score FROM candidates")
def score_services(spark, sf_dir):
    """RNK2: service scores."""
    c = view(spark, sf_dir, "candidates")
    return c.select("run_id", "seq", scores.service_score(F.col("match_score"), F.col("channel"), _geo(), F.col("completeness"), F.when(F.col("flagged"), -5.0).otherwise(0.0)).alias("score"))


@query(duck("candidates") + f"SELECT run_id, seq, round((least(35.0, 35 * confidence + CASE WHEN flagged THEN 3.0 ELSE 0.0 END) + 25 * (0.6 * least(refs, 3) / 3 + 0.4 * CASE WHEN part % 2 = 0 THEN 1.0 ELSE 0.0 END) + greatest(0.0, {_GEO}) * 15 / 20 + 25 * completeness)::double, 2) AS score FROM candidates")
def score_contacts(spark, sf_dir):
    """RNK3: contact scores."""
    c = view(spark, sf_dir, "candidates")
    return c.select("run_id", "seq", scores.contact_score(F.col("confidence"), F.col("flagged"), F.col("refs"), F.col("part") % 2 == 0, _geo(), F.col("completeness")).alias("score"))


_W = fixed.SERVICE_WEIGHTS
_METRICS = {"service_match": "match_score", "quote_channel": "CASE WHEN channel IS NULL THEN 0.0 ELSE 1.0 END", "geo": f"greatest(0.0, {_GEO}) / 20", "contact_reliability": "confidence", "checklist": "completeness", "evidence_diversity": "refs / 3"}
_REWARD = "round((" + " + ".join(f"round(({_W[k]} * ({v}))::double, 4)" for k, v in _METRICS.items()) + ")::double, 4)"


def _rewards(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    metrics = {"service_match": F.col("match_score"), "quote_channel": F.col("channel").isNotNull().cast("double"), "geo": F.greatest(F.lit(0.0), _geo()) / 20, "contact_reliability": F.col("confidence"), "checklist": F.col("completeness"), "evidence_diversity": F.col("refs") / 3}
    return c.withColumn("reward", scores.weighted(metrics, _W, F.lit(0.0), F.lit(0.0)))


@query(duck("candidates") + f"SELECT run_id, seq, {_REWARD} AS reward FROM candidates")
def process_rewards(spark, sf_dir):
    """RNK9: weighted process reward."""
    return _rewards(spark, sf_dir).select("run_id", "seq", "reward")


@query(duck("candidates") + f", r AS (SELECT run_id, seq, {_REWARD} AS reward FROM candidates), w AS (SELECT *, exp((reward - max(reward) OVER (PARTITION BY run_id)) / 0.15) AS e FROM r), p AS (SELECT *, e / sum(e) OVER (PARTITION BY run_id) AS p FROM w) SELECT run_id, seq, round(p, 6) AS p, round(1 / sum(p * p) OVER (PARTITION BY run_id), 6) AS ess, max(p) OVER (PARTITION BY run_id) < 0.55 AS abstains FROM p")
def trajectory_posterior(spark, sf_dir):
    """RNK10, WN7: softmax over a run's rewards, sample size and abstention."""
    p = ranking.posterior(_rewards(spark, sf_dir), ["run_id"], "reward")
    return p.select("run_id", "seq", F.round("p", 6).alias("p"), F.round("ess", 6).alias("ess"), "abstains")


@query(duck("candidates") + "SELECT run_id, seq, status, refs > 0 AND completeness >= 0.75 AND CASE WHEN part % 3 = 0 THEN status IN ('EXACT_PRICE', 'PRICE_RANGE', 'STARTING_FROM') WHEN part % 3 = 1 THEN channel IS NOT NULL AND match_score > 0 ELSE refs > 0 END AS validated FROM candidates")
def validate_candidates(spark, sf_dir):
    """FLT1: which candidates count as results."""
    c = view(spark, sf_dir, "candidates")
    mode = F.when(F.col("part") % 3 == 0, "product_exact_price").when(F.col("part") % 3 == 1, "service_quote_required").otherwise("contact_enrichment_only")
    return c.select("run_id", "seq", "status", scores.validated(mode, F.col("refs"), F.col("completeness"), F.lit(0.75), F.col("status"), F.col("channel"), F.col("match_score"), F.col("refs")).alias("validated"))


@query(duck("candidates") + "SELECT status AS pricing_status, count(*) AS n, count(DISTINCT supp) AS suppliers, max(price_q) AS best FROM (SELECT *, completeness AS price_q FROM candidates) GROUP BY status")
def pricing_summary(spark, sf_dir):
    """AG1: candidates by pricing status."""
    return view(spark, sf_dir, "candidates").groupBy(F.col("status").alias("pricing_status")).agg(F.count("*").alias("n"), F.count_distinct("supp").alias("suppliers"), F.max("completeness").alias("best"))


@query(duck("candidates") + "SELECT channel, avg(CASE WHEN refs > 0 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN status = 'EXACT_PRICE' THEN 1.0 ELSE 0.0 END) AS exact, count(*) AS n FROM candidates GROUP BY GROUPING SETS ((channel), ())")
def gold_set_ratios(spark, sf_dir):
    """AG2, AG3, CTL21: ratios of boolean outcomes, by group and overall."""
    c = view(spark, sf_dir, "candidates").groupingSets([[F.col("channel")], []], F.col("channel"))
    return c.agg(F.avg((F.col("refs") > 0).cast("double")).alias("coverage"), F.avg((F.col("status") == "EXACT_PRICE").cast("double")).alias("exact"), F.count("*").alias("n"))


@query(duck("candidates") + ", u AS (SELECT supp % 4 AS model, sum(quantity) AS tok_in, sum(part % 100) AS tok_out FROM candidates GROUP BY 1), p AS (SELECT *, (model + 1) * 0.5 AS price_in, (model + 1) * 1.5 AS price_out FROM u) SELECT model, tok_in, tok_out, round((tok_in / 1000 * price_in + tok_out / 1000 * price_out)::double, 6) AS usd, round((tok_in / 1000 * 2.0 + tok_out / 1000 * 6.0)::double, 6) AS usd_at_most, round(greatest(0.0, tok_in / 1000 * 2.0 + tok_out / 1000 * 6.0 - (tok_in / 1000 * price_in + tok_out / 1000 * price_out))::double, 6) AS saved FROM p")
def cost_report(spark, sf_dir):
    """AG4: token cost by model against the dearest model."""
    u = view(spark, sf_dir, "candidates").groupBy((F.col("supp") % 4).alias("model")).agg(F.sum("quantity").alias("tok_in"), F.sum(F.col("part") % 100).alias("tok_out"))
    usd = F.col("tok_in") / 1000 * (F.col("model") + 1) * 0.5 + F.col("tok_out") / 1000 * (F.col("model") + 1) * 1.5
    most = F.col("tok_in") / 1000 * 2.0 + F.col("tok_out") / 1000 * 6.0
    return u.select("model", "tok_in", "tok_out", F.round(usd, 6).alias("usd"), F.round(most, 6).alias("usd_at_most"), F.round(F.greatest(F.lit(0.0), most - usd), 6).alias("saved"))


@query(duck("candidates") + "SELECT run_id, least(1.0, count(DISTINCT supp) / 3.0) AS diversity, least(1.0, max(match_score)) AS best_match, bool_or(flagged) AS any_flagged, count(*) FILTER (WHERE status = 'CONFLICTING') AS conflicting FROM candidates GROUP BY run_id")
def bundle_metrics(spark, sf_dir):
    """AG8, RNK8: a run's bundle metrics."""
    return view(spark, sf_dir, "candidates").groupBy("run_id").agg(F.least(F.lit(1.0), F.count_distinct("supp") / 3.0).alias("diversity"), F.least(F.lit(1.0), F.max("match_score")).alias("best_match"), F.bool_or("flagged").alias("any_flagged"), F.count_if(F.col("status") == "CONFLICTING").alias("conflicting"))


@query(duck("candidates") + ", r AS (SELECT *, sum(quantity) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM candidates) SELECT run_id, seq, quantity, running FROM r WHERE running <= 60")
def budget_prefix(spark, sf_dir):
    """WN4, CTL1: rows of a run within its budget."""
    return ranking.budget_cut(view(spark, sf_dir, "candidates"), ["run_id"], [F.asc("seq")], "quantity", 60).select("run_id", "seq", "quantity", "running")


@query(duck("candidates") + f"SELECT run_id, seq, round((0.40 * CASE WHEN channel IS NULL THEN 0 ELSE 1 END + 0.25 * CASE WHEN match_score >= 0.5 THEN 1 ELSE 0 END + 0.20 * CASE WHEN refs > 0 THEN 1 ELSE 0 END + 0.15 * CASE WHEN country IS NULL THEN 0 ELSE 1 END)::double, 3) AS completeness, CASE WHEN channel IS NULL OR 0.40 + 0.25 * CASE WHEN match_score >= 0.5 THEN 1 ELSE 0 END + 0.20 * CASE WHEN refs > 0 THEN 1 ELSE 0 END + 0.15 * CASE WHEN country IS NULL THEN 0 ELSE 1 END < 0.65 THEN 'incomplete' ELSE 'draft' END AS rfq_status FROM candidates")
def rfq_checklist(spark, sf_dir):
    """EX40: checklist completeness and whether a draft can be made."""
    c = view(spark, sf_dir, "candidates")
    done = scores.checklist(F.col("channel").isNotNull(), F.col("match_score") >= 0.5, F.col("refs") > 0, F.col("country").isNotNull())
    return c.select("run_id", "seq", done.alias("completeness"), F.when(F.col("channel").isNull() | (done < 0.65), "incomplete").otherwise("draft").alias("rfq_status"))


@query(duck("candidates") + "SELECT run_id, seq, (ceil(quantity * 3) + ceil(quantity * 0.2 * (0.5 + CASE WHEN match_score > 0 THEN match_score / (match_score + confidence) ELSE 0.5 END)))::bigint AS ltb, CASE WHEN flagged THEN 'red' WHEN refs > 1 THEN 'green' ELSE 'amber' END AS badge FROM candidates")
def obsolescence_plan(spark, sf_dir):
    """EX43, EX45, JN13: last-time-buy quantity and counterfeit badge."""
    c = view(spark, sf_dir, "candidates")
    return c.select("run_id", "seq", scores.ltb_quantity(F.col("quantity"), F.lit(3), F.lit(0.2), F.col("match_score"), F.col("confidence")).alias("ltb"), scores.counterfeit(F.col("flagged"), F.col("refs") > 1).alias("badge"))


@query(duck("candidates") + ", a AS (SELECT run_id, supp, line * 2 AS k FROM candidates WHERE line <= 3 UNION ALL SELECT run_id, supp, line * 2 + 1 FROM candidates WHERE line > 3), d AS (SELECT run_id, supp, min(k) AS k FROM a GROUP BY run_id, supp), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY k, supp) AS pos FROM d) SELECT run_id, supp, pos FROM r WHERE pos <= 4")
def merge_queries(spark, sf_dir):
    """SET2, AG18: interleave two lists, first of each value, and cut."""
    c = view(spark, sf_dir, "candidates")
    d = c.select("run_id", "supp", F.when(F.col("line") <= 3, F.col("line") * 2).otherwise(F.col("line") * 2 + 1).alias("k")).groupBy("run_id", "supp").agg(F.min("k").alias("k"))
    return ranking.top_k(d, ["run_id"], [F.asc("k"), F.asc("supp")], 4, "pos").select("run_id", "supp", F.col("pos").cast("long"))


@query("SELECT s_suppkey, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS revenue, count(l_orderkey) AS lines, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY s_suppkey")
def supplier_evidence(spark, sf_dir):
    """JN5: suppliers with the evidence of their order lines; the date reaches the scan."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")).groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count("*").alias("n"), F.count_distinct("l_partkey").alias("p"))
    s = table(spark, sf_dir, "supplier").join(l, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.select("s_suppkey", F.round(zero(F.col("r")), 2).alias("revenue"), zero(F.col("n")).alias("lines"), zero(F.col("p")).alias("parts"))
