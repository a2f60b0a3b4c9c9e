"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import scores
from provena.functions import text as T
from provena.operators import dedupe
from provena.operators.iterate import dealt
from provena.plans import query
from provena.plans.inputs import duck, table, view
from provena.sources import logs
from provena.streaming import logs as streaming


@query(duck("part_pages") + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS n FROM part_pages) SELECT run_id, id, CASE WHEN id % 3 = 0 THEN 0.6 ELSE 0.4 END::double AS confidence, left(text, 500) AS snippet FROM n WHERE n <= 25 AND id % 5 <> 4")
def fetch_pages(spark, sf_dir):
    """SRC5, CTL1: pages within the fetch budget that the gate lets in."""
    p = view(spark, sf_dir, "part_pages").withColumn("verdict", F.when(F.col("id") % 5 == 4, "reject").when(F.col("id") % 3 == 0, "accept").otherwise("flag"))
    return logs.fetched(p, budget=25)[0].select("run_id", "id", "confidence", "snippet")


@query(duck("part_pages") + ", e AS (SELECT id, url FROM part_pages WHERE id % 5 = 4), s AS (SELECT url, id AS timestamp, concat('snap', id) AS original, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS rn FROM part_pages WHERE id % 2 = 0) SELECT e.id, s.original, 0.5::double AS confidence FROM e JOIN s ON e.url = s.url WHERE rn = 1")
def recover_pages(spark, sf_dir):
    """SRC9: failed addresses with their newest snapshot."""
    p = view(spark, sf_dir, "part_pages")
    snaps = p.select("url", F.col("id").alias("timestamp"), F.concat(F.lit("snap"), F.col("id").cast("string")).alias("original"), F.when(F.col("id") % 2 == 0, 200).otherwise(404).alias("status"))
    return logs.recovered(p.where("id % 5 = 4").select("id", "url"), snaps).select("id", "original", "confidence")


@query(duck("edges") + """, l AS (SELECT DISTINCT src, '  ' || src || ' -->|' || rel || '| ' || dst AS line FROM edges) SELECT src, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM l GROUP BY src""")
def graph_diagrams(spark, sf_dir):
    """SNK4: Mermaid text of each part's edges, all parts."""
    return logs.mermaid(view(spark, sf_dir, "edges").withColumn("of", F.col("src")), ["of"]).withColumnRenamed("of", "src")


@query()
def dedupe_items(spark, sf_dir):
    """DD1: greedy duplicates by text, address and near-equal snippet; tests hold it against the sequential rule."""
    p = dealt(view(spark, sf_dir, "part_pages").select("run_id", "id", "text", "url")).select("run_id", "id", F.md5(F.col("text").cast("binary")).alias("text_hash"), F.left("text", F.lit(500)).alias("snippet"), T.canonical_url(F.col("url")).alias("canonical"))
    return dedupe.items(p, ["run_id"], ["text_hash", "canonical"], "id", "snippet").select("run_id", "id")


@query()
def dedupe_turns(spark, sf_dir):
    """DD1: the turns of each conversation as items, whose snippets are their first sentences."""
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_hash"), F.regexp_extract("text", r"^[^.\n]*", 0).alias("snippet"))
    return dedupe.items(p, ["conv_id"], ["text_hash"], "turn", "snippet").select("conv_id", "turn")


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_rates(spark, sf_dir):
    """Streaming: tumbling windows of the event log that the watermark has passed."""
    from provena.operators.iterate import written

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A stream reads folders or patterns: this pattern is the one table.
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.rates(rows, "ts", ["event_type"], "1 day")
    base = written(spark.range(1), "mark").inputFiles()[0].rsplit("/", 2)[0]
    got = streaming.run_once(out, f"{base}/rates", f"{base}/rates_checkpoint")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "calls", F.round("total", 2).alias("total"))


@query(duck("candidates") + "SELECT run_id, CASE WHEN count(*) FILTER (WHERE refs > 1) >= 2 THEN 'min_validated_candidates_met' WHEN count(channel) = 0 THEN 'no_quote_channel_found' WHEN sum(quantity) > 100 THEN 'max_runtime_reached' ELSE 'insufficient_evidence' END AS reason FROM candidates GROUP BY run_id")
def stop_reasons(spark, sf_dir):
    """CTL4: why each run stopped."""
    c = view(spark, sf_dir, "candidates").groupBy("run_id").agg(F.count_if(F.col("refs") > 1).alias("found"), F.count("channel").alias("channels"), F.sum("quantity").alias("spent"))
    return c.select("run_id", scores.stop_reason(F.col("found"), F.lit(2), F.lit(None).cast("string"), F.col("channels") == 0, F.col("spent") > 100).alias("reason"))
