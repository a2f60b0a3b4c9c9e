"""Queries over relations in text, claims and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import fixed
from provena.functions import text as T
from provena.operators import memory, verification
from provena.plans import query
from provena.plans.extraction import _HOST, _lit
from provena.plans.inputs import duck, table, view


@query(duck("part_pages") + ", m AS (SELECT id, regexp_extract(text, '([A-Z0-9]+) is superseded by', 1) AS s, regexp_extract(text, 'is superseded by ([A-Z0-9]+)', 1) AS d, string_split_regex(text, '[.!?]+')[1] AS sentence FROM part_pages WHERE text LIKE '%is superseded by%') SELECT id, 'part:' || lower(s) AS src, 'SUPERSEDED_BY' AS rel, 'part:' || lower(d) AS dst, trim(sentence) AS sentence FROM m")
def extract_triples(spark, sf_dir):
    """EX28: relations in prose."""
    return view(spark, sf_dir, "part_pages").select("id", F.explode(T.triples(F.col("text"))).alias("t")).select("id", "t.*")


@query(duck("part_pages") + ", m AS (SELECT id, upper(regexp_extract(text, '([A-Z0-9]+) is superseded by', 1)) AS original, upper(regexp_extract(text, 'is superseded by ([A-Z0-9]+)', 1)) AS replacement FROM part_pages WHERE text LIKE '%is superseded by%') SELECT id, original, replacement FROM m")
def extract_cross_references(spark, sf_dir):
    """EX29: replacement pairs by line."""
    return view(spark, sf_dir, "part_pages").select("id", F.explode(T.cross_references(F.col("text"))).alias("x")).select("id", "x.*")


@query(duck("part_pages") + ", v AS (SELECT id, cast(cast(floor(price) AS bigint) AS varchar) AS value, regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g') AS text FROM part_pages) SELECT id, list_contains(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(x AS double)), cast(value AS double)) AS grounded FROM v")
def ground_prices(spark, sf_dir):
    """EX33, EX34: whether a page's text holds the price as a whole number."""
    return view(spark, sf_dir, "part_pages").select("id", T.value_grounded(F.floor("price").cast("string"), F.col("text")).alias("grounded"))


def _candidates(spark, sf_dir):
    return view(spark, sf_dir, "part_pages").select("id", "vendor_name", F.when(F.col("id") % 3 > 0, F.floor("price").cast("double")).alias("price"), F.when(F.col("id") % 2 == 0, "EXACT_PRICE").otherwise("NOT_FOUND").alias("status"), F.when(F.col("size") > 25, F.col("size")).alias("moq"), F.when(F.col("id") % 4 == 0, "https://x.sg/rfq").alias("channel_value"), F.array(F.struct(F.lit("email").alias("type"), F.concat(F.lit("sales@v"), (F.col("id") % 9).cast("string"), F.lit(".sg")).alias("value"))).alias("contacts"))


@query(duck("part_pages") + """, c AS (SELECT id, vendor_name AS s, 'vendor_name' AS field, vendor_name AS value, FALSE AS critical FROM part_pages UNION ALL SELECT id, vendor_name, 'price', cast(cast(floor(price) AS bigint) AS varchar), id % 2 = 0 FROM part_pages WHERE id % 3 > 0
  UNION ALL SELECT id, vendor_name, 'moq', cast(size AS varchar), FALSE FROM part_pages WHERE size > 25 UNION ALL SELECT id, vendor_name, 'quote_channel', 'https://x.sg/rfq', TRUE FROM part_pages WHERE id % 4 = 0 UNION ALL SELECT id, vendor_name, 'contact_email', concat('sales@v', id % 9, '.sg'), TRUE FROM part_pages)
SELECT id, 'vclaim_' || left(sha256(concat_ws('|', s, field, value)), 12) AS claim_id, field, value, critical FROM c""")
def decompose_claims(spark, sf_dir):
    """EX32: atomic claims of candidates."""
    return verification.decompose(_candidates(spark, sf_dir), ["id"])


# Claims on the first sentences of documents: by id, sound ones and ones with each fault.
_SPANS = """c AS (SELECT doc_id AS claim, CASE k WHEN 1 THEN NULL WHEN 2 THEN -1 - doc_id ELSE doc_id END AS parent, CASE k WHEN 0 THEN NULL WHEN 4 THEN -1 ELSE 5 END AS "start", CASE k WHEN 0 THEN NULL WHEN 4 THEN 3 WHEN 8 THEN 5 WHEN 9 THEN 3000000 ELSE 60 END AS "end", k, coalesce(text, '') AS text FROM (SELECT *, doc_id % 11 AS k FROM {documents}))"""


@query("WITH " + _SPANS.format(documents="documents") + """, s AS (SELECT *, substring(text, 6, greatest(0, "end" - 5)) AS span FROM c), n AS (SELECT *, CASE k WHEN 7 THEN 'another text' WHEN 10 THEN '' ELSE span END AS snippet FROM s)
SELECT n.claim, CASE WHEN k = 0 THEN 'unchecked' WHEN k = 1 THEN 'no_parent_id' WHEN k = 2 THEN 'no_parent' WHEN d.text IS NULL THEN 'no_text' WHEN k = 4 THEN 'bad_offsets' WHEN k = 5 THEN 'span_hash' WHEN k = 6 THEN 'snippet_hash' WHEN k = 7 AND span <> '' AND NOT contains('another text', span) AND NOT contains(span, 'another text') THEN 'not_aligned' ELSE 'ok' END AS fault FROM n LEFT JOIN documents d ON d.doc_id = n.parent""")
def verify_spans(spark, sf_dir):
    """INT3, JN1: claims against the spans of their documents, all seven faults."""
    d = table(spark, sf_dir, "documents")
    c = spark.sql("WITH " + _SPANS.replace('"start"', "`start`").replace('"end"', "`end`") + " SELECT * FROM c", documents=d)
    span = F.substring(F.col("text"), F.lit(6), F.greatest(F.lit(0), F.col("end") - 5))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    k, snippet = F.col("k"), F.when(F.col("k") == 7, "another text").when(F.col("k") == 10, "").otherwise(span)
    c = c.select("claim", "parent", "start", "end", F.when(k == 5, "x").otherwise(sha(span)).alias("span_hash"), snippet.alias("snippet"), F.when(k == 6, "x").otherwise(sha(snippet)).alias("snippet_hash"))
    return verification.spans(c, d.select(F.col("doc_id").alias("id"), "text"), [])


@query(duck("part_pages") + f""", h AS (SELECT run_id, id, {_HOST} AS host, list_transform(regexp_extract_all(text, '(?i)' || {_lit(fixed.PAGE_PRICE)}), lambda p: upper(regexp_replace(p, '\\s+', '', 'g'))) AS prices FROM part_pages),
b AS (SELECT DISTINCT a.run_id, a.id FROM h a JOIN h b ON a.run_id = b.run_id AND a.host = b.host AND b.id < a.id WHERE len(a.prices) > 0 AND len(b.prices) > 0 AND NOT list_has_any(a.prices, b.prices)) SELECT h.run_id, h.id, CASE WHEN b.id IS NULL THEN 0.0 ELSE 0.6 END::double AS contradiction FROM h LEFT JOIN b USING (run_id, id)""")
def price_contradictions(spark, sf_dir):
    """JN8: pages whose prices contradict an earlier page of their host."""
    return verification.contradictions(view(spark, sf_dir, "part_pages"), ["run_id"])


@query(duck("part_pages") + """, k AS (SELECT type, id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(vendor_name), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda w: w NOT IN ('pte', 'ltd', 'sdn', 'bhd', 'llc', 'inc', 'co', 'company', 'team')), ' ') AS k FROM part_pages),
m AS (SELECT a.type, a.id, min(b.id) AS seq FROM k a JOIN k b ON a.type = b.type AND b.id % 2 = 0 AND a.id % 2 = 1 AND (contains(a.k, b.k) OR contains(b.k, a.k)) AND a.k <> '' AND b.k <> '' GROUP BY a.type, a.id) SELECT * FROM m""")
def match_vendors(spark, sf_dir):
    """JN3: recalled vendors of candidates by name."""
    p = view(spark, sf_dir, "part_pages").select("type", "id", F.col("vendor_name").alias("vendor"))
    return verification.same_vendor(p.where("id % 2 = 1"), p.where("id % 2 = 0").withColumnRenamed("id", "seq"), ["type"])


@query(duck("candidates") + ", g AS (SELECT run_id, seq, unnest([CASE WHEN part % 2 = 0 AND channel IS NULL THEN 'quote_channel' END, CASE WHEN part % 2 = 0 AND completeness < 0.6 THEN 'checklist' END, CASE WHEN part % 2 = 0 AND confidence < 0.5 THEN 'geo' END, CASE WHEN part % 2 = 1 AND match_score < 0.5 THEN 'fff_conflict' END, CASE WHEN part % 2 = 1 AND confidence < 0.5 THEN 'datasheet' END, CASE WHEN flagged THEN 'price_conflict' END]) AS gap FROM candidates) SELECT run_id, seq, gap, replace(CASE gap " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in fixed.REPAIR_QUERIES.items()) + " END, '{q}', 'bolts') AS repair FROM g WHERE gap IS NOT NULL")
def evidence_gaps(spark, sf_dir):
    """EX49: gaps of a bundle and their repair queries."""
    c = view(spark, sf_dir, "candidates").select("run_id", "seq", F.when(F.col("part") % 2 == 0, "service_quote_required").otherwise("electronics_substitution").alias("mode"), F.col("channel").isNotNull().cast("double").alias("quote_channel"), F.col("completeness").alias("checklist"), F.col("confidence").alias("geo"), F.col("match_score").alias("fff_similarity"), F.col("confidence").alias("datasheet_evidence"), F.col("flagged").cast("int").alias("disputed"), F.lit("bolts").alias("query"))
    return verification.gaps(c, ["run_id", "seq"])


@query("SELECT p_partkey, unnest([1, 2, 3, 4, 5, 6]) AS rank, unnest(['existing_stock', 'reclamation', 'substitute', 'alternate_source', 'redesign', 'emulation']) AS strategy, unnest([p_size > 25, p_partkey % 2 = 0, p_partkey % 3 > 0, p_partkey % 5 > 0, TRUE, TRUE]) AS applicable FROM part")
def dmsms_ladders(spark, sf_dir):
    """EX44: the six rungs for each part."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(0), F.col("p_size") - 25).alias("on_hand"), F.lit(None).cast("int").alias("ltb"), (k % 2 == 0).alias("reclaimed"), (k % 3).alias("alternates"), (k % 5).alias("sources"))
    return verification.ladder(p, ["p_partkey"])


@query("SELECT event_type, cast(json_extract_string(props, '$.k') AS int) % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def json_arguments(spark, sf_dir):
    """EX51: arguments parsed from JSON text, counted."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(duck("facts") + ", a AS (SELECT 'disputed' AS kind, count(*) AS n, NULL AS top FROM (SELECT entity, field FROM facts GROUP BY entity, field HAVING count(DISTINCT value) > 1) UNION ALL SELECT 'stale', count(*), NULL FROM facts WHERE event_ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'field', count(*), field FROM facts GROUP BY field) SELECT kind, n, top FROM a")
def reflections(spark, sf_dir):
    """AG10: what memory says about itself."""
    f = view(spark, sf_dir, "facts")
    none = F.lit(None).cast("string").alias("top")
    disputed = f.groupBy("entity", "field").agg(F.count_distinct("value").alias("v")).where("v > 1").agg(F.count("*").alias("n")).select(F.lit("disputed").alias("kind"), "n", none)
    stale = f.where(F.col("event_ts") < F.lit("2024-01-10").cast("timestamp")).agg(F.count("*").alias("n")).select(F.lit("stale").alias("kind"), "n", none)
    return disputed.union(stale).union(f.groupBy("field").agg(F.count("*").alias("n")).select(F.lit("field"), "n", "field"))


_REFLECTED = "f AS (SELECT *, cast(entity AS varchar(20)) AS name, CASE WHEN disputes = 2 AND reinforced = 4 AND entity % 50 = 7 THEN 'disputed' ELSE 'active' END AS status FROM facts)"


@query(duck("facts") + f""", {_REFLECTED}, a AS (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '2024-06-30') - epoch_us(event_ts)) / 86400000000) AS age FROM f), d AS (SELECT *, round(score * exp(-age / ((90.0 / ln(2.0)) * (1 + 0.5 * reinforced) / pow(2.0, disputes))), 4) AS faded FROM a),
n AS (SELECT DISTINCT name FROM d WHERE age >= 180 ORDER BY name LIMIT 21), r AS (
SELECT 1 AS a, seq AS b, 'dispute' AS kind, 'Disputed: ' || name || ' ' || field || ' has conflicting values (' || value || ', unknown); revalidate before use.' AS insight FROM d WHERE status = 'disputed'
UNION ALL SELECT 2, 0, 'staleness', count(*) || ' fact(s) are stale and need revalidation: ' || (SELECT array_to_string(list_slice(list(name ORDER BY name), 1, 20), ', ') || CASE WHEN count(*) > 20 THEN ' and others' ELSE '' END FROM n) || '.' FROM d WHERE age >= 180 HAVING count(*) > 0
UNION ALL SELECT * FROM (SELECT 3, 0, 'corroboration', name || ' ' || field || ' corroborated across ' || (reinforced + 1) || ' observations; safe to reuse.' FROM d WHERE status = 'active' ORDER BY reinforced DESC, faded DESC, seq LIMIT 1)
UNION ALL SELECT 4, 0, 'coverage', 'Tracking ' || string_agg(c || ' ' || field || '(s)', ', ' ORDER BY field) || '.' FROM (SELECT field, count(*) AS c FROM d GROUP BY field)
UNION ALL SELECT 5, 0, 'outcome', count(*) FILTER (WHERE o_orderstatus = 'F') || '/' || count(*) || ' recent run(s) succeeded.' FROM orders)
SELECT place, kind, insight FROM (SELECT row_number() OVER (ORDER BY a, b) AS place, kind, insight FROM r) WHERE place <= 40""")
def memory_insights(spark, sf_dir):
    """AG10: what memory says about itself, in order and capped: disputes, staleness, corroboration, coverage, outcomes."""
    f = view(spark, sf_dir, "facts")
    status = F.when((F.col("disputes") == 2) & (F.col("reinforced") == 4) & (F.col("entity") % 50 == 7), "disputed").otherwise("active")
    facts = f.select("seq", F.col("entity").cast("string").alias("entity"), F.col("field").alias("kind"), "field", "value", F.array(F.lit("unknown")).alias("alternatives"), status.alias("status"), F.col("score").alias("confidence"), "event_ts", "reinforced", "disputes")
    runs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("outcome"))
    return memory.reflect(facts, runs, F.lit("2024-06-30").cast("timestamp"), 40).withColumn("place", F.col("place").cast("long"))
