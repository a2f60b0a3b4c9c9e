"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import decontaminate, fill_in_middle, jaccard_join, language_id, license_scan, packing, pii, quality_cnn, quality_rules, row_patterns, secret_scan, token_counts, warc
from provena.llm.common import crc_mod, documents, let_workers_import


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod(4) == 2
    scored = quality_cnn.score(docs, quality_cnn.train(docs, labels, ~held))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """The vocabulary file that packing takes as its parameter here."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).drop("ids")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = crc_mod(3) == 1
    out = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs, ~held))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(documents(spark, sf_dir, "doc_id", "text", "source")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.classify(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet").where("client_id is not null and ts is not null")
    # Equal rows count once: columns that the pattern does not use take part as a hash.
    clicks = clicks.select("client_id", "ts", "click_id", "kind", "value", F.xxhash64("arrived_at", "props").alias("rest")).distinct()
    cents = F.when(~F.isnan("value"), F.floor(100 * F.col("value") + 0.5))
    rows = clicks.select("client_id", "ts", "click_id", cents.alias("cents"), F.coalesce(F.col("kind") == "click", F.lit(False)).alias("click"), F.coalesce(F.col("kind") != "error", F.lit(False)).alias("sound"))
    near = F.col("ts") <= row_patterns.prev("ts") + F.expr("INTERVAL 5 MINUTES")
    down, up = F.col("cents") < row_patterns.prev("cents"), F.col("cents") > row_patterns.prev("cents")
    steps = [row_patterns.Step("D", near & down & F.col("sound"), repeat=True), row_patterns.Step("U", near & up & F.col("sound"), repeat=True), row_patterns.Step("P", near & F.col("click"), bounded=True)]
    found = row_patterns.find(rows, "client_id", ["ts", "click_id"], "click_id", "cents", F.col("cents").isNotNull(), steps)
    labels = F.sha2(row_patterns.letters(steps).cast("binary"), 256)
    return found.select("client_id", F.col("match_no").cast("long").alias("match_no"), F.col("first").alias("first_id"), F.col("last").alias("last_id"), "n_rows", F.col("total").alias("sum_cents"), labels.alias("labels_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_cnn, op2_packing, op3_warc, op4_pii, op5_language_id, op6_decontaminate, op7_secret_scan, op8_license_scan, op9_jaccard_join, op10_quality_rules, op11_token_counts, op12_row_patterns, op13_fill_in_middle)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: SHA-1 in base32: the 40 hexadecimal digits as 160 bits, five bits to a letter.
_BASE32 = "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, 1 + 5 * (g // 4), 5) AS bigint) >> (15 - 5 * (g % 4))) & 31)::int, 1), '' ORDER BY g) FROM range(32) t(g))"

ORACLES = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op9_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g), s AS (SELECT doc_id, unnest(g) AS s FROM g),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT doc_id AS start, doc_id AS at FROM n UNION SELECT r.start, e.y FROM r JOIN e ON e.x = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id FROM n JOIN r ON r.start = n.doc_id GROUP BY n.doc_id, n.n""",
}

#: Within a client the falling run after a start and the rising run after that are given; the last fitting end is taken.
ORACLES["op12_row_patterns"] = """
WITH c AS (SELECT client_id, ts, click_id, kind, cast(floor(100 * value + 0.5) AS bigint) AS cents FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS rn, sum(cents) OVER w AS upto, coalesce(ts <= lag(ts) OVER w + INTERVAL 5 MINUTE, FALSE) AS near, lag(cents) OVER w AS before FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
f AS (SELECT *, coalesce(near AND cents < before AND kind <> 'error', FALSE) AS d, coalesce(near AND cents > before AND kind <> 'error', FALSE) AS u, coalesce(near AND kind = 'click' AND cents IS NOT NULL, FALSE) AS p FROM r),
e AS (SELECT *, coalesce(min(rn) FILTER (NOT d) OVER x, max(rn) OVER (PARTITION BY client_id) + 1) AS no_d, coalesce(min(rn) FILTER (NOT u) OVER x, max(rn) OVER (PARTITION BY client_id) + 1) AS no_u FROM f WINDOW x AS (PARTITION BY client_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
s AS (SELECT a.client_id, a.rn, a.click_id, a.cents, a.upto, n.no_d, m.no_u FROM e a JOIN e n ON n.client_id = a.client_id AND n.rn = a.rn + 1 JOIN e m ON m.client_id = a.client_id AND m.rn = n.no_d WHERE a.cents IS NOT NULL AND n.d AND m.u),
g AS (SELECT s.client_id, s.rn, max(z.rn) AS last FROM s JOIN e z ON z.client_id = s.client_id AND z.rn > s.no_d AND z.rn <= s.no_u AND z.p AND z.cents >= s.cents GROUP BY s.client_id, s.rn)
SELECT s.client_id, row_number() OVER (PARTITION BY s.client_id ORDER BY s.rn) AS match_no, s.click_id AS first_id, z.click_id AS last_id, z.rn - s.rn + 1 AS n_rows, cast(z.upto - s.upto + s.cents AS bigint) AS sum_cents,
  sha256(concat('A', repeat('D', (s.no_d - s.rn - 1)::bigint), repeat('U', (z.rn - s.no_d)::bigint), 'P')) AS labels_sha256
FROM g JOIN s USING (client_id, rn) JOIN e z ON z.client_id = g.client_id AND z.rn = g.last"""

ORACLES["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::bigint AS n, sha256(concat('1:', doc_id)) AS h FROM documents),
k AS (SELECT *, ('0x' || h[1:8])::bigint % (n + 1) AS a, ('0x' || h[9:16])::bigint % (n + 1) AS b, ('0x' || h[17:24])::bigint % 100 AS h3, ('0x' || h[25:32])::bigint % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS low, greatest(a, b) AS high, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', substring(t, 1, low), '<S>', substring(t, high + 1), '<M>', substring(t, low + 1, high - low)) ELSE concat('<S>', substring(t, high + 1), '<P>', substring(t, 1, low), '<M>', substring(t, low + 1, high - low)) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
