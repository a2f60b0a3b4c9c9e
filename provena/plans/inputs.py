"""Inputs of the registered queries: views over the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # A page for each part: vendor, address, text with prices, channels, lifecycle and relations, and a user's query.
    "part_pages": """
SELECT p_partkey AS id, p_partkey % 50 AS run_id,
  concat(p_brand, ' ', CASE p_partkey % 4 WHEN 0 THEN 'Pte Ltd' WHEN 1 THEN 'Sdn Bhd' WHEN 2 THEN 'Trading' ELSE 'Inc' END) AS vendor_name,
  concat('https://www.', CASE p_partkey % 8 WHEN 0 THEN 'DigiKey.com' WHEN 1 THEN 'shop.alibaba.example' WHEN 2 THEN concat('vendor', cast(p_partkey % 20 AS varchar(20)), '.com.sg') WHEN 3 THEN 'ti.com'
    WHEN 4 THEN 'rochester.example' WHEN 5 THEN 'octopart.com' WHEN 6 THEN 'supply.gov.sg' ELSE concat('v', cast(p_partkey % 30 AS varchar(20)), '.my') END, '/', lower(p_type), '/', cast(p_partkey % 40 AS varchar(20)), '/?utm_source=x&b=2&a=', cast(p_partkey % 5 AS varchar(20)), '#top') AS url,
  CASE p_partkey % 10
    WHEN 0 THEN concat(p_name, ' unit price S$', cast(cast(floor(p_retailprice) AS bigint) AS varchar(20)), ' per unit. Email Sales@Acme.com.sg or call +65 6123 4567.')
    WHEN 1 THEN concat('From US$', cast(cast(floor(p_retailprice) AS bigint) AS varchar(20)), ' / month for ', p_name, '. Contact jane.doe@acme.sg')
    WHEN 2 THEN concat('$', cast(cast(floor(p_retailprice) AS bigint) AS varchar(20)), ' - $2,500.50 range for ', p_name, ' in stock 2023')
    WHEN 3 THEN concat(p_name, ' $10 or $', cast(cast(floor(p_retailprice) AS bigint) AS varchar(20)), ' each. Obsolete since 2019. PCN-', cast(p_partkey AS varchar(20)))
    WHEN 4 THEN 'Please request a quote via our rfq page. Not recommended for new design.'
    WHEN 5 THEN 'Download our price list PDF. Supplier portal: login to view. Singapore office'
    WHEN 6 THEN concat('Contact us for pricing of ', p_name, '. Last time buy 2024')
    WHEN 7 THEN concat('Part BQ', cast(p_partkey AS varchar(20)), 'A is superseded by TX', cast(p_partkey AS varchar(20)), 'B. Delivery 14 days, 5% discount')
    WHEN 8 THEN 'About our company in Malaysia'
    ELSE '' END AS text,
  CASE p_partkey % 8 WHEN 0 THEN 'find cleaning service quote in Singapore' WHEN 1 THEN 'bulk office chairs price 200 units' WHEN 2 THEN 'contact email for acme' WHEN 3 THEN 'substitute for obsolete mosfet bq2057'
    WHEN 4 THEN 'revalidate pricing still valid' WHEN 5 THEN 'datasheet for lm317 voltage regulator' WHEN 6 THEN 'hello there' ELSE 'managed it support training' END AS query,
  p_size AS size, p_retailprice AS price, p_type AS type
FROM {part}""",
    # A candidate for each order line: scores' inputs.
    "candidates": """
SELECT l_orderkey AS run_id, (l_linenumber * 100000 + l_partkey) * 100000 + l_suppkey * 100 + cast(l_quantity AS bigint) AS seq, l_linenumber AS line, l_suppkey AS supp, l_partkey AS part,
  CASE l_suppkey % 6 WHEN 0 THEN 'EXACT_PRICE' WHEN 1 THEN 'PRICE_RANGE' WHEN 2 THEN 'STARTING_FROM' WHEN 3 THEN 'QUOTE_REQUIRED' WHEN 4 THEN 'CONFLICTING' ELSE 'NOT_FOUND' END AS status,
  CASE l_partkey % 5 WHEN 0 THEN 'rfq_form' WHEN 1 THEN 'contact_email' WHEN 2 THEN 'contact_page' WHEN 3 THEN 'phone' ELSE NULL END AS channel,
  CASE l_partkey % 4 WHEN 0 THEN 'Singapore' WHEN 1 THEN 'Malaysia' WHEN 2 THEN 'Japan' ELSE NULL END AS country,
  cast(l_linenumber % 4 AS bigint) AS refs, l_discount * 10 AS match_score, l_tax * 10 AS confidence, l_quantity AS quantity,
  CASE WHEN l_returnflag = 'R' THEN TRUE ELSE FALSE END AS flagged, l_quantity / 50 AS completeness, l_shipdate AS ts
FROM {lineitem}""",
    # Directed edges between parts, from order lines.
    "edges": """
SELECT concat('part:', cast(l_partkey AS varchar(20))) AS src, concat('part:', cast((l_partkey * 7 + l_linenumber) % 2000 AS varchar(20))) AS dst,
  CASE l_linenumber % 4 WHEN 0 THEN 'CROSS_REFERENCE' WHEN 1 THEN 'SUPERSEDED_BY' WHEN 2 THEN 'STOCKED_AT' ELSE 'SAME_DIE_AS' END AS rel,
  l_discount * 5 + 0.5 AS confidence, l_shipdate AS event_ts, CASE WHEN l_returnflag = 'R' THEN l_shipdate ELSE NULL END AS valid_to, concat('c', cast(l_suppkey AS varchar(20))) AS claim, (l_orderkey * 10 + l_linenumber) * 100 + cast(l_quantity AS bigint) AS seq
FROM {lineitem}""",
    # Facts of users, in order of arrival.
    "facts": """
SELECT user_id AS entity, event_type AS field, event_id AS seq, ts AS event_ts, cast(cast(floor(value) AS bigint) % 7 AS varchar(20)) AS value, value / 100 AS score, event_id % 5 AS reinforced, event_id % 3 AS disputes
FROM {events}""",
}

_TABLES = ("part", "supplier", "lineitem", "events", "orders", "nation", "customer", "pages", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(*names: str) -> str:
    """The views as a WITH clause for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in _TABLES})})" for n in names) + " "
