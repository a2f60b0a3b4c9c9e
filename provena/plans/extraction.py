"""Queries over page texts: extraction, classification, relevance."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import fixed, scores
from provena.functions import text as T
from provena.operators import dedupe
from provena.plans import query
from provena.plans.inputs import duck, table, view


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains({col}, {_lit(t)})" for t in terms) + ")"


def _hits(col: str, terms) -> str:
    return "(" + " + ".join(f"cast(contains({col}, {_lit(t)}) AS int)" for t in terms) + ")"


def _case(col: str, mapping: dict, default="NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" ELSE {default} END"


def _list(terms) -> str:
    return "[" + ", ".join(map(_lit, terms)) + "]"


_I = "'(?i)' || "
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


@query(duck("part_pages") + f"""
, p AS (SELECT id, text, regexp_extract_all(text, {_I}{_lit(fixed.PRICE)}, 1) AS tok, list_transform(regexp_extract_all(text, {_I}{_lit(fixed.PRICE)}, 2), lambda x: cast(replace(x, ',', '') AS double)) AS v FROM part_pages),
s AS (SELECT *, CASE WHEN len(v) > 0 THEN CASE WHEN regexp_matches(text, {_I}{_lit(fixed.PRICE_RANGE)}) THEN 'PRICE_RANGE' WHEN regexp_matches(text, {_I}{_lit(fixed.STARTING)}) THEN 'STARTING_FROM'
  WHEN len(list_distinct(v)) >= 2 AND list_max(v) > list_min(v) * 1.5 THEN 'CONFLICTING' ELSE 'EXACT_PRICE' END
  WHEN regexp_matches(text, {_I}{_lit(fixed.RATE_CARD_PRICE)}) THEN 'RATE_CARD_FOUND' WHEN regexp_matches(text, {_I}{_lit(fixed.QUOTE_PHRASE)}) THEN 'QUOTE_REQUIRED' WHEN regexp_matches(text, {_I}{_lit(fixed.CONTACT_PRICE)}) THEN 'CONTACT_FOR_PRICING' ELSE 'NOT_FOUND' END AS status FROM p)
SELECT id, status, CASE WHEN status <> 'CONFLICTING' THEN v[1] END AS price, {_case('lower(tok[1])', fixed.CURRENCY)} AS currency, CASE WHEN len(v) > 0 THEN nullif(lower(regexp_extract(text, {_I}{_lit(fixed.UNIT)}, 1)), '') END AS unit, len(v) AS n_prices FROM s""")
def extract_pricing(spark, sf_dir):
    """EX1: status, price, currency and unit of each page."""
    return view(spark, sf_dir, "part_pages").select("id", T.pricing(F.col("text")).alias("x")).select("id", "x.*").withColumn("n_prices", F.col("n_prices").cast("long"))


@query(duck("part_pages") + f"""
, e AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, {_lit(fixed.EMAIL)}), lambda x: lower(x)))) AS email FROM part_pages)
SELECT id, email, CASE WHEN split_part(email, '@', 1) IN ({', '.join(map(_lit, fixed.ROLE_LOCALPARTS))}) THEN 0.85 WHEN regexp_matches(split_part(email, '@', 1), {_lit(fixed.NAMED_PERSON)}) THEN 0.7 ELSE 0.55 END::double AS confidence,
  CASE WHEN split_part(email, '@', 1) NOT IN ({', '.join(map(_lit, fixed.ROLE_LOCALPARTS))}) AND regexp_matches(split_part(email, '@', 1), {_lit(fixed.NAMED_PERSON)}) THEN 'named_person_high_sensitivity' ELSE 'business_contact' END AS privacy FROM e""")
def extract_contacts(spark, sf_dir):
    """EX3, EX4: distinct addresses with confidence and privacy class."""
    e = view(spark, sf_dir, "part_pages").select("id", F.explode(T.emails(F.col("text"))).alias("email"))
    return e.select("id", "email", T.email_confidence(F.col("email")).alias("confidence"), T.privacy_class(F.col("email")).alias("privacy"))


@query(duck("part_pages") + f"""
, l AS (SELECT *, CASE id % 4 WHEN 0 THEN 'https://x.sg/rfq' WHEN 1 THEN 'https://x.sg/contact-us' WHEN 2 THEN 'https://x.sg/rate-card' ELSE 'https://x.sg/' END AS link FROM part_pages),
c AS (SELECT id, 0 AS pos, CASE WHEN regexp_matches(link, {_I}{_lit(fixed.RFQ_LINK)}) THEN 'rfq_form' WHEN regexp_matches(link, {_I}{_lit(fixed.CONTACT_LINK)}) THEN 'contact_page' WHEN regexp_matches(link, {_I}{_lit(fixed.RATE_CARD)}) THEN 'rate_card' END AS type, link AS value FROM l
  UNION ALL SELECT id, 1, 'contact_email', nullif(regexp_extract(text, {_lit(fixed.EMAIL)}), '') FROM l
  UNION ALL SELECT id, 2, 'phone', trim(list_filter(regexp_extract_all(text, {_lit(fixed.PHONE)}), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 7)[1]) FROM l
  UNION ALL SELECT id, 3, 'portal_login_required', CASE WHEN regexp_matches(text, {_I}{_lit(fixed.PORTAL)}) THEN url END FROM l
  UNION ALL SELECT id, 4, 'rate_card', nullif(regexp_extract(text, {_I}{_lit(fixed.RATE_CARD)}, 1), '') FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {_case('type', fixed.CHANNEL_PRIORITY)} DESC, pos) AS rn, count(*) OVER (PARTITION BY id) AS n FROM c WHERE type IS NOT NULL AND value IS NOT NULL)
SELECT id, n AS n_channels, type AS best_type, value AS best_value FROM r WHERE rn = 1""")
def extract_quote_channels(spark, sf_dir):
    """EX2, RNK11: a page's channels, and the best of them."""
    p = view(spark, sf_dir, "part_pages")
    link = F.when(F.col("id") % 4 == 0, "https://x.sg/rfq").when(F.col("id") % 4 == 1, "https://x.sg/contact-us").when(F.col("id") % 4 == 2, "https://x.sg/rate-card").otherwise("https://x.sg/")
    c = p.select("id", T.quote_channels(F.col("text"), F.array(link), F.col("url")).alias("c")).where(F.size("c") > 0)
    return c.select("id", F.size("c").cast("long").alias("n_channels"), T.best_channel(F.col("c")).alias("b")).select("id", "n_channels", F.col("b.type").alias("best_type"), F.col("b.value").alias("best_value"))


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z]{{3,}}'), lambda w: NOT list_contains(" + _list(fixed.SERVICE_STOPWORDS) + ", w)))"


@query(duck("part_pages") + f"""
, t AS (SELECT id, {_TERMS.format('query')} AS q, {_TERMS.format('text')} AS d FROM part_pages),
s AS (SELECT id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0.0 END AS share FROM t)
SELECT id, share >= 0.34 AS matched, round(share::double, 3) AS score FROM s""")
def extract_service_match(spark, sf_dir):
    """EX5: the share of a query's terms that a page has."""
    return view(spark, sf_dir, "part_pages").select("id", T.service_match(F.col("query"), F.col("text")).alias("x")).select("id", "x.*")


@query(duck("part_pages") + f"""
, h AS (SELECT *, {_HOST} AS host FROM part_pages)
SELECT id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS registrable,
  CASE WHEN contains(lower(vendor_name), 'pte ltd') THEN 'Singapore' WHEN contains(lower(vendor_name), 'pte. ltd') THEN 'Singapore' WHEN contains(lower(vendor_name), 'sdn bhd') THEN 'Malaysia' WHEN contains(lower(vendor_name), 'pt ') THEN 'Indonesia'
  {' '.join(f"WHEN ends_with(host, {_lit(k)}) THEN {_lit(v)}" for k, v in fixed.TLD_COUNTRY.items())} {' '.join(f"WHEN contains(text, {_lit(c)}) THEN {_lit(c)}" for c in fixed.COUNTRIES)} END AS country FROM h""")
def extract_vendor_metadata(spark, sf_dir):
    """EX6, EX10, EX12: host, registrable domain and country."""
    return view(spark, sf_dir, "part_pages").select("id", T.host(F.col("url")).alias("host"), T.registrable(F.col("url")).alias("registrable"), T.country(F.col("vendor_name"), F.col("url"), F.col("text")).alias("country"))


_CANON = r"""'https://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END"""
_PATH = r"regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"
_QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT (" + " OR ".join(f"starts_with(lower(p), {_lit(x)})" for x in fixed.TRACKING_PREFIXES) + "))), '&')"


@query(f"SELECT page_id, {_CANON.format(host=_HOST, path=_PATH, q=_QUERY)} AS canonical, {_HOST} AS host FROM pages")
def canonical_urls(spark, sf_dir):
    """EX11: canonical addresses of the crawled pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.host(F.col("url")).alias("host"))


def _suffix(domains) -> str:
    return "(" + " OR ".join(f"host = {_lit(d)} OR ends_with(host, {_lit('.' + d)})" for d in domains) + ")"


_CLASS = rf"""CASE WHEN {_any('host', fixed.MARKETPLACES)} THEN 'marketplace' WHEN {_suffix(fixed.DISTRIBUTORS)} THEN 'distributor' WHEN {_suffix(fixed.MANUFACTURERS)} THEN 'manufacturer' WHEN {_any('host', fixed.BROKERS)} THEN 'broker'
  WHEN {_suffix(fixed.AGGREGATORS)} THEN 'aggregator' WHEN regexp_matches(host, '\.(gov|edu)(\.|$)') THEN 'government' WHEN {_any('lower(text)', fixed.BUSINESS_SIGNALS)} THEN 'business' ELSE 'unknown' END"""


@query(duck("part_pages") + f"""
, h AS (SELECT *, {_HOST} AS host FROM part_pages), c AS (SELECT id, {_CLASS} AS source_class FROM h)
SELECT id, source_class, {_case('source_class', fixed.RELIABILITY)}::double AS reliability, round(0.75 * {_case('source_class', fixed.RELIABILITY)}::double, 6) AS effective FROM c""")
def source_reliability(spark, sf_dir):
    """EX13 to EX15: source class, reliability and effective confidence."""
    c = view(spark, sf_dir, "part_pages").select("id", T.source_class(F.col("url"), F.col("text")).alias("source_class"))
    return c.select("id", "source_class", T.reliability(F.col("source_class")).alias("reliability"), F.round(0.75 * T.reliability(F.col("source_class")), 6).alias("effective"))


_MODE = f"""
, n AS (SELECT id, lower(query) AS q FROM part_pages), c AS (SELECT id, {_hits('q', fixed.SUBSTITUTE_INTENT)} AS sub, {_hits('q', fixed.OBSOLESCENCE_INTENT)} AS obs, {_hits('q', fixed.ELECTRONICS_TERMS)} AS comp, {_hits('q', fixed.REVALIDATION_INTENT)} AS reval,
  {_hits('q', fixed.CONTACT_INTENT)} AS contact, {_hits('q', fixed.PRICE_INTENT)} AS price, {_hits('q', fixed.SERVICE_TERMS)} AS service, {_hits('q', fixed.SERVICE_INTENT)} AS intent, {_hits('q', fixed.PRODUCT_TERMS)} AS product,
  cast(regexp_matches(q, {_I}{_lit(fixed.QUERY_MPN)}) AS int) AS mpn, cast(regexp_matches(q, {_lit(fixed.QUANTITY)}) AS int) AS quantity FROM n),
s AS (SELECT id, unnest([{{'m': 'electronics_substitution', 'i': 0, 's': CASE WHEN sub > 0 OR obs > 0 OR (mpn > 0 AND comp > 0) THEN 2.0 * sub + 1.5 * obs + 1.5 * comp + 1.5 * mpn ELSE 0.0 END::double}}, {{'m': 'revalidation', 'i': 1, 's': (3.0 * reval)::double}},
  {{'m': 'contact_enrichment_only', 'i': 2, 's': (2.0 * contact - 1.5 * price - 1.0 * intent)::double}}, {{'m': 'service_quote_required', 'i': 3, 's': (2.0 * service + 1.5 * intent)::double}}, {{'m': 'product_exact_price', 'i': 4, 's': (1.5 * product + 1.5 * price + 1.0 * quantity)::double}}]) AS x FROM c),
r AS (SELECT id, x.m AS m, x.s AS s, row_number() OVER (PARTITION BY id ORDER BY x.s DESC, x.i) AS rn, lead(x.s) OVER (PARTITION BY id ORDER BY x.s DESC, x.i) AS nxt FROM s)
"""


@query(duck("part_pages") + _MODE + "SELECT id, CASE WHEN s <= 0 THEN 'service_quote_required' ELSE m END AS mode, round(least(0.99, greatest(0.3, 0.5 + 0.15 * (s - nxt)))::double, 2) AS confidence FROM r WHERE rn = 1")
def classify_mode(spark, sf_dir):
    """EX17: the mode of each query."""
    return view(spark, sf_dir, "part_pages").select("id", T.mode(F.col("query")).alias("x")).select("id", "x.*")


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z0-9][a-z0-9\\-]*'), lambda w: length(w) > 2 AND NOT list_contains(" + _list((*fixed.CONTENT_STOPWORDS, *fixed.GENERIC_TERMS, *fixed.GEO_TERMS)) + ", w)))"
_REL = f"round((0.6 * CASE WHEN len({_CONTENT}) > 0 THEN len(list_filter({_CONTENT}, lambda t: contains(lower(text), t))) / len({_CONTENT}) ELSE 1.0 END + 0.4 * cast({_any('lower(text)', fixed.PROCUREMENT_SIGNALS)} AS int))::double, 4)"


@query(duck("part_pages") + f"""
, r AS (SELECT run_id, id, text, {_REL} AS rel FROM part_pages), a AS (SELECT run_id, avg(rel) AS mean, max(rel) AS most, count(*) AS pages FROM r WHERE text <> '' GROUP BY run_id)
SELECT run_id, round(mean, 4) AS mean_relevance, most AS max_relevance, pages, CASE WHEN mean >= 0.5 OR most >= 0.6 THEN 'correct' WHEN mean <= 0.1 AND most <= 0.2 THEN 'incorrect' ELSE 'ambiguous' END AS verdict FROM a""")
def retrieval_verdict(spark, sf_dir):
    """EX18, EX19, AG9: relevance of a run's pages and its verdict."""
    p = view(spark, sf_dir, "part_pages").where("text <> ''").select("run_id", T.page_relevance(F.col("query"), F.col("text")).alias("rel"))
    a = p.groupBy("run_id").agg(F.avg("rel").alias("mean"), F.max("rel").alias("max_relevance"), F.count("*").alias("pages"))
    return a.select("run_id", F.round("mean", 4).alias("mean_relevance"), "max_relevance", "pages", scores.crag_verdict(F.col("mean"), F.col("max_relevance"), F.col("pages")).alias("verdict"))


def _life(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), {_lit(chr(92) + 'b(?:' + '|'.join(w) + ')' + chr(92) + 'b')}) THEN {_lit(s)}" for s, w in fixed.LIFECYCLE) + " ELSE 'unknown' END"


@query(duck("part_pages") + f"""
, l AS (SELECT id, {_life('text')} AS state, regexp_matches(lower(text), {_lit(fixed.PCN_PHRASE)}) OR regexp_matches(lower(text), {_lit(fixed.PCN_ID)}) AS pcn FROM part_pages)
SELECT id, state, pcn, {_case('state', fixed.LIFECYCLE_SEVERITY)} AS severity, {_case('state', fixed.LIFECYCLE_LABEL)} AS label FROM l""")
def lifecycle_signals(spark, sf_dir):
    """EX23, EX24: lifecycle state, change notices and severity."""
    p = view(spark, sf_dir, "part_pages").select("id", T.lifecycle(F.col("text")).alias("state"), T.has_pcn(F.col("text")).alias("pcn"))
    return p.withColumns({"severity": T.lookup(F.col("state"), fixed.LIFECYCLE_SEVERITY), "label": T.lookup(F.col("state"), fixed.LIFECYCLE_LABEL)})


@query(duck("part_pages") + f"""
, d AS (SELECT id, run_id, {_life('text')} AS state FROM part_pages), s AS (SELECT *, {_case('state', fixed.LIFECYCLE_SEVERITY)} AS sev FROM d),
w AS (SELECT *, lag(sev) OVER (PARTITION BY run_id ORDER BY id) AS before FROM s) SELECT run_id, id, state, before AS old_severity, sev AS new_severity FROM w WHERE sev > before""")
def datasheet_changes(spark, sf_dir):
    """EX25: versions of a datasheet whose lifecycle got worse."""
    from pyspark.sql import Window

    d = view(spark, sf_dir, "part_pages").select("run_id", "id", T.lifecycle(F.col("text")).alias("state"))
    d = d.withColumn("new_severity", T.lookup(F.col("state"), fixed.LIFECYCLE_SEVERITY))
    d = d.withColumn("old_severity", F.lag("new_severity").over(Window.partitionBy("run_id").orderBy("id")))
    return d.where("new_severity > old_severity").select("run_id", "id", "state", "old_severity", "new_severity")


@query(duck("part_pages") + f"""
, m AS (SELECT id, list_distinct(list_transform(list_filter(regexp_extract_all(text, {_lit(fixed.PROSE_MPN)}), lambda w: length(w) >= 4 AND regexp_matches(w, '[0-9]')), lambda w: upper(w))) AS m FROM part_pages)
, u AS (SELECT id, unnest(m) AS mpn FROM m) SELECT id, mpn, 'part:' || regexp_replace(lower(mpn), '[^a-z0-9]', '', 'g') AS key FROM u""")
def extract_part_numbers(spark, sf_dir):
    """EX26, EX27: part numbers in prose and their keys."""
    return view(spark, sf_dir, "part_pages").select("id", F.explode(T.mpns(F.col("text"))).alias("mpn")).withColumn("key", T.entity_key("part", F.col("mpn")))


@query(duck("part_pages") + f"""
, c AS (SELECT id, list_transform(regexp_extract_all(text, {_I}{_lit(fixed.NUMERIC_CLAIM)}), lambda x: lower(trim(x))) AS c, lower(query) AS corpus FROM part_pages)
, u AS (SELECT DISTINCT id, corpus, unnest(c) AS claim FROM c) SELECT id, claim FROM u WHERE NOT contains(corpus, claim)""")
def unsourced_claims(spark, sf_dir):
    """EX31: amounts and durations that the evidence doesn't hold."""
    return view(spark, sf_dir, "part_pages").select("id", F.explode(T.numeric_claims(F.col("text"), F.col("query"))).alias("claim"))


@query(duck("part_pages") + f"""
, h AS (SELECT *, {_HOST} AS host FROM part_pages), j AS (SELECT id, {_REL} AS relevance, {_case('(' + _CLASS + ')', fixed.AUTHORITY)}::double AS authority,
  CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, {_lit(fixed.YEAR)}), lambda y: cast(y AS int)), lambda y: y BETWEEN 1990 AND 2025)) = 0 THEN 0.5 ELSE round(greatest(0.0, 1 - (2024 - least(list_max(list_filter(list_transform(regexp_extract_all(text, {_lit(fixed.YEAR)}), lambda y: cast(y AS int)), lambda y: y BETWEEN 1990 AND 2025)), 2024)) / 10)::double, 4) END AS fresh FROM h),
s AS (SELECT *, round(least(1.0, greatest(0.0, 0.4 * relevance + 0.35 * authority + 0.15 * fresh))::double, 4) AS score FROM j)
SELECT id, relevance, authority, fresh, score, CASE WHEN authority <= 0.25 OR relevance <= 0.1 THEN 'reject' WHEN authority < 0.5 OR fresh <= 0.25 OR score < 0.45 THEN 'flag' ELSE 'accept' END AS verdict FROM s""")
def page_gate(spark, sf_dir):
    """JDG1, EX48: relevance, authority and freshness of a page, and whether it is let in."""
    p = view(spark, sf_dir, "part_pages")
    p = p.select("id", T.page_relevance(F.col("query"), F.col("text")).alias("relevance"), T.lookup(T.source_class(F.col("url"), F.col("text")), fixed.AUTHORITY).alias("authority"), T.freshness(F.col("text"), 2024).alias("fresh"))
    args = (F.col("relevance"), F.col("authority"), F.col("fresh"), F.lit(0.0))
    return p.withColumns({"score": scores.page_score(*args), "verdict": scores.page_verdict(*args)})


@query(duck("part_pages") + f"""
, h AS (SELECT *, {_HOST} AS host FROM part_pages), k AS (SELECT run_id, id, vendor_name, 'd:' || array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS key, size FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY size DESC, id) AS rn FROM k) SELECT run_id, key, id, vendor_name, size FROM r WHERE rn = 1""")
def dedupe_candidates(spark, sf_dir):
    """DD2: of a run's candidates of one domain the one with most evidence."""
    p = view(spark, sf_dir, "part_pages").select("run_id", "id", "vendor_name", F.col("url").alias("website"), "size")
    return dedupe.candidates(p, ["run_id"], "size", "id").select("run_id", "key", "id", "vendor_name", "size")


@query(duck("part_pages") + f"""
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(query), {_lit(chr(92) + 'b(?:' + '|'.join(fixed.REGION_WORDS) + ')' + chr(92) + 'b')}, '{{region}}', 'g'), '\\d+', '{{number}}', 'g'), '\\s+', ' ', 'g')) AS skeleton FROM part_pages""".replace("{{", "{").replace("}}", "}"))
def query_skeletons(spark, sf_dir):
    """EX46: queries with regions and numbers as placeholders."""
    return view(spark, sf_dir, "part_pages").select("id", T.skeleton(F.col("query")).alias("skeleton"))


_TITLE = r"regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '(?i)\s*[|\-–—:]\s*(home|contact|contact us|about|about us|welcome|official site).*$', '')"


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, trim({_TITLE}) AS title FROM pages)
SELECT page_id, CASE WHEN host <> '' THEN 'https://' || host END AS website, CASE WHEN title <> '' THEN title WHEN host <> '' THEN array_to_string(list_transform(string_split(replace(string_split(host, '.')[1], '-', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') ELSE 'Unknown Vendor' END AS name FROM p""")
def vendor_pages(spark, sf_dir):
    """EX6: the vendor's name and website of each page."""
    p = table(spark, sf_dir, "pages")
    v = T.vendor(F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", v.alias("v")).select("page_id", "v.website", "v.name")
