"""Queries over evidence, references, notes and governance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import fixed, searches
from provena.functions import text as T
from provena.operators import graph, integrity, ranking, verification
from provena.operators.iterate import written
from provena.operators.iterate import side
from provena.plans import query
from provena.plans.extraction import _HOST, _any, _lit
from provena.plans.inputs import duck, table, view
from provena.sources import generator, logs


@query(duck("part_pages") + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id, query ORDER BY id) AS rank FROM part_pages WHERE url <> '') SELECT run_id, query, id, rank, 0.4::double AS confidence FROM n WHERE rank <= 10")
def search_evidence(spark, sf_dir):
    """SRC1: hits of each query as evidence, ten at most."""
    p = view(spark, sf_dir, "part_pages").where("url <> ''")
    return ranking.top_k(p, ["run_id", "query"], [F.asc("id")], 10).select("run_id", "query", "id", F.col("rank").cast("long"), F.lit(0.4).alias("confidence"))


@query("SELECT q AS query, r::int AS rank, 'https://www.' || replace(q, ' ', '-') || '-' || r || '.example/' AS url FROM (VALUES ('pest control'), ('lm 317')) t(q), range(1, 4) s(r)")
def search_hits(spark, sf_dir):
    """SRC4: generated hits from a Python data source."""
    generator.register(spark)
    return spark.read.format("provena_hits").option("queries", "pest control|lm 317").option("limit", 3).load().select("query", "rank", "url")


@query("SELECT page_id, 'https://web.archive.org/cdx/search/cdx?output=json&filter=statuscode%3A200&limit=5&url=' || url_encode(url) AS cdx FROM pages")
def archive_queries(spark, sf_dir):
    """SRC11: an archive's query for each address."""
    return table(spark, sf_dir, "pages").select("page_id", logs.cdx_url(F.col("url")).alias("cdx"))


@query(duck("facts") + "SELECT field, count(*) AS n, max(seq) AS last FROM facts GROUP BY field")
def replay_log(spark, sf_dir):
    """SRC12 to SRC15, SNK2: facts appended to a JSON log with versions, and read again."""
    base = written(spark.range(1), "mark").inputFiles()[0].rsplit("/", 2)[0] + "/log"
    logs.append_log(view(spark, sf_dir, "facts").select(F.lit("1.0").alias("schema_version"), "seq", "entity", "field", "value"), base)
    back = logs.versioned(logs.read_log(spark, base, "schema_version string, seq long, entity long, field string, value string"))
    return back.groupBy("field").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(duck("candidates") + "SELECT run_id, count(*) FILTER (WHERE refs > 0) AS supported, count(*) FILTER (WHERE refs = 0) AS dropped FROM candidates GROUP BY run_id")
def enforce_evidence(spark, sf_dir):
    """FLT3: slot items without references go, with their count."""
    return view(spark, sf_dir, "candidates").groupBy("run_id").agg(F.count_if(F.col("refs") > 0).alias("supported"), F.count_if(F.col("refs") == 0).alias("dropped"))


@query(duck("facts") + "SELECT entity, seq FROM facts WHERE CASE WHEN disputes = 0 THEN TRUE WHEN disputes = 1 THEN FALSE ELSE FALSE END AND regexp_matches(field, '^[A-Za-z0-9_-]+$')")
def rfq_eligible(spark, sf_dir):
    """FLT4, FLT9: active facts with a valid id may be asked about; disputed only by choice, stale never."""
    return view(spark, sf_dir, "facts").where((F.col("disputes") == 0) & F.col("field").rlike("^[A-Za-z0-9_-]+$")).select("entity", "seq")


@query(duck("part_pages") + f", e AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(text, {_lit(fixed.EMAIL)}), lambda x: lower(x)))) AS email FROM part_pages), p AS (SELECT id, email, split_part(email, '@', 1) NOT IN ({', '.join(map(_lit, fixed.ROLE_LOCALPARTS))}) AND regexp_matches(split_part(email, '@', 1), {_lit(fixed.NAMED_PERSON)}) AS private FROM e) SELECT id, CASE WHEN private THEN '[redacted:high_sensitivity_contact]' ELSE email END AS value, private FROM p")
def redact_contacts(spark, sf_dir):
    """FLT7: personal contacts are masked."""
    e = view(spark, sf_dir, "part_pages").select("id", F.explode(T.emails(F.col("text"))).alias("email"))
    private = T.privacy_class(F.col("email")) == "named_person_high_sensitivity"
    return e.select("id", F.when(private, "[redacted:high_sensitivity_contact]").otherwise(F.col("email")).alias("value"), private.alias("private"))


@query(duck("candidates") + ", r AS (SELECT run_id, status, supp, min(seq) AS first FROM candidates GROUP BY run_id, status, supp), d AS (SELECT run_id, supp, min(first) AS first FROM r GROUP BY run_id, supp) SELECT run_id, count(*) AS refs, min_by(supp, first) AS lead FROM d GROUP BY run_id")
def evidence_bundles(spark, sf_dir):
    """FLT11, SET7: a run's distinct references in order of fields."""
    d = verification.first_rows(view(spark, sf_dir, "candidates").select("run_id", "supp", "seq"), ["run_id", "supp"], "seq")
    return d.groupBy("run_id").agg(F.count("*").alias("refs"), F.min_by("supp", "seq").alias("lead"))


_TIES = ("entity", "field", "value")
_SHARED = [[k for k, on in zip(_TIES, (m & 4, m & 2, m & 1), strict=True) if on] for m in range(1, 8)]


@query(duck("facts") + ", " + ", ".join(f"k{i} AS (SELECT * FROM (SELECT {', '.join(s)}, seq AS other, row_number() OVER (PARTITION BY {', '.join(s)} ORDER BY seq) AS rn FROM facts) WHERE rn <= 3)" for i, s in enumerate(_SHARED)) + ", c AS (" + " UNION ".join(f"SELECT a.seq, k.other FROM facts a JOIN k{i} k USING ({', '.join(s)}) WHERE k.other < a.seq" for i, s in enumerate(_SHARED)) + "), l AS (SELECT c.seq, c.other, (3 * (a.entity = b.entity)::int + (a.field = b.field)::int + (a.value = b.value)::int)::int AS score FROM c JOIN facts a ON a.seq = c.seq JOIN facts b ON b.seq = c.other), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, other) AS rn FROM l) SELECT seq, other, score FROM r WHERE rn <= 3")
def link_notes(spark, sf_dir):
    """JN10, MEM12: each note's three best earlier notes: 3 for the entity, 1 for each other tag that they share."""
    return graph.linked(view(spark, sf_dir, "facts").select("seq", *_TIES), "seq", {"entity": 3, "field": 1, "value": 1}, 3)


@query(duck("candidates") + ", c AS (SELECT DISTINCT supp FROM candidates WHERE refs > 1) SELECT s_suppkey, s_suppkey IN (SELECT supp FROM c) AS cited FROM supplier")
def cited_facts(spark, sf_dir):
    """JN11: facts that some candidate cites."""
    cited = view(spark, sf_dir, "candidates").where("refs > 1").select(F.col("supp").alias("s_suppkey")).distinct().withColumn("cited", F.lit(True))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(cited, "s_suppkey", "left").select("s_suppkey", F.coalesce("cited", F.lit(False)).alias("cited"))


@query(duck("part_pages") + "SELECT run_id, greatest(1, count(DISTINCT nullif(url, ''))) AS sources, round(count(*) FILTER (WHERE id % 3 = 0) / count(*)::double, 3) AS found_rate, round(avg(CASE WHEN id % 4 > 0 THEN price END), 4) AS mean_other FROM part_pages GROUP BY run_id")
def run_metrics(spark, sf_dir):
    """AG12, AG14 to AG16: distinct sources, rates and means of a run."""
    p = view(spark, sf_dir, "part_pages").groupBy("run_id")
    return p.agg(F.greatest(F.lit(1), F.count_distinct(F.nullif(F.col("url"), F.lit("")))).alias("sources"), F.round(F.count_if(F.col("id") % 3 == 0) / F.count("*"), 3).alias("found_rate"), F.round(F.avg(F.when(F.col("id") % 4 > 0, F.col("price"))), 4).alias("mean_other"))


@query(duck("part_pages") + f", h AS (SELECT run_id, id, {_HOST} AS host FROM part_pages), f AS (SELECT run_id, host, min(id) AS id FROM h WHERE {_any('host', (*fixed.BROKERS, *fixed.MARKETPLACES, 'octopart.com'))} GROUP BY run_id, host), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id) AS rn FROM f) SELECT run_id, host, id FROM r WHERE rn <= 8")
def long_tail_sources(spark, sf_dir):
    """WN5, GR10: brokers, marketplaces and aggregators, one row by host, eight a run."""
    p = view(spark, sf_dir, "part_pages").withColumns({"host": T.host(F.col("url")), "tier": T.source_class(F.col("url"), F.lit(""))}).where(F.col("tier").isin("broker", "marketplace", "aggregator"))
    one = p.groupBy("run_id", "host").agg(F.min("id").alias("id"))
    return ranking.top_k(one, ["run_id"], [F.asc("id")], 8).select("run_id", "host", "id")


@query(duck("facts") + "SELECT entity, seq, (epoch_us(event_ts) - min(epoch_us(event_ts)) OVER (PARTITION BY entity)) / 1000000.0::double AS seconds FROM facts")
def reference_clock(spark, sf_dir):
    """WN6: seconds since an entity's first reference."""
    us = F.unix_micros(F.col("event_ts").cast("timestamp"))
    return view(spark, sf_dir, "facts").select("entity", "seq", ((us - F.min(us).over(Window.partitionBy("entity"))) / 1000000.0).alias("seconds"))


@query(duck("part_pages") + ", q AS (SELECT id, list_distinct(string_split(query, ' ')) AS w FROM part_pages), s AS (SELECT DISTINCT type AS name, list_distinct(string_split(lower(type) || ' cleaning office quote price contact', ' ')) AS k FROM part_pages) SELECT id, name, len(list_intersect(w, k)) AS overlap, len(list_intersect(w, k)) / len(list_distinct(list_concat(w, k)))::double AS jaccard FROM q, s WHERE len(list_intersect(w, k)) >= 1")
def match_skills(spark, sf_dir):
    """RNK14, SET5: skills that share tokens with a query; a counted few are given to every task, more are shuffled."""
    p = view(spark, sf_dir, "part_pages")
    s = p.select(F.col("type").alias("name")).distinct().withColumn("k", F.array_distinct(F.split(F.concat(F.lower("name"), F.lit(" cleaning office quote price contact")), " ")))
    q = p.select("id", F.array_distinct(F.split("query", " ")).alias("w"))
    pairs = q.select("id", "w", F.explode("w").alias("t")).join(side(s.select("name", "k", F.explode("k").alias("t"))), "t").groupBy("id", "name").agg(F.count("*").alias("overlap"), F.first("w").alias("w"), F.first("k").alias("k"))
    return pairs.select("id", "name", "overlap", (F.col("overlap") / F.size(F.array_union("w", "k"))).alias("jaccard"))


@query(duck("candidates") + "SELECT a.run_id, a.seq, greatest(a.match_score, b.match_score) AS match_score, greatest(a.completeness, b.completeness) AS completeness, a.refs + b.refs AS refs FROM candidates a JOIN (SELECT run_id, max(match_score) AS match_score, max(completeness) AS completeness, sum(refs) AS refs FROM candidates WHERE flagged GROUP BY run_id) b USING (run_id) WHERE NOT a.flagged")
def merge_repairs(spark, sf_dir):
    """SET3: a bundle's metrics with those of its repair, the better of each."""
    c = view(spark, sf_dir, "candidates")
    b = c.where("flagged").groupBy("run_id").agg(F.max("match_score").alias("m"), F.max("completeness").alias("k"), F.sum("refs").alias("r"))
    return c.where("not flagged").join(b, "run_id").select("run_id", "seq", F.greatest("match_score", "m").alias("match_score"), F.greatest("completeness", "k").alias("completeness"), (F.col("refs") + F.col("r")).alias("refs"))


@query(duck("part_pages") + ", m AS (SELECT id, text, strpos(lower(text), 'price') AS pos FROM part_pages) SELECT id, pos - 1 AS start, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 20), least(pos - 1, 20) + 25) END AS snippet, contains(lower(text), 'obsolete') OR contains(lower(text), 'last time buy') AS risky FROM m")
def locate_spans(spark, sf_dir):
    """EX8, EX47: the span of a term with its surroundings, and risk tags."""
    p = view(spark, sf_dir, "part_pages")
    at = F.locate("price", F.lower("text"))
    risky = T.any_of(F.lower("text"), ("obsolete", "last time buy"))
    return p.select("id", (at - 1).cast("long").alias("start"), F.when(at > 0, F.substring(F.col("text"), F.greatest(F.lit(1), at - 20), F.least(at - 1, F.lit(20)) + 25)).alias("snippet"), risky.alias("risky"))


# A request of each page: its mode and region, and the country that its query names.
_REQUESTS = "r AS (SELECT id, query AS q, CASE size % 4 WHEN 0 THEN 'product_exact_price' WHEN 1 THEN 'revalidation' WHEN 2 THEN 'contact_enrichment_only' ELSE 'service_quote_required' END AS mode, CASE WHEN size % 5 = 0 THEN 'global' ELSE 'SEA' END AS region, CASE WHEN contains(query, 'Singapore') THEN 'Singapore' END AS country FROM part_pages)"
_LISTS = {"product_exact_price": ["price", "public pricing", "bulk price", "MOQ price"], "contact": ["official contact", "email", "phone", "contact page"], "other": ["request quotation", "for quotation", "RFQ", "contact sales"]}


@query(duck("part_pages") + f""", {_REQUESTS}, k AS (SELECT *, CASE WHEN mode IN ('revalidation', 'contact_enrichment_only') THEN 'contact' WHEN mode = 'product_exact_price' THEN mode ELSE 'other' END AS kind FROM r),
t AS (SELECT id, country, q, CASE WHEN region = 'global' THEN list_transform(CASE kind WHEN 'contact' THEN ['official contact', 'email', 'phone', 'contact page'] WHEN 'other' THEN ['vendor', 'request quotation', 'suppliers', 'pricing'] ELSE ['price', 'public pricing', 'supplier price', 'MOQ price'] END, lambda s: q || ' ' || s)
  ELSE list_concat(flatten(list_transform(CASE WHEN country IS NULL THEN ['Singapore', 'Malaysia'] ELSE [country] END, lambda c: list_transform(CASE kind WHEN 'contact' THEN {_LISTS['contact']} WHEN 'other' THEN {_LISTS['other']} ELSE {_LISTS['product_exact_price']} END, lambda s: q || ' ' || c || ' ' || s))),
    [q || ' Southeast Asia ' || CASE kind WHEN 'contact' THEN 'contact' WHEN 'other' THEN 'vendor' ELSE 'supplier price' END]) END AS l FROM k)
SELECT id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS search, CASE WHEN country IS NOT NULL THEN 'SG' END AS location FROM t""")
def expand_queries(spark, sf_dir):
    """EX22, EX53: a query's templates by mode, region and country, with location code."""
    r = spark.sql("WITH " + _REQUESTS.replace("part_pages", "{part_pages}") + " SELECT * FROM r", part_pages=view(spark, sf_dir, "part_pages"))
    code = T.lookup(F.col("country"), fixed.COUNTRY_CODE)
    made = searches.templates(*map(F.col, ("q", "mode", "region", "country")))
    return r.select("id", F.posexplode(made).alias("pos", "search"), code.alias("location")).withColumn("pos", F.col("pos").cast("long"))


@query(duck("part_pages") + """, f AS (SELECT *, ['quote_channel', 'contact_email', 'price', 'moq', 'lifecycle_status', 'size'][1 + size % 6] AS field, ' ' || lower(vendor_name || ' ' || text) || ' ' AS low FROM part_pages)
SELECT id, CASE WHEN regexp_matches(low, 'singapore|sg ') THEN 'Singapore' WHEN regexp_matches(low, 'malaysia|kuala lumpur|pembekal') THEN 'Malaysia' WHEN regexp_matches(low, 'indonesia|jakarta') THEN 'Indonesia' WHEN regexp_matches(low, 'thailand|bangkok') THEN 'Thailand' WHEN regexp_matches(low, 'vietnam|hanoi|ho chi minh') THEN 'Vietnam' WHEN regexp_matches(low, 'philippines|manila') THEN 'Philippines' END AS geo,
  CASE field WHEN 'quote_channel' THEN 'sourcing' WHEN 'contact_email' THEN 'contact' WHEN 'lifecycle_status' THEN 'lifecycle' WHEN 'size' THEN 'general' ELSE 'pricing' END AS stage, price > 1500 OR regexp_matches(lower(text), 'nrnd|eol|obsolete|last-time-buy|ltb|nla|discontinued|counterfeit') AS risk FROM f""")
def note_tags(spark, sf_dir):
    """EX47, MEM12: the country, stage and risk that a fact's note is tagged with."""
    field = F.get(F.array(*(F.lit(x) for x in ("quote_channel", "contact_email", "price", "moq", "lifecycle_status", "size"))), F.col("size") % 6)
    tags = T.note_tags(F.col("vendor_name"), field, F.col("text"), F.col("price") > 1500)
    return view(spark, sf_dir, "part_pages").select("id", tags.alias("t")).select("id", "t.*")


@query(duck("part_pages") + ", v AS (SELECT id, CASE id % 3 WHEN 0 THEN 'a@b.sg' WHEN 1 THEN '+65 6123 4567' ELSE 'https://x.sg/c' END AS value FROM part_pages) SELECT id, CASE WHEN contains(value, '@') THEN 'contact_email' WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 7 THEN 'phone' ELSE 'contact_page' END AS type, id % 3 = 0 OR id % 5 = 0 AS promoted FROM v")
def recalled_channels(spark, sf_dir):
    """EX54: the kind of a remembered channel, and whether a contact is promoted."""
    k = F.col("id")
    value = F.when(k % 3 == 0, "a@b.sg").when(k % 3 == 1, "+65 6123 4567").otherwise("https://x.sg/c")
    return view(spark, sf_dir, "part_pages").select("id", T.channel_of_value(value).alias("type"), ((k % 3 == 0) | (k % 5 == 0)).alias("promoted"))


@query(duck("edges") + ", n AS (SELECT src AS id, rel AS k, claim AS v, seq FROM edges), l AS (SELECT id, k, max_by(v, seq) AS v FROM n GROUP BY id, k) SELECT id, (SELECT max_by(k, seq) FROM n m WHERE m.id = l.id) AS type, string_agg(k || '=' || v, ',' ORDER BY k) AS props FROM l GROUP BY id")
def upsert_nodes(spark, sf_dir):
    """GR1: nodes with the last type and the last value of each property."""
    n = view(spark, sf_dir, "edges").select(F.col("src").alias("id"), F.col("rel").alias("type"), F.create_map("rel", "claim").alias("props"), "seq")
    return graph.upsert_nodes(n).select("id", "type", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("props"))


@query("WITH r AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS corpus FROM documents WHERE text IS NOT NULL GROUP BY source) SELECT source, length(corpus) AS chars, sha256(corpus) AS digest FROM r")
def evidence_corpora(spark, sf_dir):
    """CTL13, EX16: the texts of a source in order, as one; its length and digest are folded over sorted batches."""
    return integrity.joined_digest(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text")


@query(duck("facts") + ", b AS (SELECT entity, seq, field = 'error' AS bad, sum(CASE WHEN field <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY event_ts, seq) AS grp FROM facts), r AS (SELECT entity, grp, count(*) FILTER (WHERE bad) AS run FROM b GROUP BY entity, grp) SELECT entity, max(run) AS longest, max(run) >= 5 AS opened FROM r GROUP BY entity")
def circuit_breakers(spark, sf_dir):
    """CTL15: the longest run of failures, which any success ends; five open the breaker."""
    w = Window.partitionBy("entity").orderBy("event_ts", "seq")
    bad = F.col("field") == "error"
    b = view(spark, sf_dir, "facts").withColumn("grp", F.sum(F.when(bad, 0).otherwise(1)).over(w))
    r = b.groupBy("entity", "grp").agg(F.count_if(bad).alias("run")).groupBy("entity").agg(F.max("run").alias("longest"))
    return r.withColumn("opened", F.col("longest") >= 5)


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE event_id % 10 = 0) AS malformed FROM events GROUP BY event_type")
def malformed_outputs(spark, sf_dir):
    """CTL16: structured outputs that don't parse are counted, never guessed."""
    e = table(spark, sf_dir, "events").withColumn("out", F.when(F.col("event_id") % 10 == 0, F.concat(F.col("props"), F.lit("{"))).otherwise(F.col("props")))
    e = e.withColumn("out", F.when(F.col("event_id") % 10 == 0, F.lit('{"k": ')).otherwise(F.col("out")))
    p = F.from_json("out", "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(p["_bad"].isNotNull()).alias("malformed"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 0 ELSE floor(log2(n_nationkey + 1))::int END AS level FROM nation")
def plan_levels(spark, sf_dir):
    """CTL3: topological levels of a plan."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    edges = n.where("id > 0").select(F.floor((F.col("id") - 1) / 2).cast("int").alias("src"), F.col("id").alias("dst"))
    return verification.levels(edges, n)


@query()
def salted_leaves(spark, sf_dir):
    """INT7: leaves hidden behind a keyed salt; tests hold the salt against Python's hmac."""
    f = view(spark, sf_dir, "facts").select("seq", F.concat_ws("|", "field", "value").alias("leaf"))
    salt = integrity.hmac_sha256(b"key", F.col("seq").cast("string"))
    return f.select("seq", F.sha2(F.concat(F.unhex(salt), F.lit(b"\x00"), F.col("leaf").cast("binary")), 256).alias("redacted"))


@query("""
WITH j AS (SELECT click_id, CASE WHEN json_valid(props) THEN props::json END AS p FROM clicks),
f AS (SELECT click_id, p, list_filter([
  CASE WHEN json_exists(p, '$.device') THEN '"device": {"os": ' || json_extract(p, '$.device.os')::varchar || ', "ver": ' || json_extract(p, '$.device.ver')::varchar || '}' END,
  CASE WHEN json_exists(p, '$.items') THEN '"items": [' || coalesce(array_to_string(list_transform(json_extract(p, '$.items[*]'), lambda i: '{"qty": ' || json_extract(i, '$.qty')::varchar || ', "sku": ' || json_extract(i, '$.sku')::varchar || '}'), ', '), '') || ']' END,
  CASE WHEN json_exists(p, '$.k') THEN '"k": ' || json_extract(p, '$.k')::varchar END,
  CASE WHEN json_type(p, '$.tags') = 'NULL' THEN '"tags": null' WHEN json_exists(p, '$.tags') THEN '"tags": [' || coalesce(array_to_string(json_extract(p, '$.tags[*]')::varchar[], ', '), '') || ']' END], lambda x: x IS NOT NULL) AS parts FROM j)
SELECT click_id, CASE WHEN p IS NOT NULL THEN sha256('{' || array_to_string(parts, ', ') || '}') END AS digest FROM f""")
def canonical_digests(spark, sf_dir):
    """EX16: the digest of each click's properties as canonical JSON; broken ones have none."""
    return integrity.canonical_digests(table(spark, sf_dir, "clicks").select("click_id", "props"), "props").select("click_id", "digest")
