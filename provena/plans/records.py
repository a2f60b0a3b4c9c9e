"""Queries over stores, proofs, limits, retrieval and watches."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import ed25519, fixed, grounding, similar
from provena.functions import text as T
from provena.operators import graph, integrity, ledger, limits, ranking, verification, walk
from provena.operators.iterate import written
from provena.plans import query
from provena.plans.extraction import _lit
from provena.plans.inputs import duck, table, view
from provena.sources import cards, graphs, logs, policy


def _folder(spark) -> str:
    """A fresh folder that all executors see."""
    return written(spark.range(1), "mark").inputFiles()[0].rsplit("/", 2)[0]


def _ledger(spark, sf_dir):
    f = view(spark, sf_dir, "facts")
    return f.select(F.col("entity").alias("run_id"), "seq", F.sha2(F.concat_ws("|", "field", "value").cast("binary"), 256).alias("digest"))


def _items(spark, sf_dir):
    """Rows of ledgers, a run for each user, with content in JSON."""
    f = view(spark, sf_dir, "facts")
    return f.select(F.col("entity").alias("run_id"), "seq", F.to_json(F.struct("value", "field", F.struct("score", "reinforced").alias("metadata"))).alias("content"))


_CUT = "(SELECT max(seq) * 2 // 3 FROM facts)"


@query(duck("facts") + f"SELECT entity AS run_id, count(*) AS n, max(seq) AS last, CASE WHEN max(seq) > {_CUT} THEN 2 ELSE 1 END AS published, CASE WHEN entity % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status, 0 AS faults FROM facts GROUP BY entity")
def persist_ledgers(spark, sf_dir):
    """SNK1, SRC12, SNK3: the first two thirds of all rows are published, then all, then all again; heads keep their time where a run is unchanged.

    Read again, every seventh run has a row that was tampered with, and no other does not match its head.
    """
    store, items, by = f"{_folder(spark)}/ledgers", _items(spark, sf_dir), ["run_id"]
    cut = items.agg(F.max("seq").alias("s")).first()["s"] * 2 // 3
    for n, rows in enumerate((items.where(F.col("seq") <= cut), items, items)):
        ledger.publish(rows, store, by, F.lit(n + 1))
    back, heads = ledger.committed(spark, store, by), ledger.published(spark, store, by)
    faults = integrity.chain_faults(back, by).groupBy(*by).agg(F.count("*").alias("faults"))
    hit = (F.col("run_id") % 7 == 0) & (F.col("seq") == F.col("_last"))
    bad = back.join(heads.select(*by, F.col("last_seq").alias("_last")), by).withColumn("content", F.when(hit, "{}").otherwise(F.col("content"))).drop("_last")
    told = ledger.checked(bad, heads, by).join(faults, by, "left")
    return told.select("run_id", F.col("tree_size").alias("n"), F.col("last_seq").alias("last"), F.col("published_at").alias("published"), "status", F.coalesce("faults", F.lit(0)).cast("int").alias("faults"))


@query(duck("facts") + f", r AS (SELECT entity, min(seq) AS a, max(seq) AS z, count(*) FILTER (WHERE seq <= {_CUT}) AS old, count(*) AS n FROM facts GROUP BY entity) SELECT entity AS run_id, (a <= {_CUT})::int + (z <= {_CUT} AND a <> z)::int AS refused, n AS rows, CASE WHEN a > {_CUT} THEN 0 WHEN z > {_CUT} THEN n - 1 ELSE n END AS unchanged, 0 AS faults FROM r")
def annotate_ledgers(spark, sf_dir):
    """INT1: each run's first and last rows get new content; what its head covers is refused, the rest of the chain is linked anew from there."""
    items, by = _items(spark, sf_dir), ["run_id"]
    cut = items.agg(F.max("seq").alias("s")).first()["s"] * 2 // 3
    heads = ledger.roots(items.where(F.col("seq") <= cut), by)
    rows = written(ledger.sealed(items, by), "sealed")
    ends = items.groupBy(*by).agg(F.array_distinct(F.array(F.min("seq"), F.max("seq"))).alias("s")).select(*by, F.explode("s").alias("seq"), F.lit('{"verified": true}').alias("content"))
    new, refused = ledger.annotate(rows, heads, ends, by)
    new = written(new, "annotated")
    same = new.join(rows.select(*by, "seq", F.col("chain_hash").alias("old")), [*by, "seq"]).groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col("old") == F.col("chain_hash")).alias("unchanged"))
    faults = integrity.chain_faults(new, by).groupBy(*by).agg(F.count("*").alias("faults"))
    told = same.join(refused.groupBy(*by).agg(F.count("*").alias("refused")), by, "left").join(faults, by, "left")
    return told.select("run_id", F.coalesce("refused", F.lit(0)).cast("int").alias("refused"), "rows", "unchanged", F.coalesce("faults", F.lit(0)).cast("int").alias("faults"))


@query(duck("facts") + "SELECT status, count(*) AS n, min(seq) AS first FROM (SELECT seq, CASE WHEN score > 0.9 THEN 'approved' WHEN score < 0.1 THEN 'rejected' ELSE 'pending' END AS status FROM facts WHERE disputes = 1) GROUP BY status")
def review_store(spark, sf_dir):
    """SRC16: reviews written as a versioned log, read again and listed by status."""
    path = f"{_folder(spark)}/reviews"
    status = F.when(F.col("score") > 0.9, "approved").when(F.col("score") < 0.1, "rejected").otherwise("pending")
    logs.append_log(view(spark, sf_dir, "facts").where("disputes = 1").select(F.lit(logs.SCHEMA_VERSION).alias("schema_version"), "seq", status.alias("status")), path)
    back = logs.versioned(logs.read_log(spark, path, "schema_version string, seq long, status string"))
    return back.groupBy("status").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '2021' ELSE '20230101' END AS stamp, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'b' ELSE url END AS original FROM pages")
def latest_snapshots(spark, sf_dir):
    """SRC10: the newest capture in an archive's answer; a header alone, short rows or no JSON give none."""
    p = table(spark, sf_dir, "pages")
    row = lambda *c: F.concat(F.lit('["'), F.concat_ws('","', *c), F.lit('"]'))
    header = F.lit('[["urlkey","timestamp","original"]')
    body = F.when(F.col("page_id") % 8 == 0, "not json").when(F.col("page_id") % 4 == 0, F.concat(header, F.lit("]"))).when(F.col("page_id") % 4 == 1, F.lit('[["original","x","timestamp"],["a","","2019"],["b","","2021"],["c"]]'))
    body = F.coalesce(body, F.concat(header, F.lit(","), row(F.lit("k"), F.lit("20200101"), F.lit("old")), F.lit(","), row(F.lit("k"), F.lit("20230101"), F.col("url")), F.lit("]")))
    return p.select("page_id", logs.latest_snapshot(body).alias("s")).select("page_id", F.col("s.stamp").alias("stamp"), F.col("s.original").alias("original"))


@query(duck("facts") + "SELECT run_id, n * 2 // 3 + 1 AS first, n AS size, TRUE AS ok, FALSE AS forged FROM (SELECT entity AS run_id, count(*) AS n FROM facts GROUP BY 1)")
def merkle_consistency(spark, sf_dir):
    """INT5, INT6: proofs that each run's first two thirds are the start of its tree; one with a changed leaf proves nothing."""
    rows, by = _ledger(spark, sf_dir), ["run_id"]
    sizes = rows.groupBy(*by).agg((F.floor(F.count("*") * 2 / 3) + 1).alias("first"))
    blocks = integrity.merkle_blocks(rows, by, "digest")
    proofs = integrity.consistency_proofs(rows, by, "digest", sizes, blocks)
    early = integrity.early_roots(blocks, by, sizes).withColumnRenamed("root", "early")
    roots = integrity.merkle_root(rows, by, "digest", blocks).join(early, by).drop("first")
    other = F.sha2(F.col("early").cast("binary"), 256)
    got = proofs.join(roots, "run_id")
    ok = lambda root: integrity.consistent(F.col("first"), F.col("size"), root, F.col("root"), F.col("path"))
    return got.select("run_id", "first", "size", ok(F.col("early")).alias("ok"), ok(other).alias("forged"))


@query(duck("facts") + ", c AS (SELECT entity, seq, epoch_us(event_ts) / 1000000.0::double AS called, row_number() OVER (PARTITION BY entity ORDER BY event_ts, seq) AS n FROM facts), w AS (WITH RECURSIVE b AS (SELECT entity, seq, n, 4.0::double AS tokens, called AS last, 0.0::double AS wait FROM c WHERE n = 1 UNION ALL SELECT x.entity, x.seq, x.n, CASE WHEN x.t >= 1 THEN x.t - 1 ELSE 0.0 END, x.now + CASE WHEN x.t >= 1 THEN 0.0 ELSE (1 - x.t) / (5.0 / 60.0)::double END, x.now + CASE WHEN x.t >= 1 THEN 0.0 ELSE (1 - x.t) / (5.0 / 60.0)::double END - x.called FROM (SELECT c.entity, c.seq, c.n, c.called, greatest(c.called, b.last) AS now, least(5.0::double, b.tokens + (greatest(c.called, b.last) - b.last) * (5.0 / 60.0)::double) AS t FROM b JOIN c ON c.entity = b.entity AND c.n = b.n + 1) x) SELECT * FROM b) SELECT entity, count(*) AS calls, count(*) FILTER (WHERE wait > 0) AS waited, round(max(wait), 3) AS longest FROM w GROUP BY entity")
def token_buckets(spark, sf_dir):
    """CTL2: five calls a minute by key, with refill; how many waited and the longest wait."""
    c = view(spark, sf_dir, "facts").select("entity", "seq", (F.unix_micros(F.col("event_ts").cast("timestamp")) / 1000000.0).alias("at"))
    w = limits.buckets(c, ["entity"])
    return w.groupBy("entity").agg(F.count("*").alias("calls"), F.count_if(F.col("wait") > 0).alias("waited"), F.round(F.max("wait"), 3).alias("longest"))


@query(duck("part_pages") + ", m AS (SELECT id, regexp_extract(text, '([A-Z0-9]+) is superseded by', 1) AS s, regexp_extract(text, 'is superseded by ([A-Z0-9]+)', 1) AS d FROM part_pages WHERE text LIKE '%is superseded by%') SELECT 'part:' || lower(s) AS src, 'part:' || lower(d) AS dst, 'SUPERSEDED_BY' AS rel, id AS claim, NULL::bigint AS valid_to FROM m")
def ingest_texts(spark, sf_dir):
    """GR3: edges from prose with their page as claim; newer objects of functional relations close older ones."""
    return graph.ingest(view(spark, sf_dir, "part_pages")).select("src", "dst", "rel", "claim", "valid_to")


@query(duck("part_pages") + ", m AS (SELECT id, lower(regexp_extract(text, '([A-Z0-9]+) is superseded by', 1)) AS s, lower(regexp_extract(text, 'is superseded by ([A-Z0-9]+)', 1)) AS d FROM part_pages WHERE text LIKE '%is superseded by%') SELECT 'part:' || s AS src, 'part:' || d AS dst, 'CROSS_REFERENCE' AS rel, id AS claim, 0.7::double AS confidence, 0.85::double AS reliability FROM m")
def legacy_edges(spark, sf_dir):
    """GR13: cross-reference edges from replacement tables."""
    x = view(spark, sf_dir, "part_pages").select("id", F.explode(T.cross_references(F.col("text"))).alias("x"))
    key = lambda c: T.entity_key("part", c)
    return x.select(key(F.col("x.original")).alias("src"), key(F.col("x.replacement")).alias("dst"), F.lit("CROSS_REFERENCE").alias("rel"), F.col("id").alias("claim"), F.lit(0.7).alias("confidence"), F.lit(0.85).alias("reliability"))


def _named_edges(spark, sf_dir):
    e = view(spark, sf_dir, "edges")
    name = lambda c: F.regexp_replace(c, "^part:", "part:bq")
    return e.withColumns({"src": name("src"), "dst": name("dst"), "reliability": F.lit(0.85)}).where("valid_to is null")


@query()
def retrieve_parts(spark, sf_dir):
    """GR6: the five parts nearest to the two that each query names; tests hold it against a plain loop."""
    key = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(key.alias("query_id"), F.concat(F.lit("replacement for BQ"), (key + 100).cast("string"), F.lit(" or bq"), (key * 3 + 110).cast("string")).alias("text"))
    return graph.retrieve(_named_edges(spark, sf_dir), asked)


@query(duck("edges") + "SELECT src, count(*) AS edges, count(*) FILTER (WHERE old OR valid_to IS NULL) AS open FROM (SELECT src, dst, rel, claim, arg_max_null(valid_to, seq) AS valid_to, max(seq) % 2 = 0 AS old FROM edges GROUP BY src, dst, rel, claim) GROUP BY src")
def graph_store(spark, sf_dir):
    """SRC17: edges of files from before and after edges could be closed, read as one table; older ones are open."""
    e, path = view(spark, sf_dir, "edges").withColumn("reliability", F.lit(0.85)), f"{_folder(spark)}/edges"
    graphs.append_edges(e.where("seq % 2 = 0").drop("valid_to"), path)
    graphs.append_edges(e.where("seq % 2 <> 0"), path)
    return graphs.read_edges(spark, path).groupBy("src").agg(F.count("*").alias("edges"), F.count_if(F.col("valid_to").isNull()).alias("open"))


@query(duck("facts") + "SELECT entity AS run_id, count(*) AS tree_size, entity % 5 <> 0 AS valid FROM facts GROUP BY entity")
def signed_heads(spark, sf_dir):
    """INT8: signed heads of all ledgers; every fifth had its size changed after it was signed."""
    key = bytes(range(32))  # stands for a key that the caller keeps
    heads = ledger.roots(_items(spark, sf_dir), ["run_id"]).withColumn("published_at", F.lit("2024-01-01T00:00:00Z"))
    heads = written(ledger.signed(heads, ["run_id"], key), "signed")
    forged = heads.withColumn("tree_size", F.when(F.col("run_id") % 5 == 0, F.col("tree_size") + 1).otherwise(F.col("tree_size")))
    told = ledger.signatures_hold(forged, ["run_id"], ed25519.public_key(key))
    return told.select("run_id", F.when(F.col("run_id") % 5 == 0, F.col("tree_size") - 1).otherwise(F.col("tree_size")).alias("tree_size"), "valid")


@query()
def budgeted_walks(spark, sf_dir):
    """GR14: a walk from each part's name, with the lenses' verdicts from a table; tests hold it against a plain recursion."""
    roots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), F.concat("p_name", F.lit(" substitute")).alias("query"))
    edges, leaves = walk.walk(roots)
    leaves = leaves.groupBy("root").agg(F.count("*").alias("leaves"), F.count_if("verified").alias("verified"), F.count_if(~F.col("agree")).alias("disputed"))
    grown = edges.groupBy("root").agg(F.count("*").alias("edges"), F.max("depth").alias("depth"), F.max_by("child", F.struct("depth", "child")).alias("last"))
    return grown.join(leaves, "root").select("root", "edges", "depth", "last", "leaves", "verified", "disputed")


@query()
def discover_substitutes(spark, sf_dir):
    """GR9: for each query the substitutes within two edges of its parts that are still made, the eight nearest by PageRank."""
    e, nations = _named_edges(spark, sf_dir), table(spark, sf_dir, "nation")
    asked = nations.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("substitute for BQ"), (F.col("n_nationkey") * 4 + 100).cast("string")).alias("text"))
    state = T.lookup(F.col("p_size") % 6, {0: "EOL", 1: "nrnd", 2: "End of Life", 3: "active", 4: "Obsolete"})
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:bq"), F.col("p_partkey").cast("string")).alias("id"), state.alias("lifecycle"))
    found = graph.nearest_substitutes(e, asked).join(parts, "id", "left").where(grounding.alive(F.col("lifecycle"), F.lit(1)))
    return ranking.top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], 8).select("query_id", "id", "depth", "confidence", F.col("rank").cast("long"))


@query()
def lexical_rank(spark, sf_dir):
    """RNK15: the five parts whose names are most like the query, without the graph; tests hold it against difflib."""
    nodes = _named_edges(spark, sf_dir).select(F.col("src").alias("id")).distinct()
    scored = nodes.withColumn("score", similar.ratio(F.lit("replacement for bq1 or bq2"), F.col("id")))
    return scored.orderBy(F.desc("score"), "id").limit(5)


_STATE = "CASE WHEN regexp_matches(lower(text), '\\b(end of life|end-of-life|obsolete|discontinued|eol)\\b') THEN 'eol' WHEN regexp_matches(lower(text), '\\b(last time buy|last-time-buy|ltb)\\b') THEN 'ltb' WHEN contains(lower(text), 'not recommended for new design') THEN 'nrnd' ELSE 'unknown' END"


@query(duck("part_pages", "edges") + f", w AS (SELECT id, {_STATE} AS state, regexp_matches(lower(text), '\\b(pcn|pdn)\\b[\\s#:.-]*\\d') AS pcn FROM part_pages), a AS (SELECT src, count(DISTINCT dst) AS n FROM edges WHERE valid_to IS NULL AND src <> dst AND rel IN ({', '.join(_lit(r) for r in fixed.SUBSTITUTE_RELS)}) GROUP BY src) SELECT w.id, state, CASE WHEN pcn AND state = 'unknown' THEN 'pcn_alert' ELSE 'lifecycle_deprecation' END AS signal, coalesce(n, 0) AS alternates, CASE WHEN state = 'unknown' THEN 0 ELSE 2 + (coalesce(n, 0) > 0)::int END AS rungs FROM w LEFT JOIN a ON a.src = 'part:' || w.id WHERE state <> 'unknown' OR pcn")
def watch_risks(spark, sf_dir):
    """GR11: parts at risk, with the alternates that the graph knows and the rungs of the ladder that apply."""
    p = view(spark, sf_dir, "part_pages")
    state, pcn = T.lifecycle(F.col("text")), T.has_pcn(F.col("text"))
    risky = T.lookup(state, fixed.LIFECYCLE_SEVERITY, 0) >= fixed.LIFECYCLE_SEVERITY["nrnd"]
    w = p.where(risky | pcn).select("id", state.alias("state"), F.when(pcn & ~state.isin("nrnd", "eol", "ltb"), "pcn_alert").otherwise("lifecycle_deprecation").alias("signal"), F.concat(F.lit("part:"), F.col("id").cast("string")).alias("src"))
    e = graph.current(view(spark, sf_dir, "edges"), fixed.SUBSTITUTE_RELS).where("src <> dst").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    w = w.join(e, "src", "left").withColumn("alternates", F.coalesce("n", F.lit(0)))
    parts = w.select("id", F.lit(0).alias("on_hand"), F.lit(None).cast("int").alias("ltb"), F.lit(False).alias("reclaimed"), "alternates", F.lit(0).alias("sources"))
    rungs = verification.ladder(parts, ["id"]).where("applicable").groupBy("id").agg(F.count("*").alias("rungs"))
    return w.join(rungs, "id").select("id", "state", "signal", "alternates", F.when(F.col("state") == "unknown", 0).otherwise(F.col("rungs")).cast("int").alias("rungs"))


@query(duck("part_pages", "edges") + f", s1 AS (SELECT p.run_id, count(DISTINCT dst) AS n FROM part_pages p JOIN edges e ON e.src = 'part:' || p.id WHERE valid_to IS NULL AND src <> dst AND rel IN ({', '.join(_lit(r) for r in fixed.SUBSTITUTE_RELS)}) GROUP BY p.run_id), s2 AS (SELECT run_id, count(DISTINCT CASE id % 8 WHEN 1 THEN 'shop.alibaba.example' WHEN 4 THEN 'rochester.example' WHEN 5 THEN 'octopart.com' END) AS n FROM part_pages GROUP BY run_id), s3 AS (SELECT run_id, count(*) FILTER (WHERE {_STATE} <> 'unknown') AS n FROM part_pages GROUP BY run_id) SELECT s2.run_id, least(8, coalesce(s1.n, 0)) AS substitutes, least(8, s2.n) AS sources, s3.n AS risks FROM s2 JOIN s3 USING (run_id) LEFT JOIN s1 USING (run_id)")
def build_discovery(spark, sf_dir):
    """GR12: a run's discovery in three slots: substitutes and long-tail sources, eight at most each, and risks."""
    p = view(spark, sf_dir, "part_pages")
    e = graph.current(view(spark, sf_dir, "edges"), fixed.SUBSTITUTE_RELS).where("src <> dst").select("src", "dst")
    s1 = p.select("run_id", F.concat(F.lit("part:"), F.col("id").cast("string")).alias("src")).join(e, "src").groupBy("run_id").agg(F.count_distinct("dst").alias("s1"))
    rare = T.source_class(F.col("url"), F.lit("")).isin("broker", "marketplace", "aggregator")
    rest = p.groupBy("run_id").agg(F.count_distinct(F.when(rare, T.host(F.col("url")))).alias("s2"), F.count_if(T.lookup(T.lifecycle(F.col("text")), fixed.LIFECYCLE_SEVERITY, 0) >= fixed.LIFECYCLE_SEVERITY["nrnd"]).alias("risks"))
    most = lambda c: F.least(F.lit(8), F.coalesce(c, F.lit(0)))
    return rest.join(s1, "run_id", "left").select("run_id", most("s1").alias("substitutes"), most("s2").alias("sources"), "risks")


@query("SELECT event_id, event_type IN ('search', 'view', 'click', 'purchase') AS allowed FROM events")
def allowed_tools(spark, sf_dir):
    """FLT13: calls of tools on the list."""
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("search", "view", "click", "purchase").alias("allowed"))


@query(duck("candidates") + "SELECT run_id, count(DISTINCT supp) AS urls, least(20, count(*)) AS fetched, least(4, count(*) FILTER (WHERE flagged)) AS searched FROM candidates GROUP BY run_id")
def working_memory(spark, sf_dir):
    """CTL20: distinct addresses of a run, and counters clamped to their caps."""
    c = view(spark, sf_dir, "candidates").groupBy("run_id")
    return c.agg(F.count_distinct("supp").alias("urls"), F.least(F.lit(20), F.count("*")).alias("fetched"), F.least(F.lit(4), F.count_if("flagged")).alias("searched"))


@query(duck("candidates") + "SELECT run_id, sum(quantity::bigint) AS tokens, round(sum(quantity::bigint * CASE WHEN line % 3 = 0 THEN 24 WHEN line % 3 = 1 THEN 3 ELSE 2 END) / 10000000.0::double, 9) AS usd FROM candidates GROUP BY run_id")
def usage_costs(spark, sf_dir):
    """CTL8, CTL9: the tokens that a run used, drained by run, at its models' prices of a thousand."""
    price = T.lookup(F.col("line") % 3, {0: 24, 1: 3}, 2)  # ten-thousandths of a cent a token: whole numbers
    c = view(spark, sf_dir, "candidates").withColumn("tokens", F.col("quantity").cast("bigint"))
    return c.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * price) / 10000000.0, 9).alias("usd"))


@query(duck("candidates") + ", s AS (SELECT run_id, seq, round(confidence::double, 4) AS score, CASE WHEN line % 3 = 0 THEN NULL WHEN line % 3 = 1 THEN 'yes' ELSE 'no' END AS graded FROM candidates WHERE refs > 0) SELECT run_id, count(*) AS claims, count(graded) AS graded, count(*) FILTER (WHERE graded = 'yes') AS correct, count(graded) = count(*) AS usable FROM s GROUP BY run_id")
def calibration_sheets(spark, sf_dir):
    """UNC7: the scored claims of a run as a sheet to grade, and whether all of it is graded."""
    graded = T.lookup(F.col("line") % 3, {1: "yes", 2: "no"})
    s = view(spark, sf_dir, "candidates").where("refs > 0").select("run_id", "seq", F.round("confidence", 4).alias("score"), graded.alias("graded"))
    return s.groupBy("run_id").agg(F.count("*").alias("claims"), F.count("graded").alias("graded"), F.count_if(F.col("graded") == "yes").alias("correct"), (F.count("graded") == F.count("*")).alias("usable"))


@query(duck("part_pages") + "SELECT run_id, string_agg(DISTINCT '  ' || replace(vendor_name, '|', ' ') || ' -->|evidence| page ' || id, chr(10) ORDER BY '  ' || replace(vendor_name, '|', ' ') || ' -->|evidence| page ' || id) AS lines, count(DISTINCT vendor_name) AS vendors FROM part_pages GROUP BY run_id")
def supplier_graphs(spark, sf_dir):
    """SNK4: a run's suppliers and the pages that are their evidence, as Mermaid lines."""
    p = view(spark, sf_dir, "part_pages").select("run_id", F.regexp_replace("vendor_name", r"\|", " ").alias("src"), F.lit("evidence").alias("rel"), F.concat(F.lit("page "), F.col("id").cast("string")).alias("dst"))
    n = p.groupBy("run_id").agg(F.count_distinct("src").alias("vendors"))
    return logs.mermaid(p, ["run_id"]).join(n, "run_id").select("run_id", F.replace("diagram", F.lit("graph TD\n"), F.lit("")).alias("lines"), "vendors")


@query("SELECT DISTINCT p_type AS source, 'skill ' || p_type AS name, 'First line of ' || p_type AS description, 'quote,' || lower(p_brand) AS keywords, 'search' AS tools, 'Ask for ' || p_brand || chr(10) || 'twice.' AS instructions FROM part")
def skill_cards(spark, sf_dir):
    """SRC19: settings and sections of skill cards."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    text = F.concat(F.lit("---\nname: skill "), "p_type", F.lit("\nkeywords: [quote, '"), F.lower("p_brand"), F.lit("']\nallowedTools:\n  - search\n---\n# A card\nFirst line of "), "p_type", F.lit("\n\n## Instructions\n\nAsk for "), "p_brand", F.lit("\ntwice.\n\n## Examples\nnone\n"))
    c = cards.parsed(p.select(F.col("p_type").alias("source"), text.alias("text")))
    return c.select("source", "name", "description", F.array_join("keywords", ",").alias("keywords"), F.array_join("allowed_tools", ",").alias("tools"), "instructions").distinct()


@query("SELECT n_name AS policy, unnest(['budgets.service.searches', 'budgets.service.fetches', 'threshold']) AS path, unnest([(n_nationkey + 1)::varchar, '25', '0.65']) AS value FROM nation")
def load_policies(spark, sf_dir):
    """SRC18: a policy's settings as rows of path and value."""
    text = F.concat(F.lit("# limits\nbudgets:\n  service:\n    searches: "), (F.col("n_nationkey") + 1).cast("string"), F.lit("  # calls\n    fetches: 25\n\nthreshold: '0.65'\n"))
    return policy.flattened(table(spark, sf_dir, "nation").select(F.col("n_name").alias("policy"), text.alias("text")))
