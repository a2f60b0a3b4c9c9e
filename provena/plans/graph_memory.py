"""Queries over the property graph, bi-temporal facts and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import fixed
from provena.functions import text as T
from provena.operators import graph, nearest, temporal
from provena.plans import query
from provena.plans.inputs import duck, table, view

_RELS = ", ".join(f"'{r}'" for r in fixed.SUBSTITUTE_RELS)
_UPSERT = ", e AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, rel, claim ORDER BY seq DESC) AS rn FROM edges) WHERE rn = 1)"


@query(duck("edges") + _UPSERT + "SELECT src, dst, rel, claim, confidence, seq FROM e WHERE valid_to IS NULL")
def graph_current_edges(spark, sf_dir):
    """GR2, FLT6, SRC17: the last version of each edge that is still open."""
    return graph.current(graph.upsert_edges(view(spark, sf_dir, "edges"))).select("src", "dst", "rel", "claim", "confidence", "seq")


@query(duck("edges") + ", c AS (SELECT * FROM edges WHERE valid_to IS NULL), a AS (SELECT src AS start, dst AS id, 1 AS depth, src || ' -> ' || rel || ' -> ' || dst AS path FROM c WHERE src IN ('part:1', 'part:2', 'part:3')) SELECT * FROM a UNION ALL SELECT a.start, c.dst, 2, a.path || ' -> ' || c.rel || ' -> ' || c.dst FROM a JOIN c ON c.src = a.id")
def graph_traverse(spark, sf_dir):
    """GR4, JN6: all walks of two hops from some parts."""
    start = spark.createDataFrame([("part:1",), ("part:2",), ("part:3",)], "id string")
    return graph.traverse(view(spark, sf_dir, "edges"), start)


@query(duck("edges") + f", s AS (SELECT DISTINCT src AS id FROM edges WHERE src LIKE 'part:1%'), c AS (SELECT src, dst, confidence FROM edges WHERE valid_to IS NULL AND rel IN ({_RELS})), one AS (SELECT s.id AS seed, c.dst AS id, 1 AS depth, c.confidence * 0.85 AS confidence FROM s JOIN c ON s.id = c.src), two AS (SELECT DISTINCT seed, id AS src FROM one), f AS (SELECT * FROM one UNION ALL SELECT two.seed, c.dst, 2, c.confidence * 0.7224999999999999 FROM two JOIN c ON two.src = c.src), g AS (SELECT *, row_number() OVER (PARTITION BY seed, id ORDER BY depth, confidence DESC) AS rn FROM f WHERE id NOT IN (SELECT id FROM s)) SELECT seed, id, depth, round(confidence, 6) AS confidence FROM g WHERE rn = 1")
def graph_substitutes(spark, sf_dir):
    """GR7, GR8: substitutes within two hops."""
    e = view(spark, sf_dir, "edges")
    seeds = e.where("src like 'part:1%'").select(F.col("src").alias("id")).distinct()
    return graph.substitutes(e, seeds)


def _ppr_sql(rounds: int) -> str:
    sql = duck("edges") + ", w AS (SELECT src, dst, sum(confidence * 0.85) AS w FROM edges WHERE valid_to IS NULL GROUP BY src, dst), t AS (SELECT src, sum(w) AS t FROM w GROUP BY src), l AS (SELECT w.src, w.dst, w.w / t.t AS share FROM w JOIN t USING (src)), s AS (SELECT DISTINCT src AS id FROM edges WHERE src IN ('part:1', 'part:2', 'part:3')), n AS (SELECT id, max(j) AS j FROM (SELECT src AS id, 0.0::double AS j FROM l UNION ALL SELECT dst, 0.0 FROM l UNION ALL SELECT id, 1.0 / (SELECT count(*) FROM s) FROM s) GROUP BY id), r0 AS (SELECT id, j AS r FROM n)"
    for i in range(rounds):
        sql += f", r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 * n.j + 0.85 * (coalesce(m.m, 0) + n.j * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM t))) AS r FROM n LEFT JOIN (SELECT l.dst AS id, sum(r{i}.r * l.share) AS m FROM l JOIN r{i} ON r{i}.id = l.src GROUP BY l.dst) m USING (id))"
    return sql + f" SELECT id, round(r, 6) AS rank FROM r{rounds}"


@query(_ppr_sql(30))
def graph_pagerank(spark, sf_dir):
    """GR5: personalised PageRank, thirty rounds."""
    e = graph.current(view(spark, sf_dir, "edges"))
    seeds = view(spark, sf_dir, "edges").where(F.col("src").isin("part:1", "part:2", "part:3")).select(F.col("src").alias("id")).distinct()
    return graph.pagerank(e.select("src", "dst", (F.col("confidence") * 0.85).alias("weight")), seeds).select("id", F.round("rank", 6).alias("rank"))


@query(duck("edges") + "SELECT rel, count(*) AS edges, count(*) FILTER (WHERE valid_to IS NULL) AS open, count(DISTINCT src) AS sources FROM edges GROUP BY rel")
def graph_counts(spark, sf_dir):
    """AG17: edges by relation, superseded ones included."""
    return view(spark, sf_dir, "edges").groupBy("rel").agg(F.count("*").alias("edges"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count_distinct("src").alias("sources"))


_FUNCTIONAL = "SELECT src AS key, seq, event_ts, dst FROM edges WHERE rel = 'SUPERSEDED_BY'"


@query(duck("edges") + f", f AS ({_FUNCTIONAL}), p AS (SELECT a.key, a.seq, min_by(b.event_ts, b.seq) AS valid_to FROM f a JOIN f b ON a.key = b.key AND b.seq > a.seq AND b.event_ts > a.event_ts GROUP BY a.key, a.seq) SELECT f.key, f.seq, f.event_ts, p.valid_to FROM f LEFT JOIN p USING (key, seq)")
def fact_versions(spark, sf_dir):
    """TMP1, WN2: closing times under arrival order; late facts stay open."""
    f = view(spark, sf_dir, "edges").where("rel = 'SUPERSEDED_BY'").select(F.col("src").alias("key"), "seq", "event_ts")
    return temporal.versions(f, ["key"])


@query(duck("facts") + ", v AS (SELECT entity, field, seq, event_ts, value, lead(event_ts) OVER (PARTITION BY entity, field ORDER BY event_ts, seq) AS valid_to FROM facts), a AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY event_ts DESC, seq DESC) AS rn FROM v WHERE event_ts <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')) SELECT entity, field, seq, value FROM a WHERE rn = 1")
def facts_as_of(spark, sf_dir):
    """TMP4, JN7: each fact as it was at a time."""
    v = temporal.versions_in_order(view(spark, sf_dir, "facts"), ["entity", "field"])
    return temporal.as_of(v, ["entity", "field"], F.lit("2024-01-15").cast("timestamp")).select("entity", "field", "seq", "value")


@query(duck("facts") + ", a AS (SELECT *, greatest(0.0, (epoch_us(TIMESTAMP '2024-06-30') - epoch_us(event_ts)) / 86400000000) AS age FROM facts) SELECT entity, seq, round(score * exp(-age / ((90.0 / ln(2.0)) * (1 + 0.5 * reinforced) / pow(2.0, disputes))), 4) AS decayed, CASE WHEN age >= 180 THEN 'stale' ELSE 'active' END AS status FROM a")
def decayed_facts(spark, sf_dir):
    """TMP5, TMP6, CTL18: decayed confidence and staleness."""
    f = view(spark, sf_dir, "facts").withColumns({"confidence": F.col("score"), "last_ts": F.col("event_ts")})
    return temporal.aged(f, F.lit("2024-06-30").cast("timestamp")).select("entity", "seq", "decayed", "status")


@query(duck("facts") + ", d AS (SELECT entity, field, min_by(value, (-score, seq)) AS value, max(score) AS score, count(*) AS n, min(seq) AS first FROM facts GROUP BY entity, field, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g')), r AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, first) AS rn, count(*) OVER (PARTITION BY entity, field) AS sides FROM d) SELECT entity, field, value, score AS confidence, n - 1 AS reinforced, sides - 1 AS alternatives, CASE WHEN sides > 1 THEN 'disputed' ELSE 'active' END AS status FROM r WHERE rn = 1")
def memory_upsert(spark, sf_dir):
    """MEM1 to MEM3: one fact for each key; values that differ in letters or digits are disputed sides."""
    d = view(spark, sf_dir, "facts").groupBy("entity", "field", T.alnum(F.col("value")).alias("side")).agg(F.min_by("value", F.struct(-F.col("score"), "seq")).alias("value"), F.max("score").alias("confidence"), F.count("*").alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("entity", "field")
    d = d.withColumns({"rn": F.row_number().over(w.orderBy(F.desc("confidence"), "first")), "sides": F.count("*").over(w)}).where("rn = 1")
    return d.select("entity", "field", "value", "confidence", (F.col("n") - 1).alias("reinforced"), (F.col("sides") - 1).alias("alternatives"), F.when(F.col("sides") > 1, "disputed").otherwise("active").alias("status"))


@query(duck("facts") + ", p AS (SELECT entity % 10 AS wf, row_number() OVER (PARTITION BY entity ORDER BY event_ts, seq) AS pos, entity, field FROM facts), n AS (SELECT wf, count(DISTINCT entity) AS n FROM p GROUP BY wf), s AS (SELECT wf, pos, count(*) AS c, count(DISTINCT field) AS kinds, min(field) AS step FROM p GROUP BY wf, pos), b AS (SELECT s.wf, min(CASE WHEN kinds > 1 OR c < n THEN pos ELSE 1000000000 END) AS brk FROM s JOIN n USING (wf) GROUP BY s.wf) SELECT s.wf, s.pos, s.step, s.kinds FROM s JOIN b USING (wf) WHERE s.pos <= b.brk")
def induce_workflows(spark, sf_dir):
    """MEM10: positions up to the first at which a group's trajectories part."""
    p = view(spark, sf_dir, "facts").select((F.col("entity") % 10).alias("wf"), "entity", "field", F.row_number().over(Window.partitionBy("entity").orderBy("event_ts", "seq")).alias("pos"))
    n = p.groupBy("wf").agg(F.count_distinct("entity").alias("n"))
    s = p.groupBy("wf", "pos").agg(F.count("*").alias("c"), F.count_distinct("field").alias("kinds"), F.min("field").alias("step")).join(n, "wf")
    brk = F.min(F.when((F.col("kinds") > 1) | (F.col("c") < F.col("n")), F.col("pos")).otherwise(1_000_000_000)).over(Window.partitionBy("wf"))
    return s.withColumn("brk", brk).where("pos <= brk").select("wf", F.col("pos").cast("long"), "step", "kinds")


@query(duck("facts") + ", o AS (SELECT entity, field, value, score, lag(value) OVER w AS before, lag(score) OVER w AS was FROM facts WINDOW w AS (PARTITION BY entity, field ORDER BY event_ts, seq)) SELECT entity, field, count(*) FILTER (WHERE before = value) AS confirmed, count(*) FILTER (WHERE before <> value AND score > was + 0.1) AS replaced, count(*) FILTER (WHERE before <> value AND score <= was + 0.1) AS disputed FROM o GROUP BY entity, field")
def revalidate(spark, sf_dir):
    """MEM13: what each newer reading does to the fact before it."""
    w = Window.partitionBy("entity", "field").orderBy("event_ts", "seq")
    o = view(spark, sf_dir, "facts").withColumns({"before": F.lag("value").over(w), "was": F.lag("score").over(w)})
    return o.groupBy("entity", "field").agg(F.count_if(F.col("before") == F.col("value")).alias("confirmed"), F.count_if((F.col("before") != F.col("value")) & (F.col("score") > F.col("was") + 0.1)).alias("replaced"), F.count_if((F.col("before") != F.col("value")) & (F.col("score") <= F.col("was") + 0.1)).alias("disputed"))


@query("SELECT a.vec_id, b.vec_id AS near_id FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, LATERAL (SELECT vec_id FROM embeddings b WHERE b.vec_id <> a.vec_id ORDER BY list_distance(a.embedding, b.embedding), vec_id LIMIT 3) b")
def vector_recall(spark, sf_dir):
    """MEM7: the three nearest vectors of each query vector, exactly."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.exact(e, e.where("vec_id % 20 = 0"), 3).select("vec_id", "near_id")
