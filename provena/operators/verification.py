"""Claims of candidates and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import fixed
from provena.functions import text as T


def decompose(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, claim_id, field, value, critical): the atomic claims of a candidate.

    Columns: vendor_name, price, status, moq, channel_value, contacts (array of type and value).
    """
    subject = F.trim(F.coalesce("vendor_name", F.lit("")))
    text = lambda c: F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    claim = lambda field, value, critical: F.struct(F.lit(field).alias("field"), value.alias("value"), critical.alias("critical"))
    own = F.array(
        claim("vendor_name", F.when((subject != "") & (F.lower(subject) != "unknown vendor"), subject), F.lit(False)),
        claim("price", text(F.col("price")), ~F.coalesce(F.col("status").isin(*fixed.NON_PRICED), F.lit(False))),
        claim("moq", F.when(F.col("moq") > 0, F.col("moq").cast("string")), F.lit(False)),
        claim("quote_channel", F.col("channel_value"), F.lit(True)),
    )
    contacts = F.transform(F.coalesce("contacts", F.array().cast("array<struct<type:string,value:string>>")), lambda c: F.struct(F.concat(F.lit("contact_"), c["type"]).alias("field"), c["value"].alias("value"), F.lit(True).alias("critical")))
    rows = candidates.select(*keys, subject.alias("subject"), F.explode(F.filter(F.concat(own, contacts), lambda c: c["value"].isNotNull())).alias("c"))
    claim_id = F.concat(F.lit("vclaim_"), F.left(F.sha2(F.concat_ws("|", "subject", "c.field", "c.value").cast("binary"), 256), F.lit(12)))
    return rows.select(*keys, claim_id.alias("claim_id"), "c.field", "c.value", "c.critical")


def spans(claims: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, claim, fault): claims (by, claim, parent, start, end, span_hash, snippet, snippet_hash) against their parent pages (by, id, text).

    The first of seven faults, or "ok"; a claim with neither offset is not checked ("unchecked"). One left join on the
    parent; the order of the checks is the order of the cases. An end beyond the text leaves a shorter span, an empty
    span is one, and a snippet is in line with its span if either holds the other or it is blank.
    """
    page = pages.select(*by, F.col("id").alias("parent"), F.lit(True).alias("_there"), "text")
    joined = claims.join(page, [*by, "parent"], "left")
    found = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    snippet = F.coalesce("snippet", F.lit(""))
    bare = F.regexp_replace(snippet, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    aligned = (bare == "") | F.contains(found, bare) | F.contains(snippet, found)
    fault = (
        F.when(F.col("start").isNull() & F.col("end").isNull(), "unchecked")
        .when(F.coalesce(F.col("parent").cast("string"), F.lit("")) == "", "no_parent_id")
        .when(F.col("_there").isNull(), "no_parent")
        .when(F.col("text").isNull(), "no_text")
        .when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start")), "bad_offsets")
        .when(~F.coalesce(sha(found) == F.col("span_hash"), F.lit(False)), "span_hash")
        .when(~F.coalesce(sha(snippet) == F.col("snippet_hash"), F.lit(False)), "snippet_hash")
        .when(~aligned, "not_aligned")
        .otherwise("ok")
    )
    return joined.select(*by, "claim", fault.alias("fault"))


def contradictions(pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, contradiction): .6 where an earlier page of the same host names only other prices.

    Earlier pages are reduced to their distinct price sets by host before the join.
    """
    prices = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(T.ignoring_case(fixed.PAGE_PRICE)), F.lit(0)), lambda p: F.upper(F.regexp_replace(p, r"\s+", ""))))
    rows = pages.select(*by, "id", T.host(F.col("url")).alias("host"), F.array_sort(prices).alias("prices")).where(F.size("prices") > 0)
    before = rows.groupBy(*by, "host", "prices").agg(F.min("id").alias("first")).withColumnRenamed("prices", "other")
    bad = rows.join(before, [*by, "host"]).where((F.col("first") < F.col("id")) & ~F.arrays_overlap("prices", "other")).select(*by, "id").distinct().withColumn("c", F.lit(0.6))
    return pages.select(*by, "id").join(bad, [*by, "id"], "left").select(*by, "id", F.coalesce("c", F.lit(0.0)).alias("contradiction"))


def same_vendor(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``left`` (by, id, vendor) with the first row of ``right`` (by, seq, vendor) of the same vendor.

    Names match when one's key holds the other's. The distinct keys meet on the first characters, three at most, of
    one and any as many of the other, so that no two lists are compared pair by pair.
    """
    a = left.select(*by, "id", T.vendor_key(F.col("vendor")).alias("_k")).where("_k <> ''")
    b = right.select(*by, "seq", T.vendor_key(F.col("vendor")).alias("_o")).where("_o <> ''").groupBy(*by, "_o").agg(F.min("seq").alias("seq"))
    keys = a.select(*by, "_k").distinct()
    start = lambda c: F.left(F.col(c), F.lit(3))

    def inside(c: str):
        runs = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*(F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3))))
        return F.explode(F.array_distinct(F.flatten(runs)))

    one = keys.withColumn("_g", inside("_k")).join(b.withColumn("_g", start("_o")), [*by, "_g"]).where(F.contains("_k", F.col("_o")))
    two = keys.withColumn("_g", start("_k")).join(b.withColumn("_g", inside("_o")), [*by, "_g"]).where(F.contains("_o", F.col("_k")))
    first = one.unionByName(two).groupBy(*by, "_k").agg(F.min("seq").alias("seq"))
    return a.join(first, [*by, "_k"]).select(*by, "id", "seq")


def gaps(bundles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap, query): what a bundle lacks, and the query that would repair it."""
    service = F.col("mode") == "service_quote_required"
    kinds = F.array(
        F.when(service & (F.col("quote_channel") < 0.5), "quote_channel"), F.when(service & (F.col("checklist") < 0.6), "checklist"), F.when(service & (F.col("geo") < 0.5), "geo"),
        F.when(~service & (F.col("fff_similarity") < 0.5), "fff_conflict"), F.when(~service & (F.col("datasheet_evidence") < 0.5), "datasheet"), F.when(F.col("disputed") > 0, "price_conflict"),
    )
    rows = bundles.select(*keys, "query", F.explode(F.array_compact(kinds)).alias("gap"))
    template = T.lookup(F.col("gap"), fixed.REPAIR_QUERIES)
    return rows.select(*keys, "gap", F.replace(template, F.lit("{q}"), F.col("query")).alias("repair"))


def ladder(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, strategy, applicable): six rungs for each part, from on_hand, ltb, reclaimed, alternates, sources."""
    tests = (F.coalesce((F.col("on_hand") > 0) | F.col("ltb").isNotNull(), F.lit(False)), F.col("reclaimed"), F.col("alternates") > 0, F.col("sources") > 0, F.lit(True), F.lit(True))
    rungs = F.array(*(F.struct(F.lit(i + 1).alias("rank"), F.lit(s).alias("strategy"), t.alias("applicable")) for i, (s, t) in enumerate(zip(fixed.DMSMS_LADDER, tests, strict=True))))
    return parts.select(*keys, F.explode(rungs).alias("r")).select(*keys, "r.*")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level) of a plan's nodes (id) under edges (src before dst): each level waits only for those before it.

    A cycle or an unknown dependency is an error. Each round is a join over what is still open.
    """
    from provena.operators.iterate import written

    if not edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").isEmpty():
        raise ValueError("an edge names an unknown node")
    todo, out = written(nodes.select("id").distinct(), "todo"), None
    level = 0
    while not todo.isEmpty():
        waits = edges.join(todo.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        ready = todo.join(waits, "id", "left_anti").withColumn("level", F.lit(level))
        if ready.isEmpty():
            raise ValueError("the plan has a cycle")
        out = ready if out is None else out.unionByName(ready)
        todo, level = written(todo.join(waits, "id", "left_semi"), "todo"), level + 1
    return out if out is not None else nodes.select("id").withColumn("level", F.lit(0))


def first_rows(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First-wins distinct in the order of ``seq``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")
