"""Append-only JSON logs: torn tails, schema versions, atomic replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log up to its first torn line; blank lines are skipped. Each row has its file and line.

    The cut is found by one aggregation of line numbers and joined back, not by reading the log in order.
    """
    raw = spark.read.schema("value string").text(path, wholetext=False).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    rows = raw.withColumn("row", F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}))
    torn = rows.where(F.col("row._torn").isNotNull()).groupBy("file").agg(F.min("line").alias("cut"))
    kept = rows.join(F.broadcast(torn), "file", "left").where(F.col("cut").isNull() | (F.col("line") < F.col("cut")))
    return kept.select("file", "line", "row.*").drop("_torn")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def versioned(df: DataFrame) -> DataFrame:
    """Rows, which fail the job if one has another schema version."""
    return df.where(F.coalesce(F.assert_true(F.col("schema_version") == SCHEMA_VERSION, F.lit("another schema version")).cast("boolean"), F.lit(True)))


def fetched(pages: DataFrame, verdict: str = "verdict", budget: int | None = None, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept with confidence .6 or .4 and a 500 character snippet, errors) of judged pages; empty addresses go."""
    from pyspark.sql import Window

    rows = pages.where(F.coalesce(F.col("url"), F.lit("")) != "")
    if budget is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or ["run_id"])).orderBy("id"))).where(F.col("_n") <= budget).drop("_n")
    kept = rows.where(F.col(verdict) != "reject").withColumns({"confidence": F.when(F.col(verdict) == "accept", 0.6).otherwise(0.4), "snippet": F.left("text", F.lit(500))})
    return kept, rows.where(F.col(verdict) == "reject").select("id", "url", verdict)


def recovered(errors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Errors with the newest successful archive snapshot (url, timestamp, status, original) of their address."""
    newest = snapshots.where("status = 200").groupBy("url").agg(F.max_by("original", "timestamp").alias("original"), F.max("timestamp").alias("timestamp"))
    return errors.join(newest, "url").withColumn("confidence", F.lit(0.5))


def cdx_url(url, limit: int = 5):
    return F.concat(F.lit("https://web.archive.org/cdx/search/cdx?output=json&filter=statuscode%3A200&limit="), F.lit(str(limit)), F.lit("&url="), F.url_encode(url))


def mermaid(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, diagram): Mermaid text of distinct (src, rel, dst), labels escaped and cut at 80 characters."""
    label = lambda c: F.left(F.regexp_replace(c, r'["\[\]{}|<>]', " "), F.lit(80))
    line = F.concat(F.lit("  "), label(F.col("src")), F.lit(" -->|"), label(F.col("rel")), F.lit("| "), label(F.col("dst")))
    lines = edges.select(*by, line.alias("line")).distinct()
    return lines.groupBy(*by).agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("diagram"))


def latest_snapshot(body):
    """(stamp, original) of the newest capture in an archive's JSON answer, or null; columns by its header, else second and third."""
    rows = F.from_json(body, "array<array<string>>")

    def place(name: str, default: int):
        header = F.get(rows, 0)
        both = (F.array_position(header, "timestamp") > 0) & (F.array_position(header, "original") > 0)
        return F.when(both, (F.array_position(header, name) - 1).cast("int")).otherwise(default)

    at, of = place("timestamp", 1), place("original", 2)
    valid = F.filter(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.size(r) > F.greatest(at, of))
    found = F.transform(valid, lambda r: F.struct(F.get(r, at).alias("stamp"), F.get(r, of).alias("original")))
    newest = F.aggregate(found, F.get(found, 0), lambda a, x: F.when(x["stamp"] > a["stamp"], x).otherwise(a))
    return F.when(F.size(found) > 0, newest)
