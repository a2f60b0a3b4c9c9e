"""Policies: settings by indented keys, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flattened(policies: DataFrame) -> DataFrame:
    """(policy, path, value) of policies (policy, text): a row for each scalar, its path the keys that it stands under.

    Blank lines and comments are skipped. A key stands under the nearest line before it that is indented less.
    """
    lines = policies.select("policy", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(r"^\s*[A-Za-z0-9_.-]+\s*:"))
    lines = lines.select("policy", "pos", F.length(F.regexp_extract("line", r"^( *)", 1)).alias("depth"), F.regexp_extract("line", r"^\s*([A-Za-z0-9_.-]+)\s*:", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("line", r":(.*)$", 1), r"(^|\s)#.*$", "")), "^[\"']|[\"']$", "").alias("value"))
    before = F.collect_list(F.struct("depth", "key")).over(Window.partitionBy("policy").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))

    def climb(a, x):
        above = x["depth"] < a["depth"]
        return F.struct(F.when(above, x["depth"]).otherwise(a["depth"]).alias("depth"), F.when(above, F.concat_ws(".", x["key"], a["path"])).otherwise(a["path"]).alias("path"))

    path = F.aggregate(F.reverse("before"), F.struct(F.col("depth").alias("depth"), F.col("key").alias("path")), climb, lambda a: a["path"])
    return lines.withColumn("before", before).where("value <> ''").select("policy", path.alias("path"), "value")
