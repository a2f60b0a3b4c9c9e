"""A Python data source of synthetic search hits, for tests and offline runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from provena.functions import fixed
from provena.functions import text as T


class HitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("|") if q]
        self.limit = int(options.get("limit", 5))

    def partitions(self):
        return [InputPartition(q) for q in self.queries] or [InputPartition("")]

    def read(self, part):
        query = part.value
        slug = "-".join("".join(c if c.isalnum() else " " for c in query.lower()).split())
        for rank in range(1, (min(self.limit, 5) if query else 0) + 1):
            yield (query, rank, f"https://www.{slug}-{rank}.example/", f"{query} vendor {rank}", 0.4)


class Hits(DataSource):
    @classmethod
    def name(cls):
        return "provena_hits"

    def schema(self):
        return "query string, rank int, url string, title string, confidence double"

    def reader(self, schema):
        return HitsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Hits)


def obsolete(topic: Column) -> Column:
    """Whether a topic is that of a part that is no longer made: a part number and a word for it."""
    low = F.lower(topic)
    return T.any_of(low, fixed.OBSOLETE_TOPIC) & low.rlike(fixed.TOPIC_PART)


def hits(query: Column, limit: int = 5) -> Column:
    """Addresses of made-up hits: vendors, five at most, or a datasheet, a broker and a vendor of an obsolete part."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    of = lambda *hosts: F.array(*(F.concat(F.lit(f"https://{h}/"), slug) for h in hosts))
    return F.when(obsolete(query), of("datasheet-archive.example", "rochester-electronics.example", "example-vendor-1.sg")).otherwise(of(*(f"example-vendor-{i}.sg" for i in range(1, min(limit, 5) + 1))))


def pages(urls: DataFrame, fixtures: DataFrame) -> DataFrame:
    """``urls`` with status and text: of the fixture (url, status, text) of an address, null text where it is dead, and else made from its path."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)), r"^www\.", "")
    topic = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)", 1), "^/+|/+$", ""), "[-_]", " "))
    topic = F.when(topic == "", "professional services").otherwise(topic)
    made = F.concat(F.lit("We provide "), topic, F.lit(" in Singapore. Request a quotation by emailing sales@"), host, F.lit(" or call +65 6123 4567. Contact us for pricing."))
    known = fixtures.select("url", F.col("status").alias("_status"), F.col("text").alias("_text"), F.lit(True).alias("_known"))
    out = urls.join(known, "url", "left")
    return out.select(*urls.columns, F.col("_status").alias("status"), F.when(F.col("_known"), F.when(F.coalesce("_status", F.lit(200)) < 400, F.col("_text"))).otherwise(made).alias("text"))
