"""A graph's edges in a folder of Parquet files that were written over time, with fewer columns in older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from provena.operators import graph

#: The columns of today's files; a file without the later ones was written before they existed.
FIRST = ("src", "dst", "rel", "confidence", "reliability", "claim", "event_ts", "seq")
LATER = {"valid_to": "timestamp", "grade": "string"}


def append_edges(edges: DataFrame, path: str) -> None:
    """Add edges (FIRST, and of LATER what there is). An edge without the claim that asserts it is an error."""
    if missing := [c for c in FIRST if c not in edges.columns]:
        raise ValueError(f"edges lack {missing}")
    if not edges.where(F.coalesce(F.col("claim").cast("string"), F.lit("")) == "").isEmpty():
        raise ValueError("every edge needs the claim that asserts it")
    edges.select(*FIRST, *(F.col(c).cast(t).alias(c) for c, t in LATER.items() if c in edges.columns)).write.mode("append").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each (src, dst, rel, claim), with all columns of today.

    Schemas are merged over the files' footers. What a file lacks is null: an edge from before ``valid_to`` is open.
    """
    try:
        all_ = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        raise ValueError(f"no edges in {path}") from e
    for c, t in LATER.items():
        if c not in all_.columns:
            all_ = all_.withColumn(c, F.lit(None).cast(t))
    return graph.upsert_edges(all_.select(*FIRST, *LATER))
