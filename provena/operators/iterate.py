"""Rounds of iterative operators, written to the folder that all executors see, and how sides and rows are dealt."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="provena-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/provena-{uuid.uuid4().hex}/{name}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop.getParent())
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side that is given to every task.
FEW = 1 << 16


def side(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join: broadcast if its counted rows are few, else shuffled; what is exploded or read from small files may be large."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, by ``keys`` if there are any: rows that are dear to work on may come from one small file or partition."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
