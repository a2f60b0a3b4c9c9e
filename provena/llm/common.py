"""Shared plumbing: the folder all executors see, written intermediates, counted-size decisions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 8 << 20
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="provena-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with its file system's scheme, deleted when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/provena-{uuid.uuid4().hex}")
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parent = fs.makeQualified(parent)
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent.toString()}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, every executor can reread it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Python workers get the folder that holds this package, unless their path has it already.

    This changes the session: PYTHONPATH of its workers, and, as rows of texts are heavy, Arrow batches of 10,000
    rows and 64 MB, the defaults, to batches of BATCH_ROWS and BATCH_BYTES.
    """
    for key, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "") + os.pathsep + os.environ.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ("doc_id", "text")))


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n: the folds that the labelled sets are split by."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows of ``df`` stay under the broadcast bound."""
    return df.count() * row_bytes <= limit


def split(docs: DataFrame, ids: DataFrame, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id), and the others, null ones among them.

    A broadcast of at most 2^bits small numbers tells most rows apart where they are read; only the rest are shuffled
    for the exact join.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    held = F.broadcast(ids.select(bit.alias("_provena_bit")).distinct())
    docs_bit = docs.withColumn("_provena_bit", bit)
    maybe = docs_bit.join(held, "_provena_bit", "left_semi").drop("_provena_bit")
    never = docs_bit.join(held, "_provena_bit", "left_anti").drop("_provena_bit")
    return maybe.join(ids, "doc_id", "left_semi"), never.unionByName(maybe.join(ids, "doc_id", "left_anti"))
