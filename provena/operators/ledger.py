"""Ledgers in a shared folder: rows are written first, and then a head for each run commits them.

``items/<version>`` holds the sealed rows of a publication (by, seq, content, digest, parent_hash, chain_hash), content
being JSON; ``heads/<version>`` a head for each run (by, tree_size, last_seq, root, published_at, version). Rows whose
version no head names were never committed: a crash between the two steps leaves the runs as they were. One publisher
writes to a store at a time. Rows without ``seq`` have no place in a run and are an error.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import ed25519
from provena.operators import integrity
from provena.operators.iterate import dealt, written


def sealed(items: DataFrame, by: list[str], start: DataFrame | None = None) -> DataFrame:
    """Rows (by, seq, content) with the digest of their canonical content and their links."""
    return integrity.chained(_digests(items, by), by, start)


def _digests(items: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, seq, content, digest), dealt first: digests are dear, and a table or a publication may be a few small files."""
    return integrity.canonical_digests(dealt(items.select(*by, "seq", "content")), "content")


def roots(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, tree_size, last_seq, root) of rows (by, seq, content): from the content, whatever digest a row claims."""
    return _rooted(written(_digests(items, by).select(*by, "seq", "digest"), "digests"), by)


def _rooted(rows: DataFrame, by: list[str]) -> DataFrame:
    """``roots`` of rows (by, seq, digest) whose digests are known to be those of their content."""
    rows = rows.select(*by, "seq", F.coalesce("digest", F.lit("")).alias("digest"))
    return integrity.merkle_root(rows, by, "digest").join(rows.groupBy(*by).agg(F.count("*").alias("tree_size"), F.max("seq").alias("last_seq")), by).select(*by, "tree_size", "last_seq", "root")


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _versions(spark: SparkSession, store: str) -> list[str]:
    """The committed publications: a head table counts once its writer has marked it as whole."""
    fs, path = _folder(spark, f"{store}/heads")
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    return [n for n in names if fs.exists(_folder(spark, f"{store}/heads/{n}/_SUCCESS")[1])]


def published(spark: SparkSession, store: str, by: list[str]) -> DataFrame | None:
    """The last head of each run; None before any publication."""
    versions = _versions(spark, store)
    if not versions:
        return None
    all_ = spark.read.parquet(*(f"{store}/heads/{v}" for v in versions))
    rest = [c for c in all_.columns if c not in by]
    return all_.groupBy(*by).agg(F.max_by(F.struct(*rest), "version").alias("h")).select(*by, "h.*")


def publish(items: DataFrame, store: str, by: list[str], at: Column) -> DataFrame:
    """Write sealed rows, then the heads that commit them; the heads.

    ``items`` hold each of their runs in full. A run whose root and size are those of its last head keeps that head's
    time: others may have noted it.
    """
    spark = items.sparkSession
    if not items.where(F.col("seq").isNull()).isEmpty():
        raise ValueError("a row's seq is null")
    before = _versions(spark, store)
    # Versions sort by the order of their publication.
    version = f"{len(before):08d}-{uuid.uuid4().hex}"
    sealed(items, by).write.parquet(f"{store}/items/{version}")
    rows = spark.read.parquet(f"{store}/items/{version}")
    # These digests were worked out from the content just now.
    heads = _rooted(rows, by).withColumns({"published_at": at, "version": F.lit(version)})
    if (last := published(spark, store, by)) is not None:
        old = last.select(*by, F.col("root").alias("_root"), F.col("tree_size").alias("_size"), F.col("published_at").alias("_at"))
        same = (F.col("_root") == F.col("root")) & (F.col("_size") == F.col("tree_size"))
        heads = heads.join(old, by, "left").withColumn("published_at", F.when(same, F.col("_at")).otherwise(F.col("published_at"))).drop("_root", "_size", "_at")
    heads.write.parquet(f"{store}/heads/{version}")
    return spark.read.parquet(f"{store}/heads/{version}")


def checked(items: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, tree_size, last_seq, published_at) of the runs of ``heads``: "ok", or "mismatch" where the rows' root or number is another."""
    found = roots(items, by).select(*by, F.col("root").alias("_root"), F.col("tree_size").alias("_size"))
    same = (F.col("_root") == F.col("root")) & (F.col("_size") == F.col("tree_size"))
    return heads.join(found, by, "left").select(*by, F.when(same, "ok").otherwise("mismatch").alias("status"), "tree_size", "last_seq", "published_at")


def committed(spark: SparkSession, store: str, by: list[str]) -> DataFrame | None:
    """The rows that the last heads name; None before any publication."""
    versions, heads = _versions(spark, store), published(spark, store, by)
    if heads is None:
        return None
    rows = spark.read.parquet(*(f"{store}/items/{v}" for v in versions)).withColumn("version", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return rows.join(heads.select(*by, "version"), [*by, "version"], "left_semi").drop("version")


def load(spark: SparkSession, store: str, by: list[str], wal: DataFrame | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, statuses) of a store, with the write-ahead rows ``wal`` (by, seq, content) of runs that were never published.

    A run that does not match its head is an error, or with ``strict`` off a status "mismatch" without rows. A run
    without a head is sealed anew from its write-ahead rows: "recovered"; for one with a head they are superseded.
    """
    heads, rows = published(spark, store, by), committed(spark, store, by)
    out: list[tuple[DataFrame, DataFrame]] = []
    if heads is not None:
        rows = written(rows, "rows")
        status = written(checked(rows, heads, by), "status")
        bad = status.where("status = 'mismatch'")
        if strict and not bad.isEmpty():
            raise ValueError(f"{bad.count()} runs do not match their published heads, such as {bad.first()}")
        out.append((rows.join(bad.select(*by), by, "left_anti"), status))
    if wal is not None:
        lone = wal if heads is None else wal.join(heads.select(*by), by, "left_anti")
        again = written(sealed(lone, by), "recovered")
        none = F.lit(None)
        kind = heads.schema["published_at"].dataType if heads is not None else "string"
        out.append((again, again.groupBy(*by).agg(F.lit("recovered").alias("status"), F.count("*").alias("tree_size"), F.max("seq").alias("last_seq")).withColumn("published_at", none.cast(kind))))
    if not out:
        raise ValueError("the store is empty")
    if len(out) == 1:
        return out[0]
    return out[0][0].unionByName(out[1][0]), out[0][1].unionByName(out[1][1])


def annotate(rows: DataFrame, heads: DataFrame | None, updates: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): sealed ``rows`` with the new content of ``updates`` (by, seq, content), one for a row.

    Rows that a head covers are refused ("published"), and so are those that are not there ("unknown"). A run is linked
    anew from its first changed row on, with the hash of the row before it; what is before keeps its links, so that a
    published tree is still the start of the next.
    """
    keyed = updates.select(*by, "seq", F.col("content").alias("_new")).join(rows.select(*by, "seq", F.lit(True).alias("_known")), [*by, "seq"], "left")
    last = (heads.select(*by, F.col("last_seq").alias("_last")) if heads is not None else updates.select(*by).distinct().withColumn("_last", F.lit(None).cast(rows.schema["seq"].dataType)))
    reason = F.when(F.col("_known").isNull(), "unknown").when(F.col("seq") <= F.col("_last"), "published")
    told = written(keyed.join(last, by, "left").withColumn("reason", reason).select(*by, "seq", "_new", "reason"), "updates")
    taken = told.where("reason is null")
    from_ = taken.groupBy(*by).agg(F.min("seq").alias("_from"))
    split = rows.join(from_, by, "left")
    kept = split.where(F.col("_from").isNull() | (F.col("seq") < F.col("_from")))
    start = kept.where("_from is not null").groupBy(*by).agg(F.max_by("chain_hash", "seq").alias("chain_hash"))
    changed = split.where(F.col("seq") >= F.col("_from")).select(*by, "seq", "content").join(taken.select(*by, "seq", "_new", F.lit(True).alias("_hit")), [*by, "seq"], "left")
    changed = sealed(changed.select(*by, "seq", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("content")).alias("content")), by, start)
    return kept.drop("_from").select(changed.columns).unionByName(changed), told.where("reason is not null").select(*by, "seq", "reason")


def head_text(by: list[str]) -> Column:
    """What of a head is signed: run, size, root and time."""
    return F.concat_ws("|", *(F.col(c).cast("string") for c in (*by, "tree_size", "root", "published_at")))


def signed(heads: DataFrame, by: list[str], key: bytes) -> DataFrame:
    """``heads`` with a signature in hexadecimal. There is one head for a run; the key goes to the tasks that sign."""

    @F.pandas_udf("string")
    def put(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ed25519.sign(key, t.encode()).hex())

    return dealt(heads).withColumn("signature", put(head_text(by)))


def signatures_hold(heads: DataFrame, by: list[str], trusted: bytes) -> DataFrame:
    """``heads`` with ``valid``: whether the signature is that of the trusted public key, which comes from elsewhere."""

    @F.pandas_udf("boolean")
    def ask(texts: pd.Series, signatures: pd.Series) -> pd.Series:
        def one(text, signature):
            try:
                return ed25519.verify(trusted, text.encode(), bytes.fromhex(signature or ""))
            except ValueError:
                return False

        return pd.Series([one(t, s) for t, s in zip(texts, signatures, strict=True)], dtype="bool")

    return dealt(heads).withColumn("valid", ask(head_text(by), F.col("signature")))
