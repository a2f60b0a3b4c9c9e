"""The training-data pipeline: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from provena.llm.common import let_workers_import, split, written
from provena.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the model learns from the stage's own labelled documents.

    Null and empty texts and texts without a letter have no language and go. Repeated rows have one fate. Without any
    label only texts without a letter go.
    """
    let_workers_import(spark)
    model = language_id.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    return language_id.predict(docs.select(COLUMNS), model).where(~F.col("rejected")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id.

    Rows that share a doc_id, and rows without one, are told apart by their text: each such (doc_id, text) is a
    document of its own, after all doc_ids in order, known by a hash. Of rows equal in both, the first in order of
    source, lang and n_chars stays. Null and empty texts and texts of white space alone link with nothing: all stay but for
    such equal rows.
    """
    let_workers_import(spark)
    docs = docs.select(COLUMNS)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    # 63 bits with the highest set: after any doc_id that counts up from 0.
    named = F.shiftrightunsigned(F.xxhash64("text", F.col("doc_id").cast("string")), 2).bitwiseOR(F.lit(1 << 62))
    again, once = split(docs, repeated)
    nodes = once.where("doc_id is not null").withColumn("node", F.col("doc_id"))
    odd = again.unionByName(once.where("doc_id is null")).withColumn("node", named)
    odd = written(odd.groupBy("node", "doc_id", "text").agg(F.min(F.struct("source", "lang", "n_chars")).alias("x")).select("doc_id", "text", "x.lang", "x.source", "x.n_chars", "node"), "odd")
    nodes = nodes.unionByName(odd)
    found = written(jaccard_join.join(nodes.select(F.col("node").alias("doc_id"), "text")), "components")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    keys = nodes.withColumnsRenamed({"doc_id": "kept_id", "node": "doc_id"})
    return split(keys, gone)[1].drop("doc_id").withColumnRenamed("kept_id", "doc_id").select(COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or re-parameterised, go.

    Null and empty texts hold none and stay, and so do rows of the same doc_id whose own text holds none; repeated rows
    have one fate. A document without doc_id goes by its text, too.
    """
    let_workers_import(spark)
    docs = docs.select(COLUMNS).withColumn("node", F.xxhash64("text", F.col("doc_id").cast("string")))
    found = decontaminate.scan(docs.select(F.col("node").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaked = written(found.where("contaminated").select("doc_id").distinct(), "leaks")
    keys = docs.withColumnsRenamed({"doc_id": "kept_id", "node": "doc_id"})
    return split(keys, leaked)[1].drop("doc_id").withColumnRenamed("kept_id", "doc_id").select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark, and n_chars follows the text; every row stays.

    Null texts stay null, with n_chars null; empty texts stay empty. Repeated rows are changed alike.
    """
    out = secret_scan.redact(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Null and empty texts are one id each; repeated rows are packed each."""
    let_workers_import(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path()).drop("ids")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("secret_scan", secrets), ("packing", pack)]

#: The stages are models and hashes that SQL can't express; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
