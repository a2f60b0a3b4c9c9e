"""Bi-temporal facts: rows (key, value, event_ts, seq) in order of arrival ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import scores
from provena.operators.iterate import written


#: Arrivals of a key that are compared with each other at once.
BLOCK = 256


def versions(facts: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """valid_to: the event time of the first later arrival of the key whose event time is greater.

    Facts that arrive late stay open, as they do where each arrival closes only what is older. A key's arrivals are in
    blocks: a fact is compared with the later ones of its block, then with the later blocks' greatest times, and then
    with the rows of the first block that has a greater one, so that no key's facts are all paired.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    rows = written(facts.select(*keys, "seq", "event_ts").withColumn("_b", F.floor((rank - 1) / block)), "arrivals")
    later = rows.select(*keys, F.col("_b"), F.col("event_ts").alias("_ts"), F.col("seq").alias("_seq"))

    def first(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*keys, "seq").agg(F.min(F.struct("_seq", "_ts")).alias("x")).select(*keys, "seq", F.col("x._ts").alias("valid_to"))

    near = written(first(rows.join(later, [*keys, "_b"]).where((F.col("_seq") > F.col("seq")) & (F.col("_ts") > F.col("event_ts")))), "near")
    open_ = rows.join(near, [*keys, "seq"], "left_anti")
    most = rows.groupBy(*keys, F.col("_b").alias("_n")).agg(F.max("event_ts").alias("_most"))
    found = open_.join(most, keys).where((F.col("_n") > F.col("_b")) & (F.col("_most") > F.col("event_ts"))).groupBy(*keys, "seq", "event_ts").agg(F.min("_n").alias("_b"))
    far = first(found.join(later, [*keys, "_b"]).where(F.col("_ts") > F.col("event_ts")))
    return facts.join(near.unionByName(far), [*keys, "seq"], "left")


def conflicts(facts: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """valid_to: the event time of the first later arrival of the key with a greater event time and another ``value``.

    As in ``versions``, but what is kept of a block is its greatest time, the value that has it, and the greatest time
    of any other value: one of the two tells whether the block closes a fact. A null value conflicts with none.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    rows = written(facts.select(*keys, "seq", "event_ts", F.col(value).alias("_v")).withColumn("_b", F.floor((rank - 1) / block)), "arrivals")
    later = rows.where("_v is not null").select(*keys, "_b", F.col("event_ts").alias("_ts"), F.col("seq").alias("_seq"), F.col("_v").alias("_o"))
    closes = (F.col("_ts") > F.col("event_ts")) & (F.col("_o") != F.col("_v"))

    def first(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*keys, "seq").agg(F.min(F.struct("_seq", "_ts")).alias("x")).select(*keys, "seq", F.col("x._ts").alias("valid_to"))

    near = written(first(rows.join(later, [*keys, "_b"]).where((F.col("_seq") > F.col("seq")) & closes)), "near")
    open_ = rows.where("_v is not null").join(near, [*keys, "seq"], "left_anti")
    best = later.groupBy(*keys, "_b", "_o").agg(F.max("_ts").alias("_t")).groupBy(*keys, F.col("_b").alias("_n"))
    # The two greatest times of different values.
    best = best.agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("_t", "_o")))), 1, 2).alias("_top"))
    hit = F.exists("_top", lambda x: (x["_o"] != F.col("_v")) & (x["_t"] > F.col("event_ts")))
    found = open_.join(best, keys).where((F.col("_n") > F.col("_b")) & hit).groupBy(*keys, "seq", "event_ts", "_v").agg(F.min("_n").alias("_b"))
    far = first(found.join(later, [*keys, "_b"]).where(closes))
    return facts.join(near.unionByName(far), [*keys, "seq"], "left")


def versions_in_order(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The same where arrival is in the order of event time: no join."""
    return facts.withColumn("valid_to", F.lead("event_ts").over(Window.partitionBy(*keys).orderBy("event_ts", "seq")))


def as_of(facts: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The row of each key that was valid at ``at``, the latest if several."""
    held = facts.where((F.col("event_ts") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    return held.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("event_ts"), F.desc("seq")))).where("_n = 1").drop("_n")


def aged(facts: DataFrame, now: Column) -> DataFrame:
    """decayed confidence and status, from confidence, last_ts, reinforced and disputes."""
    age = scores.age_days(F.col("last_ts"), now)
    return facts.withColumns({"decayed": scores.decayed(F.col("confidence"), age, F.col("reinforced"), F.col("disputes")), "status": F.when(age >= 180.0, "stale").otherwise("active")})
