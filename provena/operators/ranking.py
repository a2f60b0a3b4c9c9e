"""Order, positions and posteriors of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; ties are the order's to break."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def slots(df: DataFrame, by: list[str], score: str, seq: str) -> DataFrame:
    """rank, and the slot of it: primary, then three near alternatives, then the rest."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(seq))))
    return ranked.withColumn("slot", F.when(F.col("rank") == 1, "primary").when(F.col("rank") <= 4, "s1").otherwise("s2"))


def posterior(df: DataFrame, by: list[str], reward: str, temperature: float = 0.15, least: float = 0.55) -> DataFrame:
    """Softmax of the reward within each group, effective sample size, and whether the group abstains."""
    w = Window.partitionBy(*by)
    out = df.withColumn("weight", F.exp((F.col(reward) - F.max(reward).over(w)) / temperature))
    out = out.withColumn("p", F.col("weight") / F.sum("weight").over(w)).drop("weight")
    return out.withColumn("ess", 1 / F.sum(F.col("p") * F.col("p")).over(w)).withColumn("abstains", F.max("p").over(w) < least)


def budget_cut(df: DataFrame, by: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows of each group while the running total of ``size`` is within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)
