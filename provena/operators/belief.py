"""Evidence under conflict: belief fusion, conformal thresholds, entropy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import fixed
from provena.operators.iterate import written


def fuse(sources: DataFrame, by: list[str]) -> DataFrame:
    """(by, belief, plausibility, unknown, conflict, rule) of rows (by, reliability, supports).

    The closed form of the conjunctive rule over {true, false}: three products for each group, combined before the
    shuffle as sums of logarithms would be; Yager's rule where the conflict is above .8, Dempster's else.
    """
    r = F.greatest(F.lit(0.0), F.least(F.lit(fixed.MAX_RELIABILITY), F.col("reliability")))
    masses = sources.select(*by, F.when(F.col("supports"), r).otherwise(0.0).alias("t"), F.when(~F.col("supports"), r).otherwise(0.0).alias("f"), F.round(1 - r, 6).alias("u"))
    p = masses.groupBy(*by).agg(F.product(F.col("t") + F.col("u")).alias("pt"), F.product(F.col("f") + F.col("u")).alias("pf"), F.product("u").alias("pu"), F.count("*").alias("n"))
    p = p.withColumns({"qt": F.greatest(F.lit(0.0), F.col("pt") - F.col("pu")), "qf": F.greatest(F.lit(0.0), F.col("pf") - F.col("pu"))})
    p = p.withColumn("k", F.when(F.col("n") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("qt") - F.col("qf") - F.col("pu"))))
    yager = F.col("k") > fixed.YAGER_CONFLICT
    scale = F.when(yager | (F.col("n") == 1), 1.0).otherwise(1 - F.col("k"))
    unknown = (F.col("pu") + F.when(yager, F.col("k")).otherwise(0.0)) / scale
    return p.select(*by, F.round(F.col("qt") / scale, 6).alias("belief"), F.round(F.col("qt") / scale + unknown, 6).alias("plausibility"), F.round(F.col("k"), 6).alias("conflict"), F.when(F.col("n") == 1, "single").when(yager, "yager").otherwise("dempster").alias("rule"))


#: A score in [0, 1] is a whole number of 2^-53; it is found digit by digit, 4096 values at a time.
_BITS, _DIGIT = 53, 12


def conformal(examples: DataFrame, by: list[str], alpha: float = 0.1) -> DataFrame:
    """(by, n, threshold) from rows (by, score, correct): null where too few are correct for ``alpha``.

    The rank is exact, and no group's scores are put in order: the rows are counted by the first digit of their
    score, which tells the digit that the rank falls into and the rank within it; then those rows alone by the next,
    and so on. Equal scores are one row with a count from the start. Rows without a score are left out.
    """
    alpha = min(0.99, max(0.01, alpha))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    group = F.struct(*by)
    rows = examples.where(F.col("correct") & F.col("score").isNotNull()).select(group.alias("_g"), ((1 - score) * float(1 << _BITS)).cast("long").alias("_k"))
    rows = written(rows.groupBy("_g", "_k").agg(F.count("*").alias("_c")), "scores")
    state = rows.groupBy("_g").agg(F.sum("_c").alias("n")).withColumn("_rank", F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    state = written(state, "ranks")
    for shift in range((_BITS // _DIGIT) * _DIGIT, -1, -_DIGIT):
        digit = F.shiftright("_k", shift)
        counts = rows.groupBy("_g", digit.alias("_d")).agg(F.sum("_c").alias("_c"))
        # At most 4096 counts of a group, in order.
        listed = counts.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_d", "_c"))).alias("_l")).join(state, "_g")
        nothing = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("d"))

        def step(a, x):
            found = a["d"].isNotNull()
            over = a["before"] + x["_c"] >= F.col("_rank")
            return F.struct(F.when(found | over, a["before"]).otherwise(a["before"] + x["_c"]).alias("before"), F.when(found, a["d"]).when(over, x["_d"]).alias("d"))

        state = listed.withColumn("_x", F.aggregate("_l", nothing, step)).select("_g", "n", (F.col("_rank") - F.col("_x.before")).alias("_rank"), F.col("_x.d").alias("_d"))
        state = written(state, "ranks")
        if shift:
            rows = written(rows.withColumn("_d", digit).join(state.select("_g", "_d"), ["_g", "_d"], "left_semi").select("_g", "_k", "_c"), "scores")
            # A group whose rank is beyond its rows has no digit, and no more rows.
            done = state.where("_d is null").select("_g", "n", "_d")
            lost = done if shift == (_BITS // _DIGIT) * _DIGIT else lost
            state = state.where("_d is not null").drop("_d")
    ends = state.select("_g", "n", "_d").unionByName(lost)
    return ends.select(*(F.col(f"_g.{c}").alias(c) for c in by), "n", F.round(1 - F.col("_d") / float(1 << _BITS), 6).alias("threshold"))


def entropy(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, clusters, entropy, confidence, top) of the non-empty values: confidence is 1 less the normalised entropy."""
    counts = samples.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("clusters"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.max("c").alias("most"))
    h = F.log("n") - F.col("clogc") / F.col("n")
    sure = F.when(F.col("clusters") > 1, 1 - h / F.log("clusters")).otherwise(1.0)
    return total.select(*by, "clusters", F.round(h, 4).alias("entropy"), F.round(sure, 4).alias("confidence"), F.round(F.col("most") / F.col("n"), 4).alias("top"))


def calibrated(score, threshold):
    """Whether a score abstains: always without a threshold."""
    return threshold.isNull() | (score < threshold)


def levels(n: int) -> int:
    return max(0, math.ceil(math.log2(n))) if n else 0
