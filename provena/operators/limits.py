"""Rate limits: token buckets that refill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


def buckets(calls: DataFrame, by: list[str], per_minute: float = 5.0, capacity: float = 5.0) -> DataFrame:
    """(by, seq, wait): how long, in seconds, each call (by, at in seconds, seq) waits for a token of its key.

    A bucket starts full and refills evenly; a call that finds less than one token waits for it, and later calls wait
    behind it. A bucket is sequential by definition: each key's calls are folded by one task, in chunks, so that n
    calls cost about n steps.
    """
    rate = per_minute / 60.0
    kind = calls.schema["seq"].dataType.simpleString()
    items = calls.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("double").alias("at"), "seq"))).alias("x"))
    out_type, state = f"array<struct<seq:{kind},wait:double>>", f"struct<tokens:double,last:double,out:array<struct<seq:{kind},wait:double>>>"

    def step(a: Column, c: Column) -> Column:
        now = F.greatest(c["at"], a["last"])
        tokens = F.least(F.lit(capacity), a["tokens"] + (now - a["last"]) * rate)
        wait = F.when(tokens >= 1, 0.0).otherwise((1 - tokens) / rate)
        after = F.when(tokens >= 1, tokens - 1).otherwise(0.0)
        return F.struct(after.alias("tokens"), (now + wait).alias("last"), F.concat(a["out"], F.array(F.struct(c["seq"].alias("seq"), (now + wait - c["at"]).alias("wait")))).alias("out")).cast(state)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / CHUNK).cast("int")), lambda k: F.slice("x", k * CHUNK + 1, F.lit(CHUNK)))
    none = F.array().cast(out_type)

    def outer(a: Column, chunk: Column) -> Column:
        begin = F.struct(a["tokens"].alias("tokens"), a["last"].alias("last"), none.alias("out")).cast(state)
        inner = F.aggregate(chunk, begin, step)
        return F.element_at(F.transform(F.array(inner), lambda i: F.struct(i["tokens"].alias("tokens"), i["last"].alias("last"), F.concat(a["out"], F.array(i["out"])).alias("out"))), 1)

    start = F.struct(F.lit(float(capacity)).alias("tokens"), F.get("x", 0)["at"].alias("last"), F.array().cast(f"array<{out_type}>").alias("out"))
    rows = items.select(*by, F.explode(F.flatten(F.aggregate(chunks, start, outer, lambda a: a["out"]))).alias("r"))
    return rows.select(*by, "r.seq", "r.wait")
