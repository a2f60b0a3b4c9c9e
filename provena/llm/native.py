"""Catalyst expressions for matches with their places. No Python runs on executors here."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Matches are accumulated in chunks of this many, so that a text with n matches costs about n steps.
CHUNK = 256
SPAN = "struct<s:int,e:int,v:string,l:string,r:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, v, l, r): code points, end exclusive; l and r are up to
    ``context`` characters on either side, back to the neighbouring match. Null text has none.

    The places follow from the matches and from the pieces between them, both of which the JVM's regex gives.
    """

    def places(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        left = F.right if context else (lambda c, n: F.lit(""))
        right = F.left if context else (lambda c, n: F.lit(""))

        def zipped(p: Column) -> Column:
            rest = F.slice(p, F.lit(2), F.size(m))
            return F.arrays_zip(m.alias("v"), F.transform(F.slice(p, F.lit(1), F.size(m)), lambda x: F.struct(F.length(x).alias("g"), left(x, F.lit(context)).alias("l"))).alias("p"), F.transform(rest, lambda x: right(x, F.lit(context))).alias("r"))

        def step(a: Column, z: Column) -> Column:
            start = a["at"] + z["p"]["g"]
            end = start + F.length(z["v"])
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("s"), end.alias("e"), z["v"].alias("v"), z["p"]["l"].alias("l"), z["r"].alias("r")).cast(SPAN))).alias("out"))

        def chunked(z: Column) -> Column:
            none = F.array().cast(f"array<{SPAN}>")
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda k: F.slice(z, k * CHUNK + 1, F.lit(CHUNK)))

            def outer(a: Column, chunk: Column) -> Column:
                return let(F.aggregate(chunk, F.struct(a["at"].alias("at"), none.alias("out")), step), lambda i: F.struct(i["at"].alias("at"), F.concat(a["out"], F.array(i["out"])).alias("out")))

            return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), outer, lambda a: F.flatten(a["out"]))

        return F.when(F.size(m) > 0, let(let(pieces, zipped), chunked)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), places), F.array().cast(f"array<{SPAN}>"))


def tagged(kind: str, order: int, found: Column) -> Column:
    """The spans as (k, kind, s, e): k is the kind's place in the listing."""
    return F.transform(found, lambda x: F.struct(F.lit(order).alias("k"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def by_kind(found: Column) -> Column:
    return F.array_sort(found)


def by_start(found: Column) -> Column:
    """Sorted by start, then by the kind's place, then end."""
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))), lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def count_of(found: Column, k: int) -> Column:
    """How many of the spans are of the kind at place k."""
    return F.size(F.filter(found, lambda x: x["k"] == k)).cast("long")


def overlapped(is_base: Column) -> Column:
    """Of rows (rid, s, e, k): the k of a base row that a row overlaps, or null.

    A text's rows are met in order of place: the furthest base end before a row or the nearest base start after it
    tells, so a text with n spans costs about n log n steps.
    """
    by = Window.partitionBy("rid").orderBy("s", ~is_base)
    last = F.max(F.when(is_base, F.struct("e", "k"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_base, F.struct("s", "k"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    return F.when(last["e"] > F.col("s"), last["k"]).when(after["s"] < F.col("e"), after["k"])
