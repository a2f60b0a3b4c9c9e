"""Row pattern matching: a start row and then steps, each one row or one or more, over the ordered rows of a key.

Right to left, for each row and each state of the pattern (how many steps have begun), the largest measure of a start
row that can still succeed from there is kept: the maximum over the moves that the row allows of the minimum of what
the move and the next row's state let through. A start row succeeds if its measure is at most that number. Forward, a
walk takes the preferred move (the same step again before the next one) whenever its number is at least the start's
measure, so it never backtracks; of repeated rows of one step it finds the last by bisection, as the number does not
grow along them.

Rows are range-partitioned by key and order and numbered; blocks of BLOCK rows are the unit of work, however many of
them one key has. A row at which no step fits is crossed by no match, so all but a block's rows before its first and
after its last such row are settled within it. Each block's start is a function of the next block's (maxima of minima);
functions of blocks that can be crossed whole are composed by pointer doubling, and walks that leave a block go on in
the next. Nothing goes through one task or the driver.

Null keys and rows without a first order value are left out. A null measure is no start. Equal rows are the caller's to
drop; among rows equal in key and order any order is taken. An empty table has no matches. Other columns stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import let_workers_import, written

#: Rows of a block are 2^14. Of a row's number the lowest 33 bits count within its partition.
BLOCK, INDEX = 14, 33
#: Beyond every 64-bit measure: what lets nothing or everything through.
NONE, ALL = -(10**19), 10**19
NUMBER = "decimal(20,0)"
_NUMBERS = pa.list_(pa.decimal128(20, 0))


@dataclass(frozen=True)
class Step:
    """One row, or as many as ``repeat`` allows, for which ``fits`` holds; ``bounded``: the measure is at least the start's."""

    letter: str
    fits: Column
    repeat: bool = False
    bounded: bool = False


def prev(column: str) -> Column:
    """A column of the row before, null at a key's first row."""
    return F.col(f"_prev.{column}")


@dataclass(frozen=True)
class Shape:
    """What of the steps the tasks need: by state, whether its step repeats and whether it is bounded."""

    repeat: tuple[bool, ...]
    bounded: tuple[bool, ...]

    @property
    def states(self) -> int:
        return len(self.repeat) - 1

    def limits(self, flags: list[int], measures: list[int | None], fresh: list[bool], end: list[int]) -> list[list[int]]:
        """For each row and, last, the end: by state, the largest start measure that can still succeed.

        ``end`` is what holds after the last row. A row that is ``fresh`` begins a key, before which nothing passes.
        """
        k, none = self.states, [NONE] * self.states
        out = [end]
        after = end
        for i in range(len(flags) - 1, -1, -1):
            f, v = flags[i], measures[i]
            here = none
            if f > 1 and not fresh[i]:
                here = none[:]
                for q in range(k):
                    best = NONE
                    if q and self.repeat[q] and f >> q & 1:
                        best = after[q] if not self.bounded[q] else min(v, after[q])
                    if f >> (q + 1) & 1:
                        on = ALL if q + 1 == k else after[q + 1]
                        best = max(best, min(v, on) if self.bounded[q + 1] else on)
                    here[q] = best
            out.append(here)
            after = here
        out.reverse()
        return out

    def walk(self, at: int, q: int, c: int, flags: list[int], measures: list[int | None], limits: list[list[int]], stretch: list[list[int]]) -> tuple[int, int, list[int]]:
        """From state ``q`` before row ``at``: the row where the match ended, or the rows' end; the state there; rows by step."""
        n, took = len(flags), [0] * (self.states + 1)
        while True:
            if at < n and q and self.repeat[q] and flags[at] >> q & 1:
                if self.bounded[q]:
                    stop = at
                    while stop < stretch[q][at] and measures[stop] >= c and limits[stop + 1][q] >= c:
                        stop += 1
                else:
                    low, high = at, stretch[q][at]
                    while low < high:
                        mid = (low + high + 1) // 2
                        low, high = (mid, high) if limits[mid][q] >= c else (low, mid - 1)
                    stop = low
                took[q] += stop - at
                at = stop
            if at == n:
                return n, q, took
            q += 1
            took[q] += 1
            if q == self.states:
                return at, q, took
            at += 1

    def stretches(self, flags: list[int], fresh: list[bool]) -> list[list[int]]:
        """By state and row: the first row from there on that its step does not fit."""
        out: list[list[int]] = []
        for q in range(self.states + 1):
            ends = [0] * len(flags)
            if q and self.repeat[q]:
                stop = len(flags)
                for i in range(len(flags) - 1, -1, -1):
                    if not flags[i] >> q & 1:
                        stop = i
                    ends[i] = stop
                    if fresh[i]:
                        stop = i
            out.append(ends)
        return out


class Rows:
    """A block's rows as lists, with the running sums that a match's sum comes from."""

    def __init__(self, shape: Shape, table: pa.Table):
        table = table.sort_by("_id")
        self.table, self.shape = table, shape
        self.flags, self.measures, self.fresh = (table.column(c).to_pylist() for c in ("_flags", "_measure", "_fresh"))
        self.sums = [0, *accumulate(m or 0 for m in self.measures)]
        self.stretch = shape.stretches(self.flags, self.fresh)

    def settle(self, end: list[int]) -> None:
        self.limits = self.shape.limits(self.flags, self.measures, self.fresh, end)

    def starts(self, low: int, high: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(row, last row or the end, state, rows by step) of the starts from ``low`` to ``high`` that succeed."""
        n = len(self.flags)
        for i in range(low, high):
            c = self.measures[i]
            if self.flags[i] & 1 and c is not None and (i + 1 == n or not self.fresh[i + 1]) and self.limits[i + 1][0] >= c:
                yield i, *self.shape.walk(i + 1, 0, c, self.flags, self.measures, self.limits, self.stretch)

    def breaks(self) -> list[int]:
        """Rows that no match crosses: no step fits, or they begin a key."""
        return [i for i, f in enumerate(self.flags) if f <= 1 or self.fresh[i]]


def _fields(names: pa.Schema, by: str, name: str) -> pa.Schema:
    key, label = names.field(by).type, names.field(name).type
    return pa.schema([("_block", pa.int64()), ("start", pa.int64()), (by, key), ("first", label), ("last", label), ("c", pa.int64()), ("state", pa.int32()), ("n_rows", pa.int64()), ("total", pa.int64()), ("steps", pa.list_(pa.int64()))])


def _edge_fields(names: pa.Schema, by: str, name: str) -> list[pa.Field]:
    return [pa.field("_id", pa.int64()), pa.field("_measure", pa.int64()), pa.field("_flags", pa.int32()), pa.field("_fresh", pa.bool_()), pa.field("_key", names.field(by).type), pa.field("_name", names.field(name).type)]


def _ended(rows: Rows, block: int, by: str, name: str, found: list[tuple], schema: pa.Schema) -> pa.Table:
    """Matches that ended (last set) and walks that go on (last null) of (start row or None, walk before, end, state, steps)."""
    n = len(rows.flags)
    keys, labels, ids = (rows.table.column(c) for c in (by, name, "_id"))
    keys, labels, ids = (x.to_pylist() for x in (keys, labels, ids))
    out: dict[str, list] = {f: [] for f in schema.names}
    for i, end, q, took in found:
        over = end < n
        took[0] += 1
        values = (block, ids[i], keys[i], labels[i], labels[end] if over else None, rows.measures[i], q, sum(took), rows.sums[end + over] - rows.sums[i], took)
        for f, v in zip(schema.names, values, strict=True):
            out[f].append(v)
    return pa.table(out, schema)


def _local(shape: Shape, by: str, name: str) -> Callable[[pa.Table], pa.Table]:
    """A block on its own: its settled matches, its edges' rows, and its start as a function of its end."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("_block")[0].as_py()
        base = _fields(table.schema, by, name)
        edge = _edge_fields(table.schema, by, name)
        full = pa.schema([*base, *edge, pa.field("head", pa.bool_()), pa.field("tail", pa.bool_()), pa.field("const", _NUMBERS), pa.field("caps", _NUMBERS)])
        real = table.filter(pc.equal(table.column("_halo"), False))
        if real.num_rows == 0:
            return full.empty_table()
        rows, k = Rows(shape, real), shape.states
        n, cuts = len(rows.flags), rows.breaks()
        head, tail = (cuts[0], cuts[-1]) if cuts else (n, 0)
        rows.settle([NONE] * k)
        const, caps = rows.limits[0], None
        if not cuts:  # what each state at the end would let through, by state at the start
            columns = [shape.limits(rows.flags, rows.measures, rows.fresh, [ALL if r == q else NONE for r in range(k)])[0] for q in range(k)]
            caps = [min(columns[q][p], ALL) for p in range(k) for q in range(k)]
            # What succeeds within the block is in const; a cap above it is a way through.
        done = _ended(rows, block, by, name, list(rows.starts(0, tail)), base)
        edges = [i for i in range(n) if i < head or i >= tail]
        part = rows.table.take(edges)
        columns = {f.name: pa.nulls(len(edges), f.type) for f in full}
        columns["_block"] = pa.array([block] * len(edges), pa.int64())
        for f in edge:
            columns[f.name] = part.column({"_key": by, "_name": name}.get(f.name, f.name)).cast(f.type)
        columns["head"], columns["tail"] = pa.array([i < head for i in edges]), pa.array([i >= tail for i in edges])
        row = {f.name: pa.nulls(1, f.type) for f in full} | {"_block": pa.array([block], pa.int64()), "const": pa.array([const], _NUMBERS), "caps": pa.array([caps], _NUMBERS)}
        return pa.concat_tables([pa.table({f.name: done.column(f.name) if f.name in base.names else pa.nulls(done.num_rows, f.type) for f in full}, full), pa.table(columns, full), pa.table(row, full)])

    return run


def _bound(table: pa.Table, k: int) -> list[int]:
    found = table.column("bound")[0].as_py() if table.num_rows else None
    return [int(x) for x in found] if found is not None else [NONE] * k


def _tails(shape: Shape, by: str, name: str) -> Callable[[pa.Table], pa.Table]:
    """The starts in a block's tail, with what holds at the block's end."""

    def run(table: pa.Table) -> pa.Table:
        rows = Rows(shape, table)
        rows.settle(_bound(table, shape.states))
        return _ended(rows, table.column("_block")[0].as_py(), by, name, list(rows.starts(0, len(rows.flags))), _fields(table.schema, by, name))

    return run


def _onward(shape: Shape, by: str, name: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Walks that came into a block, over its head."""

    def run(walks: pa.Table, heads: pa.Table) -> pa.Table:
        if not walks.num_rows:
            return walks.schema.empty_table()
        rows = Rows(shape, heads)
        n = len(rows.flags)
        rows.settle(_bound(heads, shape.states) if heads.column("tail")[0].as_py() else [NONE] * shape.states)
        labels, out = rows.table.column(name).to_pylist(), []
        for w in walks.to_pylist():
            end, q, took = shape.walk(0, w["state"], w["c"], rows.flags, rows.measures, rows.limits, rows.stretch)
            over = end < n
            out.append(w | {"state": q, "last": labels[end] if over else None, "n_rows": w["n_rows"] + sum(took), "total": w["total"] + rows.sums[end + over], "steps": [a + b for a, b in zip(w["steps"], took, strict=True)]})
        return pa.Table.from_pylist(out, walks.schema)

    return run


def _resolved(blocks: DataFrame, k: int) -> DataFrame:
    """(block, const): what can still succeed at each block's start; ``blocks``: block, next (null: its key ends), const, caps.

    A block that can be crossed takes over the function of the next, and the next of that, until none can be crossed.
    """
    number = lambda x: F.lit(str(x)).cast(NUMBER)
    blocks = written(blocks, "blocks")
    # n doublings cover 2^n blocks, so that the rounds are the logarithm of the longest run of crossed blocks.
    while not (crossed := blocks.where("caps is not null")).isEmpty():
        to = blocks.select(F.col("_block").alias("next"), F.col("next").alias("n2"), F.col("const").alias("c2"), F.col("caps").alias("m2"))
        joined = crossed.join(to.hint("merge"), "next", "left")

        def through(p: int, target: Callable[[int], Column]) -> list[Column]:
            return [F.least(F.get("caps", p * k + q), F.coalesce(target(q), number(NONE))) for q in range(p, k)]

        top = lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0]
        const = F.array(*(top([F.get("const", p), *through(p, lambda q: F.get("c2", q))]) for p in range(k)))
        caps = F.when(F.col("m2").isNotNull(), F.array(*(top(through(p, lambda q, r=r: F.get("m2", q * k + r))) for p in range(k) for r in range(k))))
        moved = joined.select("_block", F.col("n2").alias("next"), const.alias("const"), caps.alias("caps"))
        blocks = written(blocks.where("caps is null").unionByName(moved.select("_block", "next", F.col("const").cast(f"array<{NUMBER}>"), F.col("caps").cast(f"array<{NUMBER}>"))), "blocks")
    return blocks.select("_block", "const")


def find(rows: DataFrame, by: str, order: list[str], name: str, measure: str, start: Column, steps: list[Step]) -> DataFrame:
    """(by, match_no, first, last, n_rows, total, steps): the matches of each key, numbered in the order of their starts.

    ``start`` and the steps' conditions are columns over the rows and ``prev`` of them; every row may start a match,
    also inside another. ``first`` and ``last`` are values of ``name``, ``total`` the sum of ``measure`` (64-bit), ``steps``
    the rows of the start (one) and of each step. The last step takes one row.
    """
    if not steps or steps[-1].repeat:
        raise ValueError("the last step takes one row")
    if by == name or by in ("start", "first", "last", "c", "state", "n_rows", "total", "steps", "match_no") or any(c.startswith("_") for c in rows.columns):
        raise ValueError("key and name are two columns, the key's name is no result's, and names do not begin with _")
    spark = rows.sparkSession
    let_workers_import(spark)
    shape = Shape((False, *(s.repeat for s in steps)), (False, *(s.bounded for s in steps)))
    k, columns = shape.states, rows.columns
    ordered = rows.where(F.col(by).isNotNull() & F.col(order[0]).isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(ordered.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("_block", F.shiftright("_id", BLOCK))
    # The last row of each block comes once more before the first of the next block, for what is compared with it.
    chunk = INDEX - BLOCK
    known = ordered.groupBy("_block").agg(F.max_by(F.struct(*columns), "_id").alias("_last"), F.min_by(by, "_id").alias("_first_key"))
    ends = known.groupBy(F.shiftright("_block", chunk).alias("_part")).agg(F.max("_block").alias("_end"))
    known = known.withColumn("_part", F.shiftright("_block", chunk)).join(ends.hint("merge"), "_part").withColumn("next", F.when(F.col("_block") == F.col("_end"), F.shiftleft(F.col("_part") + 1, chunk)).otherwise(F.col("_block") + 1))
    known = written(known.drop("_part", "_end"), "known")
    halo = known.select(F.col("next").alias("_block"), "_last.*", F.lit(-1).cast("long").alias("_id"), F.lit(True).alias("_halo"))
    within = Window.partitionBy("_block").orderBy("_id")
    flagged = ordered.withColumn("_halo", F.lit(False)).unionByName(halo).withColumn("_prev", F.lag(F.struct(*columns)).over(within))
    flagged = flagged.withColumn("_fresh", ~F.coalesce(F.col(f"_prev.{by}") == F.col(by), F.lit(False))).withColumn("_prev", F.when(~F.col("_fresh"), F.col("_prev")))
    bits = [F.when(cond & (F.col(measure).isNotNull() if bound else F.lit(True)), 1 << i).otherwise(0) for i, (cond, bound) in enumerate([(start, True), *((s.fits, s.bounded) for s in steps)])]
    flagged = flagged.select("_block", "_id", "_halo", "_fresh", sum(bits[1:], bits[0]).cast("int").alias("_flags"), F.col(measure).cast("long").alias("_measure"), by, name)
    key, label = flagged.schema[by].dataType.simpleString(), flagged.schema[name].dataType.simpleString()
    base = f"_block long, start long, `{by}` {key}, first {label}, last {label}, c long, state int, n_rows long, total long, steps array<long>"
    edge = f"_id long, _measure long, _flags int, _fresh boolean, _key {key}, _name {label}"
    out = written(flagged.groupBy("_block").applyInArrow(_local(shape, by, name), f"{base}, {edge}, head boolean, tail boolean, const array<{NUMBER}>, caps array<{NUMBER}>"), "settled")

    starts = known.select(F.col("_block").alias("next"), F.col("_first_key").alias("_next_key"))
    linked = known.join(starts.hint("merge"), "next", "left").select("_block", F.when(F.col(f"_last.{by}") == F.col("_next_key"), F.col("next")).alias("next"))
    linked = written(linked, "linked")
    resolved = _resolved(out.where("const is not null").select("_block", "const", "caps").join(linked.hint("merge"), "_block"), k)
    bounds = written(linked.join(resolved.select(F.col("_block").alias("next"), F.col("const").alias("bound")).hint("merge"), "next").select("_block", "next", "bound"), "bounds")
    edges = out.where("_id is not null").select("_block", "_id", "_measure", "_flags", "_fresh", F.col("_key").alias(by), F.col("_name").alias(name), "head", "tail").join(bounds.select("_block", "bound").hint("merge"), "_block", "left")

    fields = [c.strip().split(" ")[0].strip("`") for c in base.split(", ")]
    moved = written(edges.where("tail").groupBy("_block").applyInArrow(_tails(shape, by, name), base), "tails")
    found = [out.where("start is not null").select(*fields), moved.where("last is not null")]
    while not (on := moved.where("last is null")).isEmpty():
        on = on.join(bounds.select("_block", "next").hint("merge"), "_block").withColumn("_block", F.col("next")).select(*fields)
        moved = written(on.groupBy("_block").cogroup(edges.where("head").groupBy("_block")).applyInArrow(_onward(shape, by, name), base), "onward")
        found.append(moved.where("last is not null"))
    matches = reduce(DataFrame.unionByName, found).withColumn("_block", F.shiftright("start", BLOCK)).withColumn("_part", F.shiftright("start", INDEX))
    # Running numbers: within a block, over the blocks of a partition, over the partitions of a key.
    counts = matches.groupBy(by, "_part", "_block").agg(F.count("*").alias("n"))
    per_part = counts.groupBy(by, "_part").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_before_part", F.coalesce(F.sum("n").over(before(by).orderBy("_part")), F.lit(0))).drop("n")
    counts = counts.withColumn("_before_block", F.coalesce(F.sum("n").over(before(by, "_part").orderBy("_block")), F.lit(0))).drop("n")
    offsets = counts.join(per_part.hint("merge"), [by, "_part"]).select(by, "_block", (F.col("_before_part") + F.col("_before_block")).alias("_before"))
    number = F.row_number().over(Window.partitionBy(by, "_block").orderBy("start"))
    return matches.join(offsets.hint("merge"), [by, "_block"]).select(by, (F.col("_before") + number).alias("match_no"), "first", "last", "n_rows", "total", "steps")


def letters(steps: list[Step], first: str = "A") -> Column:
    """A match's labels, one letter a row."""
    return F.concat(*(F.repeat(F.lit(x), F.get("steps", i).cast("int")) for i, x in enumerate([first, *(s.letter for s in steps)])))
