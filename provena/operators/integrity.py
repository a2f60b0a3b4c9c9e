"""Hash chains and Merkle trees over a run's evidence rows (by, seq, digest)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions import canonical
from provena.operators.iterate import dealt, written

def _in_order(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Each group's rows in one partition and in order; a sort that does not fit in memory spills. Small tables are dealt over all cores, too."""
    return dealt(rows, *by).sortWithinPartitions(*by, *order)


def chained(rows: DataFrame, by: list[str], start: DataFrame | None = None) -> DataFrame:
    """``rows`` with parent_hash and chain_hash: sha256 of the digest and the previous chain hash, in the order of ``seq``.

    ``start`` (by, chain_hash): the hash that a run's chain goes on from; without one it begins with "". A chain is
    sequential by definition: the task that holds a run reads its rows in sorted batches and carries one hash, so a run
    of any length needs no more memory. Checking is not sequential. Of equal ``seq`` the smaller digest comes first; a
    null digest counts as "".
    """
    import hashlib as h

    import pyarrow as pa

    given = rows.withColumns({"_state": F.lit(None).cast("string"), "_own": F.lit(True)})
    if start is not None:
        fields = [F.col(c) if c in by else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
        given = given.unionByName(start.select(*fields, F.col("chain_hash").alias("_state"), F.lit(False).alias("_own")))

    def fold(batches):
        key, last = None, ""
        for batch in batches:
            parents, hashes = [], []
            columns = [batch.column(c).to_pylist() for c in (*by, "digest", "_state", "_own")]
            for *at, digest, state, own in zip(*columns, strict=True):
                if at != key:
                    key, last = at, ""
                parents.append(last)
                last = h.sha256(((digest or "") + last).encode()).hexdigest() if own else state
                hashes.append(last)
            kept = batch.column("_own")
            names = [n for n in batch.schema.names if n not in ("_state", "_own")]
            out = [batch.column(n) for n in names] + [pa.array(parents, pa.string()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "parent_hash", "chain_hash"]).filter(kept)

    schema = T.StructType([*rows.schema.fields, T.StructField("parent_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])
    return _in_order(given, by, "_own", "seq", "digest").mapInArrow(fold, schema)


def joined_digest(rows: DataFrame, by: list[str], seq: str, text: str, between: str = " ") -> DataFrame:
    """(by, chars, digest): length and sha256 of each run's texts in the order of ``seq``, as one; none is ever put together."""
    import hashlib as h

    import pyarrow as pa

    def fold(batches):
        key, state, chars, schema, done = None, None, 0, None, []
        for batch in batches:
            schema = schema or pa.schema([*(batch.schema.field(c) for c in by), ("chars", pa.int64()), ("digest", pa.string())])
            for *at, value in zip(*(batch.column(c).to_pylist() for c in (*by, text)), strict=True):
                if at != key:
                    if state is not None:
                        done.append((*key, chars, state.hexdigest()))
                    key, state, chars = at, h.sha256(), 0
                else:
                    state.update(between.encode())
                    chars += len(between)
                state.update(value.encode())
                chars += len(value)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, chars, state.hexdigest()), schema, strict=True)], schema=schema)

    held = rows.where(F.col(text).isNotNull()).select(*by, seq, text)
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("chars", T.LongType()), T.StructField("digest", T.StringType())])
    return _in_order(held, by, seq, text).mapInArrow(fold, schema)


def chain_faults(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, fault): rows whose parent is not the row before, or whose hash is not that of its content."""
    w = Window.partitionBy(*by).orderBy("seq")
    parent = F.coalesce(F.lag("chain_hash").over(w), F.lit(""))
    fault = F.when(F.col("parent_hash") != parent, "parent_mismatch").when(F.col("chain_hash") != F.sha2(F.concat(F.coalesce("digest", F.lit("")), "parent_hash").cast("binary"), 256), "content_mismatch")
    return rows.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*by, "seq", "fault")


#: Levels of arrays and objects in a text with a canonical digest.
LEVELS = 32


def canonical_digests(rows: DataFrame, text: str, name: str = "digest") -> DataFrame:
    """``rows`` with the sha256 of the canonical form of a column of JSON; null where there is none.

    Nothing is shuffled: the expression is as deep as the deepest text, which one pass over the brackets tells (LEVELS at
    most: a deeper text has no digest).
    """
    # Rows have few patterns of brackets: these combine before the shuffle, and each is measured once.
    shapes = rows.select(canonical.brackets(F.col(text)).alias("b")).distinct()
    deepest = shapes.agg(F.max(canonical.depth(F.col("b"))).alias("deepest")).first()["deepest"] or 0
    deepest = min(deepest, LEVELS)
    digest = F.sha2(canonical.dump(F.col(text), deepest).cast("binary"), 256)
    return rows.withColumn(name, F.when(canonical.depth(canonical.brackets(F.col(text))) <= LEVELS, digest) if deepest == LEVELS else digest)


def leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"\x00"), data.cast("binary")), 256)


def node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit(b"\x01"), F.unhex(left), F.unhex(right)), 256)


#: Levels of a tree that are worked out in one row: a block has 2^BLOCK nodes of the lowest of them.
BLOCK = 6


def merkle_blocks(rows: DataFrame, by: list[str], data: str) -> list[DataFrame]:
    """Blocks (by, block, hashes) from the leaves up, each table the nodes BLOCK levels above the one before it."""
    w = Window.partitionBy(*by).orderBy("seq")
    held = dealt(rows.select(*by, "seq", F.col(data).alias("_data")), *by)
    leaves = held.select(*by, (F.row_number().over(w) - 1).cast("long").alias("idx"), leaf(F.col("_data")).alias("hash"))
    # Leaves are in one partition by run already: their blocks need no further shuffle.
    return _grown(_blocked(leaves, by), by)


def _blocked(level: DataFrame, by: list[str]) -> DataFrame:
    nodes = F.array_sort(F.collect_list(F.struct("idx", "hash")))
    return level.groupBy(*by, F.shiftright("idx", BLOCK).alias("block")).agg(F.transform(nodes, lambda x: x["hash"]).alias("hashes"))


def _grown(leaves: DataFrame, by: list[str]) -> list[DataFrame]:
    """``merkle_blocks`` of the blocks of the leaves."""
    out = [written(leaves, "blocks")]
    while not out[-1].where("block > 0").isEmpty():
        out.append(written(_blocked(_climbed(out[-1]).select(*by, F.col("block").alias("idx"), _top().alias("hash")), by), "blocks"))
    return out


def _climbed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``levels``, the hashes of each level, 0 to BLOCK: neighbours are joined, a lone last node goes up unchanged.

    One expression, in which a level is a variable: levels that are columns on columns are put into each other by a
    filter, such as an explode brings, and each hash then works out all below it anew.
    """

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        left, right = (lambda n: F.get(last, n * 2)), (lambda n: F.get(last, n * 2 + 1))
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(last) + 1, 1) - 1)
        return F.concat(levels, F.array(F.transform(pairs, lambda n: F.when(n * 2 + 1 < F.size(last), node(left(n), right(n))).otherwise(left(n)))))

    return blocks.withColumn("levels", F.aggregate(F.sequence(F.lit(1), F.lit(BLOCK)), F.array("hashes"), up))


def _top() -> Column:
    """The node that a climbed block leads to."""
    return F.get(F.get("levels", F.lit(BLOCK)), F.lit(0))


def _beside(i: int, n: Column) -> Column:
    """(side, hash) of the neighbour of a climbed block's node ``n`` at level ``i``; null where it is a lone last one."""
    level, other = F.get("levels", F.lit(i)), n.bitwiseXOR(F.lit(1)).cast("int")
    return F.when(other < F.size(level), F.struct(F.when(n % 2 == 0, "right").otherwise("left").alias("side"), F.get(level, other).alias("hash")))


def merkle_root(rows: DataFrame, by: list[str], data: str, blocks: list[DataFrame] | None = None) -> DataFrame:
    return _climbed((blocks or merkle_blocks(rows, by, data))[-1]).select(*by, _top().alias("root"))


def _within(sizes: DataFrame, blocks: list[DataFrame], by: list[str]) -> DataFrame:
    """(by, first, size): the sizes (by, first) that their trees have had, once each, and how many leaves these have now."""
    size = blocks[0].groupBy(*by).agg(F.sum(F.size("hashes")).alias("size"))
    return sizes.select(*by, "first").distinct().join(size, by).where((F.col("first") >= 1) & (F.col("first") <= F.col("size")))


def early_roots(blocks: list[DataFrame], by: list[str], sizes: DataFrame) -> DataFrame:
    """(by, first, root) of the trees of the first ``first`` leaves (``sizes``: by, first), grown from these leaves."""
    rest = F.col("first") - F.shiftleft("block", BLOCK)
    held = blocks[0].join(_within(sizes, blocks, by), by).where(rest > 0)
    cut = held.select(*by, "first", "block", F.slice("hashes", 1, F.least(rest, F.lit(1 << BLOCK)).cast("int")).alias("hashes"))
    return _climbed(_grown(dealt(cut, *by, "block"), [*by, "first"])[-1]).select(*by, "first", _top().alias("root"))


def inclusion_proofs(rows: DataFrame, by: list[str], data: str, blocks: list[DataFrame] | None = None) -> DataFrame:
    """(by, idx, hash, path): the siblings of each leaf from the leaves up, (side, hash), to recompute the root.

    From the roots down: a block's nodes share what is above it, so that paths are joined to blocks, never to leaves.
    """
    none = F.array().cast("array<struct<side:string,hash:string>>")
    above = None
    for table in reversed(blocks or merkle_blocks(rows, by, data)):
        held = table.withColumn("above", none) if above is None else table.join(above, [*by, "block"])
        steps = [_beside(i, F.shiftright("n", i)) for i in range(BLOCK)]
        leaves = _climbed(held).select("*", F.posexplode("hashes").alias("n", "hash"))
        out = leaves.select(*by, (F.shiftleft("block", BLOCK) + F.col("n")).alias("idx"), "hash", F.concat(F.array_compact(F.array(*steps)), "above").alias("path"))
        above = out.select(*by, F.col("idx").alias("block"), F.col("path").alias("above"))
    return out


def root_of(hash_: Column, path: Column) -> Column:
    """The root that a leaf's path leads to."""
    return F.aggregate(path, hash_, lambda h, s: F.when(s["side"] == "right", node(h, s["hash"])).otherwise(node(s["hash"], h)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal: the two padded keys are constants."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))), 256)


def consistency_proofs(rows: DataFrame, by: list[str], data: str, sizes: DataFrame, blocks: list[DataFrame] | None = None) -> DataFrame:
    """(by, first, size, path): for each tree the nodes, (side, hash), that prove its first ``first`` leaves (``sizes``: by, first) unchanged.

    From the first tree's last leaf up: right turns are shared by both trees, so the path starts at the first left one,
    the level of the lowest bit of ``first``. A neighbour on the left belongs to both roots, one on the right to the
    larger tree's. All are in the one block of each table that the climb goes through.
    """
    tables = blocks or merkle_blocks(rows, by, data)
    out = _within(sizes, tables, by).withColumn("path", F.array().cast("array<struct<side:string,hash:string>>"))
    first, last = F.col("first").cast("long"), F.col("first").cast("long") - 1
    for k, table in enumerate(tables):
        steps = []
        for i in range(BLOCK):
            level = k * BLOCK + i
            at = F.shiftright(last, level).bitwiseAND(F.lit((1 << BLOCK - i) - 1)).cast("int")
            turned = first.bitwiseAND(F.lit((2 << level) - 1))
            opening = (turned == 1 << level) & (first != 1 << level)
            steps += [F.when(opening, F.struct(F.lit("both").alias("side"), F.get(F.get("levels", F.lit(i)), at).alias("hash"))), F.when(turned != 0, _beside(i, at))]
        here = out.withColumn("block", F.shiftright(last, (k + 1) * BLOCK)).join(table, [*by, "block"])
        path = F.when(F.col("first") == F.col("size"), F.col("path")).otherwise(F.concat("path", F.array_compact(F.array(*steps))))
        out = _climbed(here).select(*by, "first", "size", path.alias("path"))
    return out


def consistent(first: Column, size: Column, first_root: Column, root: Column, path: Column) -> Column:
    """Whether a path proves the smaller tree to be the start of the larger. A malformed path proves nothing."""
    whole = first.bitwiseAND(first - 1) == 0
    start = F.when(whole, first_root).otherwise(F.get(path, 0)["hash"])
    rest = F.when(whole, path).otherwise(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))))

    def fold(a: Column, x: Column) -> Column:
        left = x["side"] == "left"
        return F.struct(F.when(left, node(x["hash"], a["f"])).otherwise(a["f"]).alias("f"), F.when(left, node(x["hash"], a["s"])).otherwise(node(a["s"], x["hash"])).alias("s"))

    both = F.aggregate(rest, F.struct(start.alias("f"), start.alias("s")), fold)
    proven = (F.size(path) > 0) & (both["f"] == first_root) & (both["s"] == root)
    return F.coalesce(F.when((first < 1) | (first > size), False).when(first == size, (F.size(path) == 0) & (first_root == root)).otherwise(proven), F.lit(False))
