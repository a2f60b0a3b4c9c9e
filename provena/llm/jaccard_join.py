"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (64-bit hashes of lower-cased words). Documents of equal sets are
one class. Classes link when ``100 * |A & B| >= 80 * |A | B|``; the join finds every such link's component:

1. ``sets``: one pass over the texts gives each document's set size and a 128-bit signature, and the corpus-wide
   shingle counts as a sketch of 2^18 counters (its size does not depend on the corpus).
2. ``prefixes``: shingles are ordered rare first by that sketch. A document keeps a quarter of them, and more where
   the estimated cost of its prefix (the summed counts) is high. The longer the prefixes, the more of their shingles a
   linked pair must share: with ``rest`` the shingles outside a prefix, at least ``overlap - max(rest)``. A document
   too few of whose prefix shingles occur elsewhere is out before any pair is formed. Per-shingle tables are written
   before they are joined, so that both sides are plain shuffles and a hot shingle's partition can be split, and the
   documents of one are dealt over blocks where they are paired.
3. Every class is verified against the smallest document of its shared prefix shingles, then in rounds against other
   documents of its most frequent ones. This is linear and joins whole groups of near copies, so that no group is
   expanded into its pairs.
4. Pairs whose components still differ are joined on their prefix shingles by classes of the ratio of their sizes and
   of their prefixes' lengths. Each class has its own number h of shingles that a pair shares at least, and a document
   leaves out its h - 1 most frequent: the rarest shared one is never among them. What is left is verified. Verification
   compares whole sets, so every link is exact.
5. Components by repeated minimum with pointer jumping, each round written to the shared folder.

Null and empty texts have an empty set and link with nothing. Rows that share a doc_id are one node. A null doc_id
takes the component of its class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm import kernels
from provena.llm.common import written

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
SKETCH_BITS = 18
#: Per cent of its set that a document's prefix holds beyond 100 - PERCENT, by the cost of the shortest such prefix: the
#: mean count of its counters, in multiples of the mean of all counters, passes none, one or both of COSTS.
EXTRA, COSTS = (5, 10, 16), (1.2, 4.0)
#: Bounds of the classes of size ratios; rounds and shingles by document in which hot shingles' other documents are tried.
RATIOS, ROUNDS, TRIES, HOT = (1.0, 1.04, 1.1, 1.17, 1.25), 2, 4, 16
#: Rows of one shingle that a task joins at most: groups of more are dealt over blocks of about so many.
BLOCK = 500
#: Bits of the filter that keeps texts of unpaired documents out of the shuffle before verification.
FILTER_BITS = 20


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(kernels.mix(s + np.uint64(0x51ED270B)))
        b = kernels.mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _each_set(batch: pa.RecordBatch, words: int):
    for _, _, texts in kernels.blocks(batch.column("text")):
        yield from kernels.Words(texts, kernels.SPACED).sets(words)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("bucket", pa.int32()), ("seen", pa.int64())])


def _sets(words: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            n, sig_a, sig_b, pending = [], [], [], []
            held = 0
            for s in _each_set(batch, words):
                n.append(len(s))
                a, b = _signature(s) if len(s) else (None, None)
                sig_a.append(a)
                sig_b.append(b)
                pending.append(s >> np.uint64(64 - SKETCH_BITS))
                held += len(s)
                if held > 1 << 18:
                    counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=len(counts))
                    pending, held = [], 0
            if held:
                counts += np.bincount(np.concatenate(pending).astype(np.int64), minlength=len(counts))
            nulls = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig_a, pa.int64()), pa.array(sig_b, pa.int64()), pa.nulls(len(n), pa.int32()), nulls], schema=_SETS)
        used = np.flatnonzero(counts)
        nulls = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, pa.array(used.astype(np.int32)), pa.array(counts[used])], schema=_SETS)

    return kernels.frugal(run)


def sets(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig_a, sig_b) by document, and (bucket, seen): the sketch of shingle counts over all documents."""
    both = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sets(words), "doc_id long, n long, sig_a long, sig_b long, bucket int, seen long"), "sets")
    return both.where("bucket is null").select("doc_id", "n", "sig_a", "sig_b"), both.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen"))


def _counters(sketch: DataFrame) -> np.ndarray:
    """The sketch on the driver: 2^18 numbers at most."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sketch.collect():
        counts[r["bucket"]] = r["seen"]
    return counts


_PREFIX = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("shingles", pa.list_(pa.int64()))])


def _prefixes(words: int, percent: int, shared):
    def run(batches):
        counts = shared.value
        order = (np.log2(counts + 1.0) * 16).astype(np.uint64) << np.uint64(54)
        mean = max(1.0, float(counts.sum()) / len(counts))
        for batch in batches:
            rows = ([], [], [], [])
            for doc, s in zip(batch.column("doc_id").to_pylist(), _each_set(batch, words), strict=True):
                n = len(s)
                if not n or doc is None:
                    continue
                bucket = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                by = np.argsort(order[bucket] | (s >> np.uint64(10)), kind="stable")
                base = n * (100 - percent + EXTRA[0]) // 100 + 1
                cost = float(counts[bucket[by[:base]]].mean()) / mean
                level = sum(cost > c for c in COSTS)
                length = n * (100 - percent + EXTRA[level]) // 100 + 1
                for column, x in zip(rows, (doc, n, level, s[by[:length]].view(np.int64)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PREFIX, strict=True)], schema=_PREFIX)

    return kernels.frugal(run)


_FULL = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])


def _full(words: int):
    def run(batches):
        for batch in batches:
            for a, b, texts in kernels.blocks(batch.column("text")):
                held = [s.tobytes() for s in kernels.Words(texts, kernels.SPACED).sets(words)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(held, pa.binary())], schema=_FULL)

    return kernels.frugal(run)


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            ok = []
            for x, y in zip(left, right, strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
                both = int((b[at] == a).sum()) if len(b) else 0
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return kernels.frugal(run)


def _verified(pairs: DataFrame, full: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (x, y) of class representatives whose whole sets link."""
    joined = pairs.join(full.select(F.col("id").alias("x"), F.col("shingles").alias("left")), "x").join(full.select(F.col("id").alias("y"), F.col("shingles").alias("right")), "y")
    return written(joined.select("x", "y", "left", "right").mapInArrow(_linked(percent), "x long, y long").distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): for each end of the edges (x, y) the smallest id that it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label; it ends when no label
    changes. Labels are written to the shared folder each round.
    """
    both = written(edges.select(F.col("x").alias("id"), F.col("y").alias("to")).union(edges.select(F.col("y"), F.col("x"))).where("id <> to").distinct(), "edges")
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("c")), "to").groupBy("id").agg(F.min("c").alias("c"))
        step = labels.join(near, "id", "left").select("id", F.col("comp").alias("was"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        step = written(step.join(up, "comp", "left").select("id", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        labels = step.select("id", "comp")
        if step.where("comp <> was").isEmpty():
            return labels


def _needed(percent: int):
    """Prefix shingles that a linked pair (n_a, p_a), (n_b, p_b) shares at least: overlap less the larger rest."""
    overlap = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100.0 + percent) - 1e-9)
    return F.greatest(F.lit(1), overlap - F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")))


def _sets_of(docs: DataFrame, pairs: DataFrame, words: int, name: str) -> DataFrame:
    """(id, shingles) of at least the documents in ``pairs``. The filter is 2^20 small numbers, whatever the corpus."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).alias("bit")
    need = pairs.select(bit("x")).union(pairs.select(bit("y"))).distinct()
    return written(docs.withColumn("bit", bit("doc_id")).join(F.broadcast(need), "bit", "left_semi").select("doc_id", "text").mapInArrow(_full(words), "id long, shingles binary"), name)


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig_a, sig_b) by document, and (n, sig_a, sig_b, rep, comp) by class of equal sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_doc, sketch = sets(docs, words)
    reps = written(by_doc.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep")), "reps")
    counts = spark.sparkContext.broadcast(_counters(sketch))
    prefix = written(docs.mapInArrow(_prefixes(words, percent, counts), "id long, n long, level int, shingles array<bigint>"), "prefixes")
    rows = prefix.select("id", F.explode("shingles").alias("shingle"))
    # Only shingles that several documents have go on: with the smallest of these as their centre.
    centre = rows.groupBy("shingle").agg(F.min("id").alias("centre"), F.max("id").alias("most")).where("centre <> most").select("shingle", "centre")
    centre = written(centre, "centres")
    sizes = prefix.select("id", "n", "level", F.size("shingles").alias("p")).join(reps.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").distinct()
    shared = written(rows.join(centre, "shingle"), "shared")
    # A partner's size and prefix can be anything within the bounds: a linked document shares
    # EXTRA[0] per cent of its set at the least.
    able = written(shared.groupBy("id").agg(F.count("*").alias("hits")).join(sizes, "id").where(F.col("hits") * 100 >= F.col("n") * EXTRA[0]).select("id", "n", "p", "level"), "able")
    shared = written(shared.join(able, "id"), "able_rows")
    held = written(shared.groupBy("id").agg(F.collect_list("shingle").alias("held")), "held")

    hits = shared.where("id <> centre").groupBy(F.col("centre").alias("x"), F.col("id").alias("y"), F.col("n").alias("n_b"), F.col("p").alias("p_b")).agg(F.count("*").alias("hits"))
    near = hits.join(able.select(F.col("id").alias("x"), F.col("n").alias("n_a"), F.col("p").alias("p_a")), "x")
    near = near.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("hits") >= _needed(percent)))
    near = written(near.select("x", "y"), "near_pairs")
    links = _verified(near, _sets_of(docs, near, words, "near_sets"), percent, "near")
    comps = components(links)

    at = _apart(shared, comps)
    for i in range(ROUNDS):
        pairs = written(_enough(_tried(at, i), able, held, percent), "tried")
        if pairs.isEmpty():
            break
        found = _verified(pairs, _sets_of(docs, pairs, words, "tried_sets"), percent, "found")
        if found.isEmpty():
            break
        links = written(links.union(found), "links")
        comps = components(links)
        at = _apart(shared, comps)

    rest = written(_enough(_classed(at, percent), able, held, percent), "rest_pairs")
    if not rest.isEmpty():
        found = _verified(rest, _sets_of(docs, rest, words, "rest_sets"), percent, "rest")
        if not found.isEmpty():
            comps = components(links.union(found))
    return by_doc, written(reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("n", "sig_a", "sig_b", "rep", F.coalesce("comp", "rep").alias("comp")), "classes")


def _apart(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """The shared prefix shingles that join different components: d, their documents, and each document's order by it."""
    at = shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    counted = at.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("d")).where("lo <> hi").select("shingle", "d")
    counted = written(counted, "counted")
    often = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("d"), F.desc("shingle")))
    return written(at.join(counted, "shingle").select("shingle", "id", "n", "p", "level", "comp", "d").withColumn("often", often), "apart")


def _tried(at: DataFrame, i: int) -> DataFrame:
    """Pairs of each document with one other, by round, of each of its few hottest shingles."""
    hot = at.where(F.col("d") >= HOT)
    other = hot.groupBy("shingle").agg(F.min_by("id", F.xxhash64("id", "shingle", F.lit(i))).alias("other"), F.max("d").alias("d"))
    # The one other document of a shingle is given to each of its blocks, so that no task gets all its documents.
    other = other.select("shingle", "other", F.explode(F.sequence(F.lit(0).cast("long"), _blocks() - 1)).alias("block"))
    pairs = hot.where(F.col("often") <= TRIES).withColumn("block", _block()).join(other, ["shingle", "block"]).where("id <> other")
    return pairs.select(F.least("id", "other").alias("x"), F.greatest("id", "other").alias("y")).distinct()


def _blocks():
    """Blocks of a shingle's documents, from their number ``d``."""
    return F.floor(F.col("d") / BLOCK) + 1


def _block():
    return F.pmod(F.xxhash64("id"), _blocks())


def _enough(pairs: DataFrame, able: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sizes can link and whose prefixes share enough."""
    for side, c in (("a", "x"), ("b", "y")):
        pairs = pairs.join(able.select(F.col("id").alias(c), F.col("n").alias(f"n_{side}"), F.col("p").alias(f"p_{side}")), c)
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    for side, c in (("a", "x"), ("b", "y")):
        pairs = pairs.join(held.select(F.col("id").alias(c), F.col("held").alias(f"held_{side}")), c)
    return pairs.where(F.size(F.array_intersect("held_a", "held_b")) >= _needed(percent)).select("x", "y")


def _classed(at: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y) of different components. A class is (ratio, level of the smaller, level of the larger)."""
    t, n, outside = percent / (100.0 + percent), F.col("n"), F.col("n") - F.col("p")
    top = 100.0 / percent
    bounds = [*(r for r in RATIOS if r < top), top]

    def least(smaller: bool, k: int, level: int):
        lo, hi = bounds[k], bounds[k + 1]
        spare = (percent - EXTRA[level]) / 100.0 - t  # of the partner: outside its prefix beyond its share of the overlap
        first, last = (lo, hi) if smaller else (1 / hi, 1 / lo)
        return F.greatest(F.lit(1), F.ceil(F.least(t * (n + first * n) - outside, t * n - last * n * spare) - 1e-6))

    def side(smaller: bool, name: str) -> DataFrame:
        kinds = [F.when(F.col("often") >= least(smaller, k, level), F.struct(F.lit(k).alias("k"), F.lit(level).alias("partner"))) for k in range(len(bounds) - 1) for level in range(len(EXTRA))]
        rows = at.withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
        mine, other = ("level_a", "level_b") if smaller else ("level_b", "level_a")
        return rows.select("shingle", _blocks().alias("blocks"), F.col("kind.k").alias("k"), F.col("level").alias(mine), F.col("kind.partner").alias(other), *(F.col(c).alias(f"{c}_{name}") for c in ("id", "n", "comp")))

    # Each smaller document is in one row of blocks and each larger one in one column: they meet in one place, and a
    # task gets BLOCK documents of either.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    smaller_side = side(True, "a").withColumns({"row": F.pmod(F.xxhash64("id_a"), F.col("blocks")), "column": every})
    larger_side = side(False, "b").withColumns({"column": F.pmod(F.xxhash64("id_b"), F.col("blocks")), "row": every})
    pairs = smaller_side.drop("blocks").join(larger_side.drop("blocks"), ["shingle", "k", "level_a", "level_b", "row", "column"])
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))
    high = F.element_at(F.array(*(F.lit(b) for b in bounds[1:])), F.col("k") + 1)
    low = F.element_at(F.array(F.lit(0.0), *(F.lit(b) for b in bounds[1:-1])), F.col("k") + 1)
    ratio = F.col("n_b") / F.col("n_a")
    pairs = pairs.where(smaller & (F.col("comp_a") != F.col("comp_b")) & (ratio > low) & (ratio <= high))
    return pairs.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document (doc_id, n_shingles, class_id, component_id); class_id is the smallest document of equal set."""
    by_doc, by_class = classes(docs, words, percent)
    keys = ["n", "sig_a", "sig_b"]
    out = by_doc.join(by_class, keys, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("comp", "doc_id").alias("component_id"))
