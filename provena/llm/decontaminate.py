"""Benchmark decontamination by template canonicalisation.

Words are lower-cased. A template has typed placeholders: numbers, quantities (a number with its unit, glued or apart)
and names (capitalised words but function words; adjacent ones are one name), each a single token whatever its number
of words; the words they stand for are its slot's value. Windows of eight words, literal, and of eight tokens,
templated, are hashed with their place; a shorter item is one window of its own length. Documents' windows meet the
benchmark's on the hash. Hits are counted by item and run: neighbouring diagonals, up to NEAR words inserted or
dropped, are one run. A templated run counts only if its slots are consistent: the same benchmark value always stands
for the same document value, so a question with new numbers or names is caught, while an unrelated text of the same
shape is not. An item is leaked when ``min(6, half)`` of its windows, literal or templated, hit in one run.

Only a filter of 2^20 bits of the benchmark's hashes goes to the workers; it drops windows that cannot hit before they
leave Python, and the exact join follows, broadcast only if the benchmark's counted windows are small. Null text is
empty text, without windows. Rows are told apart by position, so repeated rows and null ids keep a result each;
repeated items are found each. Empty tables (either) give no leaks. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm import kernels
from provena.llm.common import small, written

WORDS = 8
#: Tokens that are no placeholder which a templated window of eight holds at least.
LITERAL = 5
ENOUGH = 6
#: Diagonals this near are one run.
NEAR = 3
FILTER_BITS = 20
# Unit words, of lower-cased text.
UNITS = "kg g mg lb oz km m cm mm mi ft l ml s min h hr hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros usd eur cents percent mph kmh liters litres meters metres miles pounds grams".split()
# Function words that are no names though they may be capitalised.
FUNCTION = "a an the and or but if then so in on at of to by for from with as is are was were be it its he she they we you i his her their this that these those there here when where what which who why how do does did can could will would may one two each every all some any no not after before answer question".split()
_DIGITS = kernels.class_table(b"0123456789")
_STOPS = kernels.class_table(b".,:/")

_OUT = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("total", pa.int32()), ("pos", pa.int32()), ("h", pa.int64()), ("literal", pa.bool_()), ("slots", pa.list_(pa.int64()))])


def _known(words: list[str]) -> np.ndarray:
    """Sorted hashes of fixed words."""
    key = words[0], len(words)
    if key not in _hashes:
        _hashes[key] = np.sort(kernels.Words([" ".join(words).encode()], kernels.ALNUM).hash)
    return _hashes[key]


_hashes: dict[tuple[str, int], np.ndarray] = {}


def _is(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _merged(value: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, first words) of the words with those marked ``more`` taken into the word before, in order."""
    first = np.flatnonzero(~more)
    size = np.diff(np.append(first, len(value)))
    within = (np.arange(len(value)) - np.repeat(first, size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        joined = kernels.mix(np.add.reduceat(value * (kernels.mix(within) | np.uint64(1)), first) + size.astype(np.uint64))
    return np.where(size == 1, value[first], joined), first


class _Canonical:
    """Words and tokens of a block of texts: values, what each stands for, whether it is a slot, and counts by text."""

    def __init__(self, w: kernels.Words):
        texts = len(w.first) - 1
        owner = np.repeat(np.arange(texts), np.diff(w.first))
        n = len(owner)
        if not n:
            self.value = self.token = self.template = np.zeros(0, np.uint64)
            self.slot, self.counts, self.tokens = np.zeros(0, bool), np.zeros(texts, np.int64), np.zeros(texts, np.int64)
            return
        is_digit = _DIGITS[w.buf]
        run_ends = np.flatnonzero(is_digit[:-1] & ~is_digit[1:]) + 1
        size = w.ends - w.starts
        digits = np.zeros(n, np.int64)  # how many digits a word begins with
        at = np.flatnonzero(is_digit[w.starts])
        digits[at] = np.minimum(run_ends[np.searchsorted(run_ends, w.starts[at] + 1)] - w.starts[at], size[at])
        number, glued = digits == size, np.zeros(n, bool)
        tail = np.flatnonzero((digits > 0) & (digits < size))
        if len(tail):
            glued[tail] = _is(_known(UNITS), w.hash_of(w.starts[tail] + digits[tail], w.ends[tail]))
        after, gap = np.zeros(n, bool), np.zeros(n, np.int64)  # the word before is of the same text; bytes between
        after[1:] = owner[1:] == owner[:-1]
        gap[1:] = w.starts[1:] - w.ends[:-1]
        between = w.buf[np.maximum(w.starts - 1, 0)]  # the one character of a gap of one
        before = lambda x: np.concatenate(([False], x[:-1]))
        part = (number | glued) & after & before(number) & (gap == 1) & _STOPS[between]
        # Of 3.5 or 10,000 one number: words as the literal windows see them.
        self.value, keep = _merged(w.hash, part)
        self.counts = np.bincount(owner[keep], minlength=texts)
        owner, n = owner[keep], len(keep)
        ends = np.append(keep[1:], len(size)) - 1  # each one's last word
        start, stop = w.starts[keep], w.ends[ends]
        number, glued = (number | glued)[keep] & ~glued[ends], glued[ends]
        after, gap, between = np.zeros(n, bool), np.zeros(n, np.int64), w.buf[np.maximum(start - 1, 0)]
        after[1:] = owner[1:] == owner[:-1]
        gap[1:] = start[1:] - stop[:-1]
        raw, nxt = w.raw[start], w.raw[np.minimum(start + 1, len(w.raw) - 1)]
        name = (raw >= 65) & (raw <= 90) | (raw == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E)
        name &= ~_is(_known(FUNCTION), self.value)
        unit = after & before(number) & _is(_known(UNITS), self.value)
        quantity = glued | unit
        quantity[:-1] |= unit[1:]
        run = name & after & before(name & ~unit) & ~unit & (gap == 1)
        token, first = _merged(self.value, unit | run)
        kind = np.where(quantity, np.uint64(2), np.where(number, np.uint64(1), np.where(name & ~unit, np.uint64(3), np.uint64(0))))[first]
        self.slot = kind > 0
        self.token = token
        self.template = np.where(self.slot, kind, token)
        self.tokens = np.bincount(owner[first], minlength=texts)


def _windows(sizes, bits):
    """Rows by text (h null; pos holds its tokens), then a row for each window whose hash passes ``bits`` (all, if None)."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        passes = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            ids = batch.column("id")
            for a, b, texts in kernels.blocks(batch.column("text")):
                c = _Canonical(kernels.Words(texts, kernels.ALNUM))
                rids = rid + np.arange(b - a)
                rid += b - a
                none = pa.nulls(b - a)
                yield pa.RecordBatch.from_arrays([pa.array(rids), ids.slice(a, b - a), pa.array(c.counts.astype(np.int32)), pa.array(c.tokens.astype(np.int32)), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.list_(pa.int64()))], schema=_OUT)
                slots = np.concatenate(([0], np.cumsum(c.slot)))
                for literal, h_of, counts in ((True, c.value, c.counts), (False, c.template, c.tokens)):
                    first = np.concatenate(([0], np.cumsum(counts)))
                    owner = np.repeat(np.arange(b - a), counts)
                    for size in sizes or sorted({min(WORDS, k) for k in counts.tolist() if k}):
                        n = len(h_of) - size + 1
                        if n <= 0:
                            continue
                        own = owner[:n]
                        pos = np.arange(n) - first[own]
                        ok = pos + size <= counts[own]
                        if sizes is None:  # of an item: windows of eight, or the whole of a shorter one
                            ok &= np.minimum(counts[own], WORDS) == size
                        if not literal:
                            ok &= (size - (slots[size:] - slots[:-size])) * WORDS >= LITERAL * size
                        h = kernels.windows(size, h_of)
                        with np.errstate(over="ignore"):
                            h = kernels.mix(h + np.uint64(size * 2 + literal))
                        if passes is not None:
                            ok &= passes[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                        at = np.flatnonzero(ok)
                        if not len(at):
                            continue
                        held = [[] if literal else c.token[i : i + size][c.slot[i : i + size]].view(np.int64) for i in at]
                        none = pa.nulls(len(at))
                        yield pa.RecordBatch.from_arrays([pa.array(rids[own[at]]), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(pos[at].astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array([literal] * len(at)), pa.array(held, pa.list_(pa.int64()))], schema=_OUT)

    return kernels.frugal(run)


_DDL = "rid long, id long, total int, pos int, h long, literal boolean, slots array<bigint>"


def leaks(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id) by document and (rid, item_id, hits, exact) by leaked item; exact: hits of literal windows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string"))
    items = written(items.mapInArrow(_windows(None, None), _DDL), "items")
    of = items.where("h is null").select("rid", F.col("id").alias("item_id"), F.col("total").alias("words"), F.col("pos").alias("tokens"))
    windows = items.where("h is not null").select("rid", "h", "literal", F.col("pos").alias("ipos"), F.col("slots").alias("islots")).join(of, "rid").drop("rid")
    of_item = F.when(F.col("literal"), F.col("words")).otherwise(F.col("tokens"))
    size = F.least(F.lit(WORDS), of_item)
    windows = written(windows.select("item_id", "h", "ipos", "islots", size.alias("size"), (of_item - size + 1).alias("item_windows")), "windows")
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most eight
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r[0] for r in windows.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int")).distinct().collect()]] = True
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())
    table = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    table = written(table.mapInArrow(_windows(sorted(sizes) or [WORDS], shared), _DDL), "documents")
    by_doc = table.where("h is null").select("rid", F.col("id").alias("doc_id"))
    hits = table.where("h is not null").select("rid", "pos", "h", "literal", "slots").join(F.broadcast(windows) if small(windows, 128) else windows, "h")
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("ipos"))
    by = Window.partitionBy("rid", "item_id", "literal").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEAR, F.lit(True)).cast("int")
    hits = written(hits.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by)), "hits")
    run = ["rid", "item_id", "literal", "run"]
    # The same benchmark value must stand for one document value in the whole run.
    pairs = hits.where(~F.col("literal")).select(*run, F.explode(F.arrays_zip("islots", "slots")).alias("x")).groupBy(*run, F.col("x.islots").alias("i")).agg(F.min("x.slots").alias("lo"), F.max("x.slots").alias("hi"))
    clash = pairs.where("lo <> hi").select(*run).distinct()
    runs = hits.join(clash, run, "left_anti").groupBy(*run, "item_windows").agg(F.count_distinct("ipos").alias("hits"))
    found = runs.where(F.col("hits") >= F.least(F.lit(ENOUGH), F.ceil(F.col("item_windows") / 2)))
    return by_doc, found.groupBy("rid", "item_id").agg(F.max("hits").alias("hits"), F.coalesce(F.max(F.when(F.col("literal"), F.col("hits"))), F.lit(0)).alias("exact"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document doc_id, contaminated, item_ids (sorted), n_windows, and reworded: items of which templates hit more than twice the literal windows."""
    by_doc, found = leaks(docs, benchmark)
    found = found.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.sum("hits").cast("long").alias("n_windows"), F.array_sort(F.collect_set(F.when(F.col("exact") * 2 < F.col("hits"), F.col("item_id")))).alias("reworded"))
    none = F.array().cast("array<bigint>")
    return by_doc.join(found, "rid", "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("reworded", none).alias("reworded"))
