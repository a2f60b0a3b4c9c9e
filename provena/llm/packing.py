"""Packing of documents into token sequences by non-negative least squares over the length histogram.

1. One pass tokenises whole texts; a document's ids end with ``END``. Full windows of 2048 ids are sequences of their
   own; each document's remainder of 1 to 2047 ids is counted by length.
2. On the driver, from that histogram of 2047 numbers: the combinations of one to three lengths that fill a window (or
   alone are a power of two, which needs no padding) are enumerated, the repeats of each solved by coordinate descent on
   non-negative least squares against the histogram, and rounded down to what the histogram holds.
3. Remainders in no repeat are packed greedily: in the order of length (longest first) and rank, each is put after
   the one before, and the piece that meets a window's end is cut there. The last window is cut at its powers of two, so
   that it needs no padding either.

A remainder's place follows from its rank among those of its length. Ranks come from counts by (length, salt), so that
a length with a third of all rows is ranked by many tasks; the plan joined to the rows has a row for each use of a
length by a combination, and its size does not depend on the corpus. Null text is empty text: one id, END. Repeated rows are packed each.
An empty table has no pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm import kernels
from provena.llm.common import small, written

WINDOW, END, SALTS = 2048, 1, 512
#: Lengths that a third piece of a combination is taken from: the most frequent ones.
COMMON = 24
SWEEPS = 20
#: Cached chunks of a worker; the cache starts anew beyond. Bytes of a long text that are encoded at once.
CACHE, PART = 200_000, 1 << 20
#: Characters from here on always go to tokenizers.
PLAIN = 0x250
_GAP = re.compile(rb"[ \t\n\v\f\r]")
FILTER_BITS = 20


class Encoder(dict):
    """Ids of a word-end BPE vocabulary file, as tokenizers gives them without adding special tokens.

    Pieces never cross white space, so a text's ids are those of its chunks between ASCII white space, which are kept
    here. A new chunk goes to tokenizers itself unless all its characters are ``plain``: ones that are their own
    normal form and for which this class's lower case, split and merges were seen to give the ids of tokenizers when
    the file was loaded. Each of these steps looks at single characters, but for the merges, which follow the ranks.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(t) for t in special).encode() or b"(?!)")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        suffix = spec["model"]["end_of_word_suffix"]
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others follow from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        # No UTF-8 text holds the byte 255: it stands for the end of a word.
        ranks = {bytes(byte[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        known = [c for c in map(chr, range(0x21, PLAIN)) if not c.isspace() and unicodedata.is_normalized("NFC", c + "a") and not unicodedata.combining(c)]
        self.plain = frozenset(c for c in known if all(self._merged(x) == self._asked(x) for x in (c, f"ab{c}cd", f"1{c}{c}", f"'{c}.{c}")))

    def _merged(self, text: str) -> bytes:
        text = text.lower()
        if text.isascii() and text.isalpha():  # one piece
            return array("I", self.merge(text.encode() + b"\xff")).tobytes()
        ids = array("I")
        for p in self.pattern.findall(text):
            ids.extend(self.merge(p.encode() + b"\xff"))
        return ids.tobytes()

    def _asked(self, text: str) -> bytes:
        return array("I", self.inner.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        ids = self._merged(text) if self.plain.issuperset(text) and not self.special.search(chunk) else self._asked(text)
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of UTF-8 text; long texts go in parts that end at white space."""
        parts, at = [], 0
        while at < len(text):
            gap = _GAP.search(text, at + PART) if len(text) - at > PART else None
            end = gap.start() if gap else len(text)
            parts.append(b"".join(map(self.__getitem__, text[at:end].split())))
            at = end
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_DDL = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(path: str, window: int, end: int):
    mark = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, rid = encoder(path).encode, TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in kernels.blocks(batch.column("text")):
                rows: tuple[list, ...] = ([], [], [], [], [], [], [])
                for doc, text in zip(ids[a:b], texts, strict=True):
                    got = encode(text or b"") + mark
                    n = len(got) // 4
                    for at in range(0, n, window):
                        piece = got[at * 4 : (at + window) * 4]
                        for column, x in zip(rows, (rid, doc, at, len(piece) // 4, zlib.crc32(piece), n, piece), strict=True):
                            column.append(x)
                        rid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)

    return kernels.frugal(run)


def combinations(have: dict[int, int], window: int = WINDOW, common: int = COMMON) -> list[tuple[int, ...]]:
    """Of the lengths in ``have``: powers of two alone, pairs that fill the window, and triples with one of the
    ``common`` most frequent lengths."""
    found = [(n,) for n in sorted(have) if n & (n - 1) == 0]
    found += [(window - a, a) for a in sorted(have) if 2 * a <= window and window - a in have]
    triples = set()
    for c in sorted(have, key=lambda n: (-have[n], n))[:common]:
        for a in have:
            b = window - c - a
            if b >= a and b in have:
                triples.add(tuple(sorted((a, b, c), reverse=True)))
    return found + sorted(triples)


def solve(have: dict[int, int], patterns: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Repeats x >= 0 that minimise |A x - have|^2, by coordinate descent; A counts a pattern's lengths."""
    left = {n: float(c) for n, c in have.items()}
    uses = [[(n, p.count(n)) for n in dict.fromkeys(p)] for p in patterns]
    norms = [sum(m * m for _, m in u) for u in uses]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(uses):
            step = max(-x[j], sum(m * left[n] for n, m in u) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in u:
                    left[n] -= m * step
        if moved < 0.01:
            break
    return x


def plan(have: dict[int, int], window: int = WINDOW, common: int = COMMON) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int], int]:
    """(length, first rank, end rank, first sequence, offset) by use, the ranks used by length, and the sequences.

    Rounded repeats first, those solved largest first; then whatever whole combinations the remaining counts allow.
    """
    patterns = combinations(have, window, common)
    x = solve(have, patterns)
    used, rows, sequences = dict.fromkeys(have, 0), [], 0
    order = sorted(range(len(patterns)), key=lambda j: (-x[j], j))
    for rounded in (True, False):
        for j in order:
            p = patterns[j]
            most = min((have[n] - used[n]) // p.count(n) for n in p)
            repeats = min(most, int(x[j] + 0.5)) if rounded else most
            if repeats <= 0:
                continue
            offset = 0
            for n in p:
                rows.append((n, used[n], used[n] + repeats, sequences, offset))
                used[n] += repeats
                offset += n
            sequences += repeats
    return rows, used, sequences


def _cut(batches):
    """Pieces cut at ``cuts`` (places in the piece), each with its own ids."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        for rid, start, ids, cuts in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "ids", "cuts")), strict=True):
            for a, b in zip([0, *cuts], [*cuts, len(ids) // 4], strict=True):
                piece = ids[a * 4 : b * 4]
                for column, v in zip(rows, (rid, a, start + a, zlib.crc32(piece), piece), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["rid", "at", "start", "ids_crc32", "ids"])


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, common: int = COMMON) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 32-bit)."""
    spark = docs.sparkSession
    table = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = written(table.mapInArrow(_pieces(path, window, end), _DDL), "pieces")
    rest = table.where(F.col("length") < window)
    have = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, used, sequences = plan(have, window, common)
    # Where each length's remainders begin in the stream of those in no combination, longest first.
    begin, total = {}, 0
    for n in sorted(have, reverse=True):
        begin[n] = total
        total += (have[n] - used[n]) * n
    tail, inner = total % window, []
    for bit in range(window.bit_length() - 1, 0, -1):
        done = sum(1 << k for k in range(bit, window.bit_length()) if tail >> k & 1)
        if tail >> bit & 1 and done < tail:
            inner.append(total - tail + done)

    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt")
    narrow = rest.select("rid", "length", salt)
    before = narrow.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = narrow.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid")) - 1)
    ranked = ranked.join(written(before, "counts"), ["length", "salt"]).select("rid", "length", (F.col("before") + F.col("own")).alias("rank"))
    ranked = written(ranked, "ranks")

    uses = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")
    starts = spark.createDataFrame([(n, used[n], begin[n]) for n in have] or [(0, 0, 0)], "length long, used long, begin long")
    uses, starts = (F.broadcast(d) if small(d, 64) else d for d in (uses, starts))
    whole = ranked.join(uses, "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("rid", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", F.lit(0).cast("long").alias("at"), "length")

    # The others lie in the stream from P on, cut at every multiple of the window and at the tail's powers of two.
    stream = ranked.join(starts, "length").where("rank >= used").select("rid", "length", (F.col("begin") + (F.col("rank") - F.col("used")) * F.col("length")).alias("p"))
    next_window = (F.floor(F.col("p") / window) + 1) * window
    points = F.array_sort(F.array_distinct(F.array(next_window, *(F.lit(x).cast("long") for x in inner))))
    cuts = F.filter(points, lambda x: (x > F.col("p")) & (x < F.col("p") + F.col("length")))
    stream = stream.withColumn("cuts", F.transform(cuts, lambda x: x - F.col("p")))
    part = F.explode(F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), F.col("cuts")).alias("a"), F.concat(F.col("cuts"), F.array(F.col("length"))).alias("b")))
    parts = stream.select("rid", "p", part.alias("x")).select("rid", (F.col("p") + F.col("x.a")).alias("q"), F.col("x.a").alias("at"), (F.col("x.b") - F.col("x.a")).alias("length"))
    edges = F.array(*(F.lit(x).cast("long") for x in inner)) if inner else F.array().cast("array<bigint>")
    crossed = F.filter(edges, lambda x: x <= F.col("q"))
    at_edge = F.greatest(F.floor(F.col("q") / window) * window, F.coalesce(F.array_max(crossed), F.lit(0).cast("long")))
    parts = parts.select("rid", (F.lit(sequences) + F.floor(F.col("q") / window) + F.size(crossed)).cast("long").alias("sequence_id"), (F.col("q") - at_edge).alias("offset"), "at", "length")
    placed = written(whole.unionByName(parts), "places")

    cut = written(stream.where(F.size("cuts") > 0).select("rid", "cuts"), "cuts")
    bit = F.pmod(F.xxhash64("rid"), F.lit(1 << FILTER_BITS))
    maybe = F.broadcast(cut.select(bit.alias("bit")).distinct())  # 2^20 small numbers at most
    pieces = rest.withColumn("bit", bit).join(maybe, "bit", "left_semi").select("rid", "start", "ids").join(cut, "rid").select("rid", "start", "ids", "cuts")
    pieces = pieces.mapInArrow(_cut, "rid long, at long, start long, ids_crc32 long, ids binary")

    packed = sequences + -(-total // window) + len(inner)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    full = table.where(F.col("length") == window).withColumns({"sequence_id": F.col("rid") + packed, "offset": F.lit(0).cast("long")}).select(keep)
    uncut = table.join(placed.drop("length").join(cut.select("rid"), "rid", "left_anti"), "rid").select(keep)
    return full.unionByName(uncut).unionByName(pieces.join(placed, ["rid", "at"]).join(rest.select("rid", "doc_id", "doc_tokens"), "rid").select(keep))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, from ``pack``; a sequence has 2048 ids at most."""
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
