"""Token counts of every prefix of a text, for byte-fallback BPE models of sentencepiece.

Of a text's prefixes, each has one last token: the token that ends it and may follow the last token of the shorter
prefix that it leaves. Two tokens may follow each other if encoding them together gives the two back; a row of
tokens is an encoding if all its neighbours are. So one pass from left to right gives, for each prefix, its last token
and one more than the count of the prefix before that token. Counts of all prefixes are kept, and whether a text
is over a limit, where it must be cut for a budget and how many tokens a stretch from the start takes are looked up in
them; nothing is encoded again.

No piece spans two characters that stand next to each other in none, so a text falls into chunks there whose
counts add up. Chunks repeat, and a worker keeps the counts of the short ones.

A space is the mark U+2581, and one stands before every text that is not empty. Runs of it merge last, at one rank
for all of their pieces; they are counted by their length. A character in no piece is as many tokens as it has bytes.
Control pieces in a text are ordinary text. Null text is empty and has no tokens. Repeated rows are counted each. An
empty table has no rows. Other columns stay out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import let_workers_import
from provena.llm.kernels import frugal

SPACE = "▁"
#: Characters of a text that are handled at once, and of a stored row of counts.
PART, STORED = 1 << 16, 1 << 16
#: Chunks up to so many characters are kept, so many of them; then, and with so many pairs, the caches start anew.
SHORT, CHUNKS, PAIRS = 48, 500_000, 1_000_000
#: Bytes of a batch of stored rows.
BATCH = 4 << 20


class Counter:
    """The prefix counts of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        runs = [p for p in self.rank if len(p) > 1 and not p.strip(SPACE)]
        words = [p for p in self.rank if len(p) > 1 and p.strip(SPACE)]
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in words) or len({self.rank[p] for p in words}) < len(words) or (runs and min(self.rank[p] for p in runs) <= max(self.rank[p] for p in words)):
            raise ValueError("pieces are expected to have one rank each and spaces only at their start, runs of spaces to merge last")
        if model.encode("a\tb", out_type=str)[:1] != [SPACE + "a"] or SPACE in "".join(model.encode("", out_type=str)) or model.normalize(" Aéﬁ") != SPACE * 2 + "Aéﬁ":
            raise ValueError("the model is expected to change no characters and to put one space before a text")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        # Lengths, longest first, of the pieces that end with three characters (pieces of two: with these); a piece that merges do not lead to is no token.
        self.halves: dict[str, tuple[str, str]] = {}
        for p in words:
            row, pair = self.merged(p)
            if row == [p]:
                self.halves[p] = pair
        self.endings: dict[str, list[int]] = {}
        for n in sorted({len(p) for p in self.halves}, reverse=True):
            for e in {p[-3:] for p in self.halves if len(p) == n}:
                self.endings.setdefault(e, []).append(n)
        # Characters by number (0: in no piece), and the pairs that stand in some piece.
        chars = sorted({c for p in words for c in p})
        self.points = np.array([ord(c) for c in chars], np.uint32)
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in words:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True
        self.space = number.get(SPACE, 0)
        self.runs = self._run_counts(max((len(p) for p in runs), default=1), {len(p) for p in runs})

    @staticmethod
    def _run_counts(longest: int, lengths: set[int]) -> list[int]:
        """Tokens of a run of 0 to twice ``longest`` spaces: of equal ranks the leftmost pair merges first."""
        out = []
        for n in range(2 * longest + 1):
            row = [1] * n
            while (at := next((i for i in range(len(row) - 1) if row[i] + row[i + 1] in lengths), None)) is not None:
                row[at : at + 2] = [row[at] + row[at + 1]]
            out.append(len(row))
        if any(out[n + longest] != out[n] + 1 for n in range(longest + 1)):
            raise ValueError("runs of spaces are expected to fill up with the longest piece")
        return out

    def _spaces(self, n: int) -> int:
        longest = len(self.runs) // 2
        return n // longest + self.runs[n % longest]

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short string, the pair of lowest rank merging until none is a piece; and the last pair."""
        row, pair = list(text), None
        while len(row) > 1:
            best, at = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(row, row[1:])))
            if best == np.inf:
                break
            pair = row[at], row[at + 1]
            row[at : at + 2] = [row[at] + row[at + 1]]
        return row, pair

    def _follows(self, a: str, b: str) -> bool:
        """Whether the two encode to themselves: at no time would a merge across them have come first.

        Merges are undone from the last one back. The pieces that then touch may merge if their rank is below that of
        the merge just undone; at equal ranks the one further left comes first.
        """
        key, limit, rank, halves = (a, b), np.inf, self.rank, self.halves
        found = True
        while (r := rank.get(a + b)) is None or r >= limit:
            left, right = rank[a] if len(a) > 1 else -np.inf, rank[b] if len(b) > 1 else -np.inf
            if left == right == -np.inf:
                break
            if left > right:
                a, limit = halves[a][1], left
            else:
                b, limit = halves[b][0], right + 0.5
        else:
            found = False
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def _counts(self, word: str) -> tuple[list[int], list[str]]:
        """For each prefix of a chunk, the empty one first, its count and its last token."""
        counts, last = [0], [""]
        rank, halves, pairs, endings = self.rank, self.halves, self.pairs, self.endings
        for j in range(1, len(word) + 1):
            for n in (*endings.get(word[j - 3 : j], ()), 2) if j > 2 else (2,) if j == 2 else ():
                if n <= j and (piece := word[j - n : j]) in halves:
                    if j == n:
                        break
                    before = last[j - n]
                    if (ok := pairs.get((before, piece))) or (ok is None and self._follows(before, piece)):
                        break
            else:
                piece, n = word[j - 1], 1
                if j > 1 and not (pairs.get((last[j - 1], piece)) or self._follows(last[j - 1], piece)):
                    raise ValueError(f"no token ends {word[:j]!r}")
            counts.append(counts[j - n] + (1 if piece in rank else len(piece.encode())))
            last.append(piece)
        return counts, last

    def _steps(self, chunk: str) -> bytes:
        """What each character of a chunk adds to the count, as 16-bit numbers."""
        word = chunk.lstrip(SPACE)
        extra = len(chunk) - len(word) - 1
        if extra < 1:
            counts, _ = self._counts(chunk)
        elif not word:
            counts = [self._spaces(i) for i in range(extra + 2)]
        else:
            # The last space goes with the word if they merge; if not, it is one more of the run.
            inner, last = self._counts(SPACE + word)
            counts = [self._spaces(i) for i in range(extra + 2)]
            alone, joined = self._spaces(extra + 1) - 1, self._spaces(extra)
            first: list[bool] = []
            for j, piece in enumerate(last):
                before = j - len(piece)
                first.append(piece == SPACE if before == 0 else first[before])
                if j > 1:
                    counts.append(inner[j] + (alone if first[j] else joined))
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def __call__(self, chunk: str) -> bytes:
        steps = self.known.get(chunk)
        if steps is None:
            steps = self._steps(chunk)
            if len(chunk) <= SHORT:
                if len(self.known) >= CHUNKS:
                    self.known.clear()
                self.known[chunk] = steps
        return steps

    def _chunks(self, text: str) -> Iterator[str]:
        """The chunks of a text of marks for spaces; a part's last chunk waits for what follows."""
        rest = ""
        for start in range(0, len(text), PART):
            part = rest + text[start : start + PART]
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            at = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
            number = np.where(self.points[at] == codes, at + 1, 0)
            apart = ~self.beside[number[:-1], number[1:]]
            apart[(number[:-1] == self.space) & (number[1:] == self.space)] = False  # a run stays with its word
            cuts = [0, *(np.flatnonzero(apart) + 1).tolist()]
            yield from (part[a:b] for a, b in zip(cuts, cuts[1:]))
            rest = part[cuts[-1] :]
        if rest:
            yield rest

    def prefixes(self, text: str | None) -> np.ndarray:
        """The number of tokens of each prefix of a text, of 0 characters to all."""
        if not text:
            return np.zeros(1, np.int64)
        steps = b"".join(map(self, self._chunks(SPACE + text.replace(" ", SPACE))))
        out = np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int64)
        out[0] = 0  # the space before a text is no prefix of it
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): the last of each document's prefix counts."""
    let_workers_import(docs.sparkSession)

    def run(batches):
        dp = counter(path)
        for b in batches:
            n = pa.array([int(dp.prefixes(t.as_py())[-1]) for t in b.column("text")], pa.int64())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": n})

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def prefixes(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, counts): the counts of all prefixes, STORED to a row; counts[i] is that of the first start + i characters."""
    let_workers_import(docs.sparkSession)

    def run(batches):
        dp = counter(path)
        for b in batches:
            kind, ids, starts, values, size = b.column("doc_id").type, [], [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                found = dp.prefixes(t.as_py())
                for start in range(0, len(found), STORED):
                    part = found[start : start + STORED]
                    ids.append(i)
                    starts.append(start)
                    values.append(part)
                    size += part.nbytes
                    if size >= BATCH:
                        yield pa.record_batch({"doc_id": pa.array(ids, kind), "start": pa.array(starts, pa.int64()), "counts": pa.array(values, pa.list_(pa.int64()))})
                        ids, starts, values, size = [], [], [], 0
            yield pa.record_batch({"doc_id": pa.array(ids, kind), "start": pa.array(starts, pa.int64()), "counts": pa.array(values, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, counts array<long>")


def within(stored: DataFrame, budget: Column) -> DataFrame:
    """(doc_id, chars, tokens): the longest prefix of at most ``budget`` tokens, and its count, from ``prefixes``.

    A longer prefix may have fewer tokens, so the last place under the budget is taken, not the first one over it.
    """
    places = F.filter(F.sequence(F.lit(0), F.size("counts") - 1), lambda i: F.get("counts", i) <= budget)
    last = stored.withColumn("i", F.array_max(places)).where("i is not null")
    best = last.groupBy("doc_id").agg(F.max(F.struct((F.col("start") + F.col("i")).alias("chars"), F.get("counts", "i").alias("tokens"))).alias("x"))
    return best.select("doc_id", "x.chars", "x.tokens")


def at(stored: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, chars, tokens) of ``places`` (doc_id, chars): the number of tokens of the first ``chars`` characters."""
    start = F.floor(F.col("chars") / STORED) * STORED
    return places.withColumn("start", start).join(stored, ["doc_id", "start"]).select("doc_id", "chars", F.get("counts", (F.col("chars") - F.col("start")).cast("int")).alias("tokens"))
