"""Language identification by nearest centroid.

A text's vector holds the TF-IDF of its byte 2- and 3-grams (letters only; other characters act as one space), hashed
to 4096 places, of unit length. The vectors of each language are clustered by spherical k-means into several
centroids; a text gets the language of the centroid with the largest cosine. The cosine of a short text is smaller, so
the distance for rejection is kept for each power of two of the number of n-grams: ``margin`` times a low quantile of
the cosines that labelled texts of the right language reached at that size and the nearest ones, so far as enough are
together. No size is without a distance, if any text was right.

The model is fitted on a sample of at most ``per_language`` labelled documents for each language: those of the smallest
hashes of doc_id and text, equal ones once, so that neither the files' layout nor repeated rows nor null doc_ids change
it. Their sparse vectors are a written table; the inverse document frequencies, the centroids of each language and the
cosines of the right ones are found on executors, and only these come to the driver: 16 KB for each centroid, 12 bytes for each
right text. Every language with a label is learned. Everything else covers all rows.

Null texts and texts without a letter are ``und`` with score 0 and rejected. With nothing to learn from, all are
``und`` with score 0, and only those are rejected that have no letter. Rows are independent; repeated rows repeat their
result. Extra columns are kept; those named as a result are replaced.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm import kernels
from provena.llm.common import small, written

BINS = 4096
PER_LANGUAGE, CENTROIDS, ROUNDS, MARGIN = 1000, 4, 12, 0.5
#: The quantile for rejection, how many right texts it is taken of, and how many of a size are few.
LOW, POOLED, FEW = 0.01, 200, 20
#: Bytes of a long text whose n-grams are counted at once.
PART = 256 << 10
#: Unicode's category L; numbers that are written with letters or as fractions are none.
_LETTER = regex.compile(r"\p{L}")

_fold = np.full(256, 0x20, np.uint8)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)
_fold[0x61:0x7B] = np.arange(0x61, 0x7B)
_fold[0x80:] = np.arange(0x80, 0x100)


def _bins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the 2- and 3-grams that begin at each folded byte but the last one and two, and which of them count."""
    x = x.astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    mixed = lambda g, salt: ((g * np.uint32(2654435761) ^ np.uint32(salt)) * np.uint32(2246822519)) >> np.uint32(20)
    with np.errstate(over="ignore"):
        a, b = mixed(two, 0x5BD1E995), mixed(three, 0x1B873593)
    return a, b, two != 0x2020, (three & 0xFFFF != 0x2020) & (three >> 8 != 0x2020)


def _counts(texts: list[bytes | None]) -> np.ndarray:
    """n-gram counts, a row for each text."""
    out = np.zeros((len(texts), BINS), np.float32)
    if len(texts) == 1 and len(texts[0] or b"") > PART:
        t = texts[0] + b"  "
        for i in range(0, len(t) - 2, PART):
            a, b, keep_a, keep_b = _bins(_fold[np.frombuffer(t[i : i + PART + 2], np.uint8)])
            n = min(PART, len(t) - 2 - i)
            out[0] += np.bincount(np.concatenate((a[:n][keep_a[:n]], b[:n][keep_b[:n]])), minlength=BINS)
        return out
    a, b, keep_a, keep_b = _bins(_fold[np.frombuffer(b"  ".join(t or b"" for t in texts) + b"  ", np.uint8)])
    at = 0
    for i, t in enumerate(texts):
        end = at + len(t or b"") + 1
        if t:
            out[i] = np.bincount(np.concatenate((a[at:end][keep_a[at:end]], b[at : end - 1][keep_b[at : end - 1]])), minlength=BINS)
        at = end + 1
    return out


class Model:
    """Centroids with their languages, idf, and the lowest cosine accepted by size."""

    def __init__(self, idf, centroids, langs, floor):
        self.idf, self.centroids, self.langs, self.floor = idf, centroids, langs, floor

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, cosine, rejected)"""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        cosine = np.clip(cosines[np.arange(len(best)), best], 0, 1)
        return best, cosine, cosine < self.floor[_size(counts)]


def _size(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), 31)


def _low(cosines: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The cosine at quantile LOW for each size, of that size and the nearest ones until POOLED are together.

    Shorter texts have smaller cosines: where a size has few, the least of its own bounds it, and sizes below all seen
    are as the smallest seen.
    """
    out = np.zeros(32)
    if not len(size):
        return out
    for s in range(32):
        away = np.abs(size - s)
        near = away <= np.sort(away)[min(POOLED, len(away)) - 1]
        own = cosines[size == s]
        out[s] = min([np.quantile(cosines[near], LOW), *(own if len(own) < FEW else [])])
    out[: size.min()] = out[size.min()]
    return out


def _centroids(v: np.ndarray, centroids: int, rounds: int) -> np.ndarray:
    """Spherical k-means of one language's vectors."""
    k = min(centroids, len(v))
    c = v[np.random.default_rng(0).choice(len(v), k, replace=False)]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                m = v[near == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-9)
    return c


def _idf(seen: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)


def _floor(cosines: np.ndarray, size: np.ndarray, margin: float) -> np.ndarray:
    return margin * _low(cosines, size)


def fit(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS, rounds: int = ROUNDS, margin: float = MARGIN) -> Model | None:
    """A model of the labelled ``counts``, in memory; None without any. ``train`` does the same over a table."""
    if not len(counts):
        return None
    model, labels = Model(_idf((counts > 0).sum(axis=0), len(counts)), None, None, np.zeros(32)), np.array(langs)
    v = model.vectors(counts)
    found = [_centroids(v[labels == lang], centroids, rounds) for lang in sorted(set(langs))]
    model.centroids, model.langs = np.concatenate(found), [lang for lang, c in zip(sorted(set(langs)), found, strict=True) for _ in c]
    cosines = v @ model.centroids.T
    right = np.array(model.langs)[cosines.argmax(axis=1)] == labels
    model.floor = _floor(cosines.max(axis=1)[right], _size(counts)[right], margin)
    return model


def _sparse(batches):
    for batch in batches:
        for a, b, texts in kernels.blocks(batch.column("text")):
            at, n = [], []
            for row in _counts(texts):
                i = np.flatnonzero(row)
                at.append(i.astype(np.uint16).tobytes())
                n.append(row[i].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("lang", "h")), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "h", "at", "n"])


def _dense(at: list[bytes], n: list[bytes]) -> np.ndarray:
    out = np.zeros((len(at), BINS), np.float32)
    for row, i, c in zip(out, at, n, strict=True):
        row[np.frombuffer(i, np.uint16)] = np.frombuffer(c, np.float32)
    return out


def _seen(batches):
    """(bin, seen): in how many vectors of the partition each place is used."""
    seen = np.zeros(BINS, np.int64)
    for batch in batches:
        for i in batch.column("at").to_pylist():
            seen[np.frombuffer(i, np.uint16)] += 1
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["bin", "seen"])


def _right(shared):
    """(size, cosine) of the vectors whose nearest centroid is of their language."""

    def run(batches):
        model = shared.value
        langs = np.array(model.langs)
        for batch in batches:
            counts = _dense(batch.column("at").to_pylist(), batch.column("n").to_pylist())
            best, cosine, _ = model.predict(counts)
            ok = langs[best] == np.array(batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(_size(counts)[ok].astype(np.int32)), pa.array(cosine[ok].astype(float))], names=["size", "cosine"])

    return kernels.frugal(run)


def train(docs: DataFrame, where: Column, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, rounds: int = ROUNDS, margin: float = MARGIN) -> Model | None:
    """Fit on the documents under ``where`` whose lang is not null: a bounded sample for each language."""
    known = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("text", F.col("doc_id").cast("string")).alias("h"))
    known = known.withColumn("h", F.shiftrightunsigned("h", 11))
    n = written(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"), F.min("h").alias("lowest")), "languages")
    n = F.broadcast(n) if small(n, 64) else n
    # Hashes under a share of each language, where 1.5 times the bound is expected; of these the bound is taken.
    few = known.join(n, "lang").where((F.col("h") / float(1 << 53) <= 1.5 * per_language / F.col("texts")) | (F.col("h") == F.col("lowest")))
    vectors = few.select("lang", "h", "text").mapInArrow(kernels.frugal(_sparse), "lang string, h long, at binary, n binary").dropDuplicates(["lang", "h"])
    ranked = vectors.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= per_language)
    sample = written(ranked.select("lang", "h", "at", "n"), "vectors")
    total = sample.count()
    if not total:
        return None
    seen = np.zeros(BINS)
    for r in sample.select("at").mapInArrow(kernels.frugal(_seen), "bin int, seen long").groupBy("bin").agg(F.sum("seen").alias("seen")).collect():  # 4096 rows at most
        seen[r["bin"]] = r["seen"]
    model = Model(_idf(seen, total), None, None, np.zeros(32))
    weights = docs.sparkSession.sparkContext.broadcast(model.idf)

    def cluster(group):
        group = group.sort_by("h")
        c = _centroids(Model(weights.value, None, None, None).vectors(_dense(group["at"].to_pylist(), group["n"].to_pylist())), centroids, rounds)
        return pa.table({"lang": group["lang"][: len(c)], "j": np.arange(len(c), dtype=np.int32), "centroid": [x.astype(np.float32).tobytes() for x in c]})

    found = sample.groupBy("lang").applyInArrow(cluster, "lang string, j int, centroid binary").orderBy("lang", "j").collect()
    model.centroids, model.langs = np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), [r["lang"] for r in found]
    right = sample.mapInArrow(_right(docs.sparkSession.sparkContext.broadcast(model)), "size int, cosine double").orderBy("size", "cosine").collect()
    model.floor = _floor(np.array([r["cosine"] for r in right]), np.array([r["size"] for r in right], int), margin)
    return model


def _predict(shared, extra: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, texts in kernels.blocks(batch.column("text")):
                letter = np.array([bool(t) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts], bool)
                if model is None:
                    lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                else:
                    best, score, out = model.predict(_counts(texts))
                    lang = [model.langs[i] if ok else "und" for i, ok in zip(best, letter, strict=True)]
                    score = np.where(letter, score, 0.0)
                out = out | ~letter
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in extra), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(out)], names=[*extra, "lang_pred", "score", "rejected"])

    return kernels.frugal(run)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "rejected").withColumn("text", F.col("text").cast("string"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast(model), docs.columns), f"{ddl}, lang_pred string, score double, rejected boolean")
