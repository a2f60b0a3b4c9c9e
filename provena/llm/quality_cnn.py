"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks (16 bytes, every 8) of the whole document; each
filter's largest response over all chunks is kept, and these are combined into one probability. Only the text is an
input. The network is fitted by Adam on at most ``rows`` labelled documents (the smallest hashes of doc_id) with at most
``size`` bytes together, whose whole texts come to the driver; scoring covers every chunk of every document, in parts
of at most PART bytes.

Null and empty texts are one chunk of zeros and get that chunk's score. With no labels every score is 0.5. Rows are
independent; repeated rows repeat their score. A doc_id is learned from once, from its text of the smallest hash and
its lowest label; labels of null doc_ids and null labels are not learned from. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm import kernels

WIDTH, STRIDE, DEPTH, FILTERS = 16, 8, 8, 24
ROWS, SIZE, SHARES, EPOCHS, BATCH, RATE = 3000, 64 << 20, 16, 10, 32, 0.01
#: Bytes of a long text whose chunks are held at once; a multiple of STRIDE.
PART = 256 << 10


def _chunked(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of zero-padded texts, and the first chunk and end of each."""
    parts, bounds, at = [], [], 0
    for t in texts:
        t = t or b""
        n = max(1, -(-len(t) // STRIDE))
        parts.append(t + bytes(n * STRIDE - len(t) + WIDTH - STRIDE))
        bounds += [at, at + n]
        at += n + (WIDTH - STRIDE) // STRIDE
    return np.frombuffer(b"".join(parts), np.uint8), np.array(bounds)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {"e": rng.normal(0, 0.5, (256, DEPTH)).astype(f), "w": rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(f), "b": np.zeros(FILTERS, f), "v": rng.normal(0, 0.1, FILTERS).astype(f), "c": np.zeros(1, f)}

    def _chunks(self, buf: np.ndarray) -> np.ndarray:
        x = self.p["e"][buf].reshape(-1)
        n = (len(buf) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DEPTH), (STRIDE * DEPTH * 4, 4), writeable=False)

    def _pooled(self, texts: list[bytes | None]):
        buf, bounds = _chunked(texts)
        x = self._chunks(buf)
        z = np.ascontiguousarray(x) @ self.p["w"]
        z = np.concatenate((z, np.full((1, FILTERS), -np.inf, np.float32)))
        return buf, bounds, x, z

    def _largest(self, texts: list[bytes | None]) -> np.ndarray:
        """Each filter's largest response, by text. A part of a long text ends with the chunk that begins in it last."""
        if len(texts) == 1 and len(texts[0] or b"") > PART:
            t = texts[0]
            parts = (t[i : i + PART + WIDTH - STRIDE] for i in range(0, len(t), PART))
            return np.max([self._pooled([p])[3][: PART // STRIDE].max(axis=0) for p in parts if p], axis=0)[None]
        _, bounds, _, z = self._pooled(texts)
        return np.maximum.reduceat(z, bounds, axis=0)[::2]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        h = np.maximum(self._largest(texts) + self.p["b"], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -30, 30)))

    def gradients(self, texts: list[bytes | None], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; only each filter's best chunk of a document has any."""
        p = self.p
        buf, bounds, x, z = self._pooled(texts)
        best = np.stack([a + z[a:b].argmax(axis=0) for a, b in bounds.reshape(-1, 2)])
        top = z[best, np.arange(FILTERS)] + p["b"]
        h = np.maximum(top, 0)
        d = (1 / (1 + np.exp(-np.clip(h @ p["v"] + p["c"], -30, 30))) - y) / len(y)
        dh = d[:, None] * p["v"] * (top > 0)
        at = x[best]  # documents, filters, inputs
        de = np.zeros_like(p["e"])
        back = (dh[:, :, None] * p["w"].T).reshape(-1, DEPTH)
        places = (best[:, :, None] * STRIDE + np.arange(WIDTH)).reshape(-1)
        np.add.at(de, buf[places], back)
        return {"e": de, "w": np.einsum("df,dfi->if", dh, at), "b": dh.sum(axis=0), "v": d @ h, "c": d.sum(keepdims=True)}


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network | None:
    """Adam over shuffled batches; None without labels."""
    if not texts:
        return None
    net, y, rng = Network(seed), np.array(labels, np.float32), np.random.default_rng(seed)
    share = float(np.clip(y.mean(), 0.01, 0.99))
    net.p["c"][:] = np.log(share / (1 - share))
    m, s = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            g = net.gradients([texts[j] for j in at], y[at])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, where: Column, rows: int = ROWS, size: int = SIZE, **how) -> Network | None:
    """Fit on at most ``rows`` documents, ``size`` bytes together, with a quality label whose doc_id is under ``where``.

    Labelled texts of more than a SHARES-th of ``size`` are not learned from.
    """
    picked = labels.where(where & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # At most ``rows`` ids and labels are broadcast, and one text of each comes on.
    got = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    # A text over a share of the bytes is passed over, so that no one text keeps out those after it.
    got = got.where(F.octet_length("text") <= size // SHARES)
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    got = got.withColumn("bytes", F.sum(F.octet_length("text")).over(before)).where(F.col("bytes") <= size).select("doc_id", "quality", "text").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in got], [int(r["quality"]) for r in got], **how)


def _scores(shared):
    def run(batches):
        net = shared.value
        for batch in batches:
            for a, b, texts in kernels.blocks(batch.column("text")):
                score = np.full(len(texts), 0.5) if net is None else net.score(texts).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score)], names=["doc_id", "score"])

    return kernels.frugal(run)


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(shared), "doc_id long, score double")
