"""Nearest vectors by brute force, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators import ranking

#: Rows of a block, of queries and of vectors.
BLOCK = 4096


def exact(rows: DataFrame, queries: DataFrame, top: int, block: int = BLOCK) -> DataFrame:
    """(vec_id, near_id, distance, rank): the ``top`` rows (vec_id, embedding) nearest to each query, but for itself.

    Every block of queries meets every block of rows in a task of its own, which gives back its best of each query, so
    neither side has to fit a task. Distances are Euclidean, of 64-bit floats; of equal ones the smaller id is nearer.
    Null vectors are left out.
    """
    rows, queries = (d.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null") for d in (rows, queries))
    n_rows, n_queries = (max(1, -(-d.count() // block)) for d in (rows, queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).withColumn("b", spread(n_queries))
    right = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int")).withColumn("a", spread(n_rows))

    def best(x: pa.Table, q: pa.Table) -> pa.Table:
        ids, vectors = x["vec_id"].to_numpy(), np.array(x["embedding"].to_pylist(), float)
        out: tuple[list, list, list] = ([], [], [])
        if len(ids):
            for query, v in zip(q["vec_id"].to_pylist(), q["embedding"].to_pylist(), strict=True):
                d = np.sqrt(((vectors - np.array(v, float)) ** 2).sum(axis=1))
                for i in np.lexsort((ids, d))[: top + 1]:
                    if ids[i] != query:
                        for column, value in zip(out, (query, int(ids[i]), float(d[i])), strict=True):
                            column.append(value)
        return pa.table({"vec_id": pa.array(out[0], pa.int64()), "near_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.float64())})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "vec_id long, near_id long, distance double")
    return ranking.top_k(found, ["vec_id"], [F.asc("distance"), F.asc("near_id")], top)
