"""Exact top-k search by inner product over tiles of queries and shards of vectors.

Vectors are packed into blocks; each block of queries meets each block of
candidates once, as one matrix product with a partial selection, and the
per-query lists are merged in a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

TILE = 1024
SHARD = 8192
FAN_IN = 32


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec array<long>) with floor(64 * x); rows that are null or not finite go."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(64.0) * v.cast("double"))).alias("vec"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (block, dim, ids, data) of up to ``size`` vectors of one dimension, made without a shuffle."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out(dim: int) -> pd.DataFrame:
            rows = sorted(held.pop(dim), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], dtype="<i8")
            data = np.array([r[1] for r in rows], dtype="<i8").reshape(len(rows), dim)
            return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "data": [data.tobytes()]})

        for pdf in batches:
            for i, vec in zip(pdf["id"].tolist(), pdf["vec"]):
                rows = held.setdefault(len(vec), [])
                rows.append((i, vec))
                if len(rows) >= size:
                    yield out(len(vec))
        for dim in list(held):
            yield out(dim)

    return rows.mapInPandas(pack, "dim int, ids binary, data binary")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller id; ids rise."""
    n = scores.shape[1]
    if n > k:
        part = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        # Everything above the k-th score, then ties in order of id.
        above, tie = scores > part, scores == part
        take = above | (tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        cols = np.nonzero(take)[1].reshape(-1, k)
    else:
        cols = np.tile(np.arange(n), (len(scores), 1))
    order = np.lexsort((ids[cols], -np.take_along_axis(scores, cols, 1)), axis=1)
    return np.take_along_axis(cols, order, 1)


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``queries`` (id, vec) among ``candidates``.

    A candidate with the query's own id takes no part; vectors of other
    dimensions don't meet. Queries that repeat an id count once (the smallest
    vector); candidates that repeat an id stay rows of their own.
    """
    spark = queries.sparkSession
    one = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    # The rows per task follow from one count each, so that blocks come out full.
    n_q, n_c = one.count(), candidates.count()
    parts = max(1, -(-n_q // tile))
    grid = max(1, -(-n_c // (shard * 4)))
    left = materialize(_blocks(one.repartition(parts, F.xxhash64("id")), tile).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    n_tiles = left.count()
    right = _blocks(candidates, shard).withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(grid)))
    if not n_tiles:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Fragment and replicate: every tile goes to every cell of shards.
    spread = left.select("tile", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("cell"))
    spread = spread.withColumn("cell", F.col("cell").cast("long"))
    pairs = right.repartition(grid, "cell").join(spread.repartition(grid, "cell"), ["cell", "dim"])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, ids, data, q_ids, q_data in pdf[["dim", "ids", "data", "q_ids", "q_data"]].itertuples(index=False):
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                c, q = (np.frombuffer(x, "<i8").reshape(-1, dim) for x in (data, q_data))
                bound = dim * int(np.abs(c).max(initial=0)) * int(np.abs(q).max(initial=0))
                kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
                c, step = c.astype(kind).T.copy(), 128
                for at in range(0, len(q), step):
                    scores = q[at : at + step].astype(kind) @ c
                    own = q_ids[at : at + step]
                    lost = np.array([], dtype=np.int64)
                    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                    scores = scores.astype(np.int64)
                    lowest = np.iinfo(np.int64).min + 1
                    for r in np.flatnonzero(hi > lo):
                        scores[r, lo[r] : hi[r]] = lowest
                    cols = best(ids, scores, k)
                    top = np.take_along_axis(scores, cols, 1)
                    lists = [[(int(s), -int(i)) for s, i in zip(a, b) if s != lowest] for a, b in zip(top, ids[cols])]
                    yield pd.DataFrame({"query_id": own, "top": [[{"score": s, "neg": i} for s, i in x] for x in lists]})

    lists = pairs.select("dim", "ids", "data", "q_ids", "q_data").mapInPandas(product, "query_id long, top array<struct<score:long, neg:long>>")
    width = max(1, -(-n_c // shard)) + spark.sparkContext.defaultParallelism * 4
    merged = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k).alias("top")
    lists = lists.withColumn("branch", F.spark_partition_id() + F.lit(0))
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        lists = lists.withColumn("branch", F.pmod(F.xxhash64("branch"), F.lit(width))).groupBy("query_id", "branch").agg(merged)
    out = lists.groupBy("query_id").agg(merged).select("query_id", F.posexplode("top").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), (-F.col("hit.neg")).alias("vec_id"), F.col("hit.score").alias("score"))
