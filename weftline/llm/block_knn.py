"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks; each block of queries meets each block of candidates as one row, a tile.  In a tile
the unit vectors, rounded to int8, give all cosines at once, with an error that is bounded by the lengths of what was rounded off.
Only pairs whose upper bound reaches the k-th best lower bound of their query, or the k-th best cosine of the tiles before, are
computed again from the original vectors, in double precision.  Best pairs are kept in heaps across the tiles of a task and merged by
rank at the end, so the result is exact.

Blocks of each side are dealt to groups, and a task compares one group of queries with one of candidates.  Each side is moved
once, however many groups the other has: no row is repeated for the groups, nothing is collected or broadcast.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
id; vectors of different length are never compared; a repeated query id is one query,
by its smallest vector, and never its own neighbour; repeated candidates are each a neighbour; ties go to the smaller
id; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from weftline.session import stored

K = 5
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: queries that are compared with a block of candidates at a time; a worker holds some ten numbers for each of these pairs
TILE_ROWS = 64
#: queries whose heaps a task keeps before it hands them on
KEPT_QUERIES = 100_000
#: groups of candidate blocks, at most: a task hands on k rows for each of its queries, so these rows grow with the groups
CANDIDATE_GROUPS = 32
#: query blocks in a group, about: a task holds them and the heaps of their queries
GROUP_BLOCKS = 32

BLOCKS = "dim int, n int, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector has a length and finite components only."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def number_type(df: DataFrame) -> str:
    """What the components of column ``vector`` are packed as: singles stay singles, which is half the bytes."""
    return "<f4" if isinstance(df.schema["vector"].dataType.elementType, FloatType) else "<f8"


def blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows ``(id, vector)`` packed into rows of at most ``size`` vectors of one length."""
    kind = number_type(df)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}

        def row(dim: int) -> pd.DataFrame:
            rows = waiting.pop(dim)
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            vectors = np.stack([r[1] for r in rows]).tobytes()
            return pd.DataFrame({"dim": [dim], "n": [len(rows)], "ids": [ids], "vectors": [vectors]})

        for batch in batches:
            for own, vector in zip(batch["id"], batch["vector"], strict=True):
                own_rows = waiting.setdefault(len(vector), [])
                own_rows.append((own, np.asarray(vector, dtype=kind)))
                if len(own_rows) >= size:
                    yield row(len(vector))
        for dim in list(waiting):
            yield row(dim)

    return df.mapInPandas(pack, BLOCKS)


class Rounded:
    """Unit vectors as int8 numbers with a step each, and what the rounding can change."""

    def __init__(self, vectors: np.ndarray):
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / largest  # no overflow in the squares
        self.unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.step = np.abs(self.unit).max(axis=1, keepdims=True) / 127.0
        self.int8 = np.rint(self.unit / self.step).astype(np.int8)
        kept = self.int8 * self.step
        self.error = np.sqrt(((self.unit - kept) ** 2).sum(axis=1))
        self.length = np.sqrt((kept * kept).sum(axis=1))


def evened(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power)


def tile_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 vectors.  Sums below 2**24 are exact in single precision, so 1,024 components go at a time."""
    single = np.float32
    parts = (
        a[:, at : at + 1024].astype(single, copy=False) @ b[:, at : at + 1024].astype(single, copy=False).T
        for at in range(0, a.shape[1], 1024)
    )
    total = next(parts)
    for part in parts:
        total = total.astype(np.float64, copy=False)
        total += part
    return total


def tile_best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, bars: np.ndarray
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact cosines of what can be among its k nearest in the tile.

    ``bars``: cosines that k others are known to reach, of each query; -inf where none is known.
    """
    queries, vectors = evened(queries), evened(vectors)
    q, c = Rounded(queries), Rounded(vectors)
    length_q = np.sqrt((queries * queries).sum(axis=1))
    length_c = np.sqrt((vectors * vectors).sum(axis=1))
    # one bound for all candidates of a query; near, in single precision, adds some 4e-7
    slack = q.length * c.error.max() + q.error * (c.length + c.error).max() + 1e-6
    asked = np.flatnonzero(np.isin(ids, query_ids))
    steps, int8 = c.step.T.astype(np.float32), c.int8.astype(np.float32)
    for at in range(0, len(query_ids), TILE_ROWS):
        rows = slice(at, at + TILE_ROWS)
        near = tile_product(q.int8[rows], int8).astype(np.float32, copy=False)
        near *= q.step[rows].astype(np.float32)
        near *= steps
        own, place = np.nonzero(query_ids[rows, None] == ids[None, asked])
        near[own, asked[place]] = -np.inf
        bar = bars[rows].copy()
        new = np.flatnonzero(np.isneginf(bar))
        if len(new) and near.shape[1] > k:
            bar[new] = np.partition(near[new], near.shape[1] - k, axis=1)[:, near.shape[1] - k] - slack[at + new]
        bar = np.maximum(bar - slack[rows], -2.0)  # no cosine is below, only the query itself
        survivors = near >= bar[:, None].astype(np.float32)
        for i in np.flatnonzero(survivors.any(axis=1)).tolist():
            which, n = np.flatnonzero(survivors[i]), at + i
            dots = np.einsum("ij,j->i", vectors[which], queries[n])
            yield int(query_ids[n]), ids[which], dots / (length_c[which] * length_q[n])


def nearest(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest rows of each query row by cosine."""
    clean = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("q"))
    clean = clean.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    kind = number_type(clean)
    candidates = stored(blocks(clean.select("id", "vector"), CANDIDATE_BLOCK), "candidate-blocks")
    asked = clean.filter("q").groupBy("id").agg(F.min("vector").alias("vector"))
    queries = stored(blocks(asked, QUERY_BLOCK), "query-blocks")
    n_queries, tasks = queries.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_places = max(1, min(candidates.count(), CANDIDATE_GROUPS))
    n_groups = max(1, min(n_queries, max(-(-tasks // n_places), -(-n_queries // GROUP_BLOCKS))))
    # every group of one side meets every group of the other in a task of its own, which holds the queries
    sent = queries.select("dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")).repartition(n_groups)
    tiles = candidates.repartition(n_places).join(sent.hint("shuffle_replicate_nl"), "dim")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}

        def out() -> pd.DataFrame:
            rows = [(own, -m, s) for own, heap in heaps.items() for s, m in heap]
            heaps.clear()
            return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        for batch in batches:
            for t in batch.itertuples(index=False):
                tile = (
                    np.frombuffer(t.query_ids, "<i8"),
                    np.frombuffer(t.queries, kind).reshape(-1, t.dim).astype(np.float64),
                    np.frombuffer(t.ids, "<i8"),
                    np.frombuffer(t.vectors, kind).reshape(-1, t.dim).astype(np.float64),
                )
                known = [heaps.get(own, ()) for own in tile[0].tolist()]
                bars = np.array([heap[0][0] if len(heap) == k else -np.inf for heap in known])
                for own, ids, scores in tile_best(*tile, k, bars):
                    heap = heaps.setdefault(own, [])
                    for i, s in zip(ids.tolist(), scores.tolist(), strict=True):
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -i))
                        elif (s, -i) > heap[0]:
                            heapq.heapreplace(heap, (s, -i))
                if len(heaps) > KEPT_QUERIES:
                    yield out()
        yield out()

    # a tile is some megabytes, so a few make a batch
    found = tiles.select("dim", "query_ids", "queries", "ids", "vectors").mapInPandas(search, FOUND)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each query; Spark drops what cannot be among them before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
