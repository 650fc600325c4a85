"""Approximate nearest neighbours by counting collisions of query-centred windows."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, table


def window_reach(projections: int, needed: int, missed: float) -> float:
    """How many times a vector's distance windows have to be wide, so that it collides less than needed times with a chance of missed."""
    low, high = 0.0, 40.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        p = math.erf(middle / math.sqrt(2))
        below = sum(math.comb(projections, j) * p**j * (1 - p) ** (projections - j) for j in range(needed))
        low, high = (middle, high) if below > missed else (low, middle)
    return high


class CollisionIndex:
    """Sorted single projections of one block of vectors, searched by windows that grow around the query.

    For the largest inner product, vectors get one more component that makes all norms equal, and queries are scaled to
    that norm: the nearest by distance are then those of the largest product. A vector collides with a query in a
    projection when it lies in the query's window; virtual rehashing widens all windows by ``grow`` at a time. Vectors that
    collide in at least ``threshold`` of the projections are verified. A query ends once its windows are ``reach`` times as
    wide as the distance of the k-th best verified, or hold the block. Differences of projections are normal with the
    distance as their deviation, so a vector at most that far is left out with a chance of at most ``missed``, whatever the
    block's size, norms and dimension; where distances hardly differ, most of the block is verified. Queries are searched
    some at a time, which start at the width that was enough for all of those before, and are verified together.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, *, projections: int, threshold: float, missed: float, grow: float, seed: int = 7) -> None:
        self.ids, self.rows, self.vectors, n = ids, rows, vectors, len(ids)
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max())
        full = np.column_stack((vectors, np.sqrt(np.maximum(self.top - norms, 0))))
        self.lines = np.random.default_rng(seed).standard_normal((full.shape[1], projections))
        spots = full @ self.lines
        self.sorted = np.sort(spots, axis=0).T.copy()
        places = np.argsort(np.argsort(spots, axis=0, kind="stable"), axis=0, kind="stable").T
        self.places = places.astype(np.uint16 if n < 1 << 16 else np.uint32)  # where each vector is in each sorted array
        self.needed, self.grow = math.ceil(threshold * projections), grow
        self.reach = window_reach(projections, self.needed, missed)
        self.first = max(float(np.median(self.sorted[:, -1] - self.sorted[:, 0])), math.sqrt(self.top)) / 64
        self.recent = 0.0

    def _collisions(self, spots: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For queries at spots (a row each): how often each vector lies in its window, wide to either side, and whether the windows hold the block."""
        kind, n = self.places.dtype.type, len(self.ids)
        counts, full = np.zeros((len(spots), n), np.uint8 if len(self.places) < 1 << 8 else np.uint32), np.ones(len(spots), bool)
        gap, inside = np.empty(counts.shape, kind), np.empty(counts.shape, bool)
        for row, place, x in zip(self.sorted, self.places, spots.T, strict=True):
            a, b = row.searchsorted(x - wide), row.searchsorted(x + wide, "right")
            full &= b - a == n
            np.subtract(place[None, :], a.astype(kind)[:, None], out=gap)  # a place before a wraps round
            np.less(gap, (b - a).astype(kind)[:, None], out=inside)
            counts += inside.view(np.uint8)
        return counts, full

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int, at_once: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query: ids and exact inner products of its k best verified vectors, best first, ties to the smaller id; not its own row, of owns."""
        cuts = [0, *range(min(2, len(queries)), len(queries), at_once), len(queries)]  # the first few find a width to start at
        for start, end in itertools.pairwise(dict.fromkeys(cuts)):
            mine = queries[start:end]
            spots = (mine * (math.sqrt(self.top) / np.linalg.norm(mine, axis=1, keepdims=True))) @ self.lines[:-1]
            # distances are those of the queries as scaled, to vectors of equal norm; rounding is allowed for
            scale = math.sqrt(self.top) / np.linalg.norm(mine, axis=1)
            products = np.full((len(mine), len(self.ids)), -np.inf)  # of verified vectors
            other = self.rows[None, :] != owns[start:end, None]
            left, wide, ends = np.arange(len(mine)), np.full(len(mine), self.recent or self.first), []
            while len(left):
                counts, full = self._collisions(spots[left], wide[left])
                done = full.copy()
                # all pairs to verify, by one product over the vectors that any of these queries is to verify
                new = ((counts >= self.needed) | full[:, None]) & other[left] & np.isneginf(products[left])
                some = np.flatnonzero(new.any(0))
                if len(some):
                    held = self.vectors if len(some) == len(self.ids) else self.vectors[some]
                    products[np.ix_(left, some)] = np.where(new[:, some], mine[left] @ held.T, products[np.ix_(left, some)])
                for at, i in enumerate(left):
                    kth = np.partition(products[i], -k)[-k] if k <= len(self.ids) else -np.inf
                    least = self.reach * math.sqrt(max(0.0, 2 * (self.top - kth * scale[i])) + 1e-9 * self.top) if kth > -np.inf else np.inf
                    done[at] |= wide[i] >= least
                    if done[at]:
                        ends.append(min(least, wide[i]))
                    else:  # verifying more only brings the k-th best nearer, so a window of that width is enough
                        wide[i] = least if least < np.inf else wide[i] * self.grow
                left = left[~done]
            self.recent = max(ends)
            for i, found in enumerate(products):
                query, hit = mine[i], np.flatnonzero(found > -np.inf)
                rough = found[hit]
                if len(hit) > 2 * k:  # sums of another order differ in the last digits only
                    hit = hit[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + float(np.abs(rough).max()))]
                scores = (self.vectors[hit] * query).sum(1)
                best = np.lexsort((self.ids[hit], -scores))[:k]
                yield self.ids[hit][best], scores[best]


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, block: int = 8192, queries_at_once: int = 2048, projections: int = 96, threshold: float = 0.7, missed: float = 0.01, grow: float = 1.15) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of the largest inner product found, of all but its own row.

    vectors has vec_id and embedding. Queries are the ids divisible by ``every``; a repeated id is one query, that of its
    shortest and then smallest vector, and each other of its rows a candidate, as all rows are to others. Vectors that are null, zero, or
    hold null or non-finite components, or have no id, take no part; vectors of another length are not compared. With fewer than k candidates,
    all are returned. An empty table gives no rows; further columns, of any names, are not read.

    The index is cut into blocks of bounded size by a hash, and so are the queries; every query meets every block, in
    one task for each pair of them, and keeps k of each block. So memory is bounded, no row is dropped, and recall is
    that within a block. ``missed`` is the chance at most that one of a block's k best is left out; scores are exact.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("size", F.size("v"))
    v = save(v.withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers are fixed once written
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("size", "v", "row")).alias("own")).select("vec_id", "own.*")
    n, q = v.count(), asked.count()
    blocks, chunks = max(1, math.ceil(n / block)), max(1, math.ceil(q / queries_at_once))
    part = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = v.withColumn("block", part(1, blocks)).withColumn("chunk", spread(chunks))
    right = asked.withColumn("chunk", part(2, chunks)).withColumn("block", spread(blocks))

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(queries):
            index = index.sort_values(["vec_id", "row"], kind="stable")
            held = CollisionIndex(index["vec_id"].to_numpy(), index["row"].to_numpy(), np.stack(index["v"].to_list()), projections=projections, threshold=threshold, missed=missed, grow=grow)
            for own, (ids, scores) in zip(queries["vec_id"], held.search(np.stack(queries["v"].to_list()), queries["row"].to_numpy(), k), strict=True):
                out.append((np.full(len(ids), own), ids, scores))
        columns = [np.concatenate([x[i] for x in out]) if out else [] for i in range(3)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = ["size", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
