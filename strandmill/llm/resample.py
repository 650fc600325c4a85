"""Choosing documents by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, save, table, word_hashes

#: Buckets that one- and two-word grams are hashed to.
BUCKETS = 1 << 14
_SLICE = 1000


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's words and pairs of neighbouring words, and where each row's begin. Whole texts, letters folded."""
    words, starts = word_hashes(column, fold=True)
    sizes = np.diff(starts)
    counts = np.maximum(2 * sizes - 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = out[row] + np.arange(len(words)) - starts[row]
    found = np.zeros(int(out[-1]), np.uint64)
    found[place] = words
    inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, int)
    found[place[inner] + sizes[row[inner]]] = mix(words[inner] * np.uint64(3) + words[inner + 1])
    return (found >> np.uint64(40)).astype(np.int64) % BUCKETS, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, _SLICE):
            yield b.slice(a, _SLICE)


def bucket_counts(docs: DataFrame, target: DataFrame, most_targets: int) -> list[np.ndarray]:
    """Counts of each bucket over all docs, and over the documents named in target (doc_id; at most about most_targets
    of them, by a hash, so that they can be broadcast).
    """
    ids = target.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    n = ids.count()
    share = min(1.0, most_targets / max(n, 1))
    ids = ids.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids.withColumn("is_target", F.lit(True))), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for b in _slices(batches):
            found, starts = grams(b.column(0))
            totals[0] += np.bincount(found, minlength=BUCKETS)
            chosen = np.array([x is True for x in b.column(1).to_pylist()], bool)
            totals[1] += np.bincount(found[np.repeat(chosen, np.diff(starts))], minlength=BUCKETS)
        which, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[which, bucket])], names=["which", "bucket", "n"])

    out = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for r in rows.select("text", "is_target").mapInArrow(run, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r["which"]][r["bucket"]] = r["n"]
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight: the sum of log ratios over a text's grams; 0 for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found, starts = grams(b.column(1))
            sums = np.concatenate(([0.0], np.cumsum(shared.value[found])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(starts)), pa.array(np.round(sums[starts[1:]] - sums[starts[:-1]], 6))], names=["doc_id", "n_grams", "log_weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int, at_once: int = 20_000) -> float | None:
    """The k-th largest value of a column without nulls: the range that holds it is narrowed by counting until few rows are left."""
    low, high = float("-inf"), float("inf")
    while k > 0:
        inside = rows.where((F.col(column) > low) & (F.col(column) <= high))
        if (n := inside.count()) < k:
            return None
        if n <= at_once:
            return inside.orderBy(F.col(column).desc()).limit(k).agg(F.min(column)).first()[0]
        edges = sorted(set(inside.approxQuantile(column, [i / 64 for i in range(1, 64)], 0.002)))
        found = {r["b"]: r["count"] for r in inside.groupBy(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column))).alias("b")).count().collect()}
        b = len(edges)
        while k > found.get(b, 0):
            k -= found.get(b, 0)
            b -= 1
        low, high = (edges[b - 1] if b else low), (edges[b] if b < len(edges) else high)
        if found[b] == n:  # one value holds all that is left
            return inside.agg(F.max(column)).first()[0]
    return None


def resample(docs: DataFrame, target: DataFrame, share: float | None = None, *, most_targets: int = 50_000, seed: int = 9) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, gumbel_key, selected.

    log_weight is the log likelihood ratio of a model of target texts to one of all texts, both over hashed one- and
    two-word grams with one added to each bucket's count. gumbel_key adds Gumbel noise from a hash of doc_id; the rows
    of the largest keys, share of all, are selected: a sample without replacement in proportion to the weights.
    Without share, it is the share of quality 1 among ``target``'s rows that have it. Equal keys stay together, so rows
    that repeat may add to the number. Null or empty texts have weight 0; without targets all weights are near those of a uniform model.
    An empty table gives no rows; further columns, of any names, are not read; very long texts are counted whole, in chunks of half
    a MB. Counts run over all documents; target names documents, of which most_targets are used.
    """
    wanted = target.where("quality = 1")
    if share is None:
        share = target.where("quality IS NOT NULL").agg(F.avg("quality")).first()[0] or 0.0
    raw, aimed = bucket_counts(docs, wanted, most_targets)
    ratio = np.log((aimed + 1) / (aimed.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = save(log_weights(docs, ratio).withColumn("gumbel_key", F.round(F.col("log_weight") - F.log(-F.log(u)), 9)), "weights")
    least = kth_largest(rows, "gumbel_key", round(share * rows.count()))
    return rows.withColumn("selected", F.lit(False) if least is None else F.col("gumbel_key") >= least)


def query(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
