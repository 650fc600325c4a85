"""Exact deduplication by a cuckoo-filter index of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, free, one_of_each, repeated, save, table

#: Digests that the index of one task holds at most, about: sets the number of partitions.
PER_TASK = 500_000


class CuckooIndex:
    """A set of live digests: a cuckoo filter of 16-bit fingerprints over buckets that also hold the digests.

    A fingerprint that matches is verified against the bucket's digest, so there are no false hits. Two candidate
    buckets a digest, four slots each; when ``kicks`` moves don't free a slot, the table doubles and is filled again
    from the stored digests. Digests may be deleted at any time.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 64, kicks: int = 200) -> None:
        self.kicks, self.size = kicks, 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = [0] * (buckets * self.SLOTS)
        self.held: list = [None] * (buckets * self.SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        x = int.from_bytes(digest[:8], "little")
        mark = (x & 0xFFFF) or 1
        one = (x >> 16) & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, digest: bytes) -> list | None:
        """The stored [digest, value], or None."""
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for k in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.marks[k] == mark and self.held[k][0] == digest:
                    return self.held[k]
        return None

    def insert(self, digest: bytes, value=None) -> None:
        """Add a digest that find() doesn't know."""
        self.size += 1
        self._put([digest, value])

    def _put(self, entry: list) -> None:
        while (entry := self._try(entry)) is not None:
            stored = [x for x in self.held if x is not None]
            self._clear(self.buckets * 2)
            for x in stored:
                self._put(x)

    def _try(self, entry: list) -> list | None:
        """Place entry; returns the entry left over if there is no room."""
        mark, one, two = self._places(entry[0])
        for bucket in (one, two):
            for k in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.marks[k]:
                    self.marks[k], self.held[k] = mark, entry
                    return None
        bucket = one
        for step in range(self.kicks):
            k = bucket * self.SLOTS + (mark + step) % self.SLOTS
            (mark, entry), (self.marks[k], self.held[k]) = (self.marks[k], self.held[k]), (mark, entry)
            bucket = self._other(bucket, mark)
            for k in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.marks[k]:
                    self.marks[k], self.held[k] = mark, entry
                    return None
        return entry

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for bucket in (one, two):
            for k in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.marks[k] == mark and self.held[k][0] == digest:
                    self.marks[k], self.held[k] = 0, None
                    self.size -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        return (x for x in self.held if x is not None)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text without white space) and chars (code points of the original)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sums, chars = b.column(0), [], []
            for x in b.column(1):
                text = x.as_py() or ""
                sums.append(hashlib.sha256(text.encode().translate(None, BLANKS)).digest())
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sums, pa.binary()), pa.array(chars, pa.int64())], names=["doc_id", "digest", "chars"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, digest binary, chars long")


def _better(a: tuple, b: tuple) -> bool:
    """Whether (chars, doc_id) a stays rather than b: more code points, then the smaller id, null last."""
    return (a[0], a[1] is not None, -(a[1] or 0)) > (b[0], b[1] is not None, -(b[1] or 0))


def index_rows(rows: DataFrame, most: int | None) -> DataFrame:
    """Merge rows (digest, chars, keep_id, n) of equal digest within each partition through a CuckooIndex.

    With ``most``, the index is emptied whenever it holds so many digests, which bounds memory: for pre-aggregation.
    """
    kind = "digest binary, chars long, keep_id long, n long"

    def emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        held = list(index.entries())
        for k in range(0, len(held), 10_000):
            part = held[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), *(pa.array([x[1][i] for x in part], pa.int64()) for i in range(3))], names=["digest", "chars", "keep_id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for b in batches:
            for digest, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (entry := index.find(digest)) is None:
                    index.insert(digest, tuple(row))
                else:
                    a = entry[1]
                    best = row if _better(row, a) else a
                    entry[1] = (best[0], best[1], a[2] + row[2])
                if most and index.size >= most:
                    yield from emit(index)
                    index = CuckooIndex()
        yield from emit(index)

    return rows.select("digest", "chars", "keep_id", "n").mapInArrow(run, kind)


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, chars, keep_id, n) of each group of rows (doc_id, digest, chars).

    Each partition's digests first meet in a local index, so a group of any size sends at most one row per task and
    flush. There are as many partitions as keep the last indexes within PER_TASK digests.
    """
    local = index_rows(rows.select("digest", "chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")), most=200_000)
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index_rows(local.repartition(max(least, -(-rows.count() // PER_TASK)), "digest"), most=None)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and all empty texts are one group. The
    row with the most code points stays, then the one with the smallest doc_id (null ids last). Rows that repeat both
    doc_id and text count each and are all reported, with kept true where doc_id is keep_id. Very long texts are hashed whole. An empty
    table gives no rows; columns other than doc_id and text are not read, whatever their names.

    Merged classes join back to the digests; only digests are shuffled, never text.
    """
    rows = save(digests(docs), "digests")
    groups = _groups(rows).select("digest", "keep_id", F.col("n").alias("group_size"))
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were, of any names: the row that exact_groups() keeps.

    Of rows that repeat its doc_id and length, one stays. A null text is an empty one; a very long one is read whole, as its
    digest is all that moves. An empty table gives an empty one.
    """
    rows = save(digests(docs), "digests")
    keep = _groups(rows).select(F.coalesce("keep_id", F.lit(0)), F.col("keep_id").isNull(), F.lower(F.hex("digest")), "chars")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d, names = docs, []
    for column in (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").cast("long").isNull(), F.sha2(F.translate(text, " \t\n\x0b\f\r", ""), 256), F.length(text).cast("long")):
        names.append(free(d, f"key{len(names)}"))
        d = d.withColumn(names[-1], column)
    kept = d.join(keep.toDF(*names), names, "left_semi")
    return one_of_each(kept, names, docs.columns) if repeated(rows, "doc_id", "digest", "chars") else kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: white space is space and the five characters from tab to carriage return.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM d JOIN k USING (text_sha256)
"""
