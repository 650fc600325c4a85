"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space of every operator here: ``[\x20\x09-\x0D]``.
BLANKS = b" \t\n\v\f\r"
#: The same for Java's regular expressions: a word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. One of our own only where that is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    if not (base := sc.getCheckpointDir()):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return base


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage so that a lost executor costs one stage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def repeated(rows: DataFrame, *keys: str) -> bool:
    """Whether any value of keys has several rows: a look at the keys alone, which saves one_of_each() where none has."""
    return not rows.groupBy(*keys).count().where("count > 1").isEmpty()


def one_of_each(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of one row for each value of keys, that of the smallest hash of all columns. Partly merged before the shuffle, so a value may have any number of rows."""
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns))
    kinds = dict(df.dtypes)
    hashed = (F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kinds[c] else F.col(f"`{c}`") for c in columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*hashed)).alias("best"))
    return best.select(*(F.col("best")[c].alias(c) for c in columns))


def held_out(parts: int):
    """Whether crc32 of the doc_id's decimal text leaves 0 on division by parts; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))


def numbered(df: DataFrame, by: list[str], order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """df with each row's place (from 0) within its value of ``by``, in ascending ``order``, nulls first, and that value's rows.

    All rows are sorted by ranges of (by, order), so one value's rows may lie in many tasks; a row's place is its place in
    its range and the sum of the ranges before, of which there are at most as many as partitions. The sorted rows are
    written first: the places hold when a task is run again. Rows equal in all of by and order are in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark, part, first, n = free(df, "mark"), free(df, "part"), free(df, "first_mark"), free(df, "part_rows")
    keys = [F.col(f"`{c}`") for c in [*by, *order]]
    rows = save(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(mark, F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn(part, F.shiftright(mark, 33))
    other = {c: f"{free(df, 'by')}{i}" for i, c in enumerate(by)}
    ranges = rows.groupBy(*(F.col(f"`{c}`").alias(o) for c, o in other.items()), F.col(part).alias(f"{part}_")).agg(F.count("*").alias(n), F.min(mark).alias(first))
    within = W.partitionBy(*other.values()) if by else W.partitionBy(F.lit(0))
    ranges = ranges.withColumns({place: F.coalesce(F.sum(n).over(within.orderBy(f"{part}_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), size: F.sum(n).over(within)})
    same = rows[part] == ranges[f"{part}_"]
    for c, o in other.items():
        same = same & rows[f"`{c}`"].eqNullSafe(ranges[o])
    found = rows.join(ranges, same)
    return found.select(*(rows[f"`{c}`"] for c in df.columns), (ranges[place] + rows[mark] - ranges[first]).alias(place), ranges[size])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of a sorted stream by the values of its first ``keys`` columns (integers, may be null), a table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [(pc.fill_null(b.column(k).cast(pa.int64()), 0).to_numpy(zero_copy_only=False), b.column(k).is_valid().to_numpy(zero_copy_only=False)) for k in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for v, ok in columns:
            new[1:] |= (v[1:] != v[:-1]) | (ok[1:] != ok[:-1])
        first = tuple((v[0], ok[0]) for v, ok in columns)
        new[0] = bool(held) and first != last
        last = tuple((v[-1], ok[-1]) for v, ok in columns)
        at = 0
        for cut in np.flatnonzero(new).tolist():
            if cut > at:
                held.append(b.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them, one more than rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return values[at]


def spread_codes(ids: tuple[np.ndarray, np.ndarray], codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of runs of codes, and how many each run has; ids: those of all codes, one code's after another's, and how many each has."""
    values, sizes = ids
    codes = spread(codes, starts, counts)
    wide = sizes[codes]
    before, ends = np.append(0, np.cumsum(wide)), np.cumsum(counts)
    return spread(values, (np.cumsum(sizes) - sizes)[codes], wide), before[ends] - before[ends - counts]


_CHUNK = 1 << 19
_ROOT = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_BYTES[_BLANK] = 0
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's root and of its inverse modulo 2**64, n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for x in (_ROOT, pow(_ROOT, -1, 2**64)):
            p = np.full(max(n, _CHUNK), x, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of a string column, in order, and where each row's words start, one more than rows.

    A polynomial hash over bytes, for all words of a chunk at once; fold takes A-Z as a-z. Chunks of about half a MB
    end between words, so memory stays bounded for any length of text.
    """
    data, offsets = as_bytes(column)
    worth = _FOLDED if fold else _BYTES
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    found, at, a = [], [], 0
    while a < len(data):
        b = min(a + _CHUNK, len(data))
        if b < len(data):
            ends = np.flatnonzero(_BLANK[data[a:b]] | first[a + 1 : b + 1])
            if len(ends):
                b = a + int(ends[-1]) + 1
            else:  # one word longer than a chunk
                while b < len(data) and not (_BLANK[data[b]] or first[b]):
                    b += 1
        chunk = data[a:b]
        solid = ~_BLANK[chunk]
        start = solid & first[a:b]
        start[1:] |= solid[1:] & ~solid[:-1]
        start[0] = solid[0]
        s = np.flatnonzero(start)
        if len(s):
            up, down = _powers(len(chunk))
            found.append(mix(np.add.reduceat(worth[chunk] * up[: len(chunk)], s) * down[s]))
            at.append(s + a)
        a = b
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(at) if at else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of n words and where each row's start; fewer words make one run of all of them."""
    sizes = np.diff(starts)
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(sizes)), counts)
    pos = np.arange(out[-1]) - out[row] + starts[row]
    total = np.zeros(len(pos), np.uint64)
    left = starts[row + 1] - pos
    for k in range(n):
        part = mix(words[np.minimum(pos + k, len(words) - 1)] + np.uint64(k * 0x2545F4914F6CDD1D % 2**64)) if len(pos) else total
        total += np.where(left > k, part, np.uint64(0))
    return mix(total), out
