"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, save, spread, spread_codes, table

_HEAD = struct.Struct("<4sIQB")
_MAGIC = b"DAC1"
_STEP = 512  # bits between entries of a rank directory


class DirectCodes:
    """A file image of documents' ids, any of which can be read without decoding others.

    Each id is cut into bytes, lowest first. Level k has the k-th byte of every id that is long enough, a bitmap of
    which ids continue at level k + 1, and a rank directory: the number of set bits before each 512th. An id's place at
    the next level is the rank of its bit. Before the levels come the documents' ids and where each document starts.
    Layout, little endian: magic, documents, ids, levels; doc_id and start of each document; then for each level its
    length, bytes, bitmap (padded to 64 bytes) and directory.
    """

    def __init__(self, image: bytes) -> None:
        magic, docs, self.size, levels = _HEAD.unpack_from(image)
        if magic != _MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.starts = np.append(np.frombuffer(image, "<u8", docs, at + 8 * docs), self.size).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", image, at)
            steps = -(-n // _STEP)
            at += 8
            chunk = np.frombuffer(image, np.uint8, n, at)
            bits = np.frombuffer(image, np.uint8, steps * _STEP // 8, at + n)
            ranks = np.frombuffer(image, "<u4", steps, at + n + len(bits))
            at += n + len(bits) + 4 * steps
            self.levels.append((chunk, bits, ranks))

    @staticmethod
    def build(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
        sizes = np.array([len(x) for x in ids], np.int64)
        values = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
        out, n = [], len(values)
        while True:
            more = values > 0xFF
            steps = -(-len(values) // _STEP)
            bits = np.zeros(steps * _STEP, np.uint8)
            bits[: len(values)] = more
            counts = bits.reshape(steps, _STEP).sum(1, dtype=np.int64)
            out += [struct.pack("<Q", len(values)), (values & 0xFF).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u4").tobytes()]
            values = values[more] >> 8
            if not len(values):
                break
        return b"".join([_HEAD.pack(_MAGIC, len(ids), n, len(out) // 4), np.array(doc_ids, "<i8").tobytes(), (np.cumsum(sizes) - sizes).astype("<u8").tobytes(), *out])

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, place: int) -> int:
        """One id: a byte of each level it reaches, and one rank between levels."""
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[place]) << shift
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            place, shift = self._rank(bits, ranks, place), shift + 8
        return value

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, place: int) -> int:
        """Set bits before place."""
        near = place // _STEP
        part = bits[near * _STEP // 8 : (place >> 3) + 1]
        return int(ranks[near]) + int(np.unpackbits(part, bitorder="little")[: place - near * _STEP].sum())

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from start up to end: at each level, one run of bytes."""
        values = np.zeros(end - start, np.uint32)
        where = np.arange(end - start)
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            if start >= end:
                break
            values[where] |= chunk[start:end].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start].astype(bool)
            start = self._rank(bits, ranks, start)
            where, end = where[more], start + int(more.sum())
        return values

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


class UnitTable:
    """Ids of keys seen, in one growing array, each with a slot; emptied between batches once it holds ``most`` units, which bounds memory."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, end = len(self.slots), self.used + len(ids)
        while len(self.ids) < end:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.starts) < n + len(keys):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.ids[self.used : end] = ids
        self.starts[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(keys)] = sizes
        self.slots.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.used = end

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slots one after another, and how many each has."""
        sizes = self.sizes[slots]
        return spread(self.ids, self.starts[slots], sizes), sizes


def _strings(column: pa.Array) -> list[str]:
    """to_pylist() of strings, without an object of Arrow's for each."""
    return column.to_numpy(zero_copy_only=False).tolist()


class LibraryEncoder:
    """The tokenizers library over whole texts, with the ids of parts seen kept.

    A unit is what lies between single blanks, with the blank before it; the byte-level pre-tokenizer never joins units,
    except around runs of white space, and such texts go to the library as they are. So do texts with an added token's
    string, which the library maps to that token. Arrow finds the distinct units of a few MB of texts and cuts them into
    parts where a piece always ends: after a letter before a mark, and around a single line end. Parts without a slot go to
    the library in long runs, whose ids are cut by the byte lengths of the tokens.
    """

    UNITS, AT_ONCE, RUN = 800_000, 8 << 20, 200
    _SPACES, _SOLID = (rf"[{x}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]" for x in ("", "^"))
    _LETTER, _MARK = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]", r"[!-/:-@\[-`{-~]"
    _CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.units = Tokenizer.from_str(vocabulary), UnitTable(self.UNITS)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [x.content for x in added if x.content]
        self.cuts = not any(x.lstrip or x.rstrip or re.search(r"\s", x.content) for x in added)
        tokens = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max([*tokens.values(), *self.library.get_added_tokens_decoder()], default=0) + 1, np.int64)  # a byte-level token has a character for each byte
        self.width[list(tokens.values())] = [len(x) for x in tokens]

    def _fresh(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: pa.Array) -> None:
        """Slots for parts that the table lacks. Those that begin with a blank follow each other in a run; after others stands a line end, whose id is left out."""
        led = pc.match_substring_regex(parts, f"(?s)^ .*{self._SOLID}$")
        bare = pc.match_substring_regex(parts, f"(?s)^{self._SOLID}(?:.*{self._SOLID})?$")
        alone = [] if self.cuts else _strings(parts)
        for some, gap in ((led, 0), (bare, 1)) if self.cuts else ():
            found = parts.filter(some)
            names, (data, edges) = _strings(found), as_bytes(pc.binary_join_element_wise(found, *pa.array(["", "\n"], pa.large_string())) if gap else found)
            spots = [*range(0, len(names), self.RUN), len(names)]
            texts = [data[edges[a] : edges[z]].tobytes().decode() for a, z in itertools.pairwise(spots)]
            for (a, z), ids in zip(itertools.pairwise(spots), self._fresh(texts), strict=True):
                ends = edges[a + 1 : z + 1] - edges[a]
                at = np.cumsum(self.width[ids])
                last = at.searchsorted(ends - gap)  # a part's last token
                if len(at) and at[-1] == ends[-1] and (at[last] == ends - gap).all() and (not gap or (at[last + 1] == ends).all()):
                    self.units.add(names[a:z], np.delete(ids, last + 1) if gap else ids, np.diff(last, prepend=-1 - gap) - gap)
                else:
                    alone += names[a:z]
        if self.cuts:
            alone += _strings(parts.filter(pc.invert(pc.or_(led, bare))))
        if alone:
            ids = self._fresh(alone)
            self.units.add(alone, np.concatenate(ids), np.array([len(x) for x in ids], np.int64))

    def _slots(self, parts: pa.Array) -> np.ndarray:
        slots, names = self.units.slots, _strings(parts)
        found = list(map(slots.get, names))
        if None in found:
            missing = [k for k, slot in enumerate(found) if slot is None]
            self._learn(parts.take(pa.array(missing)))
            for k in missing:
                found[k] = slots[names[k]]
        return np.array(found, np.int64)

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, one after another, and how many each has."""
        cuts = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        units = cuts.flatten().dictionary_encode()
        marked = pc.replace_substring_regex(units.dictionary, f"({self._LETTER})({self._MARK})", "\\1\0\\2")
        marked = pc.replace_substring_regex(marked, r"([!-~\x{c0}-\x{17f}])\n([!-~\x{c0}-\x{17f}])", "\\1\0\n\0\\2")
        pieces = pc.split_pattern(marked, "\0")
        parts = pieces.flatten().dictionary_encode()
        if len(self.units.slots) > self.units.most:
            self.units.clear()
        of_part = self.units.gather(self._slots(parts.dictionary))
        edges, ends = pieces.offsets.to_numpy(), cuts.offsets.to_numpy()
        of_unit = spread_codes(of_part, parts.indices.to_numpy(), edges[:-1], np.diff(edges))
        return spread_codes(of_unit, units.indices.to_numpy(), ends[:-1], np.diff(ends))

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text that may not be split at each blank; a very long one is cut where a blank stands between other characters."""
        pieces, at = [], 0
        while self.cuts and len(text) - at > self.AT_ONCE and (cut := self._CUT.search(text, at + self.AT_ONCE // 2)):
            pieces.append(text[at : cut.start()])
            at = cut.start()
        return np.concatenate([self._fresh([x])[0] for x in [*pieces, text[at:]]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (large strings without nulls) one after another, and how many each has."""
        odd = pc.match_substring_regex(texts, f"{self._SPACES} (?:{self._SPACES}|$)")
        for x in ["\0", *self.added]:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        data, offsets = as_bytes(texts)
        pieces, edges, owner = data.tobytes(), [], []  # long texts are cut before a blank
        for k in np.flatnonzero(~odd).tolist():
            a, z = int(offsets[k]), int(offsets[k + 1])
            while z - a > self.AT_ONCE and (cut := pieces.find(b" ", a + self.AT_ONCE // 2, z)) > 0:
                edges.append((a, cut))
                owner.append(k)
                a = cut
            edges.append((a, z))
            owner.append(k)
        sizes, found, at = np.zeros(len(texts), np.int64), {}, 0
        while at < len(edges):
            end, n = at, 0
            while end < len(edges) and (end == at or n + edges[end][1] - edges[end][0] <= self.AT_ONCE):
                n += edges[end][1] - edges[end][0]
                end += 1
            ids, counts = self._split(pa.array([pieces[a:z] for a, z in edges[at:end]], pa.large_binary()).cast(pa.large_string()))
            cuts = np.cumsum(counts)
            for k, a, z in zip(owner[at:end], cuts - counts, cuts, strict=True):
                found.setdefault(k, []).append(ids[a:z])
            at = end
        for k in np.flatnonzero(odd).tolist():
            found[k] = [self._whole(texts[k].as_py())]
        out = [x for k in range(len(texts)) for x in found[k]]
        for k, parts in found.items():
            sizes[k] = sum(map(len, parts))
        return (np.concatenate(out) if out else np.zeros(0, "<u4")), sizes


_ENCODERS: dict[int, LibraryEncoder] = {}


#: One row a row group: the writer counts rows, and asks for sizes after each.
_ONE_A_GROUP = {"parquet.block.row.count.limit": 1, "parquet.block.size": 1 << 16, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def write_images(docs: DataFrame, vocabulary: str, end_id: int, image_ids: int = 1 << 18) -> DataFrame:
    """Images of all documents in ascending order of doc_id: shard, part, n_docs, n_ids, image.

    Documents are dealt by ranges of doc_id and sorted (null first, repeated ids by text), so shard and part order the
    images. An image is closed once it has image_ids ids: it holds that and one document at most. A null text counts
    as empty and gives the end id alone; a very long text is encoded in pieces. An empty table gives no images; further
    columns are not read. vocabulary is a tokenizers file, read by the driver and broadcast. Images are stored without
    compression, each in a row group of its own, so that one is found by shard and part and read without decoding others.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = LibraryEncoder(shared.value)
        encode, shard, part = _ENCODERS[key].encode, TaskContext.get().partitionId(), 0
        names, ids, n = [], [], 0

        def close() -> pa.RecordBatch:
            row = [[shard], [part], [len(names)], [n], [DirectCodes.build(names, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "part", "n_docs", "n_ids", "image"])

        for b in batches:
            flat, sizes = encode(pc.fill_null(b.column(1).cast(pa.large_string()), ""))
            ends = np.cumsum(sizes)
            for doc_id, a, z in zip(b.column(0).to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                names.append(doc_id)
                ids.append(np.concatenate((flat[a:z], end)))
                n += z - a + 1
                if n >= image_ids:
                    yield close()
                    part, names, ids, n = part + 1, [], [], 0
        if names:
            yield close()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return save(rows.mapInArrow(run, "shard int, part int, n_docs long, n_ids long, image binary"), "token-images", compression="none", **_ONE_A_GROUP)


def _image_starts(images: DataFrame) -> DataFrame:
    """shard, part, and how many ids come before; the windows are over shards, and over images within a shard."""
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = images.select("shard", "part", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", earlier(W.orderBy("shard")).alias("shard_from"))
    parts = sizes.select("shard", "part", "n_ids", earlier(W.partitionBy("shard").orderBy("part")).alias("part_from"))
    return parts.join(shards, "shard").select("shard", "part", "n_ids", (F.col("shard_from") + F.col("part_from")).alias("image_from"))


def tokens_at(images: DataFrame, places: DataFrame) -> DataFrame:
    """place and id: the token at each place of the whole corpus, counted from 0; none for places outside it.

    Only images that hold a place are opened, and in them only the bytes and ranks on the way to it.
    """
    spans = _image_starts(images)
    wanted = places.select(F.col("place").cast("long")).distinct()
    found = wanted.join(spans, (F.col("place") >= F.col("image_from")) & (F.col("place") < F.col("image_from") + F.col("n_ids")))
    lists = found.groupBy("shard", "part").agg(F.first("image_from").alias("image_from"), F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, begin, asked in zip(*(b.column(k) for k in range(3)), strict=True):
                codes, asked = DirectCodes(image.as_py()), asked.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([codes[p - begin.as_py()] for p in asked], pa.int64())], names=["place", "id"])

    return images.select("shard", "part", "image").join(lists, ["shard", "part"]).select("image", "image_from", "places").mapInArrow(run, "place long, id long")


def read_images(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the images alone; a null id comes back as null.

    Starts add the ids of all images before and of the documents before in the image.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, part, image in zip(*b.columns, strict=True):
                codes = DirectCodes(image.as_py())
                n, flat = len(codes.doc_ids), codes.read(0, len(codes)).astype("<u4").tobytes()
                sums = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in itertools.pairwise(codes.starts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), pa.array([part.as_py()] * n, pa.int32()), pa.array(codes.doc_ids), pa.array(codes.starts[:-1]), pa.array(np.diff(codes.starts)), pa.array(sums, pa.int64())], names=["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = images.select("shard", "part", "image").mapInArrow(run, "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    doc_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return docs.join(_image_starts(images), ["shard", "part"]).select(doc_id.alias("doc_id"), (F.col("image_from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return read_images(write_images(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
