"""Near-duplicate documents by BagMinHash signatures, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free, mix, one_of_each, repeated, save, shingle_hashes, table, word_hashes

_GOLDEN = 0x9E3779B97F4A7C15
_AT_ONCE = 1 << 19  # shingles looked at together
_SMALL = 500_000  # keys of texts that are broadcast, of some tens of bytes each; more are joined by a shuffle


def multisets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of n words of each row, their counts, and where each row's start. Whole texts; no words, no shingles."""
    words, starts = word_hashes(column)
    found, out = shingle_hashes(words, starts, n)
    row = np.repeat(np.arange(len(column)), np.diff(out))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return found[at], np.diff(np.append(at, len(found))), np.searchsorted(row[at], np.arange(len(column) + 1))


def bag_minhash(shingles: np.ndarray, counts: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Signatures of weighted sets, one row each: two of them agree in a place with the probability of their weighted Jaccard similarity.

    A weight is cut into levels of one, and the levels into blocks [0, 1), [1, 2), [2, 4), [4, 8) and so on. A Poisson
    process of an element and block, with a rate of the block's length, gives points in ascending time; each point has a
    place of the signature and a level, and counts if that level is below the weight. Blocks that lie below the weight need no
    level drawn; at most the last one has points to spare. A place keeps its earliest time. A process ends when its time is
    past the latest of all places of its set, so a set takes time linear in its elements plus a constant.
    """
    rows = len(starts) - 1
    best = np.full((rows, size), np.inf)
    if not len(shingles):
        return best
    owner = np.repeat(np.arange(rows), np.diff(starts))
    blocks = np.where(counts > 1, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 1)
    element = np.repeat(np.arange(len(shingles)), blocks)
    block = np.arange(len(element)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.maximum(low, 1)
    keep = np.minimum(counts[element] - low, length) / length  # the share of the block below the weight
    seed = mix(shingles[element] + (block.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLDEN))
    of, rate, time = owner[element], length.astype(float), np.zeros(len(element))
    flat, step = best.reshape(-1), 0
    while len(seed):
        step += 1
        z = mix(seed + np.uint64(step * _GOLDEN % 2**64))
        time = time - np.log(((z >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / rate
        place = (mix(z) % np.uint64(size)).astype(np.int64)
        if (keep < 1).any():
            level = (mix(z ^ np.uint64(_GOLDEN)) >> np.uint64(11)).astype(float) * 2.0**-53
            ok = level < keep
            np.minimum.at(flat, of[ok] * size + place[ok], time[ok])
        else:
            np.minimum.at(flat, of * size + place, time)
        alive = np.unique(of)
        latest = np.zeros(rows)
        latest[alive] = best[alive].max(1)
        on = time < latest[of]
        seed, time, of, rate, keep = seed[on], time[on], of[on], rate[on], keep[on]
    return best


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are of about a few MB together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.concatenate(([0], np.cumsum(sizes) // (_AT_ONCE * 6)))
    edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, z - a) for a, z in zip(edges, edges[1:], strict=False) if z > a)


def _text_keys(text: Column) -> list[Column]:
    """Two hashes of a text, which tell the rows of a doc_id apart."""
    return [F.xxhash64(F.lit(k), text).alias(f"k{k}") for k in (1, 2)]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_text_keys(text))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, k1, k2, content (a hash of the multiset, null without words), words, and a hash of each band of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 1):
                found, counts, starts = multisets(part.column(1), n)
                total = np.concatenate(([0], np.cumsum(counts)))
                weight = total[starts[1:]] - total[starts[:-1]]
                one, two = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(found ^ np.uint64(k)) * counts.astype(np.uint64), dtype=np.uint64))) for k in (1, 2))
                both = np.stack([x[starts[1:]] - x[starts[:-1]] for x in (one, two)], 1)
                content = [x.tobytes() if w else None for x, w in zip(both, weight.tolist(), strict=True)]
                sig = bag_minhash(found, counts, starts, bands * rows).view(np.uint64).reshape(-1, bands, rows)
                key = np.zeros((part.num_rows, bands), np.uint64)
                for k in range(rows):
                    key = mix(key * np.uint64(31) + sig[:, :, k])
                key = mix(key + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(_GOLDEN))
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * bands, pa.array(key.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(content, pa.binary()), pa.array(weight), lists], names=["doc_id", "k1", "k2", "content", "words", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, content binary, words long, bands array<long>")


def bags(texts: DataFrame, n: int) -> DataFrame:
    """id and the multiset of shingles of each text: the distinct ones in order, then counts, packed; counts are left out where all are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b, 1):
                found, counts, starts = multisets(part.column(1), n)
                cuts = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([found[a:z].tobytes() for a, z in cuts], pa.binary()), pa.array([counts[a:z].astype("<u4").tobytes() if (counts[a:z] > 1).any() else b"" for a, z in cuts], pa.binary())], names=["id", "shingles", "counts"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary, counts binary")


def overlap(a: np.ndarray, na: bytes, b: np.ndarray, nb: bytes) -> int:
    """Common weight of two multisets: distinct shingles in order, and packed counts as in bags()."""
    at = np.searchsorted(a, b)
    hit = np.flatnonzero(a[np.minimum(at, len(a) - 1)] == b)
    if not na and not nb:
        return len(hit)
    x = np.frombuffer(na, "<u4")[at[hit]] if na else np.ones(len(hit), np.int64)
    y = np.frombuffer(nb, "<u4")[hit] if nb else np.ones(len(hit), np.int64)
    return int(np.minimum(x, y).sum())


def verify(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of (a, b, words_a, words_b), a saved table, whose multisets have a weighted Jaccard similarity of ``least`` or more.

    Where pairs are few enough for their ids to be broadcast, only bags that they need are moved.
    """
    mine = {x: held for x in "ab"}
    if pairs.count() <= _SMALL:
        mine = {x: held.join(F.broadcast(pairs.select(F.col(x).alias("id")).distinct()), "id", "left_semi") for x in "ab"}
    left = mine["a"].select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("na"))
    right = mine["b"].select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for wa, wb, sa, na, sb, nb in zip(*(b.column(k) for k in range(2, 8)), strict=True):
                common, total = overlap(np.frombuffer(sa.as_py(), np.uint64), na.as_py(), np.frombuffer(sb.as_py(), np.uint64), nb.as_py()), wa.as_py() + wb.as_py()
                ok.append(common >= least * (total - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "words_a", "words_b", "sa", "na", "sb", "nb")
    return rows.mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and label, the smallest id of its connected component, of each id in nodes.

    Each round takes the smallest label among neighbours and then the label of one's label; rounds are few as links
    mostly form stars, and each ends with a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    near = both.groupBy("a").agg(F.min("b").alias("near"))
    labels = None
    while True:
        if labels is None:  # every label is the id itself at first
            new = nodes.select("id", F.col("id").alias("label")).join(near, F.col("id") == near["a"], "left")
        else:
            near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            new = labels.join(near, labels["id"] == near["a"], "left")
        new = save(new.select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low")), "labels")
        if new.where("low < label").isEmpty():
            return new.select("id", "label")
        jump = new.where("low < id").select(F.col("id").alias("low"), F.col("low").alias("lower"))
        labels = save(new.join(jump, "low", "left").select("id", F.least("low", F.coalesce("lower", "low")).alias("label")), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after further links (a, b): only components that these touch are looked at."""
    a, b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    ends = links.select("a", "b").join(a, "a").join(b, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    ends = save(ends, "ends")
    new = components(ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct(), ends)
    return save(labels.join(new.select(F.col("id").alias("label"), F.col("label").alias("new")), "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")


def _needed(least: float, a: str, b: str) -> Column:
    """The overlap that multisets of these weights need."""
    return least / (1 + least) * (F.col(a) + F.col(b)) - 1e-9


def prefix_rows(members: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(id, label, words, s, left): shingles that members (id, label, words) could share first with one of another label.

    Each multiset's shingles are put in order of rarity among the members, those that one member has alone first. At a
    pair's first common shingle all their overlap is still to come, so ``left``, what a member has from there on, must be
    the overlap needed. A shingle that one member has alone makes no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = np.frombuffer(b.column(3)[k].as_py(), np.int64)
                n = np.frombuffer(b.column(4)[k].as_py(), "<u4") if b.column(4)[k].as_py() else np.ones(len(s), np.int64)
                for a in range(0, len(s), _AT_ONCE):
                    m = len(s[a : a + _AT_ONCE])
                    own = [pa.array([b.column(j)[k].as_py()] * m, pa.int64()) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(s[a : a + _AT_ONCE]), pa.array(n[a : a + _AT_ONCE].astype(np.int64))], names=["id", "label", "words", "s", "n"])

    rows = members.join(held, "id").select("id", "label", "words", "shingles", "counts").mapInArrow(run, "id long, label long, words long, s long, n long")
    rows = save(rows, "shingles")
    common = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("df > 1").select("s", "df", (F.col("l1") < F.col("l2")).alias("mixed"))
    shared = rows.join(common, "s")
    after = W.partitionBy("id").orderBy(F.col("df").desc(), F.col("s").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    shared = shared.withColumn("left", F.sum("n").over(after))
    return save(shared.where(F.col("mixed") & (F.col("left") >= least * F.col("words") - 1e-9)).select("id", "label", "words", "s", "left"), "prefixes")


def narrowed(able: DataFrame, least: float) -> DataFrame:
    """Rows of prefix_rows() that some size and label at their shingle could pair with, before any pair is made.

    Members that differ by more than the threshold allows in shingles of their own meet nobody, in groups of any size.
    """
    for _ in range(2):
        step = F.floor(F.log(F.col("words").cast("double")) * 50).cast("int")  # sizes in steps of a fiftieth
        cells = able.groupBy("s", step.alias("step")).agg(F.min("words").alias("w"), F.max("left").alias("most"), F.min("label").alias("c1"), F.max("label").alias("c2"))
        cells = cells.withColumnRenamed("s", "cs")
        meets = (F.col("s") == F.col("cs")) & ((F.col("label") != F.col("c1")) | (F.col("label") != F.col("c2"))) & (F.col("left") >= _needed(least, "words", "w")) & (F.col("most") >= _needed(least, "words", "w"))
        able = save(able.join(cells, meets, "left_semi"), "prefixes")
    return able


def prefix_pairs(able: DataFrame, least: float, hubs_only: bool = False) -> DataFrame:
    """Pairs (a, b, words_a, words_b) of different label that may reach the similarity; with hubs_only, of each member and the one
    that has most left of those at its shingle.
    """
    y = able.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("words").alias("words_b"), F.col("s").alias("t"), F.col("left").alias("left_b"))
    x = able.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("words").alias("words_a"), "s", F.col("left").alias("left_a"))
    if hubs_only:
        x = x.groupBy("s").agg(F.max(F.struct("left_a", "a", "la", "words_a")).alias("hub")).select("hub.*", "s")
    order = F.col("a") != F.col("b") if hubs_only else F.col("a") < F.col("b")
    meets = (F.col("s") == F.col("t")) & (F.col("la") != F.col("lb")) & order & (F.least("left_a", "left_b") >= _needed(least, "words_a", "words_b"))
    return x.join(y, meets).select("a", "b", "words_a", "words_b").distinct()


def near_classes(docs: DataFrame, *, shingle: int = 5, least: float = 0.8, bands: int = 40, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (doc_id, k1, k2, content) and the class of each content (content, class): see near_groups().

    Texts of one multiset are one node from the start, numbered as the table of nodes is written. Nodes that share a band
    of the signature (a pair at the threshold misses all with a probability of 5e-6) form a bucket, and a bucket needs
    few of its pairs: first every member is verified against one hub, which links groups of near copies of any size in as
    many pairs as members. Members of buckets that aren't in one component yet go through an exact filter, prefix_rows()
    and narrowed(), which leaves out no pair of the similarity; what passes is verified against the hubs of its shingles,
    and then, if it is still apart, pair by pair.
    """
    sig = save(signatures(docs, shingle, bands, rows), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("rep")
    nodes = sig.where("content IS NOT NULL").groupBy("content").agg(rep, F.max("words").alias("words"), F.max("bands").alias("bands"))
    nodes = save(nodes.select(F.monotonically_increasing_id().alias("id"), "content", "words", "rep", "bands"), "nodes")
    keys = nodes.select("id", "words", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = save(keys.join(buckets, "key"), "members")
    # the hub of a bucket is the member with most company in all its buckets: the middle of a group of near copies
    company = members.groupBy("id").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "id").groupBy("key").agg(F.max(F.struct("company", F.xxhash64(F.lit(3), "id").alias("order"), "id", "words")).alias("hub"))
    hubbed = members.join(hubs, "key").select(F.col("hub.id").alias("a"), F.col("id").alias("b"), F.col("hub.words").alias("words_a"), F.col("words").alias("words_b"))

    def alike(x: str, y: str):  # the similarity can't be more than that of the sizes
        return F.least(x, y) >= least * F.greatest(x, y)

    wanted = members.select("id").distinct().join(nodes.select("id", "words", "rep"), "id")
    wanted = save(wanted.select("id", "words", F.col("rep.doc_id").alias("d"), F.col("rep.k1").alias("j1"), F.col("rep.k2").alias("j2")), "wanted")
    texts = _keyed(docs).join(F.broadcast(wanted) if wanted.count() <= _SMALL else wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")))
    held = save(bags(texts, shingle), "bags")  # rows that repeat doc_id and text give equal bags
    held = held.dropDuplicates(["id"]) if repeated(held, "id") else held
    pairs = hubbed.where((F.col("a") != F.col("b")) & alike("words_a", "words_b"))
    links = save(verify(save(pairs.distinct(), "pairs"), held, least), "links")
    ids = wanted.select("id")
    labels = components(ids, links)
    named = members.select("key", "id", "words").join(labels, "id")
    open_ = named.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("key")
    left = save(named.join(open_, "key", "left_semi").select("id", "label", "words").distinct(), "left")  # a bucket in one component stays so
    if not left.isEmpty():
        able = narrowed(prefix_rows(left, held, least), least)
        for hubs_only in (True, False):
            if able.isEmpty():
                break
            pairs = save(prefix_pairs(able, least, hubs_only), "pairs")  # few, mostly: bags aren't moved for a small table
            if pairs.isEmpty():
                break
            more = save(verify(pairs, held, least), "links")
            if more.isEmpty():
                continue
            labels = merged(labels, more)
            if hubs_only:
                able = narrowed(able.drop("label").join(labels, "id").select("id", "label", "words", "s", "left"), least)
    classes = nodes.join(labels, "id", "left").select("content", "rep", F.coalesce("label", "id").alias("class"))
    return sig.select("doc_id", "k1", "k2", "content"), classes


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id and class_id, the smallest doc_id of its class.

    Texts are linked when the multisets of their shingles of five words have a weighted Jaccard similarity of ``least``
    or more; classes are the connected components. Fewer words make one shingle; a text without words (null, empty, white
    space) is a class of its own, of its own doc_id. Classes are of texts: rows that repeat a doc_id with another text may be in
    another class, and a row without doc_id is in that of its text (class_id is null where no row of a class has an id). Very long texts are
    read whole, in pieces. An empty table gives no rows; other columns are not read, whatever their names.
    """
    sig, classes = near_classes(docs, **options)
    first = classes.groupBy("class").agg(F.min("rep.doc_id").alias("class_id"))
    known = classes.join(first, "class").select("content", "class_id")
    return sig.join(known, "content", "left").select("doc_id", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, all columns as they were: that of the smallest doc_id (null last), one where rows repeat.

    Texts without words all stay. Columns of any names and further ones are kept; an empty table gives none.
    """
    sig, classes = near_classes(docs, **options)
    keep = classes.groupBy("class").agg(F.min("rep").alias("rep"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wordless = ~text.rlike(WORD)
    d, names = docs.where(~wordless), []
    for column in (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").cast("long").isNull(), *_text_keys(text)):
        names.append(free(d, f"key{len(names)}"))
        d = d.withColumn(names[-1], column)
    rep = (F.coalesce("rep.doc_id", F.lit(0)), F.col("rep.last"), F.col("rep.k1"), F.col("rep.k2"))
    kept = d.join(keep.select(*(c.alias(name) for c, name in zip(rep, names, strict=True))), names, "left_semi")
    kept = one_of_each(kept, names, docs.columns) if repeated(sig, "doc_id", "k1", "k2") else kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    return kept.union(docs.where(wordless))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
