"""Scores of texts under a Katz backoff model with Good-Turing discounts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, save, table, word_hashes

#: Hashes of what precedes a text and of what ends it; no word has them but by chance.
_BEGIN, _END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_BLOCK_TOKENS, _BLOCK_DOCS, _BUCKET_TOKENS = 1 << 20, 50_000, 1_000_000
_RARE = 5  # counts up to this are discounted


def pack(x: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def unpack(x: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind) if len(planes) else np.zeros(0, kind)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts of counts 1 to 5 from the numbers of grams with counts 1 to 6.

    Katz's form, which leaves larger counts alone. Where the numbers don't support it (some discount isn't within
    (0, 1)), absolute discounting by n1 / (n1 + 2 n2) takes its place.
    """
    out = []
    if n[0] and (top := (_RARE + 1) * n[_RARE] / n[0]) < 1:
        for r in range(1, _RARE + 1):
            star = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 1.0
            out.append((star - top) / (1 - top))
    if len(out) == _RARE and all(0 < d < 1 for d in out):
        return out
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [(r - cut) / r for r in range(1, _RARE + 1)]


class Unigrams:
    """Discounted unigram probabilities by count; what is left over goes to a word never seen."""

    def __init__(self, total: int, kinds: int, n: list[int]) -> None:
        self.total, self.kinds, self.scale = total, kinds, 1.0 / max(total, 1)
        self.cuts = np.array(discounts(n)) if total else np.ones(_RARE)
        self.left = sum((1 - d) * r * k for r, (d, k) in enumerate(zip(self.cuts, n, strict=False), 1)) * self.scale
        if total and self.left <= 0:  # no count is rare: one more is taken for the unseen word
            self.cuts, self.scale = np.ones(_RARE), 1 / (total + 1)
            self.left = self.scale
        if not total:
            self.left = 1.0

    def chance(self, counts: np.ndarray) -> np.ndarray:
        rare = self.cuts[np.clip(counts, 1, _RARE).astype(int) - 1]
        return np.where(counts > 0, np.where(counts <= _RARE, rare, 1.0) * counts * self.scale, self.left)


def encode_corpus(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents of about a million tokens: local vocabulary with training counts, tokens as places in it."""

    def close(block: int, ids: list, held: list, words: list, sizes: list) -> pa.RecordBatch:
        sizes = np.concatenate(sizes)
        tokens = np.full(int(sizes.sum()) + len(sizes), _END)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = np.concatenate(words)
        kinds, at, often = np.unique(np.append(tokens, _BEGIN), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small places, which pack well
        spot = np.empty_like(order)
        spot[order] = np.arange(len(order))
        kinds, at = kinds[order], spot[at]
        spot_of_begin = at[-1]
        flags = np.array(held, bool)
        seen = np.bincount(at[:-1][np.repeat(~flags, sizes + 1)], minlength=len(kinds))
        row = [[block], [ids], [held], [len(tokens)], [int((~flags).sum())], [int(seen.sum())], [pack(sizes.astype("<u4") + np.uint32(1))], [kinds.tobytes()], [pack(np.argsort(kinds).astype("<u4"))], [int(spot_of_begin)], [pack(seen.astype("<u4"))], [pack(at[:-1].astype("<u4"))]]
        kind = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kind, strict=True)], names=["block", "doc_ids", "held", "tokens", "train_docs", "train_tokens", "sizes", "kinds", "order", "begin", "seen", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n = TaskContext.get().partitionId() << 32, 0
        ids, held, words, sizes = [], [], [], []
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                found, starts = word_hashes(b.column(1), fold=True)
                ids += b.column(0).to_pylist()
                held += b.column(2).to_pylist()
                words.append(found)
                sizes.append(np.diff(starts))
                n += len(found) + b.num_rows
                if n >= _BLOCK_TOKENS or len(ids) >= _BLOCK_DOCS:
                    yield close(block, ids, held, words, sizes)
                    block, n = block + 1, 0
                    ids, held, words, sizes = [], [], [], []
        if ids:
            yield close(block, ids, held, words, sizes)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(10).alias("held"))
    return save(rows.mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, tokens long, train_docs long, train_tokens long, sizes binary, kinds binary, order binary, begin long, seen binary, places binary"), "corpus")


def _by_hash(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, by ranges, so that hashes in order fall into buckets in order."""
    return ((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _table(names: str, kinds: tuple, columns: list) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, t, c in zip(names.split(), kinds, columns, strict=True)})


def count_words(corpus: DataFrame, buckets: int) -> DataFrame:
    """Unigram tables by bucket, as rows (bucket, kind): kind 0 has the counts' statistics, kind 1 answers a block with ids and counts.

    An id is unique over buckets; within one, more frequent words have smaller ids. A block sends a bucket one row at most.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, kinds, seen in zip(*b.columns, strict=True):
                kinds, seen = np.frombuffer(kinds.as_py(), np.uint64), unpack(seen.as_py(), "<u4")
                order = np.argsort(kinds)
                kinds, seen = kinds[order], seen[order]
                to = _by_hash(kinds, buckets)
                cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                ends = np.append(cut[1:], len(kinds))
                rows = [(int(to[a]), block.as_py(), kinds[a:z].tobytes(), pack(seen[a:z])) for a, z in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "kinds", "seen"])

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        bucket = rows["bucket"][0].as_py()
        kinds = [np.frombuffer(x.as_py(), np.uint64) for x in rows["kinds"]]
        seen = [unpack(x.as_py(), "<u4") for x in rows["seen"]]
        words, at = np.unique(np.concatenate(kinds), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(seen), minlength=len(words)).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * buckets + bucket
        few = np.bincount(counts[counts <= _RARE + 1], minlength=_RARE + 2)[1:].tolist()
        blocks, cuts = rows["block"].to_pylist(), np.cumsum([0, *map(len, kinds)])
        parts = [at[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        none = [None] * len(blocks)
        return _table("bucket kind block kinds few ids counts", (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()), [[bucket] * (1 + len(blocks)), [0, *[1] * len(blocks)], [None, *blocks], [int((counts > 0).sum()), *none], [few, *none], [None, *(pack(ids[p].astype("<u8")) for p in parts)], [None, *(pack(counts[p].astype("<u8")) for p in parts)]])

    sent = corpus.select("block", "kinds", "seen").mapInArrow(send, "bucket int, block long, kinds binary, seen binary")
    return save(sent.groupBy("bucket").applyInArrow(merge, "bucket int, kind int, block long, kinds long, few array<long>, ids binary, counts binary"), "words")


def _rows(*columns: list) -> pa.Table:
    """Rows of score_pairs()."""
    return _table("kind context block doc times kept sums few", (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64())), list(columns))


def score_pairs(corpus: DataFrame, words: DataFrame, unigrams: Unigrams, train_docs: int, buckets: int) -> DataFrame:
    """Bigram tables by bucket of the context, evaluated for the documents, as rows by kind.

    0: few, numbers of bigrams with counts 1 to 6. 1: for a block, sums by document. 2: a context's kept counts, for its
    backoff weight. 3: a document's backed-off tokens in a context. 4: for a block, base
    scores, known tokens and tokens by document. 5: a document's seen tokens in a spread context that has no rare follower here.

    A context of very many tokens is spread over as many keys as its size takes, by the following word, and what it has is
    added up later. That only moves work: whether a context has rare followers is known from all its keys together, so
    scores don't depend on the number of buckets or on which contexts are spread.
    """
    total, kinds = unigrams.total, unigrams.kinds
    hot = max(1000, total // (8 * buckets))  # tokens of a context that one key takes

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows:
            row = block.to_pylist()[0]
            answers = answers.sort_by("bucket")
            order, places = unpack(row["order"], "<u4"), unpack(row["places"], "<u4").astype(np.int64)
            ids, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            for column, name in ((ids, "ids"), (counts, "counts")):  # answers come in order of hash
                column[order] = np.concatenate([unpack(x.as_py(), "<u8") for x in answers[name]])
            sizes, n = unpack(row["sizes"], "<u4").astype(np.int64), len(order)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            floor = np.log10((counts[places] + 0.1) / (total + 0.1 * (kinds + 1)))
            own = [np.bincount(doc, weights=x, minlength=len(sizes)) for x in (floor, counts[places] > 0)] + [sizes]
            out.append((row["block"] % buckets, row["block"], len(sizes), *[None] * 8, pack(np.concatenate(own).astype("<f8"))))
            before = np.empty_like(places)
            before[1:] = places[:-1]
            begin = row["begin"]
            before[np.cumsum(sizes) - sizes] = begin
            pairs, times = np.unique((before * n + places) * len(sizes) + doc, return_counts=True)
            doc, pair = pairs % len(sizes), pairs // len(sizes)
            context, word = pair // n, pair % n
            as_context = counts.copy()
            as_context[begin] = train_docs
            spread = np.where(as_context[context] > hot, ids[word] % (8 * (as_context[context] // hot) + 1) + 1, 0)
            to = ((ids[context] * 0x9E3779B1 + spread * 0x85EBCA6B) & 0xFFFFFFFF) * buckets >> 32
            order = np.argsort(to, kind="stable")
            flags = np.array(row["held"], np.int64)
            context, word, doc, times, to = (x[order] for x in (context, word, doc * 2 + flags[doc], times, to))
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(to)).tolist(), strict=True):
                # contexts and words once each with what is known of them, entries as places among them
                heads, of_context = np.unique(context[a:z], return_inverse=True)
                kinds_, of_word = np.unique(word[a:z], return_inverse=True)
                lists = [ids[heads], as_context[heads], ids[kinds_], counts[kinds_]]
                entries = [np.diff(of_context, prepend=0), of_word, doc[a:z], times[a:z]]
                out.append((int(to[a]), row["block"], len(sizes), *(pack(x.astype("<u8")) for x in lists), *(pack(x.astype("<u4")) for x in entries), None))
        return _table("bucket block docs contexts bases words counts context word doc times base", (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 9), list(zip(*out, strict=True)) if out else [[]] * 12)

    def evaluate(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        plain = rows.filter(pc.is_valid(rows["base"]))
        rows = rows.filter(pc.is_null(rows["base"]))
        k4 = plain.num_rows
        kept_out = (plain["block"].to_pylist(), plain["base"].to_pylist())
        if not rows.num_rows:
            return _rows([4] * k4, [None] * k4, kept_out[0], [None] * k4, [None] * k4, [None] * k4, kept_out[1], [None] * k4)
        blocks, docs = rows["block"].to_pylist(), rows["docs"].to_pylist()
        get = lambda x, kind: unpack(x.as_py(), kind).astype(np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for *lists, of_context, of_word, doc, times in zip(*(rows[c] for c in ("contexts", "bases", "words", "counts", "context", "word", "doc", "times")), strict=True):
            heads, bases, kinds_, counts = (get(x, "<u8") for x in lists)
            of_context, of_word = np.cumsum(get(of_context, "<u4")), get(of_word, "<u4")
            for part, x in zip(parts, (heads[of_context], kinds_[of_word], counts[of_word], bases[of_context], get(doc, "<u4"), get(times, "<u4")), strict=True):
                part.append(x)
        cuts = np.cumsum([0, *map(len, parts[0])])
        context, word, count, base, doc, times = (np.concatenate(p) for p in parts)
        held, doc = (doc & 1).astype(bool), doc >> 1
        order = np.lexsort((word, context))
        new = np.append(True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1]))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        first = order[new]  # an entry of each pair, in order of context
        got = np.bincount(pair, weights=np.where(held, 0, times), minlength=len(first)).astype(np.int64)
        few = np.bincount(got[got <= _RARE + 1], minlength=_RARE + 2)[1:]
        heads = np.flatnonzero(np.append(True, context[first][1:] != context[first][:-1]))
        group = np.cumsum(np.append(True, context[first][1:] != context[first][:-1])) - 1  # the context of each pair
        size = base[first][heads]
        add = lambda x: np.add.reduceat(x, heads)
        rare = add(((got > 0) & (got <= _RARE)).astype(np.int64)) > 0
        below = size + ((size <= hot) & ~rare)  # one more where nothing would be left for unseen words; of spread contexts, later
        chance = unigrams.chance(count)
        seen, n = got[pair] > 0, got[pair]
        with np.errstate(divide="ignore"):
            value = np.where(seen, np.log10(np.maximum(n, 1) / np.maximum(below[group[pair]], 1)), np.log10(chance))
        sums = []
        for a, z, d in zip(cuts, cuts[1:], docs, strict=False):
            s, t = doc[a:z], times[a:z]
            own = [t * value[a:z], *(t * (n[a:z] == r) for r in range(1, _RARE + 1))]
            sums.append(pack(np.concatenate([np.bincount(s, weights=x, minlength=d) for x in own]).astype("<f8")))
        away = ~seen & (base > 0)
        wanted = np.zeros(len(heads), bool)
        wanted[group[pair[away]]] = True
        wanted |= size > hot
        kept = [add(np.where(got > _RARE, got, 0)), *(add(np.where(got == r, got, 0)) for r in range(1, _RARE + 1)), add(np.where(got > 0, chance[first], 0.0)), size, rare]
        kept = np.stack(kept, 1)[wanted].astype(float)
        late = seen & ((size > hot) & ~rare)[group[pair]]
        gone = np.concatenate((np.flatnonzero(away), np.flatnonzero(late)))
        which = np.searchsorted(cuts, gone, "right") - 1
        k1, k2, k3 = len(blocks), int(wanted.sum()), len(gone)
        kind = [0] + [1] * k1 + [2] * k2 + [3] * int(away.sum()) + [5] * int(late.sum())
        key = [None] * (1 + k1) + context[first][heads][wanted].tolist() + context[gone].tolist()
        of = [None, *blocks, *[None] * k2, *np.array(blocks)[which].tolist()]
        where = [None] * (1 + k1 + k2) + doc[gone].tolist()
        amount = [None] * (1 + k1 + k2) + times[gone].tolist()
        none = [None] * k4
        return _rows(kind + [4] * k4, key + none, of + kept_out[0], where + none, amount + none, [None] * (1 + k1) + kept.tolist() + [None] * (k3 + k4), [None, *sums, *[None] * (k2 + k3), *kept_out[1]], [few.tolist(), *[None] * (k1 + k2 + k3 + k4)])

    answers = words.where("kind = 1").select("bucket", "block", "ids", "counts")
    blocks = corpus.select("block", "held", "sizes", "order", "begin", "places")
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, "bucket int, block long, docs long, contexts binary, bases binary, words binary, counts binary, context binary, word binary, doc binary, times binary, base binary")
    return save(sent.groupBy("bucket").applyInArrow(evaluate, "kind int, context long, block long, doc long, times long, kept array<double>, sums binary, few array<long>"), "pairs")


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents whose crc32(doc_id as text) mod 10 is not 0, scores all. Tokens are words, with A-Z as a-z, and one
    end a text, so a null or empty text has one token. base_score adds log10 of add-0.1 unigram chances. score is the
    text's log10 probability under a Katz backoff model of bigrams: a word after its context (or the beginning) that
    training has seen gets its Good-Turing discounted share of the context's count; another gets the context's backoff weight
    times its discounted unigram chance, and an unknown word what unigrams leave over. Backoff weights make each
    context's chances sum to one exactly; a context without rare followers is counted once more so that something is
    left. Without training texts, every word has the chance 1. Repeated rows count each; very long texts are read whole, in
    chunks; an empty table gives no rows; other columns are not read.

    Words and bigrams are counted in tables partitioned by word and by context; blocks of about a million tokens
    exchange with them at most one row each, or one an entry where there are more buckets than entries. Bigram counts
    and evaluation meet in one pass: discounts enter by how many tokens of a text have counts of 1 to 5.
    """
    corpus = encode_corpus(docs)
    n = corpus.agg(F.sum("tokens"), F.sum("train_docs"), F.sum("train_tokens")).first()
    tokens, train_docs, total = (int(x or 0) for x in n)
    buckets = max(16, math.ceil(tokens / _BUCKET_TOKENS))
    words = count_words(corpus, buckets)
    sums = lambda rows: [int(x or 0) for x in rows.agg(*(F.sum(F.col("few")[r]) for r in range(_RARE + 1))).first()]
    stats = words.where("kind = 0")
    kinds = int(stats.agg(F.sum("kinds")).first()[0] or 0)
    rows = score_pairs(corpus, words, Unigrams(total, kinds, sums(stats)), train_docs, buckets)
    cuts = discounts(sums(rows.where("kind = 0")))

    def gather(parts: pa.Table) -> pa.Table:
        """Of one block: the buckets' sums, in an order of their own so that reruns agree."""
        own = pc.equal(parts["kind"], 4)
        base, known, tokens = unpack(parts.filter(own)["sums"][0].as_py(), "<f8").reshape(3, -1)
        all_ = np.sort(np.stack([unpack(x.as_py(), "<f8") for x in parts.filter(pc.invert(own))["sums"]]), axis=0).sum(0).reshape(_RARE + 1, -1)
        score = all_[0] + np.log10(cuts) @ all_[1:]
        k = len(base)
        return pa.table({"block": pa.array([parts["block"][0].as_py()] * k, pa.int64()), "doc": pa.array(np.arange(k)), "sum": pa.array(score), "base_score": pa.array(base), "n_known": pa.array(known.astype(np.int64)), "n_tokens": pa.array(tokens.astype(np.int64))})

    found = rows.where("kind IN (1, 4)").select("kind", "block", "sums").groupBy("block").applyInArrow(gather, "block long, doc long, sum double, base_score double, n_known long, n_tokens long")
    contexts = rows.where("kind = 2").groupBy("context").agg(*(F.sum(F.col("kept")[k]).alias(f"k{k}") for k in range(_RARE + 2)), (F.max(F.col("kept")[_RARE + 2]) + 1 - F.max(F.col("kept")[_RARE + 3])).alias("below"), (F.max(F.col("kept")[_RARE + 3]) == 0).alias("more"))
    kept = F.col("k0") + sum((cuts[r - 1] * F.col(f"k{r}") for r in range(1, _RARE + 1)), F.lit(0.0))
    weight = F.log10((1 - kept / F.col("below")) / (1 - F.col(f"k{_RARE + 1}")))
    away = rows.where("kind IN (3, 5)").select("kind", "context", "block", "doc", "times").join(contexts.select("context", weight.alias("weight"), F.when(F.col("more"), F.log10((F.col("below") - 1) / F.col("below"))).otherwise(0.0).alias("late")), "context")
    away = away.withColumn("weight", F.when(F.col("kind") == 3, F.col("weight")).otherwise(F.col("late")))
    away = away.groupBy("block", "doc").agg(F.sum(F.round(F.col("times") * F.col("weight"), 12).cast("decimal(30,12)")).cast("double").alias("away"))
    names = corpus.select("block", F.posexplode(F.arrays_zip("doc_ids", "held")).alias("doc", "x"))
    out = names.join(found, ["block", "doc"]).join(away, ["block", "doc"], "left")
    return out.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.round("base_score", 9).alias("base_score"), F.round(F.col("sum") + F.coalesce("away", F.lit(0.0)), 9).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
