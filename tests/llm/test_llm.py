"""The operators of the subpackage against brute force, round trips and held-out accuracy; odd rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strandmill.llm import common, exact_dedup, language, language_model, mixing, near_dedup, neighbours, personal, resample, token_files, tokenize

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = "word and other " * 20_000
ODD = [
    (1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, "x"), (3, " \t\n", "en", None, 3, None), (4, LONG, "en", "b", len(LONG), "y"), (5, "same text here now and then", "en", "b", 1, "y"),
    (6, "same text here now and then", "en", "b", 1, "y"), (7, "same  text here now and then", "de", None, 1, "y"), (7, "same  text here now and then", "de", None, 1, "y"), (8, "1234 5678 !!", None, "c", 2, "z"), (9, "é😀 +1 (829) 555-4386. a@b.c_d@e.f 1.2.3.4", "fr", "c", 2, "z"), (None, "no id at all but text", "en", "c", 1, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").cache()


ALL = [
    personal.find_personal_data, tokenize.encode_corpus, near_dedup.near_groups, lambda d: language.identify(d, language.fit(d)),
    lambda d: token_files.read_images(token_files.write_images(d, P.path("byte_bpe_50k.json"), 2)), mixing.mix_sources, exact_dedup.exact_groups,
    lambda d: resample.resample(d, d.sparkSession.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")), language_model.score_texts,
]


@pytest.mark.parametrize("k", range(len(ALL)))
def test_odd_rows_and_empty_tables(odd, empty, k):
    got = ALL[k](odd)
    assert got.count() == len(ODD) and sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == sorted(str(r[0]) for r in ODD)
    assert ALL[k](empty).count() == 0


#: Names that operators use inside; docs may have them too.
CLASHES = ("lid_rejected", "lid_text", "c0", "mix_id", "times", "mixed_id", "key0", "key1", "rep", "best", "content", "k1")


def test_stages_on_odd_rows_clashing_names_and_empty_tables(spark, odd, empty):
    """Every stage by itself and the chain of all, on odd rows with clashing names: columns stay, rows are some of those given."""
    def wide(d):
        for c in CLASHES:
            d = d.withColumn(c, F.lit(c))
        return d

    every, text = wide(odd), lambda r: (str(r["doc_id"]), r["text"])
    given = {text(r) for r in every.collect()}
    chain = every
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (every, chain):
            out = stage(spark, d, SF)
            rows = out.collect()
            assert out.columns == every.columns and {text(r) for r in rows} <= given and all(r[c] == c for r in rows for c in CLASHES), name
        assert stage(spark, wide(empty), SF).count() == 0, name
        chain = common.save(out, name)
    kept = {text(r) for r in corpus_pipeline.STAGES[1][1](spark, every, SF).collect()}
    assert kept == {("1", None), ("4", LONG), ("7", "same  text here now and then"), ("8", "1234 5678 !!"), ("9", ODD[9][1]), ("None", "no id at all but text")} or kept == (kept - {("1", None)}) | {("3", " \t\n")}
    assert corpus_pipeline.STAGES[-1][1](spark, wide(empty), SF).count() == 0 and chain.count() > 0


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://some:7077"

        def getCheckpointDir(self):
            return None

    session = type("Session", (), {"sparkContext": Context()})()
    with pytest.raises(ValueError):
        common.shared_dir(session)


def test_word_and_shingle_hashes():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "Ab  c", "x" * 700_000 + " y"]
    h, starts = common.word_hashes(pa.array(texts), fold=True)
    assert np.diff(starts).tolist() == [6, 0, 0, 2, 2]
    assert common.word_hashes(pa.array(["aB c"]), fold=True)[0].tolist() == common.word_hashes(pa.array(["ab c"]))[0].tolist()
    s, out = common.shingle_hashes(h, starts, 5)
    assert np.diff(out).tolist() == [2, 0, 0, 1, 1] and len(set(s.tolist())) == 4


# --- personal data ---------------------------------------------------------------------------------------------------


def base_spans(text):
    found = []
    for i, (kind, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                found.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(found))


def test_personal_data_base_spans(spark, docs, odd):
    d = docs.select("doc_id", "text").union(odd.where("doc_id IS NOT NULL").select(F.col("doc_id") + 10**6, "text"))
    got = {r["doc_id"]: r["s"] for r in personal.find_personal_data(d).select("doc_id", personal.listed(F.col("base")).alias("s")).collect()}
    for r in d.collect():
        assert got[r["doc_id"]] == base_spans(r["text"] or "")


def test_personal_data_added_spans(spark):
    rows = [(1, "john [at] mail (dot) com call (555) 123-4567 now, email bob@x.org")] + [(k, f"mail me at u{k}@x.com or +1 (829) 555-{4000 + k}") for k in range(2, 30)]
    got = personal.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").first()
    assert {(s["kind"], s["start"]) for s in got["added"]} == {(0, 0), (3, 30)}
    assert [(s["kind"], s["start"]) for s in got["base"]] == [(0, 56)]


def test_prefixes_and_spans_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 99, n).tolist()) for k, n in enumerate((0, 1, 255, 256, 257, 1000))]
    d = spark.createDataFrame(rows, "k int, x array<bigint>").select("k", personal.prefixes(F.col("x"), lambda a, v: a + v, F.lit(0).cast("long")).alias("p"))
    assert {r["k"]: r["p"] for r in d.collect()} == {k: (np.cumsum(x) - x).tolist() if x else [] for k, x in rows}
    span = lambda n: [(int(kind), int(a), int(a + w), "h", "h") for kind, a, w in zip(rng.integers(0, 4, n), rng.integers(0, 400, n), rng.integers(1, 12, n), strict=True)]
    rows = [(k, span(int(rng.integers(0, 40))), span(int(rng.integers(0, 25)))) for k in range(60)]
    kind = "array<struct<kind:int,start:bigint,end:bigint,hit:string,around:string>>"
    for r in spark.createDataFrame(rows, f"k int, a {kind}, b {kind}").select("a", "b", personal.apart(F.col("a"), F.col("b")).alias("c")).collect():
        want = [s for s in r["a"] if not any(t["start"] < s["end"] and s["start"] < t["end"] for t in r["b"])]
        assert sorted(map(tuple, r["c"])) == sorted(map(tuple, want))


def test_personal_data_of_a_text_full_of_addresses(spark):
    text = " ".join(f"u{k}@x.com 10.0.{k % 256}.1 ({k % 900 + 100}) 555-{k % 9000 + 1000}" for k in range(30_000))
    got = personal.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), personal.listed(F.col("base")).alias("s")).first()
    assert got["n"] == 60_000 and got["s"] == base_spans(text)


def test_reliabilities_prefer_agreeing_labelers():
    p = personal.reliabilities({(0, "112212"): 50, (0, "002202"): 20, (0, "102222"): 3})
    assert p[0, "112212"] > 0.9 > 0.5 > p[0, "002202"]


# --- tokens ----------------------------------------------------------------------------------------------------------


def test_byte_pairs_equal_the_library(docs, odd):
    ranks = tokenize.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = docs.select("doc_id", "text").union(odd.where("doc_id IS NOT NULL").select(F.col("doc_id") + 10**6, "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for r in tokenize.encode_corpus(d, ids=True).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["ids"], r["n_tokens"], r["ids_sha256"]) == (ids, len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_byte_pairs_of_hard_pieces():
    ranks = tokenize.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, rng = tokenize.TextEncoder(ranks, P.PATTERN), np.random.default_rng(5)
    tokens = [t.decode("utf-8", "ignore") for t in ranks]
    for k in range(3000):
        t = "".join(rng.choice(tokens, rng.integers(0, 8))) if k % 2 else "".join(rng.choice(list(" \n\tab.é1  \0"), rng.integers(0, 14)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode_ordinary(t), t


def test_direct_codes_round_trip():
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 2 ** rng.integers(1, 31), n) for n in (0, 1, 700, 5000)]
    codes = token_files.DirectCodes(token_files.DirectCodes.build([4, 5, 6, 7], ids))
    flat = np.concatenate(ids)
    assert len(codes) == len(flat) and codes.doc_ids.tolist() == [4, 5, 6, 7]
    assert all(codes[int(k)] == flat[k] for k in rng.integers(0, len(flat), 300))
    for k, x in enumerate(ids):
        assert codes.document(k).tolist() == x.tolist()


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    images = token_files.write_images(docs, P.path("byte_bpe_50k.json"), 2, image_ids=20_000)
    got = token_files.read_images(images).orderBy("doc_id").collect()
    for r, want in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(want["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_each_image_is_a_row_group(spark, docs):
    images = token_files.write_images(docs, P.path("byte_bpe_50k.json"), 2, image_ids=300)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in images.inputFiles()]
    n = images.count()
    assert n > 100 and sum(f.metadata.num_row_groups for f in files) == n and all(f.metadata.row_group(k).num_rows == 1 for f in files for k in range(f.metadata.num_row_groups))


def test_single_tokens_are_read_by_place(spark, docs):
    images = token_files.write_images(docs, P.path("byte_bpe_50k.json"), 2, image_ids=20_000)
    flat = np.concatenate([token_files.DirectCodes(bytes(r["image"])).read(0, r["n_ids"]) for r in images.orderBy("shard", "part").collect()])
    places = [0, 1, 19_999, 20_000, 77_777, len(flat) - 1, len(flat), -1]
    got = {r["place"]: r["id"] for r in token_files.tokens_at(images, spark.createDataFrame([(p,) for p in [*places, 0]], "place long")).collect()}
    assert got == {p: flat[p] for p in places[:-2]}


def test_library_encoder_on_hard_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    vocabulary = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    t, e, rng = Tokenizer.from_str(vocabulary), token_files.LibraryEncoder(vocabulary), np.random.default_rng(5)
    e.AT_ONCE = 60  # texts are cut
    e.units.most = 40  # and the table is emptied now and then
    bits = ["a", "b'", "  ", " ", "\n", "\t", "é", "中", "<|endoftext|>", "<|end", "'s", " 't", "1", "!!", "\x1c", "\x85", "\0", "A1", "\u3000"]
    for _ in range(4):
        texts = ["".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(500)]
        ids, sizes = e.encode(pa.array(texts, pa.large_string()))
        ends = np.cumsum(sizes)
        for text, a, z in zip(texts, ends - sizes, ends, strict=True):
            assert ids[a:z].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_library_encoder_sends_each_part_once(monkeypatch):
    """A word is the same part before any mark or line end, so what goes to the library grows with words, not with what they meet."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    vocabulary = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    t, e, rng = Tokenizer.from_str(vocabulary), token_files.LibraryEncoder(vocabulary), np.random.default_rng(5)
    words = ["".join(rng.choice(["an", "ther", "\u00e9", "ou", "Tion", "wh"], rng.integers(3, 7))) for _ in range(300)]
    ends = [" ", ", ", ".\n", "\n", "!! ", "'s ", "*** ", ".) "]
    made = lambda words, ends: ["".join(rng.choice(words) + rng.choice(ends) for _ in range(400)) for _ in range(50)]
    sent, fresh, texts = [], e._fresh, made(words, ends)
    monkeypatch.setattr(e, "_fresh", lambda x: sent.extend(x) or fresh(x))
    e.encode(pa.array(texts, pa.large_string()))
    assert sum(map(len, sent)) < 4 * sum(map(len, words))
    texts += made([*words, "\u4e2d", "s", "ll", "7"], [*ends, "'", ".", "1 ", "\n\n", "\u00a0", "  "]) + ["", " ", "\n", "a\0 b.\0c"]
    ids, sizes = e.encode(pa.array(texts, pa.large_string()))
    for text, a, z in zip(texts, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        assert ids[a:z].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files_map_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    texts = [f(x) for x in added for f in (lambda x: x, lambda x: f"end {x} of text", lambda x: f"a{x}{x} b", lambda x: f"near {x[:-1]} miss {x}\n\n x")]
    rows = [*enumerate(["plain text first", *texts, "plain text last"])]
    got = token_files.read_images(token_files.write_images(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json"), 2)).orderBy("doc_id").collect()
    at = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)
    assert added


# --- duplicates ------------------------------------------------------------------------------------------------------


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = exact_dedup.CuckooIndex(buckets=2, kicks=8), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, x in enumerate(keys):
        assert index.find(x) is None
        index.insert(x, k)
    assert all(index.find(x)[1] == k for k, x in enumerate(keys)) and index.buckets > 2
    assert all(index.delete(x) for x in keys[::2]) and not index.delete(keys[0])
    assert [index.find(x) is None for x in keys] == [k % 2 == 0 for k in range(3000)] and index.size == 1500


def test_exact_groups_equal_brute_force(docs):
    groups: dict = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
    want = {i: (min(g)[1], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for _, i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == want


def test_dropping_copies_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other text"), (2, "other  text"), (2, "a\tb"), (None, "no id"), (None, "no id"), (None, "a b"), (3, None), (3, "")]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), re.sub(r"\s", "", r["text"] or "")) for r in got) == [("1", "ab"), ("2", "othertext"), ("3", ""), ("None", "noid")]


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts):
    bags, parent = {i: bag(t or "") for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = bags[i], bags[j]
            if a and b and (both := sum((a & b).values())) / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_groups_equal_brute_force(spark, docs):
    rng, base = np.random.default_rng(8), [f"w{k}" for k in range(120)]
    near = []
    for k in range(40):  # a group of near copies, some of them repeated words
        w = list(base)
        w[int(rng.integers(120))] = f"z{k}"
        near.append((10**6 + k, " ".join(w + base[: k % 3])))
    d = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(d).collect()}
    assert got == brute_classes({r["doc_id"]: r["text"] for r in d.collect()})


def test_near_groups_by_shuffle_equal_those_by_broadcast(spark, docs, odd, monkeypatch):
    d = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10**6, "text"))
    key = lambda x: sorted((str(r["doc_id"]), *map(str, r[1:])) for r in x.collect())
    want = key(near_dedup.near_groups(d))
    monkeypatch.setattr(near_dedup, "_SMALL", 0)
    assert key(near_dedup.near_groups(d)) == want


def test_near_groups_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    for rows, want in (([(1, a), (1, b), (2, a + " x"), (3, b + " y")], [1, 1, 1, 1]), ([(1, a), (2, b), (2, a)], [1, 1, 2]), ([(None, a), (4, a + " x"), (None, b), (None, None), (6, "")], [None, None, 4, 4, 6])):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = [r["class_id"] for r in near_dedup.near_groups(d).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        left = [(str(r["doc_id"]), r["text"]) for r in near_dedup.drop_near_copies(d.union(d)).collect() if (r["text"] or "").strip()]
        assert sorted(left) == {4: [("1", a), ("1", b)], 3: [("1", a), ("2", b)], 5: [("4", a + " x"), ("None", b)]}[len(rows)]


def test_near_groups_of_half_changed_copies(spark):
    """Groups whose members are near some of the others only: what hubs and leaders leave open goes through the prefix filter."""
    rng, rows = np.random.default_rng(21), []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(130)]
        for c in range(12):  # each variant of the base has near copies of its own
            one = [w if rng.random() > 0.05 else f"g{g}c{c}x{k}" for k, w in enumerate(base)]
            for m in range(8):
                w = list(one)
                for _ in range(int(rng.integers(0, 5))):
                    w[int(rng.integers(len(w)))] = f"m{rng.integers(1 << 40)}"
                rows.append((len(rows), " ".join(w[: len(w) - int(rng.integers(0, 12))] + w[:3] * int(rng.integers(0, 2)))))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(dict(rows))
    assert got == want and 20 < len(set(want.values())) < 200


def test_prefix_pairs_leave_out_no_pair(spark):
    rng, texts = np.random.default_rng(22), []
    for k in range(120):
        base = texts[int(rng.integers(len(texts)))].split() if texts and rng.random() < 0.7 else [f"v{x}" for x in rng.integers(0, 40, int(rng.integers(8, 60)))]
        base = [w if rng.random() > 0.03 else f"n{rng.integers(1 << 30)}" for w in base]
        texts.append(" ".join(base + base[: int(rng.integers(0, 6))]))
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = near_dedup.bags(d, 2)
    grams = [Counter(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    label = [k % 5 for k in range(120)]
    members = spark.createDataFrame([(k, label[k], sum(grams[k].values())) for k in range(120)], "id long, label long, words long")
    able = near_dedup.narrowed(near_dedup.prefix_rows(members, held, 0.8), 0.8)
    found = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(able, 0.8).collect()}
    want = {(a, b) for b in range(120) for a in range(b) if label[a] != label[b] and (o := sum((grams[a] & grams[b]).values())) >= 0.8 * (sum(grams[a].values()) + sum(grams[b].values()) - o)}
    assert want <= found and len(want) > 20 and len(found) < 120 * 119 / 4
    assert {(r["a"], r["b"]) for r in near_dedup.verify(near_dedup.prefix_pairs(able, 0.8), held, 0.8).collect()} == want
    hubs = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(able, 0.8, hubs_only=True).collect()}
    assert {tuple(sorted(p)) for p in hubs} <= found and len(hubs) <= able.count()


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(9)
    a = dict(enumerate(rng.integers(1, 20, 300).tolist()))
    b = {k: v for k, v in enumerate(rng.integers(1, 20, 330).tolist()) if k > 30}
    j = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    sig = [near_dedup.bag_minhash(common.mix(np.array(sorted(c), np.uint64)), np.array([c[k] for k in sorted(c)]), np.array([0, len(c)]), 8192)[0] for c in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - j) < 0.025


# --- learned operators -----------------------------------------------------------------------------------------------


def test_language_accuracy_held_out(spark, docs):
    d = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(d, language.fit(d)).join(d, "doc_id").where(common.held_out(5)).select("lang", "lid_lang", "lid_rejected").collect()
    assert np.mean([r["lang"] == r["lid_lang"] for r in got]) > 0.97 and np.mean([r["lid_rejected"] for r in got]) < 0.01


def test_language_equals_brute_force(spark, docs):
    """Features, frequencies and the nearest centroid again, from the centroids that were fitted."""
    d = docs.where("doc_id < 400")
    model = language.fit(d, per_language=10**6)
    known = [r["text"] for r in d.where(~common.held_out(5) & F.col("lang").isNotNull() & language.has_letter()).collect()]

    def grams(text):
        b = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode() if (text or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        one, two, three = list(b), [x * 257 + y for x, y in zip(b, b[1:], strict=False)], [(x * 257 + y) * 257 + z for x, y, z in zip(b, b[1:], b[2:], strict=False)]
        n = Counter([x * 40503 >> 4 & 4095 for x in one] + [x * 2654435761 >> 9 & 4095 for x in two] + [x * 2654435761 >> 11 & 4095 for x in three])
        v = np.zeros(4096)
        v[list(n)] = 1 + np.log(list(n.values()))
        return v

    seen = sum((grams(t) > 0).astype(int) for t in known)
    idf = np.log((1 + len(known)) / (1 + seen)) + 1
    assert np.allclose(model.idf, idf, atol=1e-5)
    for r in language.identify(d, model).join(d.select("doc_id", "text"), "doc_id").collect():
        v = grams(r["text"]) * idf
        cos = model.centers @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(cos.argmax())
        if any(c.isalpha() for c in r["text"] or ""):
            assert abs(r["lid_score"] - min(max(cos[best], 0), 1)) < 1e-4 and (r["lid_lang"] == model.langs[best] or np.sort(cos)[-1] - np.sort(cos)[-2] < 1e-5)
            assert r["lid_rejected"] == (cos[best] < model.least[best]) or abs(cos[best] - model.least[best]) < 1e-4
        else:
            assert (r["lid_lang"], r["lid_score"], r["lid_rejected"]) == ("und", 0, True)


def test_permutations_are_keyed_and_one_to_one(spark):
    for n in (1, 2, 3, 64, 100, 1000):
        d = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1), F.lit("a")).alias("a"), mixing.permuted(F.col("id"), F.lit(n), F.lit(1), F.lit("b")).alias("b")).collect()
        one, two = [r["a"] for r in d], [r["b"] for r in d]
        assert sorted(one) == sorted(two) == list(range(n))
        if n >= 64:
            assert one != two and len(Counter((y - x) % n for x, y in zip(one, one[1:], strict=False))) > n // 3  # no fixed stride


def test_mix_does_not_depend_on_lanes(docs):
    one, two = ({(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs, lane_rows=k).collect()} for k in (3, 20_000))
    assert one == two


def test_drawn_documents_follow_their_line(docs):
    """Whole copies are kept, fractions go up or down, and along each source's line the count is never off by a document."""
    mix, drawn = mixing.mix_sources(docs).collect(), Counter(r["doc_id"] for r in mixing.draw_documents(docs).collect())
    assert drawn == Counter(r["doc_id"] for r in mixing.draw_documents(docs, lane_rows=7).collect())
    by: dict = {}
    for r in sorted(mix, key=lambda r: (r["from"], r["doc_id"], r["size"])):
        share = r["taken"] / r["size"] if r["size"] else 0
        assert math.floor(share) <= drawn[r["doc_id"]] <= math.ceil(share)
        s = by.setdefault(r["source"], [0.0, 0, 0.0])
        s[0], s[1] = s[0] + share, s[1] + drawn[r["doc_id"]]
        assert abs(s[0] - s[1]) < 1 + 1e-6
    words = {r["source"]: r["words"] for r in mixing.draw_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words")).collect()}
    target = {r["source"]: r["target"] for r in mix}
    assert abs(sum(words.values()) - sum(target.values())) < 0.02 * sum(target.values())


def test_drawn_documents_lie_in_order_of_shard_and_place(spark, docs):
    first = {r["doc_id"]: min((p["shard"], p["place"]) for p in r["pieces"]) for r in mixing.mix_sources(docs).collect() if r["pieces"]}
    rows = mixing.draw_documents(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    spots = [first[r["doc_id"]] for r in sorted(rows, key=lambda r: r["p"])]
    assert spots == sorted(spots) and len({s for s, _ in spots}) > 20


def test_mix_meets_targets(docs):
    got = mixing.mix_sources(docs).collect()
    by: dict = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == sum(p["to_word"] - p["from_word"] for p in r["pieces"])
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2], s[3] = s[2] + r["taken"], s[3] + r["size"]
    weights, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}, 1.5 * sum(s[0] for s in by.values())
    full: dict = {}
    while over := [s for s in weights if s not in full and left * weights[s] / sum(w for x, w in weights.items() if x not in full) > 2 * by[s][0]]:
        for s in over:
            full[s] = 2 * by[s][0]
        left = 1.5 * sum(s[0] for s in by.values()) - sum(full.values())
    for s, (size, target, taken, total) in by.items():
        want = full.get(s, left * weights[s] / max(1, sum(w for x, w in weights.items() if x not in full)))
        assert size == total and abs(target - want) < 1e-6 * max(1, want) and abs(taken - target) < 8
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_splitting_tree_is_exact(spark):
    quotas = [(0, 700), (1, 3), (2, 0), (3, 41)]
    edges = {r["k"]: r["edges"] for r in mixing.splitting_tree(spark.createDataFrame(quotas, "k int, quota long"), 3, 1).collect()}
    assert {k: e[-1] for k, e in edges.items()} == dict(quotas)
    sizes = [sum(e[s + 1] - e[s] for e in edges.values()) for s in range(8)]
    assert sum(sizes) == 744 and max(sizes) - min(sizes) <= 3


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=600).toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 20)) and (got.groupby("query_id").size() == 20).all()
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(g["vec_id"]) & set(np.argsort(-s)[:20])))
        assert np.allclose(g.sort_values("rank")["score"], s[g.sort_values("rank")["vec_id"]])
    assert np.mean(hits) / 20 >= 0.9


@pytest.mark.parametrize("norms", ["spread", "outlying", "equal"])
def test_neighbours_recall_in_a_whole_block(spark, norms):
    rng, n = np.random.default_rng(12), 8192
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= rng.lognormal(0, 0.5, (n, 1))
    elif norms == "outlying":
        x[::1000] *= 20
    got = neighbours.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), every=80).toPandas()
    hits = []
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(g["vec_id"]) & set(np.argsort(-s)[:20])))
    assert len(hits) == 103 and np.mean(hits) / 20 >= 0.99


def test_neighbours_on_given_vectors(spark):
    v = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect() if r["embedding"] is not None}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    for block in (8192, 700):  # one block and several
        got = neighbours.nearest(v, block=block).toPandas()
        hits = [len(set(g["vec_id"]) & set(ids[[k for k in np.lexsort((ids, -(x @ rows[q]))) if ids[k] != q][:20]])) for q, g in got.groupby("query_id")]
        assert np.mean(hits) / 20 >= 0.9 and min(hits) >= 10


def test_neighbours_of_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [3.0, 0.0]), (20, [0.5]), (7, [2.0, 1.0]), (None, [9.0, 9.0]), (21, [0.0, 1.0]), (40, [0.25])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 40, 0.125), (40, 1, 20, 0.125)]  # the shortest vector asks, of vectors as long
    got = neighbours.nearest(spark.createDataFrame(rows[:3] + rows[4:5], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 20, 3.0), (20, 2, 7, 2.0), (20, 3, 20, 1.0)]


def test_neighbours_of_an_empty_table_and_of_unfit_vectors(spark):
    schema = "vec_id long, embedding array<double>, score double, rank string"
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    unfit = [(0, None, 1.0, "x"), (20, [], 1.0, "x"), (40, [0.0, 0.0], 1.0, "x"), (60, [1.0, None], 1.0, "x"), (80, [1.0, float("inf")], 1.0, "x"), (None, [1.0, 1.0], 1.0, "x")]
    assert neighbours.nearest(spark.createDataFrame(unfit, schema)).count() == 0
    fit = [(100, [1.0, 0.0], 1.0, "x"), (101, [2.0, 0.0], 1.0, "x"), (102, [2.0, 5.0], 1.0, "x"), (103, [1.0], 1.0, "x")]
    assert [tuple(r) for r in neighbours.nearest(spark.createDataFrame(unfit + fit, schema)).orderBy("rank").collect()] == [(100, 1, 101, 2.0), (100, 2, 102, 2.0)]


def test_neighbours_of_few_vectors(spark):
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]


def test_resample_separates_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = resample.query(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("quality IS NOT NULL").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()
    share = {r["quality"]: r["s"] for r in got}
    assert share[1] > 0.95 and share[0] < 0.5


def test_resample_equals_brute_force(spark, docs):
    """Weights again from counted buckets, keys from their hash, and the selection from sorted keys."""
    import pyarrow as pa

    d = docs.where("doc_id < 60")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 60, 2)], "doc_id long, quality int")
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    fold = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    word = {}
    bucket = lambda g: word.setdefault(g, int(resample.grams(pa.array([" ".join(g)]))[0][-1]))  # noqa: E731  of a text of one gram, the last
    grams = {i: [g for k, w in enumerate(fold(t)) for g in [(w,)]] + list(zip(fold(t), fold(t)[1:], strict=False)) for i, t in texts.items()}
    raw, aimed = Counter(bucket(g) for gs in grams.values() for g in gs), Counter(bucket(g) for i, gs in grams.items() if i % 6 == 0 for g in gs)
    size = resample.BUCKETS
    of_aimed, of_raw = sum(aimed.values()) + size, sum(raw.values()) + size
    ratio = lambda b: math.log((aimed[b] + 1) / of_aimed) - math.log((raw[b] + 1) / of_raw)
    got = {r["doc_id"]: r for r in resample.resample(d, labels).collect()}
    for i, gs in grams.items():
        assert got[i]["n_grams"] == len(gs) and abs(got[i]["log_weight"] - sum(ratio(bucket(g)) for g in gs)) < 1e-4
    keys = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    k = round(len(got) * labels.agg(F.avg("quality")).first()[0])
    assert {i for i, r in got.items() if r["selected"]} == {i for i, r in got.items() if r["gumbel_key"] >= keys[k - 1]}


def test_kth_largest(spark):
    d = spark.range(1000).select((F.pmod(F.col("id") * 37, F.lit(500))).cast("double").alias("x"))
    want = sorted((r["x"] for r in d.collect()), reverse=True)
    assert [resample.kth_largest(d, "x", k, at_once=100) for k in (1, 2, 333, 1000)] == [want[k - 1] for k in (1, 2, 333, 1000)] and resample.kth_largest(d, "x", 1001) is None


def katz(toks, held):
    """A Katz bigram model in plain Python: (chance of a word, chance of a word after a context, words)."""
    one, two = Counter(), {}
    for i, t in toks.items():
        if not held[i]:
            one.update(t)
            for a, b in zip(["<s>", *t], t, strict=False):
                two.setdefault(a, Counter())[b] += 1
    total = sum(one.values())

    def cuts(counts):
        n = [0, *(sum(v == r for v in counts) for r in range(1, 7))]
        if n[1] and 6 * n[6] / n[1] < 1:
            k = 6 * n[6] / n[1]
            d = [((r + 1) * n[r + 1] / n[r] / r - k) / (1 - k) if n[r] else (1 - k) / (1 - k) for r in range(1, 6)]
            if all(0 < x < 1 for x in d):
                return d
        c = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [(r - c) / r for r in range(1, 6)]

    d1 = cuts(list(one.values()))
    share = lambda v, d: d[v - 1] * v if v <= 5 else v
    rare = any(v <= 5 for v in one.values())
    p1 = {w: (share(v, d1) if rare else v) / (total + (not rare)) for w, v in one.items()}
    left = 1 - sum(p1.values())
    d2 = cuts([v for c in two.values() for v in c.values()])
    after = {}
    for h, f in two.items():
        size = sum(f.values()) + all(v > 5 for v in f.values())
        seen = {w: share(v, d2) / size for w, v in f.items()}
        after[h] = seen, (1 - sum(seen.values())) / (1 - sum(p1[w] for w in f))
    word = lambda w: p1.get(w, left)

    def next_word(h, w):
        if h not in after:
            return word(w)
        seen, back = after[h]
        return seen.get(w) or back * word(w)

    return word, next_word, one


def tokens_of(d):
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    toks = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", low(r["text"])), "</s>"] for r in d.collect()}
    return toks, {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}


#: Contexts that only frequent words follow, some of them long enough to be spread over keys.
FIXED = [(10**6, None), (10**6 + 1, "A a a a b"), *((2 * 10**6 + k, "zig zag " * 40) for k in range(40)), *((3 * 10**6 + k, "hum hem " * 9) for k in range(3))]


@pytest.mark.parametrize("tokens", [1_000_000, 3_000])
def test_language_model_equals_brute_force(spark, docs, monkeypatch, tokens):
    monkeypatch.setattr(language_model, "_BUCKET_TOKENS", tokens)
    d = docs.select("doc_id", "text").union(spark.createDataFrame(FIXED, "doc_id long, text string"))
    toks, held = tokens_of(d)
    word, next_word, one = katz(toks, held)
    n, kinds = sum(one.values()), len(one)
    for h in ("zig", "the", "<s>"):
        assert abs(sum(next_word(h, w) for w in one) + next_word(h, "never seen") - 1) < 1e-6
    for r in language_model.score_texts(d).collect():
        t = toks[r["doc_id"]]
        want = sum(math.log10(next_word(a, w)) for a, w in zip(["<s>", *t], t, strict=False))
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in one for w in t), n, held[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want)) and abs(r["base_score"] - base) < 1e-6 * abs(base)


def brute_languages(docs):
    """doc_ids that language identification keeps: its own rows, held against centroids elsewhere."""
    return {r["doc_id"] for r in language.identify(docs, language.fit(docs)).collect() if not r["lid_rejected"]}


def test_pipeline_equals_brute_force(spark):
    """Every stage by a plain reading: languages as predicted, texts by content, classes by all pairs, copies from the mix's own line, ids by the library."""
    docs = common.table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {i: text[i] for i in brute_languages(docs)}
    texts: dict = {}
    for i, t in kept.items():
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    once = {min(g)[1] for g in texts.values()}
    classes = brute_classes({i: kept[i] for i in once})
    left = docs.where(F.col("doc_id").isin([i for i in once if classes[i] == i]))
    lines: dict = {}
    for r in mixing.mix_sources(left).collect():
        lines.setdefault(r["source"], []).append((r["from"], r["doc_id"], r["size"], r["taken"]))
    u = {r["source"]: r["u"] for r in left.select("source", mixing._uniform(F.lit(20), "source").alias("u")).distinct().collect()}
    drawn: Counter = Counter()
    for source, rows in lines.items():
        total = u[source]
        for _, i, size, taken in sorted(rows):
            before, total = total, total + (taken / size if size else 0)
            drawn[i] += math.floor(total) - math.floor(before)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == +drawn and 100 < len(got)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=tokenize.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    for r in got:
        ids = np.array(enc.encode_ordinary(text[r["doc_id"]]), "<u4").tobytes()
        assert r["n_tokens"] == len(ids) // 4 and r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_neighbours_take_few_passes_over_windows(monkeypatch):
    """Queries start at the width that was enough before, so windows are counted about once a query."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((4096, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = neighbours.CollisionIndex(np.arange(4096), np.arange(4096), rows, projections=96, threshold=0.7, missed=0.01, grow=1.15)
    counted, plain = [], neighbours.CollisionIndex._collisions
    monkeypatch.setattr(neighbours.CollisionIndex, "_collisions", lambda self, spots, wide: counted.append(len(spots)) or plain(self, spots, wide))
    own = np.arange(0, 4096, 8)
    found = list(index.search(rows[own], own, 20))
    products = rows[own] @ rows.T
    products[np.arange(len(own)), own] = -np.inf
    best = np.argsort(-products, axis=1)[:, :20]
    assert np.mean([len(set(ids) & set(b)) for (ids, _), b in zip(found, best, strict=True)]) >= 0.98 * 20
    assert sum(counted) < 2 * len(own)


def test_encoder_caches_stay_small():
    """Workers of a pipeline keep their encoders: at most 300,000 cuts are held, and 131,072 pairs."""
    held = tokenize.Recent(tokenize.TextEncoder.UNITS)
    for k in range(500_000):
        held.put(k, b"")
    assert len(held.new) + len(held.old) <= 300_000 and tokenize.BytePairEncoder.PAIRS <= 1 << 17


def test_each_distinct_piece_is_encoded_once(monkeypatch):
    """Words before stops and line ends are pieces of their own; those of a few MB of texts are encoded once, all together."""
    import pyarrow as pa

    ranks = tokenize.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e, rng = tokenize.TextEncoder(ranks, P.PATTERN), np.random.default_rng(5)
    words = ["".join(rng.choice(["an", "ther", "\u00e9", "ou", "Tion", "wh"], rng.integers(3, 7))) for _ in range(2000)]
    texts = ["".join(rng.choice(words) + str(rng.choice([" ", ", ", ".\n", "\n", "!! ", "  "])) for _ in range(300)) for _ in range(40)]
    texts += ["x" * 700 + "yz" * 300, "a \0 b\0 ", "", " ", " lead", "\u3000 wide  "]
    together, alone, plain = [], [], tokenize.BytePairEncoder.encode_all
    monkeypatch.setattr(tokenize.BytePairEncoder, "encode", lambda self, piece, f=tokenize.BytePairEncoder.encode: alone.append(piece) or f(self, piece))
    monkeypatch.setattr(tokenize.BytePairEncoder, "encode_all", lambda self, data, edges: together.append(len(edges) - 1) or plain(self, data, edges))
    for at_once in (1 << 30, 500):  # at 500 bytes, texts are also cut into parts
        e.AT_ONCE = at_once
        got = list(e.encode_all(pa.array(texts, pa.large_string())))
        if at_once == 1 << 30:
            assert together == [len({x for t in texts for x in e.pattern.findall(t)})] and set(map(len, alone)) == {1300}
        ids, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        for text, a, z in zip(texts, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            assert ids[a:z].tolist() == library.encode_ordinary(text), text
        assert b"".join(e.decode(x).tobytes() for x, _ in got) == "".join(texts).encode()
