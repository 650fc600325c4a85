"""The manifest against a plain tree, with several fanouts and block sizes; places of rows; odd rows and empty tables."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandmill.llm import common, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree_no string, block string, leaf string"
ODD = [
    (None, None, None, None, None), (None, "no id", "en", None, 1), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "É mixed CASE", None, "a", 3), (10, "lower", "en", "a", 1), (3, "Long Text " * 30_000, "en", "b", 9),
    (4, "X", "fr", "é", 1), (5, "Y", "fr", "", 1), *((k, f"Text {k}.", "en", "hot", k) for k in range(100, 170)),
]


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows: list[tuple], fanout: int = 16) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted, for rows (doc_id, text, lang, source, n_chars)."""
    def leaf(r, text):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """The root and each node's list of (before, after)."""
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(proofs):
                a = at[i] // fanout * fanout
                p.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + fanout])))
                at[i] //= fanout
            nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        return nodes[0], proofs

    sources: dict = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        now = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, now)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for x, proof in zip(sorted(sources[s]), trees[s][1]):
            fold = x[3]
            for before, after in proof + top:
                fold = h(before, fold, after)
            out.append((x[1] if x[0] else None, x[2], trees[s][0], root, h(*(b + a for b, a in proof + top)), fold, fold == root))
    return sorted(out, key=str)


def got(docs, **options) -> list[tuple]:
    low = F.translate("text", merkle._UPPER, merkle._LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    d = merkle.manifest(docs, changed=F.when(tampered, merkle.leaf_hash({c: F.col(c) for c in merkle.COLUMNS} | {"text": low})), **options)
    fold = merkle.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    rows = d.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")), fold.alias("fold"), (F.col("root") == fold)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_the_contract(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = sorted((tuple(r) for r in merkle.query(spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert found == plain(rows) and {True, False} == {r[-1] for r in found}


@pytest.mark.parametrize("fanout, block_levels", [(16, 3), (16, 1), (2, 1), (2, 2), (3, 1)])
def test_odd_rows_and_ragged_trees(spark, fanout, block_levels):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], SCHEMA)
    assert got(docs, fanout=fanout, block_levels=block_levels) == plain(ODD, fanout)


def test_one_leaf_and_empty_table(spark):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in ODD], SCHEMA)
    assert got(docs.where("doc_id = 3")) == plain([ODD[6]])
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_numbered_places_within_hot_and_null_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "a", "a", "b", f"k{i}"]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    d = common.numbered(spark.createDataFrame(rows, "key string, x long, mark long").repartition(7), ["key"], ["x", "mark"])
    keys = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    want, seen = {}, {}
    for key, _, i in keys:
        want[i] = seen.get(key, 0)
        seen[key] = want[i] + 1
    assert {r["mark"]: (r["place"], r["size"]) for r in d.collect()} == {i: (want[i], seen[key]) for key, _, i in rows} and d.columns == ["key", "x", "mark", "place", "size"]


def test_runs_join_over_batches():
    keys = [None, None, 0, 0, 0, 1, 1, None, 2]
    for cut in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[a : a + cut], pa.int64()), "v": list(range(a, min(a + cut, 9)))}) for a in range(0, 9, cut)]
        assert [t["v"].to_pylist() for t in common.runs(iter(batches), 1)] == [[0, 1], [2, 3, 4], [5, 6], [7], [8]]
    assert list(common.runs(iter([]), 1)) == []
