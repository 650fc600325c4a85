"""A Merkle manifest of a table: a hash tree for each source and one over the sources, with a proof for each row.

Aligned blocks of leaves are trees of their own. Blocks then swap roots round by round: in round r, the blocks that
have the same place within each of ``fanout`` neighbouring nodes meet, so each has all of its run's hashes, hashes the
parent itself, and keeps its siblings. After the last round every block holds its upper proof; nothing goes back down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, runs, save, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Lowercase hex sha256 of all columns: ``-`` for null, else the value's UTF-8 bytes, counted, a colon, and the value."""
    parts = (F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (x.cast("string") for x in columns.values()))
    return F.sha2(F.concat(*parts), 256)


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _levels(leaves: list[bytes], depth: int | None, fanout: int) -> list[list[bytes]]:
    """Each level's runs, joined, and the root as the last: depth levels, or as many as lead to one node."""
    nodes, out = leaves, []
    while len(nodes) > 1 if depth is None else len(out) < depth:
        out.append([b"".join(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)])
        nodes = [_hash(x) for x in out[-1]]
    return [*out, nodes]


def _exchange(state: DataFrame, fanout: int, name: str) -> DataFrame:
    """Rounds of the exchange over (tree, block, n, hash, proof), n being the tree's blocks: all blocks end with the tree's root and their siblings.

    A group has at most fanout blocks and as many hashes: a last node with fewer blocks than its neighbours sends each
    hash to several places, so that every block hears from each sibling. As many rounds as the largest tree has levels.
    """
    most, width = state.agg(F.max("n")).first()[0] or 0, 1
    while width < most:
        w, node = F.lit(width), F.expr(f"block div {width}")
        low, full = F.col("block") % width, F.least(w, F.col("n") - node * width)
        sent = state.where(F.col("n") > width).withColumns({"digit": node % fanout, "to": F.expr(f"block div {width * fanout}"), "low": low})
        sent = sent.withColumn("place", F.explode(F.sequence("low", w - 1, F.greatest(full, F.lit(1)))))
        mine = F.col("place") == F.col("low")
        met = sent.groupBy("tree", "n", "to", "place").agg(F.array_sort(F.collect_list(F.struct("digit", "hash", F.when(mine, F.col("block")).alias("block"), F.when(mine, F.col("proof")).alias("proof")))).alias("met"))
        join = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda m: m["hash"]), "")
        met = met.withColumn("parent", F.sha2(join(lambda m: F.lit(True)), 256)).withColumn("m", F.explode(F.filter("met", lambda m: m["block"].isNotNull())))
        met = met.withColumns({"before": join(lambda m: m["digit"] < F.col("m.digit")), "after": join(lambda m: m["digit"] > F.col("m.digit"))})
        met = met.select("tree", F.col("m.block").alias("block"), "n", F.col("parent").alias("hash"), F.array_append("m.proof", F.struct("before", "after")).alias("proof"))
        state = save(state.where(F.col("n") <= width).unionByName(met), name)
        width *= fanout
    return state


def manifest(docs: DataFrame, *, tree: str = "source", order: str = "doc_id", leaf: Column | None = None, changed: Column | None = None, fanout: int = 16, block_levels: int = 3) -> DataFrame:
    """One row per row of docs: (order's column), source_no, place, leaf, changed, subroot, root, proof.

    Rows of each value of ``tree``, ascending by ``order`` (nulls first, equal ids by their leaf), are leaves; every
    ``fanout`` consecutive nodes become the hash of their hex texts until one is left, the subroot; subroots in order
    of ``tree`` (null first, bytewise) become the root in the same way. source_no is the tree's place in that order.
    proof lists, from the leaf up, the hex text of the siblings before and after. ``changed`` is a leaf to be verified
    in place of ``leaf`` (null: none), see folded(). Nulls, empty texts and any length of text are hashed as they are;
    rows that repeat are leaves of their own; an empty table gives no rows. Other columns are not read.

    A block has fanout ** block_levels leaves at most, whatever the tree's size. Rows are moved as digests, twice; a
    tree's proof above the subroot is joined to its blocks over as many keys as it has thousands of blocks.
    """
    leaf = leaf_hash({c: F.col(c) for c in COLUMNS}) if leaf is None else leaf
    rows = docs.select(F.col(tree).cast("string").alias("tree"), F.col(order).cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    rows = numbered(rows, ["tree"], ["id", "leaf"], size="leaves")
    trees = save(numbered(rows.where("place = 0").select("tree", "leaves"), [], ["tree"], place="tree_no", size="trees").select(F.col("tree").alias("t"), "tree_no", "trees"), "trees")
    size = fanout**block_levels
    rows = rows.join(trees, F.col("tree").eqNullSafe(F.col("t"))).select("tree_no", F.expr(f"place div {size}").alias("block"), "place", "leaves", "id", "leaf", "changed")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            depth = block_levels if t["leaves"][0].as_py() > size else None
            top = _levels([x.hex().encode() for x in t["leaf"].to_pylist()], depth, fanout)[-1][0].decode()
            yield pa.RecordBatch.from_pydict({"tree": t["tree_no"][:1].to_pylist(), "block": t["block"][:1].to_pylist(), "n": [-(-t["leaves"][0].as_py() // size)], "hash": [top], "ids": [t["id"].to_pylist()], "leaves": [t["leaf"].to_pylist()], "changed": [t["changed"].to_pylist()]}, schema=packed_schema)

    packed_schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("hash", pa.string()), ("ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.binary())), ("changed", pa.list_(pa.binary()))])
    rows = rows.repartition("tree_no", "block").sortWithinPartitions("tree_no", "block", "place")
    packed = save(rows.mapInArrow(pack, "tree long, block long, n long, hash string, ids array<long>, leaves array<binary>, changed array<binary>"), "blocks")

    none = F.array().cast(PROOF).alias("proof")
    upper = _exchange(packed.select("tree", "block", "n", "hash", none), fanout, "exchange")
    subroots = upper.where("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("block"), "hash", none).crossJoin(F.broadcast(trees.agg(F.max("trees").alias("n"))))
    tops = _exchange(subroots, fanout, "roots").select(F.col("block").alias("tree"), F.col("hash").alias("root"), F.col("proof").alias("top"))
    keys = upper.where("block = 0").select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000"))).alias("salt"))
    tops = tops.join(keys, "tree")
    upper = upper.withColumn("salt", F.expr("block div 1000")).join(tops, ["tree", "salt"]).select("tree", "block", F.col("hash").alias("subroot"), "root", F.concat("proof", "top").alias("upper"))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            leaves = [x.hex() for x in r["leaves"]]
            levels = _levels([x.encode() for x in leaves], block_levels if r["n"] > 1 else None, fanout)[:-1]
            levels = [[x.decode() for x in level] for level in levels]
            for a in range(0, len(leaves), 512):
                proofs = []
                for i in range(a, min(a + 512, len(leaves))):
                    proof = []
                    for level in levels:
                        run, d = level[i // fanout], i % fanout * 64
                        proof.append({"before": run[:d], "after": run[d + 64 :]})
                        i //= fanout
                    proofs.append(proof + r["upper"])
                m = len(proofs)
                yield pa.RecordBatch.from_pydict({"id": r["ids"][a : a + m], "source_no": [r["tree"]] * m, "place": [r["block"] * size + a + k for k in range(m)], "leaf": leaves[a : a + m], "changed": [x and x.hex() for x in r["changed"][a : a + m]], "subroot": [r["subroot"]] * m, "root": [r["root"]] * m, "proof": proofs}, schema=proved_schema)

    proved_schema = pa.schema([("id", pa.int64()), ("source_no", pa.int64()), ("place", pa.int64()), ("leaf", pa.string()), ("changed", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])
    found = packed.drop("hash").join(upper, ["tree", "block"]).mapInArrow(prove, f"id long, source_no long, place long, leaf string, changed string, subroot string, root string, proof {PROOF}")
    return found.withColumnRenamed("id", order)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def siblings_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, from the leaf up, each level's from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", _UPPER, _LOWER)
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (lowered != F.col("text"))
    d = manifest(docs, changed=F.when(tampered, leaf_hash({c: F.col(c) for c in COLUMNS} | {"text": lowered})))
    d = d.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return d.select("doc_id", "leaf", "subroot", "root", siblings_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 8, fanout: int = 16) -> str:
    """SQL of the query, for trees of up to fanout ** levels leaves: each level in turn, for all sources and then for the root."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = "sha256(" + " || ".join(field(c) for c in COLUMNS) + ")"
    low = leaf.replace(field("text"), field("lower_az"))
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    ctes = [
        f"t0 AS (SELECT *, translate(text, '{_UPPER}', '{_LOWER}') AS lower_az FROM documents)",
        f"t1 AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {low} ELSE {leaf} END AS now FROM t0)",
        "l0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM t1)",
        "n0 AS (SELECT source, p, n, leaf AS h FROM l0)",
    ]

    def climb(nodes: str, rows: str, key: str) -> tuple[str, str]:
        """A level's parents, and rows with their siblings there and what they fold to; trees of one node stay."""
        k = len(ctes)
        ctes.append(f"r{k} AS (SELECT *, string_agg(h, '') OVER run AS run, row_number() OVER run_at - 1 AS d FROM {nodes} WINDOW run AS (PARTITION BY {key}, p // {fanout}  ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), run_at AS (PARTITION BY {key}, p // {fanout} ORDER BY p))")
        ctes.append(f"n{k} AS (SELECT {key}, p // {fanout} AS p, any_value((n + {fanout - 1}) // {fanout}) AS n, CASE WHEN any_value(n) > 1 THEN sha256(any_value(run)) ELSE any_value(h) END AS h FROM r{k} GROUP BY {key}, p // {fanout})")
        side = "substr(r.run, 1, CAST(r.d * 64 AS BIGINT))", "substr(r.run, CAST(r.d * 64 + 65 AS BIGINT))"
        other = f"o.* EXCLUDE (proof, fold, p), o.p // {fanout} AS p"
        ctes.append(f"w{k} AS (SELECT {other}, CASE WHEN r.n > 1 THEN proof || {side[0]} || {side[1]} ELSE proof END AS proof, CASE WHEN r.n > 1 THEN sha256({side[0]} || fold || {side[1]}) ELSE fold END AS fold FROM {rows} o JOIN r{k} r ON o.{key} IS NOT DISTINCT FROM r.{key} AND o.p = r.p)")
        return f"n{k}", f"w{k}"

    ctes.append("w0 AS (SELECT doc_id, source, leaf, p, '' AS proof, now AS fold FROM l0)")
    nodes, rows = "n0", "w0"
    for _ in range(levels):
        nodes, rows = climb(nodes, rows, "source")
    ctes.append(f"sub AS (SELECT source, h AS subroot, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM {nodes})")
    ctes.append("s0 AS (SELECT one, p, n, subroot AS h FROM sub)")
    ctes.append(f"v0 AS (SELECT w.doc_id, w.leaf, s.subroot, s.one, s.p, w.proof, w.fold FROM {rows} w JOIN sub s ON w.source IS NOT DISTINCT FROM s.source)")
    nodes, rows = "s0", "v0"
    for _ in range(levels // 2):
        nodes, rows = climb(nodes, rows, "one")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM {rows} CROSS JOIN (SELECT h FROM {nodes})"


ORACLE_SQL = _oracle()
