"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, free, save, table

_WALK = 64  # steps within range have a chance of over a half each


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size, n_docs, k (place by code point, null last, from 0), target from one row a source.

    Targets are in proportion to weights, repeating in that order, and sum to share times all sizes; a target stops at
    ceiling times its source's size, and the excess goes to the rest by weight. Sources stop in order of size by
    weight, so one pass over that order finds who does. The windows are over sources, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    ratio = W.orderBy("ratio", "k")
    before, every = ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    scale = F.try_divide(share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)), F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    d = sizes.withColumn("k", (F.row_number().over(order) - 1).cast("int")).withColumn("w", w)
    d = d.withColumn("most", ceiling * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    d = d.withColumn("scale", scale).withColumn("free", F.col("ratio") > F.col("scale"))
    # the scale of the first source that doesn't stop holds for all after it
    final = F.min(F.when(F.col("free"), F.struct("ratio", "k", "scale"))).over(every)["scale"]
    return d.withColumn("final", final).select("source", "source_size", "n_docs", "k", F.when(F.col("ratio") <= F.coalesce("final", F.lit(float("inf"))), F.col("most")).otherwise(F.col("final") * F.col("w")).alias("target"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked blocks among ``drawn`` of ``total`` blocks, by inversion at the uniform u.

    Weights follow from each other by ratios, within 12 standard deviations of the mean: what is left out has a
    probability below 1e-30. The width of that window bounds the work.
    """
    total, marked, drawn = (x.cast("double") for x in (total, marked, drawn))
    share = F.coalesce(F.try_divide(marked, total), F.lit(0.0))
    mean = drawn * share
    spread = 12 * F.sqrt(F.greatest(mean * (1 - share) * F.coalesce(F.try_divide(total - drawn, total), F.lit(0.0)), F.lit(0.0))) + 6
    low = F.greatest(F.lit(0.0), drawn - (total - marked), F.floor(mean - spread))
    high = F.least(marked, drawn, F.ceil(mean + spread))

    def rise(weight: Column, k: Column) -> Column:
        return weight * (marked - k + 1) * (drawn - k + 1) / (k * (total - marked - drawn + k))

    steps = F.when(high > low, F.sequence((low + 1).cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1.0)
    mass = F.aggregate(steps, F.struct(one.alias("w"), one.alias("sum")), lambda s, k: F.struct(rise(s["w"], k).alias("w"), (s["sum"] + rise(s["w"], k)).alias("sum")))["sum"]
    goal = u * mass
    start = F.struct(one.alias("w"), one.alias("sum"), low.cast("long").alias("pick"))
    step = lambda s, k: F.struct(rise(s["w"], k).alias("w"), (s["sum"] + rise(s["w"], k)).alias("sum"), F.when(s["sum"] < goal, k).otherwise(s["pick"]).alias("pick"))
    return F.aggregate(steps, start, step)["pick"]


def _uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed permutation of 0 to n - 1 takes x: a Feistel network over the least power of two, walked until it is within n."""
    bits = F.length(F.bin(F.greatest(n - 1, F.lit(1)).cast("long")))
    low = bits - F.floor(bits / 2).cast("int")  # bits of the right half
    shift = lambda v, by, left=False: F.call_function("shiftleft" if left else "shiftright", v, by)
    one = F.lit(1).cast("long")
    masks = shift(one, bits - low, True) - 1, shift(one, low, True) - 1

    def network(v: Column) -> Column:
        def turn(s, k):
            a = s["a"].bitwiseXOR(F.when(k % 2 == 0, F.xxhash64(k, s["b"], *key).bitwiseAND(masks[0])).otherwise(F.lit(0).cast("long")))
            b = s["b"].bitwiseXOR(F.when(k % 2 == 1, F.xxhash64(k, s["a"], *key).bitwiseAND(masks[1])).otherwise(F.lit(0).cast("long")))
            return F.struct(a.alias("a"), b.alias("b"))

        halves = F.struct(shift(v, low).alias("a"), v.bitwiseAND(masks[1]).alias("b"))
        return F.aggregate(F.array(*map(F.lit, range(4))), halves, turn, lambda s: shift(s["a"], low, True) + s["b"])

    first = F.aggregate(F.array(F.lit(0)), x.cast("long"), lambda v, _: network(v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), first, lambda v, _: F.when(v >= n, network(v)).otherwise(v))


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """k, edges: for each source, how its quota of blocks is cut among 2**levels shards (edges[s] to edges[s + 1]).

    quotas has (k, quota), a row a source. Each node gives half its blocks to its left child; how many of each source
    is one multivariate hypergeometric draw, source by source given those before. Exact: every shard has the same
    number of blocks (but for one), and each source's shares sum to its quota. Rows: nodes, at most 2**levels.
    """
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda x: x["quota"]).alias("has")).select(F.lit(0).cast("long").alias("node"), "has")
    for level in range(levels):
        every = F.aggregate("has", F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor((every + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "node"), F.lit(2))) / 2).cast("long")

        def draw(s, x):
            got = hypergeometric(s["total"], x["quota"], s["drawn"], _uniform(F.lit(seed), F.lit(level + 1), x["node"], x["k"]))
            return F.struct((s["total"] - x["quota"]).alias("total"), (s["drawn"] - got).alias("drawn"), F.concat(s["left"], F.array(got)).alias("left"))

        items = F.transform("has", lambda q, k: F.struct(q.alias("quota"), k.alias("k"), F.col("node").alias("node")))
        start = F.struct(every.alias("total"), half.alias("drawn"), F.array().cast("array<bigint>").alias("left"))
        node = node.withColumn("left", F.aggregate(items, start, draw)["left"])
        node = node.select("node", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("has")), F.struct(F.lit(1).alias("side"), F.zip_with("has", "left", lambda a, b: a - b).alias("has")))).alias("child"))
        node = node.select((F.col("node") * 2 + F.col("child.side")).alias("node"), F.col("child.has").alias("has"))
    shares = node.select("node", F.posexplode("has").alias("k", "blocks"))
    lists = shares.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "blocks"))), lambda x: x["blocks"]).alias("blocks"))
    return lists.select("k", F.aggregate("blocks", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))).alias("edges"))


def mix_sources(docs: DataFrame, *, weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: int = 2, levels: int = 5, block_words: int = 65_536, least_blocks: int = 64, lane_rows: int = 20_000, seed: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, pieces, lane, from.

    size counts words; a null text has none and is never taken. A null source is a source, the last. Each source's
    documents, in the order of a hash, lie on a line of words that is cut into equal blocks of about block_words (at
    least least_blocks of them, or one a word). As many passes over that line as the target needs, up to ceiling, give
    blocks to draw; each pass is permuted, and a pass begins when the one before is used up, so no document exceeds
    ceiling times its size. Only the last drawn block may be cut, so taken words meet the target within a word.
    The splitting tree cuts each source's quota among 2**levels shards (as many as the output is to have; sources and shards
    fit in a row); a second permutation deals the blocks drawn out to those shares. pieces lists what a document gives: struct(shard, place, from_word, to_word, lap), place being the
    order within the shard. lane and from say where a row lies on its source's line. Rows that repeat, ties and repeated ids get places of their own on the line; very long texts span as
    many blocks as they have; an empty table gives no rows, a source without words a target of 0. Other columns are not read.

    Nothing is gathered by source: sums are pre-aggregated over (source, lane), and the line's positions come from the
    lanes' sums and a window within a lane, a range of hashes of about ``lane_rows`` rows. The line is in order of hash
    whatever the number of lanes, which only spreads a source with most of all rows.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"))
    d = save(d.withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")
    lanes = max(64, -(-d.count() // lane_rows))
    d = d.withColumn("lane", F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * lanes), F.lit(lanes - 1)).cast("int"))
    lane = d.groupBy("source", "lane").agg(F.sum("size").alias("lane_size"), F.count("*").alias("n"))
    lane = save(lane, "lanes")
    sources = targets(lane.groupBy("source").agg(F.sum("lane_size").alias("source_size"), F.sum("n").alias("n_docs")), weights, share, ceiling)
    s = F.col("source_size")
    blocks = F.least(s, F.greatest(F.lit(least_blocks), F.ceil(s / block_words))).cast("long")
    per = F.col("target") * F.col("blocks") / s  # the target, in blocks
    quota = F.coalesce(F.when(s > 0, F.ceil(per - 1e-9)), F.lit(0)).cast("long")
    sources = sources.withColumn("blocks", blocks).withColumn("quota", quota)
    sources = sources.withColumn("last", F.when(s > 0, F.col("target") - (F.col("quota") - 1) * s / F.col("blocks")).otherwise(0.0))
    sources = save(sources, "sources")
    dealt = save(sources.join(splitting_tree(sources.select("k", "quota"), levels, seed), "k", "left"), "quotas")

    before = F.coalesce(F.sum("lane_size").over(W.partitionBy("source").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = lane.select("source", "lane", before.alias("lane_from")).withColumnRenamed("source", "s1").withColumnRenamed("lane", "l1")
    mine = W.partitionBy("source", "lane").orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(mine), F.lit(0)))
    d = d.join(places, d["source"].eqNullSafe(places["s1"]) & (d["lane"] == places["l1"])).withColumn("from", F.col("lane_from") + F.col("inside")).drop("s1", "l1", "lane_from", "inside")
    d = d.join(dealt.withColumnRenamed("source", "s2"), d["source"].eqNullSafe(F.col("s2"))).drop("s2")

    n, q, size, at = F.col("blocks"), F.col("quota"), F.col("source_size"), F.col("from")
    edge = lambda b: F.floor((b * size) / n).cast("long")  # noqa: E731  where block b begins; the next one ends it
    shuffled = lambda x, m, tag: permuted(x, m, F.lit(seed + tag), F.col("k"))

    def ranked(lap: int):  # each permutation is evaluated once a block, as a field of what the next step maps over
        return lambda b: F.struct(b.alias("block"), (F.lit(lap) * n + shuffled(b, n, lap)).alias("rank"), F.lit(lap).alias("lap"))

    def piece(r: Column) -> Column:
        b, rank, spot = r["block"], r["rank"], r["spot"]
        end = F.when(rank == q - 1, F.least(edge(b) + F.round("last").cast("long"), edge(b + 1))).otherwise(edge(b + 1))
        a, z = F.greatest(at, edge(b)), F.least(at + F.col("size"), end)
        shard = F.size(F.filter("edges", lambda e: e <= spot)) - 1
        return F.struct(shard.cast("int").alias("shard"), F.xxhash64(F.lit(seed), spot, "hash").alias("place"), (a - at).alias("from_word"), (z - at).alias("to_word"), r["lap"].alias("lap"))

    first = F.floor(at * n / size).cast("long")  # blocks from one before the document's first to one after its last
    final = F.floor((at + F.col("size") - 1) * n / size).cast("long")
    near = F.filter(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(final + 1, n - 1)), lambda b: (edge(b) < at + F.col("size")) & (edge(b + 1) > at))
    taken = F.filter(F.concat(*(F.transform(near, ranked(lap)) for lap in range(ceiling))), lambda r: r["rank"] < q)
    spots = F.transform(taken, lambda r: F.struct(r["block"].alias("block"), r["rank"].alias("rank"), r["lap"].alias("lap"), shuffled(r["rank"], q, 9).alias("spot")))
    found = F.filter(F.transform(spots, piece), lambda p: p["to_word"] > p["from_word"])
    pieces = F.when(F.col("size") > 0, found).otherwise(F.array().cast("array<struct<shard:int,place:bigint,from_word:bigint,to_word:bigint,lap:int>>"))
    d = d.withColumn("pieces", pieces)
    return d.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda t, p: t + p["to_word"] - p["from_word"])).select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "lane", "from")


def draw_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents as often as the mix takes them, all columns as they were, in order of the mix's shard and place.

    Along a source's line, taken words by size add up; a document's copies are the difference of that running sum, rounded,
    after it and before it (all of a source shifted by one draw from its hash). So a document taken wholly comes as often
    as it was taken, and up to any place of the line a source has as many documents as it should, but for one.
    Null texts and documents without words aren't drawn; a very long text counts by its words like any other. Rows that repeat
    a doc_id share their mean copies, rounded by a hash. An empty table gives none; columns may have any names.
    """
    mix = save(mix_sources(docs, **options).withColumn("part", F.coalesce(F.try_divide("taken", F.col("size")), F.lit(0.0))), "mix")
    lanes = mix.groupBy("source", "lane").agg(F.sum("part").alias("lane_part"))
    before = F.coalesce(F.sum("lane_part").over(W.partitionBy("source").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    lanes = lanes.select(F.col("source").alias("s1"), F.col("lane").alias("l1"), (before + _uniform(F.lit(options.get("seed", 20)), "source")).alias("shift"))
    line = W.partitionBy("source", "lane").orderBy("from", "doc_id", "size")
    upto, until = (F.coalesce(F.sum("part").over(line.rowsBetween(W.unboundedPreceding, k)), F.lit(0.0)) for k in (0, -1))
    d = mix.withColumns({"upto": upto, "until": until}).join(lanes, mix["source"].eqNullSafe(F.col("s1")) & (mix["lane"] == F.col("l1")))
    copies = (F.floor(F.col("shift") + F.col("upto")) - F.floor(F.col("shift") + F.col("until"))).cast("int")
    first = F.array_min(F.transform("pieces", lambda p: F.struct(p["shard"].alias("shard"), p["place"].alias("place"))))
    plan = d.select("doc_id", copies.alias("copies"), first.alias("first")).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"), F.min("first").alias("first"))
    times = F.floor(F.col("copies") / F.col("n") + F.when(F.col("n") > 1, _uniform(F.lit(options.get("seed", 20)), "doc_id")).otherwise(1e-9)).cast("int")
    name, spot = free(docs, "times"), free(docs, "spot")
    plan = plan.select(F.col("doc_id").alias(free(docs, "mixed_id")), times.alias(name), F.col("first").alias(spot)).where(F.col(name) > 0)
    out = docs.join(plan, docs["doc_id"].cast("long").eqNullSafe(plan[plan.columns[0]]))
    out = out.select(*(docs[f"`{c}`"] for c in docs.columns), spot, F.explode(F.sequence(F.lit(1), F.col(name))).alias(name))
    shard, place = F.col(spot)["shard"], F.col(spot)["place"]
    return out.repartitionByRange(shard, place).sortWithinPartitions(shard, place).drop(name, spot)


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
