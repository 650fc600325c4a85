"""Exponentially weighted and other order-dependent features.

A plain prefix sum of x * (1 - a) ** -i overflows on long series. Rows are numbered and cut into blocks in which the
powers stay within range; a block's sums are window sums, and what comes in from the two blocks before is scaled by a
power of the row's place. A block's length goes with its own rate: at least REACH e-foldings, so that older blocks weigh
less than e ** -(2 * REACH), below double precision, and at most MOST, so that powers stay in range. Rates that fit one
length share its windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.scalars import log_add, ratio


def alpha_of(span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    if span is not None:
        return 2.0 / (span + 1)
    return 1 - math.exp(-math.log(2) / halflife) if halflife is not None else alpha


#: E-foldings of a block: the fewest that leave nothing to older blocks, and the most.
REACH, MOST = 25.0, 300.0
#: A decay up to this leaves nothing of the rows before, exactly.
_LEAST_DECAY = 1e-130
#: Rows of a series that are within a task where its rows are numbered.
STRETCH = 1 << 16
#: Rows of stretches that a task gets at most, about; many more would only be spilled.
_TASK_ROWS = 1 << 20


def _lengths(decays: list[float]) -> dict[float, int]:
    """A block length for each decay; neighbouring decays share one while it is long enough for the slowest and short enough for the fastest. A longer one is a multiple of the shorter."""
    out: dict[float, int] = {}
    size = 0
    for q in sorted({max(q, _LEAST_DECAY) for q in decays if q < 1}):  # the fastest first
        fall = -math.log(q)
        if not size or size * fall < REACH:
            least = max(size, 1)
            size = max(1, int(MOST / fall) // least) * least
        out[q] = size
    return out


def _columns(sums: dict[str, tuple[Column, float | Column]]) -> dict[str, str]:
    """The name of a column that holds the decay of each sum whose decay is a column; equal ones share it."""
    seen: dict[str, str] = {}
    return {n: seen.setdefault(str(q), f"_q{len(seen)}") for n, (_, q) in sums.items() if isinstance(q, Column)}


def _stretches(df: DataFrame, sums: dict[str, tuple[Column, float | Column]], by: tuple[str, ...], place: str, stretch: int) -> DataFrame:
    """Rows cut into stretches of their series, with _stretch and _row, the place in it; before each stretch a row at place -1 whose expressions are the sums so far.

    A stretch's own sums are aggregated, and the sums over stretches, a row each, are decayed sums again. Rows are counted,
    so that tasks grow in number and not in size.
    """
    decays = {n: F.greatest(q, F.lit(_LEAST_DECAY)) if isinstance(q, Column) else F.lit(max(q, _LEAST_DECAY)) for n, (_, q) in sums.items()}
    d = df.withColumns({"_stretch": F.floor(F.col(place) / stretch), "_row": F.pmod(F.col(place), F.lit(stretch))} | {f"_x_{n}": F.coalesce(x.cast("double"), F.lit(0.0)) for n, (x, _) in sums.items()})
    own = _columns(sums)
    d = d.withColumns({c: sums[n][1] for n, c in own.items()})
    ends = d.groupBy(*by, "_stretch").agg(*(F.sum(F.col(f"_x_{n}") * F.pow(q, stretch - 1 - F.col("_row"))).alias(f"_x_{n}") for n, q in decays.items()), *(F.first(c).alias(c) for c in sorted({*own.values()})))
    far = {f"_in_{n}": (F.col(f"_x_{n}"), F.pow(F.greatest(own[n], F.lit(_LEAST_DECAY)), F.lit(float(stretch))) if n in own else max(q, _LEAST_DECAY) ** stretch) for n, (_, q) in sums.items()}
    ends = decayed_sums(ends, far, by, "_stretch")
    gone = {n: F.greatest(own[n], F.lit(_LEAST_DECAY)) > _LEAST_DECAY if n in own else F.lit(q > _LEAST_DECAY) for n, (_, q) in sums.items()}
    ends = ends.select(*by, (F.col("_stretch") + 1).alias("_stretch"), F.lit(-1).cast("long").alias("_row"), *(F.when(gone[n], F.col(f"_in_{n}")).otherwise(0.0).alias(f"_x_{n}") for n in sums), *sorted({*own.values()}))
    d, parts = d.unionByName(ends, allowMissingColumns=True), -(-df.count() // _TASK_ROWS)
    return d.repartition(parts, *by, "_stretch") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else d


def decayed_sums(df: DataFrame, sums: dict[str, tuple[Column, float | Column]], by: tuple[str, ...] = ("symbol",), order: str = "dt", block: int | None = None, place: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """Adds, for each name, the sum of decay ** (rows since) * expression over a series so far; null counts as 0.

    A decay may be a column that is constant within a series; its block's length is then that of the series. A decay
    of 1 or more makes a plain running sum. ``block`` sets all lengths, for tests: at least REACH e-foldings of each decay.
    ``place`` names a column that numbers a series' rows from 0 without gaps: its stretches are then spread over tasks,
    so a series may have any length; without it, a series is within a task.
    """
    if place:
        d = _stretches(df, sums, by, place, stretch)
        own = _columns(sums)
        sums = {n: (F.col(f"_x_{n}"), F.col(own[n]) if n in own else q) for n, (_, q) in sums.items()}
        by = (*by, "_stretch")
    else:
        d = df.withColumn("_row", (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1).cast("long"))
    fixed = _lengths([q for _, q in sums.values() if not isinstance(q, Column)])
    groups: dict[str, tuple[Column, dict[str, Column], int]] = {}
    for name, (_, q) in sums.items():
        if isinstance(q, Column):
            decay = F.greatest(q, F.lit(_LEAST_DECAY))
            length = F.when(decay < 1, F.greatest(F.floor(F.lit(MOST) / -F.log(decay)), F.lit(1))).otherwise(F.lit(2**62)).cast("long")
            key, rank = str(length), 0
        else:
            decay, rank = F.lit(max(q, _LEAST_DECAY)), fixed.get(max(q, _LEAST_DECAY), 2**62)
            length, key = F.lit(rank).cast("long"), str(rank)
        groups.setdefault(key, (F.lit(block).cast("long") if block else length, {}, rank))[1][name] = decay
    zero = F.lit(0.0)
    made = sorted(groups.values(), key=lambda g: -g[2])  # lengths of fixed decays nest, so one order serves all of them
    for k, (size, _, _) in enumerate(made):
        d = d.withColumn(f"_size{k}", size).withColumn(f"_block{k}", F.floor(F.greatest(F.col("_row"), F.lit(0)) / F.col(f"_size{k}")))
    nested = [f"_block{k}" for k, (_, _, rank) in enumerate(made) if rank]
    for k, (_, decays, rank) in enumerate(made):
        outer, inner = (nested[: k + 1], nested[k + 1 :]) if rank else ([f"_block{k}"], [])
        d = d.withColumn("_at", F.col("_row") - F.col(f"_block{k}") * F.col(f"_size{k}"))
        d = d.withColumns({n: F.coalesce(sums[n][0], zero) * F.pow(q, -F.col("_at")) for n, q in decays.items()})
        inside = W.partitionBy(*by, *outer).orderBy(*inner, "_row").rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy(*by).orderBy(*outer, *inner, "_row").rowsBetween(W.unboundedPreceding, -1)
        d = d.withColumns({n: F.sum(n).over(inside) for n in decays})
        d = d.withColumns({n: F.col(n) * F.pow(q, F.col("_at")) for n, q in decays.items()})
        # what is carried in: the sums at the end of the block before, and of the one before that, whose own carry is nothing
        size = F.col(f"_size{k}")
        done = F.col("_at") == size - 1
        d = d.withColumns({f"_in_{n}": F.last(F.when(done, F.col(n)), ignorenulls=True).over(before) for n in decays})
        d = d.withColumns({f"_far_{n}": F.last(F.when(done, F.col(f"_in_{n}")), ignorenulls=True).over(before) for n in decays})
        carried = lambda n, q: (F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_far_{n}", zero) * F.pow(q, size)) * F.pow(q, F.col("_at") + 1)  # noqa: E731, B023
        d = d.withColumns({n: F.col(n) + F.when(q > _LEAST_DECAY, carried(n, q)).otherwise(zero) for n, q in decays.items()})
        d = d.drop("_at", *(f"_in_{n}" for n in decays), *(f"_far_{n}" for n in decays))
    if place:
        d = d.where("_row >= 0").drop("_stretch", *(f"_x_{n}" for n in sums), *own.values())
    return d.drop("_row", *(f"_{c}{k}" for k in range(len(made)) for c in ("size", "block")))


def _count(x: Column, by: tuple[str, ...], order: str) -> Column:
    return F.count(x).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def ewm_means(df: DataFrame, outs: dict[str, tuple[str, float | Column]], *, by: tuple[str, ...] = ("symbol",), order: str = "dt", adjust: bool = True, block: int | None = None, place: str | None = None) -> DataFrame:
    """Adds several exponentially weighted means, each of (column, alpha), in the same windows: see ewm_mean(). place: see decayed_sums()."""
    sums: dict[str, tuple[Column, float | Column]] = {}
    first = F.col(place) == 0 if place else F.row_number().over(W.partitionBy(*by).orderBy(order)) == 1
    d = df if adjust else df.withColumn("_first", first)
    for out, (x, a) in outs.items():
        value = F.col(x) if adjust else F.when(F.col("_first"), F.col(x)).otherwise(a * F.col(x))
        sums[f"_s_{out}"] = (value, 1 - a)
        if adjust:
            sums[f"_w_{out}"] = (F.col(x).isNotNull().cast("double"), 1 - a)
    counts = {x: f"_n_{x}" for x, _ in outs.values()}
    if place:
        sums |= {n: (F.col(x).isNotNull().cast("double"), 1.0) for x, n in counts.items()}
    d = decayed_sums(d, sums, by, order, block, place)
    count = lambda x: F.col(counts[x]) if place else _count(F.col(x), by, order)
    d = d.withColumns({out: F.when(count(x) >= 1, ratio(F.col(f"_s_{out}"), F.col(f"_w_{out}")) if adjust else F.col(f"_s_{out}")) for out, (x, _) in outs.items()})
    return d.drop("_first", *sums)


def ewm_mean(df: DataFrame, x: str | Column, out: str, *, by: tuple[str, ...] = ("symbol",), order: str = "dt", least: int = 1, adjust: bool = True, block: int | None = None, **rate) -> DataFrame:
    """Exponentially weighted mean; nulls keep their place and add nothing. Without adjust, the recursion from the first row (no nulls then)."""
    x = F.col(x) if isinstance(x, str) else x
    d = ewm_means(df.withColumn("_x", x), {"_mean": ("_x", alpha_of(**rate))}, by=by, order=order, adjust=adjust, block=block)
    return d.withColumn(out, F.when(_count(F.col("_x"), by, order) >= least, F.col("_mean"))).drop("_x", "_mean")


def ewm_std(df: DataFrame, x: str | Column, out: str, *, by: tuple[str, ...] = ("symbol",), order: str = "dt", least: int = 2, block: int | None = None, **rate) -> DataFrame:
    """Exponentially weighted standard deviation, corrected for bias."""
    a = alpha_of(**rate)
    x = F.col(x) if isinstance(x, str) else x
    q, on = 1 - a, F.col("_x").isNotNull().cast("double")
    d = decayed_sums(df.withColumn("_x", x), {"_s": (F.col("_x"), q), "_q": (F.col("_x") * F.col("_x"), q), "_w": (on, q), "_v": (on, q * q)}, by, order, block)
    mean = ratio(F.col("_s"), F.col("_w"))
    var = ratio(F.col("_q"), F.col("_w")) - mean * mean
    fix = ratio(F.col("_w") * F.col("_w"), F.when(F.col("_w") * F.col("_w") - F.col("_v") > 1e-12, F.col("_w") * F.col("_w") - F.col("_v")))
    return d.withColumn(out, F.when(_count(F.col("_x"), by, order) >= least, F.sqrt(F.greatest(var * fix, F.lit(0.0))))).drop("_x", "_s", "_q", "_w", "_v")


def ewm_rhos(df: DataFrame, columns: list[str], alpha: float | Column, *, by: tuple[str, ...], order: str = "dt", block: int | None = None, place: str | None = None) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Adds _n, rows so far in which no column is null, and the exponentially weighted correlation of each pair; its column by pair. place: see decayed_sums()."""
    q = 1 - alpha
    pairs = [(i, j) for k, i in enumerate(columns) for j in columns[k + 1 :]]
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    sums = {"_w": (full.cast("double"), q)} | {f"_{c}": (F.when(full, F.col(c)), q) for c in columns} | {f"_{i}_{j}": (F.when(full, F.col(i) * F.col(j)), q) for i, j in [*pairs, *((c, c) for c in columns)]}
    if place:
        d = decayed_sums(df, sums | {"_n": (full.cast("double"), 1.0)}, by, order, block, place).withColumn("_n", F.col("_n").cast("long"))
    else:
        d = decayed_sums(df, sums, by, order, block).withColumn("_n", _count(F.when(full, F.lit(1)), by, order))
    m = lambda c: ratio(F.col(c), F.col("_w"))
    cov = lambda i, j: m(f"_{i}_{j}") - m(f"_{i}") * m(f"_{j}")
    names = {(i, j): f"_rho_{i}_{j}" for i, j in pairs}
    d = d.withColumns({names[i, j]: ratio(cov(i, j), F.sqrt(F.greatest(cov(i, i) * cov(j, j), F.lit(0.0)))) for i, j in pairs})
    return d.drop(*sums), names


def ewm_corr(df: DataFrame, columns: list[str], *, by: tuple[str, ...] = (), order: str = "dt", least: int = 2, block: int | None = None, **rate) -> DataFrame:
    """Long table (*by, order, i, j, rho) of exponentially weighted correlations between columns, i < j."""
    d, keys = (df, by) if by else (df.withColumn("_all", F.lit(1)), ("_all",))
    d, names = ewm_rhos(d, columns, alpha_of(**rate), by=keys, order=order, block=block)
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(F.col("_n") >= least, F.col(c)).alias("rho")) for (i, j), c in names.items()))
    return d.select(*by, order, F.explode(rows).alias("r")).select(*by, order, "r.i", "r.j", "r.rho")


def ewm_var0(df: DataFrame, x: str, out: str, *, by: tuple[str, ...] = ("symbol",), order: str = "dt", **rate) -> DataFrame:
    """Exponentially weighted mean square, over rows that aren't null only, and held on others."""
    seen = df.where(F.col(x).isNotNull()).select(*by, order, (F.col(x) * F.col(x)).alias("_sq"))
    got = ewm_mean(seen, "_sq", out, by=by, order=order, **rate).select(*by, order, out)
    d = df.join(got, [*by, order], "left")
    return d.withColumn(out, F.last(out, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before in any of columns; true for the first."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def deadband(df: DataFrame, target: str, out: str, *, share: float = 0.1, least: float = 0.5, by: tuple[str, ...] = ("symbol",), order: str = "dt", across: str | None = None, lots: int = 4, together: bool = False, prior: str | None = None) -> DataFrame:
    """A position that moves to the rounded target only when it is further away than share of it, or least; null holds.

    An ordered fold; halves round away from zero. A series' rows come in order as a stream, of which only the current
    positions are held. ``across`` names one of ``by`` that has many values, such as a variant, each at most once at a
    step of the order: all of them move at once as one array, in ``lots`` parts by hash. With ``together``, all rows of the
    other keys are in one partition already, and stay there. ``prior``, without across, names a column for the position before.
    """
    keys = [c for c in by if c != across]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in (out, prior) if c)])

    def moved(now, x):
        with np.errstate(invalid="ignore"):
            return np.where(np.abs(x - now) > np.maximum(share * np.abs(x), least), np.copysign(np.floor(np.abs(x) + 0.5), x), now)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        held, series = np.zeros(0), None
        for b in batches:
            if not b.num_rows:
                continue
            x, got = pc.cast(b.column(target), pa.float64()).to_numpy(zero_copy_only=False), np.empty(b.num_rows)
            which = b.column(across).dictionary_encode()
            who = np.array([codes.setdefault(v, len(codes)) for v in which.dictionary.to_pylist()])[which.indices.to_numpy(zero_copy_only=False)]
            held = np.concatenate([held, np.zeros(len(codes) - len(held))])
            starts = np.flatnonzero(_changes([b.column(k) for k in keys])).tolist()
            cuts = np.flatnonzero(_changes([b.column(k) for k in (*keys, order)])).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(x)]):
                if starts and a == starts[0]:
                    starts.pop(0)
                    if (now := tuple(b.column(k)[a].as_py() for k in keys)) != series:
                        series, held = now, np.zeros(len(held))
                held[who[a:z]] = got[a:z] = moved(held[who[a:z]], x[a:z])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, out])

    def fold_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, series = 0.0, None
        for b in batches:
            starts, got, before = _changes([b.column(k) for k in keys]).tolist(), [], []
            for i, x in enumerate(pc.cast(b.column(target), pa.float64()).to_pylist()):
                if starts[i] and (head := tuple(b.column(k)[i].as_py() for k in keys)) != series:
                    series, now = head, 0.0
                before.append(now)
                if x is not None and abs(x - now) > max(share * abs(x), least):
                    now = math.copysign(math.floor(abs(x) + 0.5), x)
                got.append(now)
            made = {out: got, prior: before} if prior else {out: got}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.float64()) for x in made.values())], names=[*b.schema.names, *made])

    if across is None:
        return (df if together else df.repartition(*keys)).sortWithinPartitions(*keys, order).mapInArrow(fold_one, schema)
    if together:
        return df.sortWithinPartitions(*keys, order, across).mapInArrow(fold, schema)
    lot = F.pmod(F.xxhash64(across), F.lit(lots))
    return df.repartition(*keys, lot).sortWithinPartitions(*keys, lot, order, across).mapInArrow(fold, schema)


def regime_posterior(x: Column, params: dict[str, Column], n: int, by: str = "symbol", order: str = "dt") -> Column:
    """Probability of the second of two regimes: forward recursion in logs over the last n values.

    params: mean1, sd1, mean2, sd2 and stay, the chance to remain in a regime.
    """
    over = W.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)
    density = lambda v, k: -F.log(params[f"sd{k}"]) - 0.5 * F.pow((v - params[f"mean{k}"]) / params[f"sd{k}"], 2)
    stay, move = F.log(params["stay"]), F.log(1 - params["stay"])
    both = log_add
    start = F.struct(F.lit(math.log(0.5)).alias("a"), F.lit(math.log(0.5)).alias("b"))

    def step(s, v):
        a = both(s["a"] + stay, s["b"] + move) + density(v, 1)
        b = both(s["b"] + stay, s["a"] + move) + density(v, 2)
        return F.struct((a - both(a, b)).alias("a"), (b - both(a, b)).alias("b"))

    return F.exp(F.aggregate(F.collect_list(x).over(over), start, step)["b"])


def _split(a: str, least: int) -> dict[str, Column]:
    """m1, s1, m2, s2 of a sorted list: its lower and upper quartile, and the deviations of its lower and upper half; null under ``least`` values."""
    size, half = F.size(a), F.floor(F.size(a) / 2).cast("int")

    def quantile(q: float) -> Column:
        at = (size - 1) * q
        low = F.floor(at).cast("int")
        x, y = F.try_element_at(a, low + 1), F.coalesce(F.try_element_at(a, low + 2), F.try_element_at(a, low + 1))
        return x + (y - x) * (at - low)

    def deviation(part: Column) -> Column:
        total = lambda f: F.aggregate(part, F.lit(0.0), lambda s, v: s + f(v)) / half
        mean = total(lambda v: v)
        return F.sqrt(F.aggregate(part, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda s, v: F.struct((s["s"] + (v - s["m"]) * (v - s["m"])).alias("s"), s["m"].alias("m")))["s"] / half)

    own = {"m1": quantile(0.25), "s1": deviation(F.slice(a, F.lit(1), half)), "m2": quantile(0.75), "s2": deviation(F.slice(a, size - half + 1, half))}
    return {k: F.when(size >= least, v) for k, v in own.items()}


def split_moments(df: DataFrame, x: str, n: int, least: int, every: int = 1, by: str = "symbol", order: str = "dt") -> DataFrame:
    """Adds m1, s1, m2, s2: first guesses at two regimes, each with moments of its own, from the last n values as of the last
    row whose number is a multiple of ``every``.

    Only rows at which moments are made gather values: every row is sent to the n / every of them that reach it.
    """
    d = df.withColumn("_row", F.row_number().over(W.partitionBy(by).orderBy(order)))
    first, final = F.ceil(F.col("_row") / every) * every, F.floor((F.col("_row") + n - 1) / every) * every
    reach = F.when(first <= final, F.sequence(first, F.greatest(first, final), F.lit(every).cast("long")))
    lists = d.select(by, x, F.explode(reach).alias("_refit")).groupBy(by, "_refit").agg(F.array_sort(F.collect_list(x)).alias("_a"))
    made = lists.withColumns(_split("_a", least)).drop("_a")
    d = d.withColumn("_refit", F.floor(F.col("_row") / every) * every).join(made, [by, "_refit"], "left")
    held = W.partitionBy(by).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumns({k: F.last(k, ignorenulls=True).over(held) if every > 1 else F.col(k) for k in ("m1", "s1", "m2", "s2")}).drop("_row", "_refit")


def hold_refit(df: DataFrame, params: list[str], every: int, by: str = "symbol", order: str = "dt") -> DataFrame:
    """params as of the last row whose number is a multiple of every."""
    at = W.partitionBy(by).orderBy(order)
    d = df.withColumn("_row", F.row_number().over(at))
    for p in params:
        d = d.withColumn(p, F.last(F.when(F.col("_row") % every == 0, F.col(p)), ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, 0)))
    return d.drop("_row")
