"""The composite strategy with its parameters as rows: one library of forecasts, one plan for any number of variants."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import cap, ratio, sigmoid
from strandmill.operators import blend as B
from strandmill.operators import cross_section as X
from strandmill.operators import ledger as L
from strandmill.operators import recursive as R
from strandmill.operators import signals as G
from strandmill.operators import windows as O
from strandmill.sources.sinks import save

KEYS = ("symbol", "dt")
PARTS = ("trend", "carry", "skew", "vov")
N, LEAST = 52, 26  # rows of forecast scalars

#: A parameter's type and default, and below the values of the axes, ranges and choices. A window or span of
#: daily rows is brought to weekly ones by a fifth (256 rows a year to 52). 0 turns off conviction, vov_direction, smooth_span
#: and halflife, which goes before smooth_span; ``dropped`` names a symbol to leave out.
PARAMS: dict[str, tuple[str, object]] = {
    "speeds": ("array<string>", ["4_16", "8_32", "16_64"]), "trend_fdm": ("double", 1.0), "conviction": ("int", 0), "w_ts": ("double", 1.0), "w_xs": ("double", 0.0), "xs_lookback": ("int", 52),
    "skew_window": ("int", 52), "vov_window": ("int", 20), "vov_direction": ("int", 13), "w_trend": ("double", 0.25), "w_carry": ("double", 0.25), "w_skew": ("double", 0.25), "w_vov": ("double", 0.25),
    "fdm_mode": ("string", "pooled"), "fdm_cap": ("double", 2.0), "fdm_span": ("int", 104), "fdm_least": ("int", 26), "smooth_span": ("int", 3), "steepness": ("double", 10.0),
    "vol_trigger": ("double", 1.0), "vol_dampen": ("double", 0.5), "dd_threshold": ("double", -0.1), "dd_scale": ("double", 0.5), "cost_mult": ("double", 1.0), "lag": ("int", 0), "halflife": ("double", 0.0), "dropped": ("string", ""),
}
DEFAULTS = {k: v for k, (_, v) in PARAMS.items()}
OFF = {"vol_dampen": 1.0, "dd_scale": 1.0}  # no overlays

Params = dict[str, object]


def speeds(*pairs: tuple[int, int]) -> list[str]:
    return [f"{f}_{s}" for f, s in pairs]


def weights(t: float, c: float, s: float, v: float) -> Params:
    return {"w_trend": t, "w_carry": c, "w_skew": s, "w_vov": v}


def one_at_a_time() -> dict[str, tuple[str, Params]]:
    """Every value of every axis, A to R, as (axis, overrides) by name; windows are those of weekly rows."""
    axes: dict[str, list[Params]] = {
        "A speeds": [{"speeds": speeds(*x)} for x in (((4, 16), (8, 32), (16, 64)), ((4, 16), (8, 32)), ((4, 16), (16, 64)), ((8, 32), (16, 64)), ((4, 16),), ((8, 32),), ((16, 64),), ((2, 8), (4, 16), (8, 32)), ((8, 32), (16, 64), (32, 128)), ((2, 8), (4, 16), (8, 32), (16, 64)))],
        "B conviction": [{"conviction": x} for x in (0, 26, 39, 52, 78, 104)],
        "C trend multiplier": [{"trend_fdm": x} for x in (0.85, 0.9, 0.95, 1.0, 1.05, 1.1)],
        "D weights": [weights(*x) for x in ((0.25, 0.25, 0.25, 0.25), (0.4, 0.2, 0.2, 0.2), (0.2, 0.4, 0.2, 0.2), (0.2, 0.2, 0.4, 0.2), (0.2, 0.2, 0.2, 0.4), (0.3333, 0.2222, 0.2222, 0.2223), (0.3, 0.3, 0.3, 0.1))],
        "E multiplier cap": [{"fdm_cap": x} for x in (1.2, 1.5, 1.65, 1.8, 2.0, 2.2, 2.4, 3.0, 1e9)],
        "F correlation span": [{"fdm_mode": "single", "fdm_span": x} for x in (52, 104, 208)],
        "G skew window": [{"skew_window": x} for x in (26, 39, 52, 78, 104)],
        "H smoothing": [{"smooth_span": x} for x in (0, 2, 3, 5, 8, 10, 15, 21)],
        "I steepness": [{"steepness": x} for x in (0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 15.0, 20.0)],
        "J overlays": [{"vol_trigger": a, "vol_dampen": b, "dd_threshold": c, "dd_scale": d} for a, b, c, d in ((1.0, 0.5, -0.1, 0.5), (1.5, 0.75, -0.02, 0.5), (2.0, 0.85, -0.04, 0.65), (2.5, 0.9, -0.06, 0.75), (999.0, 1.0, -999.0, 1.0))],
        "K trend parts": [{"w_ts": x, "w_xs": 1 - x} for x in (1.0, 0.75, 0.5, 0.25, 0.0)],
        "L cross-sectional lookback": [{"xs_lookback": x, "w_ts": 0.5, "w_xs": 0.5} for x in (26, 39, 51, 52, 78, 104)],
        "M volatility window": [{"vov_window": x} for x in (8, 12, 16, 20, 26, 39)],
        "N direction": [{"vov_direction": x} for x in (13, 0)],
        "O share of volatility": [weights(x, x, x, round(1 - 3 * x, 6)) for x in (1 / 3, 0.3, 0.2833, 0.2667, 0.25, 0.2333, 0.2)],
        "P multiplier mode": [{"fdm_mode": x} for x in ("single", "pooled", "shrink", "mean")],
        "Q pooled span": [{"fdm_span": x} for x in (26, 52, 104, 208, 416)],
        "R least rows": [{"fdm_least": x} for x in (13, 26, 52)],
    }
    return {f"{axis[0]}{k:02d}": (axis, o) for axis, values in axes.items() for k, o in enumerate(values)}


def ablations() -> dict[str, tuple[str, Params]]:
    """What is left without a part, in ten groups: signals, pairs, single signals, overlays, smoothing, multiplier, direction, costs, speeds, combinations."""
    thirds = {p: {f"w_{q}": 0.0 if q == p else 1 / 3 for q in PARTS} for p in PARTS}
    halves = {f"{p}+{q}": {f"w_{x}": 0.5 * (x in (p, q)) for x in PARTS} for i, p in enumerate(PARTS) for q in PARTS[i + 1 :]}
    alone = {p: {f"w_{q}": float(q == p) for q in PARTS} for p in PARTS}
    plain = {"overlays": OFF, "vol_gate": {"vol_dampen": 1.0}, "drawdown_gate": {"dd_scale": 1.0}}
    smooth, direction, mult = {"smoothing": {"smooth_span": 0}}, {"direction": {"vov_direction": 0}}, {"multiplier": {"fdm_cap": 1.0}}
    groups = {
        "1 without a signal": thirds, "2 two signals": halves, "3 one signal": alone, "4 without overlays": plain, "5 without smoothing": smooth | {f"span{x}": {"smooth_span": x} for x in (5, 10)},
        "6 without the multiplier": mult | {x: {"fdm_mode": x} for x in ("single", "shrink", "mean")}, "7 without direction": direction, "8 costs": {f"x{x:g}": {"cost_mult": x} for x in (0.0, 0.5, 1.5, 2.0, 3.0)},
        "9 speeds": {x: {"speeds": [x]} for x in ("4_16", "8_32", "16_64")} | {f"without_{x}": {"speeds": [y for y in DEFAULTS["speeds"] if y != x]} for x in DEFAULTS["speeds"]},
    }
    rest = plain | smooth | direction | mult
    both = {f"{a}+{b}": x | y for i, (a, x) in enumerate(rest.items()) for b, y in list(rest.items())[i + 1 :]}
    groups["10 combinations"] = both | {f"{a}&{b}": x | y for a, x in thirds.items() for b, y in {**smooth, **mult, "overlays": OFF, **direction}.items()}
    return {f"no_{g.split()[0]}_{name}": (g, o) for g, of in groups.items() for name, o in of.items()}


def cumulative(steps: dict[str, Params]) -> dict[str, tuple[str, Params]]:
    """Each step has the overrides of all before."""
    out, so_far = {}, {}
    for k, (name, o) in enumerate(steps.items()):
        so_far = {**so_far, **o}
        out[f"step{k}_{name}"] = ("path", dict(so_far))
    return out


#: What the cumulative path gives up, in order.
PATH = {"costs": {"cost_mult": 0.0}, "smoothing": {"smooth_span": 0}, "overlays": OFF, "multiplier": {"fdm_cap": 1.0}, "direction": {"vov_direction": 0}, "speeds": {"speeds": ["8_32"]}, "vov": weights(1 / 3, 1 / 3, 1 / 3, 0.0), "skew": weights(0.5, 0.5, 0.0, 0.0), "carry": weights(1.0, 0.0, 0.0, 0.0)}
#: Ranges of random parameters: low, high, and whether in logs; and the values of discrete ones.
RANGES = {"trend_fdm": (0.85, 1.2), "vol_trigger": (0.8, 2.0), "vol_dampen": (0.3, 0.8), "dd_threshold": (-0.15, -0.03), "dd_scale": (0.3, 0.8), "steepness": (0.5, 10.0, "log"), "fdm_cap": (1.2, 3.0)}
CHOICES = {"smooth_span": [0, 2, 3, 5, 8, 10], "xs_lookback": [26, 39, 52, 78, 104], "vov_window": [8, 12, 16, 20, 26], "skew_window": [26, 39, 52, 78, 104], "conviction": [26, 39, 52, 78, 104]}
IDENTITY = {"speeds": ["16_64"], "trend_fdm": 1.0, "xs_lookback": 52, "conviction": 52, "skew_window": 52, "vov_window": 16, "smooth_span": 5, "steepness": 1.0, "w_ts": 0.5, "w_xs": 0.5}


def rounded(params: Params) -> Params:
    """Windows to the nearest power of two, factors to tenths, thresholds to fiftieths."""
    power = lambda x: min((2**k for k in range(1, 12)), key=lambda p: (abs(x - p), p))
    out = {k: power(params[k]) for k in ("xs_lookback", "skew_window", "vov_window", "vov_direction", "smooth_span", "fdm_span")}
    return out | {k: round(round(float(params[k]) / 0.1) * 0.1, 6) for k in ("trend_fdm", "vol_trigger", "vol_dampen", "dd_scale", "fdm_cap")} | {"dd_threshold": round(round(float(params["dd_threshold"]) / 0.02) * 0.02, 6)}


def registry(spark: SparkSession, overrides: dict[str, tuple[str, Params]]) -> DataFrame:
    """(variant, dim, *parameters): the defaults as ``master``, and one row for each of overrides."""
    rows = [("master", "master", *DEFAULTS.values())] + [(v, dim, *(o.get(k, x) for k, x in DEFAULTS.items())) for v, (dim, o) in overrides.items()]
    return spark.createDataFrame(rows, "variant string, dim string, " + ", ".join(f"{k} {t}" for k, (t, _) in PARAMS.items()))


def random_variants(spark: SparkSession, n: int, uniform: Callable[[str, int], str]) -> DataFrame:
    """n rows of RANGES and CHOICES drawn by hash, other parameters at their defaults; uniform(row, k) is SQL of the k-th draw."""
    d, cols = spark.range(n), []
    for k, (name, (low, high, *kind)) in enumerate(RANGES.items()):
        u = F.expr(uniform("id", k))
        cols.append((F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low)))) if kind else low + u * (high - low)).alias(name))
    for k, (name, values) in enumerate(CHOICES.items(), len(RANGES)):
        cols.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.expr(uniform("id", k)) * len(values)) + 1).cast("int")).alias(name))
    made = {*RANGES, *CHOICES}
    rest = [(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)).cast(PARAMS[k][0]).alias(k) for k, x in DEFAULTS.items() if k not in made]
    d = d.select(F.format_string("draw%04d", "id").alias("variant"), F.lit("random").alias("dim"), *cols, *rest)
    return d.select("variant", "dim", *(F.col(k).cast(t) for k, (t, _) in PARAMS.items()))


def needs(variants: DataFrame) -> dict[str, list]:
    """The distinct values of each parameter that a forecast depends on; as many as the axes have, whatever the number of variants."""
    wanted = variants.agg(F.sort_array(F.collect_set(F.array_join("speeds", "+"))).alias("speeds"), F.sort_array(F.collect_set(F.struct("vov_window", "vov_direction"))).alias("vov"), F.sort_array(F.collect_set(F.when(F.col("conviction") > 0, F.struct(F.array_join("speeds", "+").alias("s"), "conviction")))).alias("ramps"), *(F.sort_array(F.collect_set(k)).alias(k) for k in ("xs_lookback", "skew_window", "lag"))).first()
    pairs = sorted({tuple(map(int, p.split("_"))) for s in wanted["speeds"] for p in s.split("+")})
    return {"speeds": pairs, "vov": [tuple(x) for x in wanted["vov"]], "ramps": [tuple(x) for x in wanted["ramps"]]} | {k: [int(x) for x in wanted[k]] for k in ("xs_lookback", "skew_window", "lag")}


#: Columns of a library besides its features.
BASE = ("symbol", "dt", "open", "close", "vol", "usual", "loss")


def features(wanted: dict[str, list]) -> list[str]:
    """Names of all features that any variant needs."""
    return ["carry", *(f"{f}_{s}" for f, s in wanted["speeds"]), *(f"xs{k}" for k in wanted["xs_lookback"]), *(f"skew{k}" for k in wanted["skew_window"]), *(f"vov{w}_{k}" for w, k in wanted["vov"]), *(f"conv{k}:{s}" for s, k in wanted["ramps"])]


def library(bars: DataFrame, chain: DataFrame | None, wanted: dict[str, list], names: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """BASE, keep and a column for each feature of names (default: all that wanted has), each made once.

    One exchange by date for the cross-sectional scores, one by symbol for all else; the chain of contracts is joined,
    or bars have its c1, c2 and years12.
    """
    names = features(wanted) if names is None else names
    d = bars if chain is None else bars.join(chain.select(*KEYS, "c1", "c2", "years12"), list(KEYS), "left")
    d = d.withColumn("np", O.norm_price("dp", "vol"))
    xs = {f"xs{k}": k for k in wanted["xs_lookback"] if f"xs{k}" in names}
    if xs:
        d = d.withColumns({n: O.diff("np", k) for n, k in xs.items()})
        d = d.withColumns({n: X.xs_z(n) for n in xs})
    ramps = {f"conv{k}:{s}": (s.split("+"), k) for s, k in wanted["ramps"] if f"conv{k}:{s}" in names}
    pairs = [(f, s) for f, s in wanted["speeds"] if f"{f}_{s}" in names or any(f"{f}_{s}" in own for own, _ in ramps.values())]
    if pairs:
        d = G.crossovers(d, tuple(pairs))
    made = {f"{f}_{s}": f"cross{f}_{s}" for f, s in pairs}
    d = d.withColumn("carry", ratio(ratio(F.col("c1") - F.col("c2"), F.col("years12")), F.col("vol")))
    d = d.withColumns({f"skew{k}": -O.roll_skew("dp", k, 20) for k in wanted["skew_window"] if f"skew{k}" in names} or {"carry": F.col("carry")})
    d = G.add_vol_of_vol(d, {f"vov{w}_{k}": (8, w, 52, k) for w, k in wanted["vov"] if f"vov{w}_{k}" in names})
    total = lambda own: reduce(lambda a, b: a + b, (F.coalesce(made[x], F.lit(0.0)) for x in own))
    d = d.withColumns({f"_s{i}": total(own) for i, (own, _) in enumerate(ramps.values())} or {"carry": F.col("carry")})
    found = {n: F.coalesce(B.conviction(f"_s{i}", k, k // 2), F.lit(1.0)) for i, (n, (_, k)) in enumerate(ramps.items())}
    found |= {n: F.coalesce(B.to_forecast(made.get(n, n), N, LEAST), F.lit(0.0)) for n in names if n not in ramps}
    d = d.select(*KEYS, *keep, F.coalesce(O.shift("close", 1), F.col("close")).alias("open"), "close", "vol", usual().alias("usual"), loss().alias("loss"), *(found[n].alias(n) for n in names))
    return d


def usual(by: str | tuple = "symbol") -> Column:
    return O.roll_mean("vol", 52, 20, by=by)


def loss(by: str | tuple = "symbol") -> Column:
    return 1 - ratio(O.shift("close", 1, by=by), O.shift("close", 9, by=by))


def smoothing() -> Column:
    """The rate of a variant's smoothing; 1 for none."""
    return F.when(F.col("halflife") > 0, 1 - F.pow(F.lit(2.0), -1 / F.col("halflife"))).when(F.col("smooth_span") > 1, 2 / (F.col("smooth_span") + 1.0)).otherwise(1.0)


def gates(of: Callable[[str], Column] = F.col) -> Column:
    """Both overlays of a row with vol, usual and loss; of(name) is a parameter."""
    gate = lambda least, x: 1 - (1 - of(least)) * F.coalesce(sigmoid(of("steepness") * x), F.lit(0.0))
    return gate("vol_dampen", ratio(F.col("vol"), F.col("usual")) - of("vol_trigger")) * gate("dd_scale", F.col("loss") + of("dd_threshold"))


def mixed() -> Column:
    """The weighted parts of a row."""
    return cap(reduce(lambda a, b: a + b, (F.col(p) * F.col(f"w_{p}") for p in PARTS)))


def parts(forecasts: DataFrame, variants: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each of forecasts and variant, with its parts and its pool of correlations.

    The registry is broadcast, as it is a table of parameters. Where a variant finds its features in a row is looked up
    once a variant. A dropped symbol has no rows.
    """
    names = [c for c in forecasts.columns if c not in (*BASE, *keep)]
    places = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))
    at = lambda name: F.coalesce(F.try_element_at(places, name), F.lit(len(names)))
    named = {"i_xs": F.concat(F.lit("xs"), F.col("xs_lookback")), "i_carry": F.lit("carry"), "i_skew": F.concat(F.lit("skew"), F.col("skew_window")), "i_vov": F.concat_ws("_", F.concat(F.lit("vov"), F.col("vov_window")), "vov_direction"), "i_conv": F.concat(F.lit("conv"), F.col("conviction"), F.lit(":"), F.array_join("speeds", "+"))}
    variants = variants.withColumns({k: at(n) for k, n in named.items()} | {"i_speeds": F.transform("speeds", at)})
    f = lambda i: F.coalesce(F.get("f", i), F.lit(0.0))
    ts = F.aggregate("i_speeds", F.lit(0.0), lambda a, i: a + f(i)) / F.size("i_speeds") * F.col("trend_fdm")
    ts = ts * F.when(F.col("conviction") > 0, F.coalesce(F.get("f", F.col("i_conv")), F.lit(1.0))).otherwise(1.0)
    d = forecasts.select(*(c for c in (*BASE, *keep) if c in forecasts.columns), F.array(*(F.col(f"`{n}`") for n in names)).alias("f")).crossJoin(F.broadcast(variants)).where("symbol <> dropped")
    d = d.withColumns({"trend": cap(F.col("w_ts") * ts + F.col("w_xs") * f(F.col("i_xs"))), **{p: f(F.col(f"i_{p}")) for p in PARTS[1:]}})
    return d.withColumn("pool", F.when(F.col("fdm_mode") == "single", F.col("symbol")).otherwise(""))


#: What the multipliers are by.
POOL = ("variant", "pool")


def pools(forecasts: DataFrame, variants: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(variant, pool, dt, *PARTS): the mean of each part. Forecasts are dealt by date before variants multiply them, so this needs no further exchange."""
    return parts(forecasts.repartition("dt"), variants, keep).groupBy(*POOL, "dt").agg(*(F.avg(p).alias(p) for p in PARTS))


def multipliers(pool: DataFrame, variants: DataFrame, place: str | None = None) -> DataFrame:
    """(variant, pool, dt, mult) from pools(); place: see decayed_sums()."""
    pool = pool.join(F.broadcast(variants.select("variant", "fdm_span", "fdm_least", "fdm_mode", "fdm_cap", *(f"w_{p}" for p in PARTS))), "variant")
    pool, rho = R.ewm_rhos(pool, list(PARTS), 2 / (F.col("fdm_span") + 1.0), by=POOL, place=place)
    mult = B.multiplier({p: F.col(f"w_{p}") for p in PARTS}, rho, F.col("_n") >= F.col("fdm_least"), F.col("fdm_mode"), F.col("fdm_cap"))
    return pool.select(*POOL, "dt", mult.alias("mult"))


def scores(forecasts: DataFrame, variants: DataFrame, lags: Iterable[int] = (0,), keep: tuple[str, ...] = ()) -> DataFrame:
    """(variant, symbol, dt, score, open, close, vol, cost_mult, *keep), all rows of a variant together: the composite of each variant.

    The multipliers, a row for each variant and date, are written; after them, one exchange by variant serves all steps.
    Cross-sectional features keep the whole universe. A variant is sorted by one task, so this is for many variants of
    short series; long_series.run() is for few variants of long ones.
    """
    pool = save(multipliers(pools(forecasts, variants, keep), variants), "multipliers")
    d = parts(forecasts, variants, keep).select(*POOL, *KEYS, "open", "close", "vol", *keep, mixed().alias("mixed"), gates().alias("gates"))
    d = d.join(pool, [*POOL, "dt"]).select("variant", *KEYS, "open", "close", "vol", *keep, cap(F.col("mixed") * F.col("mult")).alias("mixed"), "gates")
    # what is a variant's own comes from the registry after the exchange, not through it
    d = d.repartition("variant").join(F.broadcast(variants.select("variant", "cost_mult", "lag", smoothing().alias("rate"))), "variant")
    d = R.ewm_means(d, {"smooth": ("mixed", F.col("rate"))}, by=("variant", "symbol"))
    d = d.withColumn("score", F.col("smooth") * F.col("gates"))
    over = W.partitionBy("variant", "symbol").orderBy("dt")
    held = reduce(lambda a, k: F.when(F.col("lag") == k, F.lag("score", k).over(over)).otherwise(a), (k for k in lags if k), F.col("score"))
    return d.select("variant", *KEYS, F.coalesce(held, F.lit(0.0)).alias("score"), "open", "close", "vol", "cost_mult", *keep)


def run(forecasts: DataFrame, variants: DataFrame, dims: DataFrame, year: float, lags: Iterable[int] = (0,), capital: float = L.CAPITAL, rates: DataFrame | None = None) -> DataFrame:
    """(variant, dt, pnl, commission, trades, cash, nav, ret, excess) of every variant: composite, positions, ledger and net asset value.

    rates: (dt, rate), what cash earns in a row's time, as of a date; without it cash earns nothing.
    """
    own = ("pointsize", "cost_rt")
    d = scores(forecasts.join(dims.select("symbol", *own), "symbol"), variants, lags, own)
    d = d.withColumn("forecast", F.col("score")).withColumn("fx", F.lit(1.0))
    d = L.target_position(d, capital=capital, root_year=year**0.5, least_vol=1e-9).drop("forecast", "score")
    held = R.deadband(d, "target", "position", by=("variant", "symbol"), across="symbol", together=True)
    return L.nav(L.portfolio_daily(L.daily_pnl(held, F.col("cost_mult")), rates, capital), capital)


def summary(ran: DataFrame, variants: DataFrame, year: float) -> DataFrame:
    """(variant, dim, ..., delta): tearsheet of each variant, and its Sharpe ratio over the master's."""
    t = L.tearsheet(ran, year, ddof=1).join(variants.select("variant", "dim"), "variant")
    master = t.where("variant = 'master'").select(F.col("sharpe").alias("base"))
    return t.crossJoin(F.broadcast(master)).withColumn("delta", F.col("sharpe") - F.col("base")).drop("base")
