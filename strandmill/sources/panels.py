"""Sources: typed readers, and panels of time series derived from the sales and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField(n, t) for n, t in (("symbol", T.StringType()), ("dt", T.DateType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.DoubleType()), ("open_interest", T.DoubleType()), ("contract", T.StringType()))])


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, date_format: str | None = None) -> DataFrame:
    """A table by format, with an explicit schema where the format has none."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if date_format:
            reader = reader.option("dateFormat", date_format)
    return reader.load(path)


def read_bars(spark: SparkSession, path: str, fmt: str = "csv", columns: list[str] | None = None) -> DataFrame:
    """Bars with one file an instrument: the symbol comes from the file's name where no column has it."""
    d = read(spark, path, fmt, BARS if fmt == "csv" else None)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    d = d.withColumn("symbol", F.coalesce("symbol", name)) if "symbol" in d.columns else d.withColumn("symbol", name)
    return d.select(*(columns or d.columns))


def read_contracts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Contract files named SYM-YYYYM, or in folders whose names end so: symbol and contract come from the name."""
    schema = T.StructType([T.StructField("Date", T.StringType()), T.StructField("Close", T.DoubleType()), T.StructField("Volume", T.DoubleType()), T.StructField("Open Interest", T.DoubleType())])
    d = read(spark, path, fmt, schema if fmt == "csv" else None)
    part = lambda k: F.regexp_extract(F.input_file_name(), r"([^/=]+)-([0-9]{4}[A-Z])(?:\.[^./]+|/[^/]+)$", k)
    return d.select(part(1).alias("symbol"), part(2).alias("contract"), F.to_date("Date", "yyyyMMdd").alias("dt"), F.col("Close").alias("close"), F.col("Volume").alias("volume"), F.col("Open Interest").alias("open_interest"))


def read_instruments(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The instruments of both tables; columns that one lacks are null there."""
    return base.unionByName(extra, allowMissingColumns=True)


def first_available(base: DataFrame, other: DataFrame, by: str = "symbol") -> DataFrame:
    """All of base, and of other the keys that base lacks."""
    return base.unionByName(other.join(base.select(by).distinct(), by, "left_anti"))


def read_factors(wide: DataFrame, date: str) -> DataFrame:
    """Factors in long form (dt, factor, value); what isn't a number is null."""
    names = [c for c in wide.columns if c != date]
    return wide.unpivot(date, names, "factor", "value").select(F.col(date).alias("dt"), "factor", F.expr("try_cast(value AS double)").alias("value"))


def frequency(df: DataFrame, by: str = "factor") -> DataFrame:
    """Median gap in days between a series' dates, and whether that is monthly."""
    gap = F.datediff("dt", F.lag("dt").over(W.partitionBy(by).orderBy("dt")))
    return df.select(by, gap.alias("gap")).groupBy(by).agg(F.expr("percentile(gap, 0.5)").alias("gap")).withColumn("monthly", F.col("gap") >= 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(x: Column) -> Column:
    return F.to_date(F.date_trunc("week", x))


def cents(x: str | Column) -> Column:
    """A sum of money in whole cents, so that it doesn't depend on the order of rows."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(F.round(x * 100).cast("long")).cast("double")


def price() -> Column:
    return cents("l_extendedprice") / F.sum("l_quantity") / 100


def bars_w(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars of a brand: price is money by quantity."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", week(F.col("l_shipdate")).alias("dt")).agg(
        price().alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum("l_quantity").alias("volume"), F.count("*").cast("double").alias("open_interest"))


#: Series of the long panel.
LONG_SERIES = 62


def bars_long(spark: SparkSession, d: str) -> DataFrame:
    """A bar for each line of an order, by remainder of the part's key: few long series. At a scale of 0.1 they have about 9,700 days each."""
    li = table(spark, d, "lineitem").select(F.format_string("L%02d", F.col("l_partkey") % LONG_SERIES).alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    place = F.row_number().over(W.partitionBy("symbol").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    return li.select("symbol", F.date_add(F.lit("1960-01-01"), place).alias("dt"), (F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity") / 100).alias("close"), F.col("l_quantity").cast("double").alias("volume"))


def bars_h(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of an event type."""
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "value", F.date_trunc("hour", "ts").alias("dt"))
    return e.groupBy("symbol", "dt").agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))


def contracts_w(spark: SparkSession, d: str) -> DataFrame:
    """Weekly closes by brand and expiry, ten sizes to an expiry."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.floor(F.col("p_size") / 10).cast("int").alias("expiry"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "expiry", week(F.col("l_shipdate")).alias("dt")).agg(price().alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").cast("double").alias("open_interest"))


def front_w(bars: DataFrame) -> DataFrame:
    """The front expiry of each bar: a roll every 60 weeks from 1995-01-02."""
    weeks = F.floor(F.datediff("dt", F.lit("1995-01-02")) / 7)
    return bars.select("symbol", "dt", F.floor(weeks / 60).cast("int").alias("front"))


def instruments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.regexp_extract("symbol", r"([0-9]+)", 1).cast("int")
    return p.withColumn("k", k).select("symbol", F.concat(F.lit("AC"), F.col("k") % 5).alias("asset_class"), F.concat(F.lit("C"), F.col("k") % 4).alias("ccy"), (1.0 + F.col("k") % 3).alias("pointsize"), (0.5 + 0.1 * (F.col("k") % 7)).alias("cost_rt"))


def fx_w(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey") % 4).alias("ccy"), week(F.col("o_orderdate")).alias("dt")).agg((cents("o_totalprice") / F.count("*") / 10000000).alias("rate"))


def cash_w(spark: SparkSession, d: str) -> DataFrame:
    """A monthly percent rate."""
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("dt")).agg((1 + cents("o_totalprice") / F.count("*") / 10000000).alias("rate"))


def positioning_w(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    up = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey") % 4).alias("ccy"), week(F.col("o_orderdate")).alias("dt")).agg((cents(F.when(up, F.col("o_totalprice")).otherwise(0.0)) / 100).alias("longs"), (cents(F.when(~up, F.col("o_totalprice")).otherwise(0.0)) / 100).alias("shorts"), (cents("o_totalprice") / 100).alias("open_interest"))


def events_cal(spark: SparkSession, d: str) -> DataFrame:
    """Every sixth week that has finished orders, three days on: dates between those of the bars."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(week(F.col("o_orderdate")).alias("dt")).distinct()
    return o.withColumn("n", F.row_number().over(W.orderBy("dt"))).where("n % 6 = 0").select(F.date_add("dt", 3).alias("event_dt"))


def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Weekly returns of a type of part: change of its price within 20 %."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("variant"))
    c = li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("variant", week(F.col("l_shipdate")).alias("dt")).agg(price().alias("close"))
    w = W.partitionBy("variant").orderBy("dt")
    return c.withColumn("ret", F.greatest(F.least(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.2)), F.lit(-0.2))).withColumn("_n", F.row_number().over(w)).where("_n > 1").select("variant", "dt", "ret")


#: The same panels as common table expressions.
SQL = {
    "bars_long": f"bars_long AS (SELECT symbol, DATE '1960-01-01' + place::INT AS dt, close, volume FROM (SELECT printf('L%02d', l_partkey % {LONG_SERIES}) AS symbol, row_number() OVER (PARTITION BY l_partkey % {LONG_SERIES} ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place, round(l_extendedprice * 100) / l_quantity / 100 AS close, l_quantity::DOUBLE AS volume FROM lineitem))",
    "bars_w": "bars_w AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, CAST(count(*) AS DOUBLE) AS open_interest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "bars_h": "bars_h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)",
    "contracts_w": "contracts_w AS (SELECT p_brand AS symbol, CAST(floor(p_size / 10) AS INT) AS expiry, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close, sum(l_quantity) AS volume, CAST(count(*) AS DOUBLE) AS open_interest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)",
    "front_w": "front_w AS (SELECT symbol, dt, CAST(floor(floor((dt - DATE '1995-01-02') / 7) / 60) AS INT) AS front FROM bars_w)",
    "instruments": "instruments AS (SELECT symbol, 'AC' || (k % 5) AS asset_class, 'C' || (k % 4) AS ccy, 1.0::DOUBLE + k % 3 AS pointsize, 0.5::DOUBLE + 0.1::DOUBLE * (k % 7) AS cost_rt FROM (SELECT DISTINCT p_brand AS symbol, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS k FROM part))",
    "fx_w": "fx_w AS (SELECT 'C' || (o_custkey % 4) AS ccy, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000000 AS rate FROM orders GROUP BY 1, 2)",
    "cash_w": "cash_w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, 1 + CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10000000 AS rate FROM orders GROUP BY 1)",
    "positioning_w": "positioning_w AS (SELECT 'C' || (o_custkey % 4) AS ccy, CAST(date_trunc('week', o_orderdate) AS DATE) AS dt, CAST(sum(CAST(round(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END * 100) AS BIGINT)) AS DOUBLE) / 100 AS longs, CAST(sum(CAST(round(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE o_totalprice END * 100) AS BIGINT)) AS DOUBLE) / 100 AS shorts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS open_interest FROM orders GROUP BY 1, 2)",
    "events_cal": "events_cal AS (SELECT dt + 3 AS event_dt FROM (SELECT dt, row_number() OVER (ORDER BY dt) AS n FROM (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS dt FROM orders WHERE o_orderstatus = 'F')) WHERE n % 6 = 0)",
    "strategies": "type_closes AS (SELECT p_type AS variant, CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / sum(l_quantity) / 100 AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), strategies AS (SELECT variant, dt, ret FROM (SELECT variant, dt, greatest(least(close / lag(close) OVER (PARTITION BY variant ORDER BY dt) - 1, 0.2), -0.2) AS ret, row_number() OVER (PARTITION BY variant ORDER BY dt) AS n FROM type_closes) WHERE n > 1)",
}
NEEDS = {"front_w": ("bars_w",)}


def ctes(*names: str) -> str:
    """WITH and the panels named, with those they need."""
    found: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in found:
                found.append(x)
    return "WITH " + ", ".join(SQL[x] for x in found)
