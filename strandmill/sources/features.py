"""A table of features by content that runs share: made once, extended by what is missing, bucketed by series."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .sinks import shared

BUCKETS = 8


def _versions(spark: SparkSession, folder: str) -> list:
    """(version, names, ddl) of the versions written to their end, the largest last."""
    try:
        rows = spark.read.parquet(f"{folder}/versions").collect()
    except AnalysisException:
        return []
    return sorted(rows, key=lambda r: (len(r["names"]), r["version"]))


def _read(spark: SparkSession, folder: str, version: str, ddl: str, buckets: int) -> DataFrame:
    """The version as a bucketed table; its files are named in the session's catalog once."""
    name = f"features_{version}"
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, dt) INTO {buckets} BUCKETS LOCATION '{folder}/{version}'")
    return spark.table(name)


def read_features(spark: SparkSession, content: str, names: list[str], make: Callable[[list[str]], DataFrame], base: tuple[str, ...], buckets: int = BUCKETS) -> DataFrame:
    """base and names of the features of ``content``, a digest of what they are made of.

    make(names) gives base and those features. The first call writes them, bucketed and sorted by symbol; a later one
    makes only what no version has, joins it to the largest version by (symbol, dt) and writes a new one, so a reader
    always has one table and needs no exchange by symbol. A version counts once its row in ``versions`` is written; runs at
    the same time write versions of their own. Files stay in the shared folder until that is cleared.
    """
    folder = f"{shared(spark)}/features-{hashlib.md5(f'{content} {base}'.encode()).hexdigest()}"
    have = _versions(spark, folder)
    known = have[-1]["names"] if have else []
    if missing := [n for n in names if n not in known]:
        new = make(missing)
        if have:
            old = _read(spark, folder, have[-1]["version"], have[-1]["ddl"], have[-1]["buckets"])
            new = old.join(new.select("symbol", "dt", *(new[f"`{n}`"] for n in missing)), ["symbol", "dt"])
        version = uuid.uuid4().hex
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        new.write.bucketBy(buckets, "symbol").sortBy("symbol", "dt").format("parquet").option("path", f"{folder}/{version}").saveAsTable(f"features_{version}")
        row = (version, [*known, *missing], ddl, buckets)
        spark.createDataFrame([row], "version string, names array<string>, ddl string, buckets int").coalesce(1).write.mode("append").parquet(f"{folder}/versions")
        have = [*have, spark.createDataFrame([row], "version string, names array<string>, ddl string, buckets int").first()]
    last = have[-1]
    return _read(spark, folder, last["version"], last["ddl"], last["buckets"]).select(*base, *(f"`{n}`" for n in names))
