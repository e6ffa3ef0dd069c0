"""Query registry: each named query has a Spark builder and (where SQL can
express it) the DuckDB oracle SQL over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def widen(df: DataFrame) -> DataFrame:
    """Registered results use 64-bit numbers (as the SQL oracle does):
    32/16/8-bit integers become BIGINT and FLOAT becomes DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # the store's clock is UTC wall-clock time (as the oracle reads it)
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            return widen(fn(spark, sf))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
