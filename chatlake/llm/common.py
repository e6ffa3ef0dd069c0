"""Helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.session import run_dir

#: ASCII white space as the word rules of these operators take it.
SPACE = r"[\x20\x09-\x0D]"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """``df`` less the columns an operator is about to write (its own win)."""
    out = {c.lower() for c in outputs}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed out of the way of an operator's own, and
    the new name of each: so that none is lost where names clash."""
    names = {c: f"c{i}__" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that ``aside`` renamed, and no others."""
    return df.select([F.col(new).alias(old) for old, new in names.items()])


def cols(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: computed once, no
    lineage behind it, readable by every executor."""
    spark: SparkSession = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space (NULL: 0)."""
    tidy = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{SPACE}+|{SPACE}+\z", "")
    return F.when(tidy == "", F.lit(0)).otherwise(
        F.size(F.split(tidy, rf"{SPACE}+"))).cast("long")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
