"""Readers for the stored tables and for the driver's parquet test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chatlake import schemas

TEST_TABLES = ("region nation customer supplier part orders lineitem events "
               "documents embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TEST_TABLES) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def open_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Open a stored chat table with its fixed schema (SRC-1).

    A missing path raises ``AnalysisException`` like the reference's failed
    connection raises.
    """
    schema: T.StructType = schemas.TABLES[table]
    df = spark.read.schema(schema).parquet(path)
    df.createOrReplaceTempView(table)
    return df


def create_tables(spark: SparkSession, location: str) -> list[str]:
    """``CREATE TABLE IF NOT EXISTS`` for the three chat tables (SRC-2..4).

    These are plain tables; the stores that ``operators.store`` writes are
    partitioned by batch and id block.
    """
    made = []
    for name, schema in schemas.TABLES.items():
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                         + ("" if f.nullable else " NOT NULL") for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                  f"LOCATION '{location.rstrip('/')}/{name}'")
        made.append(name)
    return made
