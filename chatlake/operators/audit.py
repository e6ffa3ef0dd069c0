"""The audit table of model requests (SNK-9): append, read, daily token sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake import schemas


def append(interactions: DataFrame, path: str, batch: str) -> None:
    """Write the (ts, content, response, tokens_used) of ``interactions`` as
    ``batch``. The table is partitioned by batch and day; a batch that is written
    again replaces its own days, so a retry adds nothing."""
    rows = interactions.select(*[F.col(f.name).cast(f.dataType) for f in schemas.INTERACTION_LOG])
    (rows.withColumn("batch", F.lit(batch)).withColumn("day", F.to_date("ts"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole table; a range of days is pruned to its folders."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.INTERACTION_LOG)
    return spark.read.schema(f"{kinds}, batch string, day date").parquet(path)


def daily(log: DataFrame) -> DataFrame:
    """Requests, tokens and characters of each day."""
    return log.groupBy("day").agg(
        F.count("*").alias("n_requests"), F.sum("tokens_used").alias("tokens_used"),
        F.sum(F.length("content") + F.length("response")).cast("long").alias("n_chars"))
