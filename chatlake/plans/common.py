"""Inputs shared by several registered queries, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.sources.tables import read_table


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per embedding label: the mean vector of that label.

    The query set grows with the table's labels, not its rows; the per-(label,
    dimension) mean is a partial aggregate.
    """
    e = read_table(spark, sf, "embeddings")
    comps = (e.select("label", F.posexplode("embedding").alias("pos", "v"))
             .groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m")))
    return comps.groupBy(F.col("label").cast("long").alias("qid")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
        .alias("vector"))


CENTROIDS_SQL = """centroids AS (
  SELECT qid, list(m ORDER BY pos) AS vector FROM (
    SELECT CAST(label AS BIGINT) AS qid, pos, avg(CAST(v AS DOUBLE)) AS m FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
      FROM embeddings) GROUP BY ALL) GROUP BY qid)"""


def query_vector(spark: SparkSession, sf: str, label: int = 0) -> list[float]:
    """The label-``label`` centroid as a list of floats: the search request.

    A search takes its query vector as a parameter (the embedding of the
    question); here that parameter is computed from the table. One row of
    ``dim`` numbers comes back to the driver, a bounded size.
    """
    row = label_centroids(spark, sf).where(F.col("qid") == label).select("vector").first()
    return list(row["vector"]) if row else []
