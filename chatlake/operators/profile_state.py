"""Primers kept up to date by batch (CMD-5, SNK-4, SNK-7).

A batch of messages adds its partial sums to the state: term counts a sender,
messages a term, and facts a sender and channel. All are sums, minima or maxima, so the
state is the aggregate over its batches, and a profile never needs a message twice.
A batch is a partition of its own that a replay replaces, so no message counts twice.

Inverse document frequencies move with every batch, so each update ranks all
senders' terms again, from the state; only senders whose text came out different
have their file written. The state is read by batch: a sender's term is a
row in each batch that it occurs in, so batches should be hours or days of messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.digest import PROFILE_TERMS, profile_text, term_counts
from chatlake.operators.history import read_lines
from chatlake.session import run_dir

_TERMS = "batch string, sender string, term string, n long"
_MESSAGES = "batch string, term string, n long"
_FACTS = "batch string, sender string, channel string, n_messages long, first_id long, last_id long, n_terms long"


def _put(rows: DataFrame, batch: str, path: str) -> None:
    (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))


def add_counts(messages: DataFrame, folder: str, batch: str) -> None:
    """Add the sums of a named batch of (id, sender, channel, message), or replace
    them if the batch was added before. Ids must not come in two batches. A
    batch without messages adds nothing and replaces nothing."""
    tf = term_counts(messages, carry=["sender"])
    _put(tf.groupBy("sender", "term").agg(F.sum("tf").alias("n")), batch, f"{folder}/terms")
    _put(tf.groupBy("term").agg(F.count(F.lit(1)).alias("n")), batch, f"{folder}/messages")
    n_terms = F.coalesce(F.size(tx.terms("message")), F.lit(0))
    facts = messages.groupBy("sender", "channel").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("id").cast("long").alias("first_id"),
        F.max("id").cast("long").alias("last_id"), F.sum(F.greatest(n_terms, F.lit(0))).cast("long").alias("n_terms"))
    _put(facts, batch, f"{folder}/facts")


def profiles(spark: SparkSession, folder: str, n_terms: int = PROFILE_TERMS) -> DataFrame:
    """``digest.user_profiles`` of all messages added so far, from the state alone."""
    terms = spark.read.schema(_TERMS).parquet(f"{folder}/terms").groupBy("sender", "term").agg(F.sum("n").alias("ttf"))
    facts = spark.read.schema(_FACTS).parquet(f"{folder}/facts")
    n_docs = facts.agg(F.sum("n_messages")).scalar()
    idf = (spark.read.schema(_MESSAGES).parquet(f"{folder}/messages").groupBy("term")
           .agg(F.log((1 + n_docs) / (1 + F.sum("n"))).alias("idf")))
    weight = F.round(F.col("ttf") * F.col("idf"), 9)
    w = Window.partitionBy("sender").orderBy(F.desc("weight"), "term")
    top = (terms.join(idf, "term").withColumn("weight", weight).withColumn("r", F.row_number().over(w))
           .where(F.col("r") <= n_terms).groupBy("sender").agg(F.array_join(F.transform(
               F.sort_array(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), " ").alias("top_terms")))
    by_sender = facts.where("sender IS NOT NULL").groupBy("sender").agg(
        F.sum("n_messages").alias("n_messages"), F.countDistinct("channel").alias("n_channels"),
        F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n_terms").alias("n_terms"))
    return by_sender.join(top, "sender", "left")


def update_primers(messages: DataFrame, folder: str, batch: str) -> DataFrame:
    """Add a batch and write the primer files (one folder a sender, below
    ``folder``/primers) that it changes. Returns (sender, primer) of those written.

    An update that was cut short is repeated with the same name. Messages without a
    sender count for the frequencies and have no primer.
    """
    spark = messages.sparkSession
    add_counts(messages, folder, batch)
    new = profile_text(profiles(spark, folder))
    path = f"{folder}/primers"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        old = read_lines(spark, path, "sender")
        new = new.join(old.select("sender", F.col("line").alias("primer")), ["sender", "primer"], "left_anti")
    changed = run_dir(spark, "primers-changed")     # written first: the files it is compared with are replaced
    new.write.parquet(changed)
    written = spark.read.parquet(changed)
    (written.select("sender", "primer").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("sender").text(path))
    return written
