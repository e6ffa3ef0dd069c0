"""Interaction of document filters over all their orders.

A filter removes what fails it and is still there. What a filter removes at its
step depends only on the set of filters before it, so the orders are paths
through the lattice of subsets: state S holds the filters applied so far, and an
edge (S, f) applies f next. Documents are counted once, by the set of filters
that they fail; every edge's removals are sums of those counts. Path counts do
the rest: the orders that reach S times those that leave S with f weigh the
edge's removals in f's Shapley value, and a given order reads its steps from the
edges that its path takes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import SPACE, same, written

MOST = 7        # filters: their orders are listed


def word_list(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that the text alone decides (not NULL)."""
    words = word_list(text)
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every state of the lattice of n filters, as a bit set: the orders that
    reach it from none, forward over the edges, and those that leave it to all,
    backward."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for s in range(full + 1):
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in range(full, -1, -1):
        for f in range(n):
            if s >> f & 1:
                leave[s ^ 1 << f] += leave[s]
    return reach, leave


def flagged(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, fails, good, toxic) for each row: the bit set of the failed filters
    A to E and its labels. E: some smaller id has the identical text.

    Texts are compared by SHA-256. Rows without an id are neither smaller nor
    larger than others; rows of one id are not smaller than each other. An id that
    ``labels`` (doc_id, quality, toxic) repeats has a label if any row says so.
    """
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    fails = F.lit(0)
    for k, failed in enumerate(text_failures(F.col("text")).values()):
        fails = fails + F.when(failed, 1 << k).otherwise(0)
    rows = written(docs.select(id_.alias("id"), text.alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"))
                   .select("id", "part", fails.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")
    marks = (labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col("doc_id").alias("marked"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")))
    # a text's smallest id, for the texts that more than one id has
    least = (rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
             .where("least < most").select(F.col("digest").alias("repeated"), "least"))
    return (rows.join(marks, F.col("id") == F.col("marked"), "left")
            .join(least, F.col("digest") == F.col("repeated"), "left")
            .select("part", (F.col("fails") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("fails"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """All orders of ``filters`` over (part, fails, good, toxic): one row for each
    part, filter_order and step, with long columns kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley (removals of the step's filter,
    summed over all orders). ``fails`` has bit k for the k-th filter.

    Every part has all its rows, zeros included; a NULL part is a part. No rows
    give no parts.
    """
    spark, n = rows.sparkSession, len(filters)
    if not 0 < n <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    reach, leave = path_counts(n)
    edges = [(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    # a row a part and failed set: at most 2 ** n a part
    counts = rows.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(w).alias("paths")) for s, f, w in edges]))
    bit = F.expr("shiftleft(1, f)")
    here = (F.col("fails").bitwiseAND(F.col("state")) == 0) & (F.col("fails").bitwiseAND(bit) != 0)

    def total(condition, value="n"):
        return F.sum(F.when(condition, F.col(value)).otherwise(0)).cast("long")

    removals = (counts.withColumn("e", edge).select("*", "e.*").groupBy("part", "state", "f", "paths").agg(
        total(F.col("fails").bitwiseAND(F.col("state").bitwiseOR(bit)) == 0).alias("kept"),
        total(here).alias("removed"),
        total((F.col("fails").bitwiseAND(bit) != 0) & ~here).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost")))
    weighed = removals.groupBy(F.col("part").alias("of"), F.col("f").alias("g")).agg(F.sum(F.col("removed") * F.col("paths")).cast("long").alias("shapley"))
    steps = spark.createDataFrame(
        [("".join(filters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), f)
         for order in itertools.permutations(range(n)) for k, f in enumerate(order)],
        "filter_order string, step int, state int, f int")
    return (removals.join(weighed, same(F.col("part"), F.col("of")) & (F.col("f") == F.col("g")))
            .join(steps, ["state", "f"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
