"""Digests without repeats (C-6): central messages, each unlike those before it.

Copies of a line (equal terms in equal order) count once, as the one of the smallest id. Of each
group the ``candidates`` best-scored lines make a graph: two lines are as
similar as the cosine of their tf-idf vectors over rare terms. A line's centrality is
its share in a random walk over the graph, and lines are chosen one by one by

    balance * centrality / (largest centrality) - (1 - balance) * (similarity to the nearest chosen line)

Scores, copies and frequencies are joins and partial aggregates over all messages; a
group's graph has at most ``candidates`` nodes whatever the group's size, so one
task solves it with a small matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.digest import DIGEST_K, idf, term_counts
from chatlake.session import ship_package

CANDIDATES = 40
RARE = 0.1          # a rare term is in at most this share of all messages
WALK = 0.85         # share of the walk that follows similarities; the rest starts anywhere
ROUNDS = 15
BALANCE = 0.3       # below a half: lines of a cluster of near copies raise each other's centrality
DIGITS = 9          # values are compared after rounding, ties go to the smaller id


def similarities(terms: list, weights: list) -> np.ndarray:
    """Cosines of sparse vectors, zero on the diagonal and for empty vectors."""
    names = {t: i for i, t in enumerate(sorted({t for ts in terms for t in ts}))}
    v = np.zeros((len(terms), len(names)))
    for row, ts, ws in zip(v, terms, weights):
        row[[names[t] for t in ts]] = ws
    norm = np.sqrt((v * v).sum(axis=1))
    v /= np.where(norm > 0, norm, 1)[:, None]
    sim = np.round(v @ v.T, DIGITS)
    np.fill_diagonal(sim, 0)
    return sim


def centrality(sim: np.ndarray, rounds: int = ROUNDS, walk: float = WALK) -> np.ndarray:
    n = len(sim)
    degree = sim.sum(axis=0)
    step = sim / np.where(degree > 0, degree, 1)
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        r = (1 - walk) / n + walk * (step @ r)
    return r


def choose(sim: np.ndarray, relevance: np.ndarray, k: int, balance: float = BALANCE) -> list[tuple[int, float]]:
    """(row, gain) of at most k rows, in the order they are chosen."""
    nearest, left, out = np.zeros(len(sim)), np.ones(len(sim), dtype=bool), []
    while left.any() and len(out) < k:
        gain = np.where(left, np.round(balance * relevance - (1 - balance) * nearest, DIGITS), -np.inf)
        best = int(gain.argmax())       # rows come by id, so the first of the largest is the smallest id
        out.append((best, float(gain[best])))
        left[best] = False
        nearest = np.maximum(nearest, sim[best])
    return out


def varied_messages(messages: DataFrame, group_cols: list[str], k: int = DIGEST_K, candidates: int = CANDIDATES,
                    balance: float = BALANCE) -> DataFrame:
    """Rows (groups..., digest_rank, id, copies, centrality, gain): the k lines of
    every group's digest.

    Messages without a term (NULL, empty, punctuation) are in no digest; a group
    of such messages alone, and an empty table, give no rows. A NULL group is a
    group. ``id`` must be unique.
    """
    ship_package(messages.sparkSession)
    names = [f"g{i}" for i in range(len(group_cols))]
    rows = messages.select("id", "message", *[F.col(c).alias(n) for c, n in zip(group_cols, names)])
    n_docs = rows.agg(F.count(F.lit(1))).scalar()
    tf = term_counts(rows, carry=names)
    frequencies = idf(tf, n_docs).select("term", "idf", (F.col("df") <= RARE * n_docs).alias("rare"))
    scored = tf.join(frequencies, "term").groupBy("id", *names).agg(
        F.round(F.sum(F.col("tf") * F.col("idf")) / F.sqrt(F.sum("tf")), DIGITS).alias("score"))
    # one line of each copy; the texts stay behind as 128 bits
    line = F.array_join(tx.terms("message"), " ")
    firsts = (rows.where(F.size(tx.terms("message")) > 0)
              .groupBy(*names, F.md5(F.encode(line, "UTF-8")).alias("line"))
              .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "copies"))
    best = Window.partitionBy(*names).orderBy(F.desc("score"), "id")
    picked = (scored.join(firsts, "id").withColumn("rank", F.row_number().over(best))
              .where(F.col("rank") <= candidates).select("id", "copies"))
    vectors = (term_counts(rows.join(picked, "id"), carry=[*names, "copies"]).join(frequencies, "term")
               .groupBy("id", *names, "copies")
               .agg(F.collect_list(F.when(F.col("rare"), F.struct("term", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
               .select(*names, "id", "copies", F.col("v.term").alias("terms"), F.col("v.w").alias("weights")))

    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        sim = similarities(list(pdf["terms"]), list(pdf["weights"]))
        r = centrality(sim)
        chosen = choose(sim, np.round(r / r.max(), DIGITS), k, balance)
        at = [i for i, _ in chosen]
        out = pdf.loc[at, [*names, "id", "copies"]].copy()
        out["digest_rank"] = range(1, len(at) + 1)
        out["centrality"] = r[at]
        out["gain"] = [g for _, g in chosen]
        return out[[*names, "digest_rank", "id", "copies", "centrality", "gain"]]

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    told = vectors.groupBy(*names).applyInPandas(
        digest, f"{kinds}, digest_rank int, id {rows.schema['id'].dataType.simpleString()}, copies long, centrality double, gain double")
    return told.select(*[F.col(n).alias(c) for c, n in zip(group_cols, names)], "digest_rank", "id", "copies",
                       F.round("centrality", 6).alias("centrality"), F.round("gain", 6).alias("gain"))
