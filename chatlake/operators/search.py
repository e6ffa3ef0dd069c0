"""Exact cosine vector search, its ±2 context and the text blocks (CMD-8).

Single query: one scan, cheap filters first (they reach the parquet scan),
cosine as a JVM expression, strict threshold, then a bounded top-k
(TakeOrderedAndProject). Many queries: Arrow batches through BLAS with a
per-partition top-k, then a per-query top-k whose partial WindowGroupLimit
runs before the shuffle, so the shuffle carries at most k rows per query per
partition whatever the skew.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import text as tx
from chatlake.functions import vectors as vx
from chatlake.operators.ingest import ID_BLOCK, default_embed
from chatlake.session import ship_package

TOP_K = 20          # results kept
THRESHOLD = 0.3     # similarity must be strictly greater
CONTEXT = 2         # ids on each side, same channel, inclusive
SHARD_ROWS = 16384  # messages whose vectors a batch search task holds


def _message_filters(df: DataFrame, bot_name, mention, exclude_channels) -> DataFrame:
    if bot_name is not None:
        df = df.where(F.col("sender") != F.lit(bot_name))
    if mention:
        df = df.where(~F.col("message").contains(F.lit(mention)))
    if exclude_channels:
        df = df.where(~F.col("channel").isin(list(exclude_channels)))
    return df


def vector_search(history: DataFrame, query, k: int = TOP_K, threshold: float = THRESHOLD,
                  bot_name: str | None = None, mention: str | None = None,
                  exclude_channels=()) -> DataFrame:
    """Top-k messages by cosine similarity to ``query``: a list of floats (the
    embedded question; constant-folded with its norm) or an array Column of
    the same rows. Spark rejects a scalar subquery inside the higher-order
    functions, so a query held in a table is passed as its values, or through
    ``vector_search_batch``.

    Output: hit_rank, id, role, content, similarity (6 places), timestamp
    (epoch seconds), channel. Zero vectors have no similarity and are dropped.
    Ties are broken by id.
    """
    if isinstance(query, Column):
        q, q_norm = query, vx.norm(query)
    else:
        vals = [float(x) for x in query]
        q = F.array(*[F.lit(v).cast("double") for v in vals])
        q_norm = F.lit(math.sqrt(sum(v * v for v in vals)))
    h = _message_filters(history, bot_name, mention, exclude_channels)
    v_norm = F.col("norm") if "norm" in history.columns else vx.norm("vector")
    # NaN -> NULL so it can neither pass the threshold nor sort first
    sim = F.nanvl(vx.cosine("vector", q, v_norm, q_norm), F.lit(None).cast("double"))
    scored = h.select("id", "ts", "sender", "channel", "message", sim.alias("sim"))
    # The threshold is monotone in the sort key: the rows above it are a
    # prefix of the ranking, so it is applied to the k survivors. A filter
    # on the score before the top-k would be pushed below the projection and
    # evaluate the cosine several times per row.
    top = (scored.orderBy(F.desc_nulls_last("sim"), F.asc("id")).limit(k)
           .where(F.col("sim") > threshold))
    return top.select(
        F.row_number().over(Window.orderBy(F.desc("sim"), F.asc("id"))).alias("hit_rank"),
        "id", F.col("sender").alias("role"), F.col("message").alias("content"),
        F.round("sim", 6).alias("similarity"),
        F.unix_timestamp("ts").alias("timestamp"), "channel")


_HIT_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("sim", T.DoubleType()),
])


def _topk_in_partition(qids: np.ndarray, qmat: np.ndarray, k: int, threshold: float,
                       chunk: int = 256):
    """mapInPandas body: running exact top-k per query over this partition."""
    qn = np.linalg.norm(qmat, axis=1)

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf["id"].to_numpy(dtype=np.int64)
            mat = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            vn = np.linalg.norm(mat, axis=1)
            for s in range(0, len(qids), chunk):
                qs = slice(s, s + chunk)
                with np.errstate(divide="ignore", invalid="ignore"):
                    sims = (mat @ qmat[qs].T) / np.outer(vn, qn[qs])
                ok = np.isfinite(sims) & (sims > threshold)
                masked = np.where(ok, sims, -np.inf)
                # per query, keep rows at or above its k-th best score (ties
                # included, so the id tie-break below stays exact)
                kk = min(k, masked.shape[0])
                kth = np.partition(masked, masked.shape[0] - kk, axis=0)[masked.shape[0] - kk]
                keep = ok & (masked >= kth)
                for j in np.nonzero(keep.any(axis=0))[0]:
                    rows = np.nonzero(keep[:, j])[0]
                    cand_ids, cand_sims = ids[rows], sims[rows, j]
                    qid = int(qids[s + j])
                    if qid in best:
                        cand_ids = np.concatenate([best[qid][0], cand_ids])
                        cand_sims = np.concatenate([best[qid][1], cand_sims])
                    order = np.lexsort((cand_ids, -cand_sims))[:k]
                    best[qid] = (cand_ids[order], cand_sims[order])
        if best:
            yield pd.DataFrame({
                "qid": np.concatenate([np.full(len(v[0]), q, dtype=np.int64) for q, v in best.items()]),
                "id": np.concatenate([v[0] for v in best.values()]),
                "sim": np.concatenate([v[1] for v in best.values()]),
            })
    return run


def _sharded(k: int, threshold: float):
    """Rows sorted by (shard, kind) to hits: a shard's messages (kind 0) are
    held, its queries (kind 1) stream past them."""
    def run(batches):
        shard, held = None, []
        for b in batches:
            for (s, kind), rows in b.groupby(["shard", "kind"], sort=True):
                if s != shard:
                    shard, held = s, []
                if kind == 0:
                    held.append(rows[["id", "vector"]])
                elif held:
                    held = [pd.concat(held, ignore_index=True)]
                    qmat = np.stack(rows["vector"].to_numpy()).astype(np.float64)
                    yield from _topk_in_partition(rows["id"].to_numpy(np.int64), qmat, k, threshold)(iter(held))
    return run


def vector_search_batch(history: DataFrame, queries: DataFrame, k: int = TOP_K,
                        threshold: float = THRESHOLD, bot_name: str | None = None,
                        mention: str | None = None, exclude_channels=(),
                        shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Top-k per query for a table of queries (qid, vector) (J-3, [ext]).

    One plan for any number of queries: messages are dealt into shards of
    about ``shard_rows``, the queries go to every shard, and a task holds one
    shard's vectors while the queries stream past in Arrow batches. Nothing is
    broadcast or fetched to the driver but the message count. Output: qid,
    hit_rank, id, role, content, similarity, timestamp, channel.
    """
    ship_package(history.sparkSession)
    h = _message_filters(history, bot_name, mention, exclude_channels)
    shards = max(1, -(-h.count() // shard_rows))
    vector = F.col("vector").cast("array<double>").alias("vector")
    held = h.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"),
                    F.col("id").cast("long").alias("id"), vector)
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
                           F.lit(1).alias("kind"), F.col("qid").cast("long").alias("id"), vector)
    rows = held.unionAll(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc("id"))
    ranked = (rows.mapInPandas(_sharded(k, threshold), _HIT_SCHEMA)
              .withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= k))
    info = history.select("id", "ts", "sender", "channel", "message")
    return (info.join(ranked, "id")
            .select("qid", "hit_rank", "id", F.col("sender").alias("role"),
                    F.col("message").alias("content"), F.round("sim", 6).alias("similarity"),
                    F.unix_timestamp("ts").alias("timestamp"), "channel"))


def embed_question(spark, question: str, embed=default_embed) -> list[float]:
    """The vector of a text question, normalised and embedded as stored messages
    are (U-1, CMD-8): one row of the embedding's length."""
    row = spark.range(1).select(F.lit(question).alias("q")).select(embed(tx.normalize("q")).alias("v")).first()
    return [float(x) for x in row["v"]]


def search_text(store: DataFrame, question: str, embed=default_embed, **how) -> DataFrame:
    """``vector_search`` of a stored history for a text question, by the stored
    vectors and norms. A question without terms finds nothing."""
    return vector_search(store, embed_question(store.sparkSession, question, embed), **how)


def search_context(history: DataFrame, hits: DataFrame, width: int = CONTEXT) -> DataFrame:
    """Each hit's conversation: rows of the same channel with id in
    [hit-width, hit+width] (J-1, PF-14). Context rows are not filtered, and
    overlapping contexts are not merged.

    The band is expanded into 2*width+1 keys per hit and equi-joined on
    (id, channel): no range join, no per-hit query. The join is left to
    adaptive execution, which broadcasts only a side measured small.
    """
    qkeys = [c for c in ("qid",) if c in hits.columns]
    band = hits.select(*qkeys, "hit_rank", F.col("id").alias("hit_id"), "channel",
                       F.explode(F.sequence(F.col("id") - width, F.col("id") + width)).alias("id"))
    on = ["id", "channel"]
    cols = ["id", "ts", "sender", "channel", "message"]
    if "id_block" in history.columns:
        # stored layout: partitions by id block -> dynamic partition pruning
        band = band.withColumn("id_block", F.floor(F.col("id") / ID_BLOCK).cast("long"))
        on, cols = ["id_block"] + on, ["id_block"] + cols
    return (history.select(*cols)
            .join(band, on)
            .select(*qkeys, "hit_rank", "hit_id", "id", F.col("sender").alias("role"),
                    F.col("message").alias("content"), tx.iso_text("ts").alias("timestamp"),
                    "channel"))


def context_window(history: DataFrame, width: int = CONTEXT, cell: int = 1024) -> DataFrame:
    """±width context of every row (W-3) without a per-channel window.

    A window partitioned by channel would put a hot channel in one task. Rows
    are cut into cells of ``cell`` consecutive ids, and those within ``width``
    of a border go to the next cell too, so a window over (channel, cell) sees
    all neighbours: one shuffle of about the history's size.
    """
    at = lambda c: F.floor(c / F.lit(cell))
    i = F.col("id")
    rows = history.select("id", "channel", at(i).alias("own"),
                          F.explode(F.array_distinct(F.array(at(i - width), at(i), at(i + width)))).alias("cell"))
    w = Window.partitionBy("channel", "cell").orderBy("id").rangeBetween(-width, width)
    return (rows.select("id", "channel", "own", "cell", F.count(F.lit(1)).over(w).alias("n_context"),
                        F.array_join(F.sort_array(F.collect_list("id").over(w)), ",").alias("context_ids"))
            .where("own = cell").select("id", "channel", "n_context", "context_ids"))


def search_document(context: DataFrame) -> DataFrame:
    """The texts made from a search's conversations. One bounded row.

    ``document`` is the block form handed to the relevance check (STR-4):
    per hit, 'role (timestamp): content' lines in id order, each block closed
    by '==='. ``results_text`` is the answer command's form (CMD-4, D3: the
    conversations flattened): 'role: content' of every context row in (hit,
    id) order, joined by blank lines.
    """
    lines = context.select("hit_rank", "id",
                           F.concat("role", F.lit(" ("), "timestamp", F.lit("): "), "content")
                           .alias("l"),
                           F.concat("role", F.lit(": "), "content").alias("r"))
    blocks = lines.groupBy("hit_rank").agg(
        F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "l"))),
                                          lambda s: F.concat(s["l"], F.lit("\n"))), ""),
                 F.lit("===\n")).alias("block"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "r"))),
                                 lambda s: s["r"]), "\n\n").alias("flat"),
        F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("hit_rank", "block", "flat")))
    return blocks.agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.array_join(F.transform(ordered, lambda s: s["block"]), ""), F.lit(""))
        .alias("document"),
        F.coalesce(F.array_join(F.transform(ordered, lambda s: s["flat"]), "\n\n"), F.lit(""))
        .alias("results_text"))
