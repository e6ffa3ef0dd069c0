"""Message ingest: normalise, embed, number and append (SNK-1, SNK-5, W-2, U-1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import text as tx
from chatlake.functions import vectors as vx
from chatlake.operators.ids import dense_ids

EMBED_DIM = 64
ID_BLOCK = 1 << 24   # ids per storage partition of chat_history (id_block = id div ID_BLOCK)


def default_embed(text) -> Column:
    return vx.hashed_tf(text, EMBED_DIM)


def model_embed(load_model: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Embedding hook for a trained sentence model (U-1).

    ``load_model`` runs once per Python worker (iterator pandas UDF) and
    returns an ``encode(list_of_texts) -> 2-D array`` function; whole Arrow
    batches are encoded at once.
    """
    from pyspark.sql import SparkSession
    from chatlake.session import ship_package
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load_model()
        for s in batches:
            vecs = encode(s.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32).tolist() for v in vecs])
    return embed


def prepare(messages: DataFrame, embed: Callable[[Column], Column] = default_embed) -> DataFrame:
    """Normalise the text and attach vector and norm (the stored norm lets a
    search skip one dot product per row)."""
    norm_msg = tx.normalize("message")
    out = messages.withColumn("message", norm_msg)
    out = out.withColumn("vector", embed(F.col("message")))
    return out.withColumn("norm", vx.norm("vector"))


def next_id(store: DataFrame | None) -> Column:
    """max(id) + 1 of the store as a scalar subquery (0 for an empty store)."""
    if store is None:
        return F.lit(0).cast("long")
    return F.coalesce(store.agg(F.max("id")).scalar() + 1, F.lit(0).cast("long"))


def ingest(messages: DataFrame, store: DataFrame | None,
           order_cols=("ts", "source_id"), embed=default_embed, start=None) -> DataFrame:
    """Rows to append: prepared messages numbered after the store's last id
    (or from ``start`` when the caller tracks it).

    Ids are dense and follow ``order_cols`` (which must be unique), assigned
    without a single-task window.
    """
    prepared = prepare(messages, embed)
    first = next_id(store) if start is None else start
    return dense_ids(prepared, list(order_cols), "id", start=first)
