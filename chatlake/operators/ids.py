"""Dense ascending ids and dense per-group positions without a single task.

``row_number() OVER (ORDER BY ...)`` with no partition runs in one task, and a
window partitioned by a hot key puts that key in one task. Here rows are cut
into buckets along the leading order key at fixed split points (approximate
quantiles, computed once: ``buckets`` numbers come back to the driver), so a
bucket is a pure function of the row and every recomputation after an
executor loss gives the same numbering. Rows are numbered inside their
bucket by a window partitioned by the bucket (balanced, since the buckets are
quantiles), and a tiny per-bucket count table gives the offsets.

The order key must be unique for the numbering to be deterministic.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.session import default_parallelism

_KEY, _BKT, _N, _OFF, _RN = "_cl_key", "_cl_bucket", "_cl_n", "_cl_off", "_cl_rn"


def _common_bytes(df: DataFrame, col: str) -> int:
    """Leading UTF-8 bytes that all values of a string column share: those that
    the smallest and the largest share."""
    b = F.encode(F.col(col), "UTF-8")
    low, high = df.agg(F.min(b), F.max(b)).first()
    return 0 if low is None else len(os.path.commonprefix([bytes(low), bytes(high)]))


def _numeric_key(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dtype, T.DateType):
        c = F.unix_date(c)
    elif isinstance(dtype, T.StringType):
        # 6 UTF-8 bytes behind the prefix that all values share, zero-padded, as
        # a number: monotone in the (binary UTF-8) string order, so buckets
        # never reorder rows
        head = F.hex(F.substring(F.encode(c, "UTF-8"), 1 + _common_bytes(df, col), 6))
        c = F.conv(F.rpad(head, 12, "0"), 16, 10).cast("long")
    return F.coalesce(c.cast("double"), F.lit(float("-inf")))


def _splits(qs: list[float]) -> list[float]:
    inner = sorted({q for q in qs if q not in (float("inf"), float("-inf"))})
    return [float("-inf")] + inner + [float("inf")] if inner else []


def bucketed(df: DataFrame, key_col: str, buckets: int | None = None,
             rel_error: float | None = None, tie_col: str | None = None) -> DataFrame:
    """Add ``_cl_bucket``: an order-preserving bucket of (key_col, tie_col).

    Split points are approximate quantiles of ``key_col``, with the error (a
    fraction of all rows) kept at a tenth of a bucket so buckets stay
    balanced however many there are.

    A single key value can still hold many buckets' worth of rows (a bulk
    import stamped with one time). Such hot values show up as repeated
    quantiles; their rows are split again by quantiles of ``tie_col``. A hot
    value is always the lowest key of its bucket (it is a split point), so
    its rows come first there and the refined order is still (key, tie).
    """
    spark = df.sparkSession
    n = buckets or default_parallelism(spark)
    if rel_error is None:
        rel_error = min(0.001, 0.1 / max(n, 1))
    keyed = df.withColumn(_KEY, _numeric_key(df, key_col))
    probs = [i / n for i in range(1, n)]
    qs = keyed.approxQuantile(_KEY, probs, rel_error) if n > 1 else []
    splits = _splits(qs)
    if not splits:   # empty, one-row or constant input: a single bucket
        out = keyed.withColumn(_BKT, F.lit(0.0))
    else:
        out = Bucketizer(splits=splits, inputCol=_KEY, outputCol=_BKT,
                         handleInvalid="keep").transform(keyed)
    hot = sorted({q for q in qs if qs.count(q) > 1})
    if tie_col is not None and hot:
        share = sum(qs.count(h) for h in hot)          # buckets' worth of hot rows
        is_hot = F.col(_KEY).isin(hot)
        tie = _numeric_key(df, tie_col)
        sub_probs = [i / (share + 1) for i in range(1, share + 1)]
        sq = keyed.where(is_hot).select(tie.alias("_t")).approxQuantile(
            "_t", sub_probs, min(0.001, 0.1 / (share + 1)))
        sub = _splits(sq)
        if sub:
            width = len(sub)     # sub buckets 0..len(sub)-2; non-hot rows after them
            out = out.withColumn("_cl_tie", F.when(is_hot, tie).otherwise(F.lit(float("inf"))))
            out = Bucketizer(splits=sub, inputCol="_cl_tie", outputCol="_cl_sub",
                             handleInvalid="keep").transform(out)
            out = (out.withColumn(_BKT, F.col(_BKT) * width + F.col("_cl_sub"))
                   .drop("_cl_tie", "_cl_sub"))
    return out.drop(_KEY)


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "id",
              start=0, buckets: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + 0-based rank of the row in ``order_cols`` order (W-2).

    ``start`` may be a Column (for example the store's max id + 1 as a scalar
    subquery).
    """
    b = bucketed(df, order_cols[0], buckets,
                 tie_col=order_cols[1] if len(order_cols) > 1 else None)
    counts = b.groupBy(_BKT).agg(F.count(F.lit(1)).alias(_N))
    # one row per bucket: an ordered running sum over them is cheap
    offsets = counts.select(_BKT, F.coalesce(
        F.sum(_N).over(Window.orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias(_OFF))
    ranked = b.withColumn(_RN, F.row_number().over(Window.partitionBy(_BKT).orderBy(*order_cols)))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (ranked.join(offsets, _BKT)
            .withColumn(id_col, (start_col + F.col(_OFF) + F.col(_RN) - 1).cast("long"))
            .drop(_BKT, _OFF, _RN))


def group_positions(df: DataFrame, group_col: str, order_col, pos_col: str = "pos",
                    buckets: int | None = None, sum_col=None, cum_col="cum", total_col=None) -> DataFrame:
    """Add ``pos_col`` = 1-based position of the row in its group by
    ``order_col`` (a column name or a list: lexicographic order), and with
    ``sum_col`` (a name or a list) also ``cum_col`` (name or list) = running
    sums of those columns up to and including the row; ``total_col`` (name or
    list) are their sums over the group.

    Skew-safe: buckets follow the global order key (the first order column,
    hot values of it split again by the second), so a group holding a third
    of all rows is split over many (group, bucket) windows. The offsets table
    has one row per (group, bucket) present.
    """
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    sums = [] if sum_col is None else ([sum_col] if isinstance(sum_col, str) else list(sum_col))
    cums = [cum_col] if isinstance(cum_col, str) else list(cum_col)
    totals = [] if total_col is None else ([total_col] if isinstance(total_col, str) else list(total_col))
    b = bucketed(df, order[0], buckets, tie_col=order[1] if len(order) > 1 else None)
    aggs = [F.count(F.lit(1)).alias(_N)] + [F.sum(c).alias(f"_cl_s{i}") for i, c in enumerate(sums)]
    counts = b.groupBy(group_col, _BKT).agg(*aggs)
    w = Window.partitionBy(group_col).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group_col, _BKT, F.coalesce(F.sum(_N).over(w), F.lit(0)).alias(_OFF),
                            *[F.coalesce(F.sum(f"_cl_s{i}").over(w), F.lit(0)).alias(f"_cl_o{i}")
                              for i in range(len(sums))],
                            *[F.sum(f"_cl_s{i}").over(Window.partitionBy(group_col)).alias(c) for i, c in enumerate(totals)])
    inner = Window.partitionBy(group_col, _BKT).orderBy(*order)
    ranked = b.withColumn(_RN, F.row_number().over(inner))
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    for i, c in enumerate(sums):
        ranked = ranked.withColumn(f"_cl_r{i}", F.sum(c).over(run))
    out = (ranked.join(offsets, [group_col, _BKT])
           .withColumn(pos_col, (F.col(_OFF) + F.col(_RN)).cast("long")))
    for i, name in enumerate(cums[:len(sums)]):
        out = out.withColumn(name, F.col(f"_cl_o{i}") + F.col(f"_cl_r{i}"))
    drop = [_BKT, _OFF, _RN] + [f"_cl_{k}{i}" for i in range(len(sums)) for k in ("o", "r")]
    return out.drop(*drop)
