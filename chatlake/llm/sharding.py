"""Shards of near-equal bytes by histogram sort (native).

Rows get the key (hash of the text, hash of the id, a number of their own). Split points between the
shards come from probing: a round counts, in one aggregate over all partitions,
the exact bytes between candidate boundaries, and the next round probes only
inside the span that holds a wanted boundary. A boundary is settled once the
bytes below it are within ``tolerance`` of the wanted number, or its span holds
a single row. Equal texts have neighbouring keys, so they part only where a
boundary cannot fall beside them within the tolerance, and repeated rows (equal
text and id) by their own numbers. Then every row moves once.
"""

from __future__ import annotations

import bisect
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import cols, fresh, without, written

TOP = (1 << 63) - 1
PROBES = 1024


def _spread(c: Column) -> Column:
    """A non-negative 63-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(c), 1)


PARTS = ("k1", "k2", "k3")


def _round(keys: DataFrame, spans: list[tuple]) -> dict[tuple, list[tuple[int, int]]]:
    """Bytes and rows in each probe cell of every span: one aggregate, whose
    result has at most PROBES rows a span. A span is (prefix, lo, hi): keys that
    begin with the parts of ``prefix`` and whose next part lies in lo..hi."""
    span, cell = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (prefix, lo, hi) in enumerate(spans):
        part = PARTS[len(prefix)]
        inside = F.col(part).between(lo, hi)
        for own, value in zip(PARTS, prefix):
            inside &= F.col(own) == value
        span = F.when(inside, F.lit(i)).otherwise(span)
        cell = F.when(inside, F.expr(f"({part} - {lo}) div {_step(lo, hi)}")).otherwise(cell)
    got = (keys.select(span.alias("span"), cell.alias("cell"), "size").where("span IS NOT NULL")
           .groupBy("span", "cell").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect())
    out: dict[tuple, list] = {s: [] for s in spans}
    for r in sorted(got, key=lambda r: (r["span"], r["cell"])):
        out[spans[r["span"]]].append((r["cell"], r["b"], r["n"]))
    return out


def _step(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo + 1) // PROBES))


def split_points(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[tuple[int, int, int]], int]:
    """Boundaries between ``shards`` shards of the table (k1, k2, k3, size), and its
    rows. The driver holds at most PROBES counts for each open boundary."""
    whole = ((), 0, TOP)
    cells = _round(keys, [whole])[whole]
    total, rows = sum(b for _, b, _ in cells), sum(n for _, _, n in cells)
    if not rows:
        return [], 0
    wanted = {j: total * j / shards for j in range(1, shards)}
    slack = tolerance * total / shards
    points: dict[int, tuple[int, int, int]] = {}
    open_ = {j: (whole, 0) for j in wanted}     # boundary: span, bytes below it
    counts = {whole: cells}
    while open_:
        after = {}
        for j, (span, below) in open_.items():
            prefix, lo, hi = span
            step = _step(lo, hi)
            ends = list(itertools.accumulate((b for _, b, _ in counts[span]), initial=below))
            i = min(max(bisect.bisect_right(ends, wanted[j]) - 1, 0), len(counts[span]) - 1)
            cell = counts[span][i][0]
            a, z = lo + cell * step, min(hi, lo + (cell + 1) * step - 1)
            gaps = (abs(wanted[j] - ends[i]), abs(wanted[j] - ends[i + 1]))
            if min(gaps) <= slack or (len(prefix) == 2 and a == z):
                edge = a if gaps[0] <= gaps[1] else z + 1
                points[j] = (*prefix, edge, 0, 0)[:3]
            elif a < z:
                after[j] = ((prefix, a, z), ends[i])
            else:                                # one value of this part: its next parts
                after[j] = (((*prefix, a), 0, TOP), ends[i])
        open_ = after
        counts = _round(keys, sorted({s for s, _ in open_.values()}, key=str)) if open_ else {}
    return [points[j] for j in sorted(points)], rows


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size (long), shard (int) and slot (long, gapless from 0 in a
    shard). Columns of these names in the input are replaced; others stay.

    A NULL text has size 1 (the plus one alone) and an empty text too. NULL ids
    are ordinary keys. Rows with equal id and text, whatever their other columns,
    are parted by a number that each row gets when the table is written, so any
    number of them keeps the shards even. An empty table gives no rows.
    """
    docs = without(docs, "size", "shard", "slot")
    k1, k2, k3, bin_, at = fresh(docs, "k1", "k2", "k3", "bin", "at")
    text, id_ = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    # written, so that a row keeps its number however often it is read
    rows_ = written(docs.select(*cols(docs), size.alias("size"), _spread(text).alias(k1), _spread(id_).alias(k2),
                                _spread(F.monotonically_increasing_id()).alias(k3)), "shard-rows")
    keys = rows_.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(k3).alias("k3"), "size")
    points, rows = split_points(keys, shards, tolerance)

    def place(a: Column, b: Column, c: Column) -> Column:
        n = F.lit(0)
        for p, q, r in points:
            n = n + F.when((a > p) | ((a == p) & ((b > q) | ((b == q) & (c >= r)))), 1).otherwise(0)
        return n.cast("int")

    # slots: rows are numbered within small even bins of a shard, after the rows
    # of the bins before; a row's own number spreads rows of one id or text
    bins = min(65536, max(1, math.ceil(rows / shards / 512)))
    in_bin = lambda c: F.pmod(F.shiftright(c, 7), F.lit(bins)).cast("int")
    counted = (keys.select(place(F.col("k1"), F.col("k2"), F.col("k3")).alias("shard"), in_bin(F.col("k3")).alias(bin_))
               .groupBy("shard", bin_).count())
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(bin_)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("shard", bin_, F.coalesce(before, F.lit(0)).alias(at))
    placed = rows_.withColumns({"shard": place(F.col(k1), F.col(k2), F.col(k3)), bin_: in_bin(F.col(k3))})
    number = F.row_number().over(Window.partitionBy("shard", bin_).orderBy(k3))
    return (placed.join(starts, ["shard", bin_])
            .withColumn("slot", (F.col(at) + number - 1).cast("long"))
            .select(*cols(docs), "size", "shard", "slot"))
