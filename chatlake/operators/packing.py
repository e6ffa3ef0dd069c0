"""Greedy line packing over line *rows* of arbitrarily long documents (CH-2).

``chunks.pack_lines`` packs a text held in one row. A user's whole history
may be a third of all rows, so here the document stays as rows
(group, order..., line) and nothing ever holds a whole group.

Lines are cut into segments: a group, or where it has more than ``RANGE`` lines a range of its
order (``ids.bucketed``), in pieces of at most ``PIECE`` lines. A Python call takes many segments. What a segment does to a chunk that is open
before it depends only on the chunk's *room*, the tokens that it can still take
(``CLOSED``: none, the next line starts a chunk whatever its length). The
segment's transfer function gives, for every room, the room after it and the
chunks started in it. It is a step function below the segment's own
tokens; with more room than those no chunk starts and the room shrinks by them.

1. each segment computes its function from its token counts alone;
2. functions of ``FAN`` neighbours are composed, level by level, until one
   covers a group: one level for every factor ``FAN`` of the segments;
3. the true rooms go back down the levels, from the first line of each group;
4. each segment marks its chunk starts, and its lines get their chunk by a
   window over the segment. Parts are joined in the segment, then over segments.

Chunk numbers follow the reference: when the first line alone is over the
limit, chunk 0 is empty and gets no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.chunks import PACK_LIMIT
from chatlake.operators.ids import bucketed
from chatlake.session import checkpoint_root, default_parallelism, run_dir, ship_package, staged

PIECE = 1 << 16     # lines a segment holds at most
RANGE = 1 << 14     # lines a range of the order holds, as long as there are partitions for more ranges, and about those a Python call takes
FAN = 128           # functions composed in one group
CLOSED = -1         # room of a chunk that takes no further line

_FUNCTION = "g string, seg long, first_over boolean, total long, lo array<long>, room array<long>, started array<long>"
_ENTRY = "g string, seg long, entry long, chunk long"


def _steps(lo: np.ndarray, room: np.ndarray, started: np.ndarray) -> tuple:
    """Steps of a function without those that repeat the one before."""
    keep = np.ones(len(lo), dtype=bool)
    keep[1:] = (room[1:] != room[:-1]) | (started[1:] != started[:-1])
    return lo[keep], room[keep], started[keep]


def _chunk_ends(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before each line, and the line behind a chunk that starts at it."""
    after = np.cumsum(tokens)
    before = after - tokens
    ends = np.searchsorted(after, before + limit, side="right")
    return before, np.maximum(ends, np.arange(1, len(tokens) + 1))  # a chunk takes its first line, however long


def segment_function(tokens: np.ndarray, limit: int) -> tuple:
    """(total, lo, room, started) of a segment's lines."""
    before, ends = _chunk_ends(tokens, limit)
    n, total = len(tokens), int(tokens.sum())
    last = limit - (total - before)     # room that a chunk started at this line leaves, if it is the last one
    rooms = np.where(last < 0, CLOSED, last).tolist()
    counts = [1] * n
    for i, e in zip(range(n - 1, -1, -1), ends[::-1].tolist()):
        if e < n:
            rooms[i], counts[i] = rooms[e], counts[e] + 1
    # with room r the first start is the line that r + 1 tokens reach
    at = np.flatnonzero((tokens > 0) & (before <= limit))
    first = np.concatenate([[0], at])
    lo = np.concatenate([[CLOSED], before[at]])
    return (total, *_steps(lo, np.asarray(rooms)[first], np.asarray(counts)[first]))


def apply_function(total: int, lo, room, started, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rooms after a segment and chunks started in it, for rooms ``x`` before it."""
    i = np.searchsorted(np.asarray(lo), x, side="right") - 1
    through = (x != CLOSED) & (x >= total)
    return (np.where(through, x - total, np.asarray(room)[i]), np.where(through, 0, np.asarray(started)[i]))


def compose(functions: list[tuple], limit: int) -> tuple:
    """The function of segments that follow each other, as ``segment_function`` gives it."""
    total = sum(f[0] for f in functions)
    x = np.arange(CLOSED, min(total, limit + 1))    # with more room than the total no chunk starts
    room, started = x, np.zeros(len(x), dtype=np.int64)
    for f in functions:
        room, n = apply_function(*f, room)
        started = started + n
    return (total, *_steps(x, room, started))


def _functions(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(pdf["total"].tolist(), pdf["lo"], pdf["room"], pdf["started"]))


def _function_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["g", "seg", "first_over", "total", "lo", "room", "started"])


def _runs(pdf: pd.DataFrame, order: str, fan: int = 1) -> tuple[pd.DataFrame, list[tuple]]:
    """``pdf`` by group, segment and ``order``, and (group, seg // fan, from, to) of
    the rows of each group and segment block. A NULL group is a group."""
    code = pd.factorize(pdf["g"])[0]
    at = np.lexsort((pdf[order].to_numpy(), pdf["seg"].to_numpy(), code))
    pdf, code = pdf.iloc[at], code[at]
    block = pdf["seg"].to_numpy() // fan
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *cuts.tolist(), len(code)] if len(code) else [0]
    g, n = _names(pdf), block.tolist()
    return pdf, [(g[i], n[i], i, j) for i, j in zip(edges, edges[1:])]


def _names(pdf: pd.DataFrame) -> list:
    return [None if x else g for g, x in zip(pdf["g"].tolist(), pdf["g"].isna().tolist())]


def _segment_rows(pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    pdf, runs = _runs(pdf, "rn")
    tokens = pdf["t"].to_numpy()
    return _function_rows([(g, seg, tokens[i] > limit, *segment_function(tokens[i:j], limit)) for g, seg, i, j in runs])


def _composed_rows(pdf: pd.DataFrame, limit: int, fan: int) -> pd.DataFrame:
    pdf, runs = _runs(pdf, "seg", fan)
    functions, over = _functions(pdf), pdf["first_over"].tolist()
    return _function_rows([(g, block, over[i], *compose(functions[i:j], limit)) for g, block, i, j in runs])


def _open_chunks(entries: pd.DataFrame) -> dict:
    """(group, seg) -> (room, number of the open chunk)."""
    return dict(zip(zip(_names(entries), entries["seg"].tolist()), zip(entries["entry"].tolist(), entries["chunk"].tolist())))


def _entries(children: pd.DataFrame, parents: pd.DataFrame | None = None, fan: int = 1 << 62) -> pd.DataFrame:
    """The room before each child and the number of its open chunk, from those
    of the parents (none: the groups begin here)."""
    children, runs = _runs(children, "seg", fan)
    known = None if parents is None else _open_chunks(parents)
    functions, over, segs = _functions(children), children["first_over"].tolist(), children["seg"].tolist()
    rows = []
    for g, block, i, j in runs:
        room, chunk = (CLOSED, int(over[i]) - 1) if known is None else known[g, block]
        for k in range(i, j):
            rows.append((g, segs[k], room, chunk))
            after, n = apply_function(*functions[k], np.array([room]))
            room, chunk = int(after[0]), chunk + int(n[0])
    return pd.DataFrame(rows, columns=["g", "seg", "entry", "chunk"])


def _marks(lines: pd.DataFrame, entries: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Chunk starts of segments, by line number; the chunk that is open before
    a segment starts at its line 0."""
    lines, runs = _runs(lines, "rn")
    known, all_tokens, all_rn = _open_chunks(entries), lines["t"].to_numpy(), lines["rn"].tolist()
    rows = []
    for g, seg, i, j in runs:
        tokens = all_tokens[i:j]
        ends = _chunk_ends(tokens, limit)[1].tolist()
        room, chunk = known[g, seg]
        at = 0 if room == CLOSED else int(np.searchsorted(np.cumsum(tokens), room, side="right"))
        rows.append((g, seg, 0, chunk))
        while at < len(tokens):
            chunk += 1
            rows.append((g, seg, all_rn[i + at], chunk))
            at = ends[at]
    return pd.DataFrame(rows, columns=["g", "seg", "rn", "j"])


def _part(n: int, *keys):
    """One of ``n`` parts that whole groups or segments are dealt to: a Python call takes a part."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).alias("part")


def _chunk_entries(functions: DataFrame, top: int, limit: int, fan: int) -> DataFrame:
    """Entries of the segments 0 to ``top`` of each group: functions are composed
    up to one level that ``fan`` nodes cover, and rooms go down again."""
    spark = functions.sparkSession
    levels, parts = [functions], [1 + functions.count() // FAN]
    block = F.floor(F.col("seg") / fan).cast("long")
    while top >= fan:
        path = run_dir(spark, "pack-functions")
        (levels[-1].groupBy(_part(parts[-1], "g", block)).applyInPandas(lambda pdf: _composed_rows(pdf, limit, fan), _FUNCTION)
         .write.parquet(path))
        levels.append(spark.read.parquet(path))
        parts.append(1 + levels[-1].count() // FAN)
        top //= fan
    entries = levels.pop().groupBy(_part(parts.pop(), "g")).applyInPandas(lambda pdf: _entries(pdf), _ENTRY)
    while levels:
        n = parts.pop()
        entries = (levels.pop().groupBy(_part(n, "g", block)).cogroup(entries.groupBy(_part(n, "g", "seg")))
                   .applyInPandas(lambda children, parents: _entries(children, parents, fan), _ENTRY))
    return entries


def pack_line_rows(lines: DataFrame, group_col: str, order_cols: list[str], line_col: str,
                   max_tokens: int = PACK_LIMIT, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """Rows (group, chunk_no, chunk, n_tokens) of the greedy packing of each
    group's lines in ``order_cols`` order, which must be unique in the group.

    Empty lines are kept, also any number of them. NULL lines are no lines. A
    NULL group is a group. An empty table gives no rows.
    """
    spark = lines.sparkSession
    checkpoint_root(spark)
    ship_package(spark)
    limit = int(max_tokens)
    base = lines.where(F.col(line_col).isNotNull()).select(
        F.col(group_col).cast("string").alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)],
        F.col(line_col).alias("line"), tx.token_count(line_col).cast("long").alias("t"))
    order = [f"o{i}" for i in range(len(order_cols))]
    rn = F.row_number().over(Window.partitionBy("g", "_cl_bucket").orderBy(*order)).cast("long")
    path = run_dir(spark, "pack-lines")
    with staged(base, "pack-base") as base:     # counted, split at quantiles and numbered: several passes
        # small segments cost more than they spread: only groups of many lines are cut to ranges
        large = base.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > RANGE).select(
            F.col("g").alias("large_g"), F.lit(True).alias("is_large"))
        many = not large.isEmpty()
        cut = bucketed(base, order[0], min(default_parallelism(spark), 1 + base.count() // RANGE) if many else 1,
                       tie_col=order[1] if len(order) > 1 else None)
        if many:
            cut = cut.join(F.broadcast(large), F.col("g").eqNullSafe(F.col("large_g")), "left").withColumn(
                "_cl_bucket", F.when(F.col("is_large"), F.col("_cl_bucket")).otherwise(0.0))
        (cut.select("g", F.col("_cl_bucket").cast("long").alias("bucket"), rn.alias("rn"), "line", "t")
         .write.parquet(path))
    numbered = spark.read.parquet(path)
    last = numbered.agg(F.max("bucket").alias("bucket"), F.max("rn").alias("rn")).first()
    if last.rn is None:
        return numbered.select(F.col("g").alias(group_col), F.col("rn").alias("chunk_no"), F.col("line").alias("chunk"),
                               F.col("t").alias("n_tokens"))
    pieces = (last.rn - 1) // piece + 1
    seg = (F.col("bucket") * pieces + F.floor((F.col("rn") - 1) / piece)).cast("long")
    numbered = numbered.withColumn("seg", seg)
    top = last.bucket * pieces + pieces - 1

    tokens = numbered.select("g", "seg", "rn", "t")
    path = run_dir(spark, "pack-functions")
    part = _part(1 + numbered.count() // RANGE, "g", "seg")
    tokens.groupBy(part).applyInPandas(lambda pdf: _segment_rows(pdf, limit), _FUNCTION).write.parquet(path)
    entries = _chunk_entries(spark.read.parquet(path), top, limit, fan)
    marks = (tokens.groupBy(part).cogroup(entries.groupBy(part))
             .applyInPandas(lambda lines, entry: _marks(lines, entry, limit), "g string, seg long, rn long, j long"))

    # a mark stands before the line that starts its chunk
    both = marks.select("g", "seg", "rn", F.lit(0).alias("is_line"), "j", F.lit(None).cast("string").alias("line"),
                        F.lit(0).cast("long").alias("t")).unionByName(
        numbered.select("g", "seg", "rn", F.lit(1).alias("is_line"), F.lit(None).cast("long").alias("j"), "line", "t"))
    so_far = Window.partitionBy("g", "seg").orderBy("rn", "is_line")
    told = both.withColumn("j", F.last("j", ignorenulls=True).over(so_far)).where("is_line = 1")
    parts = told.groupBy("g", "seg", "j").agg(_joined("rn", "line").alias("part"), F.sum("t").alias("t"))
    return (parts.groupBy("g", "j").agg(_joined("seg", "part").alias("chunk"), F.sum("t").alias("n_tokens"))
            .select(F.col("g").alias(group_col), F.col("j").alias("chunk_no"), "chunk", "n_tokens"))


def _joined(by: str, value: str):
    """Values of a group joined by line feeds in the order of ``by``."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, value))), lambda x: x[value]), "\n")
