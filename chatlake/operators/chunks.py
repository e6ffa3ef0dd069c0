"""Splitting long text to budgets and putting it back together (CH-1..4).

Every operator works on whole texts, one row per text, so the work spreads
with the rows. Fixed 2000-character pieces and greedy line packing are pure
Column expressions; the recursive bisection, whose cut points depend on token
counts of halves of halves, is an Arrow-batched pandas UDF with a short loop.
"""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlake.functions import text as tx
from chatlake.session import ship_package

PIECE_CHARS = 2000     # reply piece size
BISECT_LIMIT = 2048    # halve while the whitespace token count is strictly greater
PACK_LIMIT = 10000     # a chunk takes lines while its token total stays <= this


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pieces(text, size: int = PIECE_CHARS) -> Column:
    """Array of consecutive ``size``-character pieces; at least one (CH-3)."""
    t = _c(text)
    n = F.greatest(F.lit(1), F.ceil(F.length(t) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1),
                       lambda i: F.substring(t, i * size + 1, size))


def reply_pieces(df: DataFrame, keys: list[str], text_col: str,
                 size: int = PIECE_CHARS) -> DataFrame:
    """Rows (keys..., pos, piece) of a text cut to ``size`` characters (SNK-10)."""
    return df.select(*keys, F.posexplode(pieces(text_col, size)).alias("pos", "piece"))


def bisect_text(text: str, limit: int = BISECT_LIMIT) -> list[tuple[str, str]]:
    """Halve by characters while the piece has more than ``limit`` words.

    Returns (path, piece) leaves left to right; path is the string of 0/1
    turns from the root, so sorting by path gives text order.
    """
    out, stack = [], [("", text)]
    while stack:
        path, s = stack.pop()
        if len(s.split()) > limit:
            mid = len(s) // 2
            stack.append((path + "1", s[mid:]))
            stack.append((path + "0", s[:mid]))
        else:
            out.append((path, s))
    return out


_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()),
                                     T.StructField("piece", T.StringType())]))


@F.pandas_udf(_LEAVES)
def bisect_udf(texts: pd.Series, limits: pd.Series) -> pd.Series:
    """Column form of ``bisect_text``: array<struct<path, piece>> per text."""
    return pd.Series([
        [] if t is None else [{"path": p, "piece": s} for p, s in bisect_text(t, int(lim))]
        for t, lim in zip(texts, limits)])


def bisect_chunks(df: DataFrame, keys: list[str], text_col: str,
                  limit: int = BISECT_LIMIT) -> DataFrame:
    """Rows (keys..., path, piece) of the recursive bisection (CH-1)."""
    ship_package(df.sparkSession)
    return (df.select(*keys, F.explode(bisect_udf(F.col(text_col), F.lit(limit))).alias("p"))
            .select(*keys, "p.path", "p.piece"))


_CHUNKS = T.ArrayType(T.StructType([
    T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType()),
    T.StructField("n_tokens", T.LongType())]))


def packed_chunks(text: str, limit: int = PACK_LIMIT) -> list[tuple[int, str, int]]:
    """(number, chunk, tokens) of one text. The running token total places each
    chunk's end by bisection, so the cost is linear in the lines however many
    chunks they make."""
    lines = text.split("\n")
    total = list(itertools.accumulate((len(x.split()) for x in lines), initial=0))
    ends = [0]
    while ends[-1] < len(lines):
        fits = bisect.bisect_right(total, total[ends[-1]] + limit, lo=ends[-1] + 1) - 1
        ends.append(max(fits, ends[-1] + 1))
    first = 1 if total[1] > limit else 0
    return [(first + i, "\n".join(lines[x:y]), total[y] - total[x]) for i, (x, y) in enumerate(itertools.pairwise(ends))]


@F.pandas_udf(_CHUNKS)
def pack_udf(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else packed_chunks(t, int(n)) for t, n in zip(texts, limits)], dtype=object)


def pack_lines(df: DataFrame, keys: list[str], text_col: str,
               max_tokens: int = PACK_LIMIT) -> DataFrame:
    """Greedy line packing (CH-2), linear in the text.

    Lines join the current chunk while its token total stays <= max_tokens;
    otherwise the chunk closes and the line starts the next one, so an
    over-long line is a chunk of its own. Chunk numbers start at 1 when the
    first line alone is over the limit (chunk 0 would be empty and gets no
    row). Rows (keys..., chunk_no, chunk, n_tokens).
    """
    ship_package(df.sparkSession)
    return (df.select(*keys, F.explode(pack_udf(F.col(text_col), F.lit(max_tokens))).alias("c"))
            .select(*keys, "c.chunk_no", "c.chunk", "c.n_tokens"))


def reassemble(parts: DataFrame, keys: list[str], order_col: str, piece_col: str,
               sep: str = "") -> DataFrame:
    """Join per-chunk results back in order (CH-4, SET-1). The group is one
    text's pieces, bounded by that text."""
    return parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, piece_col))),
                                 lambda s: s[piece_col]), sep).alias("text"))
