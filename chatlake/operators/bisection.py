"""Recursive bisection of documents kept as line rows (CH-1).

``chunks.bisect_text`` halves a text held in one row. A user's whole history may
be a third of all rows, so here the document stays as line rows and no row or
group holds more of it than a cell.

Where the cuts fall depends on the text's length alone, so the tree's top needs
no text: a text of N characters is cut at depth D, the least at which no
node is longer than ``CELL`` characters, to 2^D *cells*.

1. running character offsets of the lines give each segment of a line its cell;
   cells are joined from their segments and written, with their word count
   and whether they begin and end inside a word's characters;
2. the words of any node above are the sum over its cells, less one for each
   border within it that cuts a word. A part never has more words than the whole, so a
   node is a leaf if and only if it has at most ``limit`` words and its parent more:
   all levels are answered at once, from the counts alone;
3. cells below a leaf are joined to its piece; a cell that no leaf covers is
   halved further as a text of its own.

The text is shuffled to the cells once and read once more at the end, however deep the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as tx
from chatlake.operators.chunks import BISECT_LIMIT, bisect_udf
from chatlake.operators.ids import group_positions
from chatlake.session import checkpoint_root, run_dir, ship_package

CELL = 1 << 16      # characters a cell holds at most
SEGMENT = 1 << 14   # long lines are cut into segments of at most this many characters
_SPACE = r"(?U)[\s\x1C-\x1F]"


def _segments(lines: DataFrame, group_col: str, order_cols: list[str], line_col: str, size: int) -> DataFrame:
    """Segments of at most ``size`` characters of the lines and the line feeds
    behind them, in the order o0, o1, ..., seg."""
    cut = F.regexp_extract_all(F.concat(F.col(line_col), F.lit("\n")), F.lit(f"(?s).{{1,{size}}}"), 0)
    return (lines.where(F.col(line_col).isNotNull())
            # a NULL group is the one without the mark, so that joins keep it
            .select(F.coalesce(F.concat(F.lit("g"), F.col(group_col).cast("string")), F.lit("")).alias("g"),
                    *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)], F.posexplode(cut).alias("seg", "text"))
            .withColumn("n", F.length("text").cast("long")))


def _cell_of(x: Column, total: Column, depth: Column) -> Column:
    """struct(b, idx, path) of the cell that holds offset ``x``: its end, its
    number from the left and the turns that lead to it."""
    def turn(node, _):
        mid = node["a"] + F.floor((node["b"] - node["a"]) / 2).cast("long")
        left = x < mid
        return F.struct(F.when(left, node["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(node["b"]).alias("b"),
                        (node["idx"] * 2 + F.when(left, 0).otherwise(1)).cast("long").alias("idx"),
                        F.concat(node["path"], F.when(left, "0").otherwise("1")).alias("path"))
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("a"), total.alias("b"), zero.alias("idx"), F.lit("").alias("path"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), depth), F.lit(2), depth), root, turn)


def _cells(segments: DataFrame, order: list[str], cell: int) -> DataFrame:
    """Rows (g, idx, path, text, words, head, tail) of all texts' cells."""
    placed = group_positions(segments, "g", order, "p", sum_col="n", cum_col="end", total_col="total")
    # a text ends before its last line feed
    total = (F.col("total") - 1).cast("long")
    over = F.floor((total - 1) / cell).cast("long")
    placed = placed.select(
        "g", (F.col("end") - F.col("n")).cast("long").alias("at"), total.alias("total"),
        F.when(over <= 0, 0).otherwise(F.length(F.bin(over))).cast("int").alias("depth"),
        F.expr("substring(text, 1, int(least(n, total - 1 - end + n)))").alias("text"))
    placed = placed.where("text <> '' OR total = 0")
    first = placed.withColumn("c", _cell_of(F.col("at"), F.col("total"), F.col("depth")))
    # segments are shorter than half a cell, so they lie in two cells at most
    here = (F.col("c.b") - F.col("at")).cast("int")
    rest = F.col("at") + F.length("text") - 1
    parts = F.array(F.struct(F.col("c.idx").alias("idx"), F.col("c.path").alias("path"), F.col("at"),
                             F.when(F.col("total") == 0, "").otherwise(F.substring(F.col("text"), F.lit(1), here)).alias("text")),
                    F.struct(F.col("d.idx").alias("idx"), F.col("d.path").alias("path"), F.col("c.b").alias("at"),
                             F.substring(F.col("text"), here + 1, F.length("text")).alias("text")))
    split = (first.withColumn("d", _cell_of(rest, F.col("total"), F.col("depth")))
             .select("g", F.explode(F.when(F.col("d.idx") > F.col("c.idx"), parts).otherwise(F.slice(parts, 1, 1))).alias("f"))
             .select("g", "f.*"))
    cells = split.groupBy("g", "idx", "path").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "").alias("text"))
    solid = lambda c: (F.length(c) > 0) & ~F.regexp_like(c, F.lit(_SPACE))
    return cells.select("g", "idx", "path", "text", tx.token_count("text").alias("words"),
                        solid(F.substring("text", 1, 1)).alias("head"), solid(F.substring("text", -1, 1)).alias("tail"))


def _leaf_depths(cells: DataFrame, limit: int) -> DataFrame:
    """Rows (g, path, leaf): the depth of the leaf that covers a cell, NULL where
    the cell itself has too many words. Reads counts, never the text."""
    # a cell learns from its left neighbour whether a word runs over their border
    both = F.array(F.struct("idx", "path", "words", "head", F.lit(False).alias("before")),
                   F.struct((F.col("idx") + 1).alias("idx"), F.lit(None).cast("string").alias("path"),
                            F.lit(0).cast("long").alias("words"), F.lit(False).alias("head"), F.col("tail").alias("before")))
    told = (cells.select("g", F.explode(both).alias("c")).select("g", "c.*").groupBy("g", "idx")
            .agg(F.max("path").alias("path"), F.sum("words").alias("words"),
                 (F.bool_or("head") & F.bool_or("before")).cast("long").alias("cut"))
            .where("path IS NOT NULL"))
    nodes = (told.select("g", "path", "words", "cut", F.explode(F.expr("sequence(0, length(path))")).alias("depth"))
             .withColumn("node", F.expr("substring(path, 1, depth)"))
             .withColumn("inside", F.expr("instr(substring(path, depth + 1), '1') > 0").cast("long")))
    small = (nodes.groupBy("g", "node").agg(F.sum(F.col("words") - F.col("cut") * F.col("inside")).alias("words"))
             .where(F.col("words") <= limit))
    return (nodes.join(small.select("g", "node", F.lit(True).alias("small")), ["g", "node"], "left")
            .groupBy("g", "path").agg(F.min(F.when(F.col("small"), F.col("depth"))).alias("leaf")))


def bisect_line_rows(lines: DataFrame, group_col: str, order_cols: list[str], line_col: str,
                     limit: int = BISECT_LIMIT, segment: int = SEGMENT, cell: int = CELL) -> DataFrame:
    """Rows (group, path, piece) of the recursive bisection of each group's
    text (its lines, joined by newlines, in ``order_cols`` order, which must be
    unique in the group): the leaves that ``chunks.bisect_text`` gives on the whole text.

    Lines must not contain newlines themselves. NULL lines are no lines; a NULL group is a
    group; a group of one empty line is one empty piece. An empty table gives no rows.
    """
    spark = lines.sparkSession
    checkpoint_root(spark)
    ship_package(spark)
    if cell < 8:
        raise ValueError("a cell takes 8 characters at least")
    size = min(segment, cell // 2 - 1)      # shorter than the shortest cell
    segments = _segments(lines, group_col, order_cols, line_col, size)
    path = run_dir(spark, "bisect-cells")
    _cells(segments, [f"o{i}" for i in range(len(order_cols))] + ["seg"], cell).write.parquet(path)
    cells = spark.read.parquet(path)
    fate = cells.select("g", "path", "text").join(_leaf_depths(cells, limit), ["g", "path"])
    whole = (fate.where("leaf IS NOT NULL").groupBy("g", F.expr("substring(path, 1, leaf)").alias("leaf_path"))
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "text"))),
                                           lambda x: x["text"]), "").alias("piece")))
    halved = (fate.where("leaf IS NULL").select("g", "path", F.explode(bisect_udf("text", F.lit(limit))).alias("l"))
              .select("g", F.concat("path", "l.path").alias("leaf_path"), F.col("l.piece").alias("piece")))
    return whole.unionByName(halved).select(F.expr("if(g = '', NULL, substring(g, 2))").alias(group_col),
                                            F.col("leaf_path").alias("path"), "piece")
