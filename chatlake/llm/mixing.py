"""Mixing sources to target weights by pivotal dependent rounding (native).

A source that shall give ``target`` words out of ``source_size`` copies each of
its documents target / source_size times on average: floor of that number for
all, and the rest is a probability of one copy more. Pivotal rounding pairs two
open documents and moves words of probability from one to the other, up or down
at random so that each probability keeps its mean, until one of them is settled
at 0 or 1. The expected words of the pair stay the same at every step, so a
source's taken words end within one document of its target.

Pairing is a reduction tree: buckets of about FAN documents of one source are
folded by a higher-order function, each leaves at most one open document, and
the open ones are bucketed again, until every source has one. A source that
holds most rows is so many buckets, never one group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import cols, fresh, same, word_count, written
from chatlake.operators.ids import group_positions

FAN = 48
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, items) to target: weights repeat over the sources by
    code point (NULL last) and share ``budget`` times all words; a target stops
    at ``most`` times its source, the excess is reshared by weight among the
    others until none is above.

    The fixed point in closed form: with sources by rising most * size / weight,
    the first ones stop at their limit, and the others get the words left by
    weight. The two windows hold one row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1,
                             F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    earlier, later = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    t = t.withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(every)
                               - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("w").over(later))
    # the level is the one of the first source that does not reach its limit
    free = F.when(F.col("level") <= F.col("limit") / F.col("w"), F.struct(F.col("limit") / F.col("w"), "level"))
    t = t.withColumn("level", F.min(free).over(every)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("w"), F.col("limit")))
    return t.select("source", "source_size", "items", target.alias("target"))


def _unit(*c: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(*c), 11) / F.lit(float(1 << 53))


def _step(acc: Column, x: Column) -> Column:
    """One pairing: the open document of ``acc`` against ``x``."""
    sa, pa, sb, pb = acc["s"], acc["p"], x["s"], x["p"]
    a_room, a_mass, b_room, b_mass = sa * (1 - pa), sa * pa, sb * (1 - pb), sb * pb
    up, down = F.least(a_room, b_mass), F.least(a_mass, b_room)
    rise = x["u"] * (up + down) < down
    eps = 1e-12

    def snap(p):
        return F.when(p > 1 - eps, 1.0).when(p < eps, 0.0).otherwise(p)

    na = F.when(rise, F.when(a_room <= b_mass, 1.0).otherwise(snap(pa + up / sa))) \
        .otherwise(F.when(a_mass <= b_room, 0.0).otherwise(snap(pa - down / sa)))
    nb = F.when(rise, F.when(b_mass <= a_room, 0.0).otherwise(snap(pb - up / sb))) \
        .otherwise(F.when(b_room <= a_mass, 1.0).otherwise(snap(pb + down / sb)))
    none = F.array().cast("array<int>")

    def keep(i, p):
        return F.when(p == 1.0, F.array(i)).otherwise(none)

    def open_(p):
        return (p > 0.0) & (p < 1.0)

    # at least one of the two is settled
    paired = F.struct(
        F.when(open_(na), acc["i"]).when(open_(nb), x["i"]).otherwise(F.lit(-1)).alias("i"),
        F.when(open_(na), sa).otherwise(sb).alias("s"),
        F.when(open_(na), na).otherwise(nb).alias("p"),
        F.concat(acc["won"], keep(acc["i"], na), keep(x["i"], nb)).alias("won"))
    alone = F.struct(x["i"].alias("i"), sb.alias("s"), pb.alias("p"), acc["won"].alias("won"))
    return F.when(acc["i"] < 0, alone).otherwise(paired)


def _fold(open_items: DataFrame, level: int, seed: int) -> DataFrame:
    """Fold every bucket of (source, buckets, doc_id, size, copy, s, p): rows with
    ``won`` and the bucket's open one with ``p`` strictly between 0 and 1."""
    n = F.greatest(F.lit(1), F.ceil(F.col("buckets") / FAN)).cast("long")
    key = [F.col("source"), F.col("doc_id"), F.col("size"), F.col("copy"), F.lit(level), F.lit(seed)]
    dealt = open_items.select(
        "source", n.alias("buckets"), F.pmod(F.xxhash64(*key), n).alias("bucket"),
        # largest first: the last one open, whose rounding is the source's error, is small
        F.struct((-F.col("s")).alias("o"), _unit(*key, F.lit("draw")).alias("u"),
                 "doc_id", "size", "copy", "s", "p").alias("x"))
    group = dealt.groupBy("source", "buckets", "bucket").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("p"),
                     F.array().cast("array<int>").alias("won"))
    at = F.transform("xs", lambda x, i: F.struct(i.alias("i"), x["s"].alias("s"), x["p"].alias("p"), x["u"].alias("u")))
    folded = group.select("source", "buckets", "xs", F.aggregate(at, start, _step).alias("r"))
    out = F.concat(
        F.transform("r.won", lambda i: F.struct(F.get("xs", i)["doc_id"].alias("doc_id"), F.get("xs", i)["size"].alias("size"), F.get("xs", i)["copy"].alias("copy"),
                                                F.get("xs", i)["s"].alias("s"), F.lit(1.0).alias("p"))),
        F.when(F.col("r.i") >= 0, F.array(F.struct(
            F.get("xs", F.col("r.i"))["doc_id"].alias("doc_id"), F.get("xs", F.col("r.i"))["size"].alias("size"),
            F.get("xs", F.col("r.i"))["copy"].alias("copy"), F.col("r.s").alias("s"), F.col("r.p").alias("p")))).otherwise(F.array()))
    return folded.select("source", "buckets", F.inline(out))


def _copies_numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: 0 for a (source, doc_id, size) that one row has, else a
    number of its own for each of its rows. Only repeated ones are shuffled for it,
    and one with many rows is numbered in many buckets."""
    again = rows.groupBy("source", "doc_id", "size").count().where("count > 1").select(
        F.col("source").alias("x_source"), F.col("doc_id").alias("x_id"), F.col("size").alias("x_size"))
    on = same(F.col("source"), F.col("x_source")) & same(F.col("doc_id"), F.col("x_id")) & (F.col("size") == F.col("x_size"))
    again = written(again, "mix-repeated")
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    twice = rows.join(again, on, "left_semi").withColumn("item", F.xxhash64("source", "doc_id", "size"))
    twice = group_positions(twice, "item", "row", "copy").drop("item")
    return rows.join(again, on, "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(twice)


def plan_mix(rows: DataFrame, seed: int = 17, **targets) -> DataFrame:
    """The (doc_id, source, size) rows, with a number ``row`` if they come from
    ``sized``, to the copies each gets:
    those with source_size, target, copies and taken = copies * size.

    Each row is rounded by itself, also where rows repeat a doc_id, source and size;
    which of such rows gets a copy more depends on their numbers, how many does not.
    Documents without words cannot bring a source nearer its target; their extra
    copy is a draw of its own. NULL ids and sources are ordinary values.
    """
    sources = written(source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("items")), **targets),
        "mix-sources")
    if "row" not in rows.columns:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = sources.withColumnRenamed("source", "src")
    rows = written(_copies_numbered(rows), "mix-items")
    items = rows.join(s, same(F.col("source"), F.col("src"))).select(
        "source", F.col("items").alias("buckets"), "doc_id", "size", "copy",
        F.col("size").cast("double").alias("s"), (rate - F.floor(rate)).alias("p"))
    level = written(_fold(items.where("s > 0 AND p > 0"), 0, seed), "mix-level")
    won = [level.where("p = 1")]
    most = sources.agg(F.max("items")).first()[0] or 1
    for k in range(1, 1 + math.ceil(math.log(max(most, 2), FAN))):
        level = written(_fold(level.where("p < 1"), k, seed), "mix-level")
        won.append(level.where("p = 1"))
    draw = _unit(F.col("source"), F.col("doc_id"), F.col("size"), F.col("copy"), F.lit("last"), F.lit(seed))
    won.append(level.where((F.col("p") < 1) & (draw < F.col("p"))))
    won.append(items.where((F.col("s") == 0) & (draw < F.col("p"))))
    extra = won[0].select("source", "doc_id", "size", "copy")
    for w in won[1:]:
        extra = extra.unionAll(w.select("source", "doc_id", "size", "copy"))
    extra = extra.select(F.col("source").alias("x_source"), F.col("doc_id").alias("x_id"),
                         F.col("size").alias("x_size"), F.col("copy").alias("x_copy"), F.lit(1).alias("x"))
    out = (rows.join(s, same(F.col("source"), F.col("src")))
           .join(extra, same(F.col("doc_id"), F.col("x_id")) & same(F.col("source"), F.col("x_source"))
                 & (F.col("size") == F.col("x_size")) & (F.col("copy") == F.col("x_copy")), "left"))
    copies = (F.floor(rate) + F.coalesce(F.col("x"), F.lit(0))).cast("long")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that plan_mix takes, as a written table: doc_id, source, size and a
    number ``row`` of their own."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                               F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "mix-rows")


def mix(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **targets) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as plan_mix copies it,
    with the input's columns unchanged. An empty table stays empty."""
    size, row, number, copies, each = fresh(docs, "size", "row", "number", "copies", "each")
    full = written(docs.withColumns({size: word_count(F.col(f"`{text_col}`")), row: F.monotonically_increasing_id()}), "mix-docs")
    plan = plan_mix(full.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                                F.col(f"`{source_col}`").alias("source"), F.col(size).alias("size")), seed, **targets)
    plan = plan.where("copies > 0").select(F.col("row").alias(number), F.col("copies").alias(copies))
    joined = full.join(plan, F.col(row) == F.col(number))
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(cols(docs))
