"""Vector math on ARRAY<FLOAT> columns (MTH-1..3, ARR-1..2, U-1).

Computation is in DOUBLE. Higher-order functions keep the work JVM side; the
batch search in operators.search uses Arrow batches and BLAS for
many-queries-by-many-rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions.text import terms


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """dot / (|a| |b|); NULL (not an error, not NaN) for a zero vector."""
    na = norm(a) if norm_a is None else _c(norm_a)
    nb = norm(b) if norm_b is None else _c(norm_b)
    return F.try_divide(dot(a, b), na * nb)


def to_text(v) -> Column:
    """Vector -> comma-joined text (ARR-1)."""
    return F.array_join(F.transform(_c(v), lambda x: x.cast("string")), ",")


def from_text(s) -> Column:
    """Comma text -> ARRAY<DOUBLE> (ARR-2); accepts 1e-05 and 1.0E-5."""
    return F.transform(F.split(_c(s), ","), lambda x: F.trim(x).cast("double"))


def term_bucket(term, dim: int) -> Column:
    """Bucket of a term: first 8 hex digits of md5, as a number, mod dim."""
    return (F.conv(F.substring(F.md5(_c(term)), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_tf(text, dim: int = 64) -> Column:
    """Default embedding (U-1): hashed term counts of fixed size ``dim``.

    The sorted bucket numbers are counted in one pass that holds at most
    ``dim`` counts, and these are laid into the slots at the end, so a term
    costs no array copy. A trained model plugs in instead through
    ``operators.ingest.model_embed`` (Arrow batches, model loaded once per
    worker).
    """
    buckets = F.array_sort(F.transform(terms(text), lambda t: term_bucket(t, dim)))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).alias("n"),
                     F.array().cast("array<struct<b:int,n:int>>").alias("done"))

    def closed(acc):
        return F.when(acc["b"] < 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.struct(acc["b"].alias("b"), acc["n"].alias("n")))))

    def step(acc, b):
        return F.when(b == acc["b"], F.struct(acc["b"].alias("b"), (acc["n"] + 1).alias("n"), acc["done"].alias("done"))) \
            .otherwise(F.struct(b.alias("b"), F.lit(1).alias("n"), closed(acc).alias("done")))

    def slots(acc):
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return F.aggregate(closed(acc), zero, lambda v, e: F.transform(
            v, lambda x, i: F.when(i == e["b"], e["n"].cast("float")).otherwise(x)))

    return F.aggregate(buckets, start, step, slots)
