"""Resampling documents towards a target's distribution of word n-grams.

A text is folded to its words with single spaces between them, and the regex
module walks every n-gram as an overlapping match, kept to whole words by look-
arounds; the CRC of a match's span gives its bucket. Documents get the mean log
ratio of the target's bucket shares to their own corpus's, and a Gumbel draw by a
hash of the id turns the highest sums into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import cols, fresh, without, written
from chatlake.operators.ids import dense_ids
from chatlake.session import ship_package

BUCKETS = 10_000
MOST_WORDS = 1          # words of the longest n-gram

#: Byte by byte: A-Z to lower case, 0-9, a-z and all of non-ASCII stay, the rest
#: of ASCII separates words.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    """The words of a text, in lower case, with single spaces between them."""
    return b" ".join(text.translate(_FOLD).split())


def scanners(most_words: int = MOST_WORDS) -> list:
    """One overlapping scan for each n-gram length."""
    import regex

    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, most_words + 1)]


def buckets_of(flat: bytes, scans: list, buckets: int = BUCKETS):
    """Bucket of every n-gram of a folded text, repeats included, as an array."""
    import numpy as np

    crc = zlib.crc32
    return np.concatenate([
        np.fromiter((crc(flat[m.start():m.end()]) % buckets for m in scan.finditer(flat, overlapped=True)), dtype=np.uint32)
        for scan in scans])


def _scan(most_words: int, buckets: int):
    """A mapInArrow function: the last column, a text, to n_words and the packed
    buckets of its n-grams."""
    def run(batches):
        import pyarrow as pa

        scans = scanners(most_words)
        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        for b in batches:
            words, packed = [], []
            for text in b.column(b.num_columns - 1):
                buffer = text.as_buffer()
                flat = folded(buffer.to_pybytes()) if buffer else b""
                words.append(flat.count(b" ") + 1 if flat else 0)
                packed.append(buckets_of(flat, scans, buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.int64()), pa.array(packed, pa.binary())],
                                             [*b.schema.names[:-1], "n_words", "packed"])
    return run


def _tally(buckets: int):
    """A mapInArrow function: packed buckets to a task's count of each."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind, total = "<u2" if buckets <= 1 << 16 else "<u4", np.zeros(buckets, np.int64)
        for b in batches:
            for p in b.column(0):
                total += np.bincount(np.frombuffer(p.as_buffer(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    return run


def _counts(packed: DataFrame, buckets: int):
    """Features in each bucket, over all rows: at most one row a bucket comes back."""
    import numpy as np

    got = packed.select("packed").mapInArrow(_tally(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy(dtype=np.int64)] = got["n"]
    return out


def gains(own, target) -> list[int]:
    """floor(1000 ln) of the target's smoothed bucket shares over the corpus's."""
    buckets, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + buckets) / ((float(s) + 1) * (t_all + buckets)))) for s, t in zip(own, target)]


def _weigh(shared, buckets: int):
    """A mapInArrow function: packed buckets, the last column, to n_features and weight."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind, gain = "<u2" if buckets <= 1 << 16 else "<u4", np.array(shared.value, dtype=np.int64)
        for b in batches:
            at = [np.frombuffer(p.as_buffer(), kind) for p in b.column(b.num_columns - 1)]
            n = [len(x) for x in at]
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                                             [*b.schema.names[:-1], "n_features", "weight"])
    return run


def weighted(docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS,
             text_col: str = "text", target_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``; all, if None) with n_words, n_features and
    weight (the floored mean gain; no features: 0). Columns of these names are
    replaced.

    NULL and wordless texts have no features. An empty ``target`` has only its
    smoothing.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = without(docs, "n_words", "n_features", "weight", "packed")
    kept = cols(docs) if keep is None else [F.col(f"`{c}`") for c in keep]

    def scanned(df, columns, text):
        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(columns).schema] + ["n_words long", "packed binary"])
        return df.select(*columns, F.col(f"`{text}`").cast("binary").alias(*fresh(df, "scan"))).mapInArrow(_scan(most_words, buckets), kinds)

    rows = written(scanned(docs, kept, text_col), "resample-buckets")
    shared = spark.sparkContext.broadcast(gains(_counts(rows, buckets), _counts(scanned(target, [], target_text_col), buckets)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "packed")
    return rows.mapInArrow(_weigh(shared, buckets), f"{kinds}, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024,
             id_col: str = "doc_id", **how) -> DataFrame:
    """``weighted`` rows with score (weight plus the id's Gumbel draw, in
    thousandths) and rank: 1, 2, .. for the ``percent`` of the rows with at least
    ``least_words`` words that have the highest scores, ties to the smaller id,
    NULL for all others. Columns of these names are replaced.

    A NULL id draws as the text 'NULL' and ranks before the ids of its score; rows
    of one id draw alike, the fewer features first, and equal rows get ranks of
    their own. Less than one row's worth of ``percent`` draws none.
    """
    rows = weighted(without(docs, "score", "rank"), target, **how)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("NULL")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = written(rows.withColumn("score", F.col("weight") + draw), "resample-scores")
    able = F.col("n_words") >= least_words
    none = F.lit(None).cast("long")
    drawn = percent * rows.where(able).count() // 100
    if not drawn:
        return rows.withColumn("rank", none)
    # a row a score, and scores are thousandths within some tens of units
    best = Window.orderBy(F.desc("score"))
    least = (rows.where(able).groupBy("score").count().select("score", F.sum("count").over(best).alias("n"))
             .where(F.col("n") >= drawn).agg(F.max("score")).first()[0])
    lead, own, place = fresh(rows, "lead", "own", "place")
    near = rows.where(able & (F.col("score") >= least)).withColumns({lead: -F.col("score"), own: F.col(f"`{id_col}`")})
    ranked = dense_ids(near, [lead, own, "n_features"], place, start=1)
    return (ranked.withColumn("rank", F.when(F.col(place) <= drawn, F.col(place))).drop(lead, own, place)
            .unionByName(rows.where(~able | (F.col("score") < least)).withColumn("rank", none)))
