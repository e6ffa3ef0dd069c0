"""Toxicity: linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

Features are the hashed character n-grams that a text holds (presence). Over all
labelled training rows each feature gets r = log of its smoothed share among
toxic rows over that among others; logistic regression then learns one weight a
feature on the scaled features, from at most ``max_rows`` of those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import aside, back, cols, fresh, without, written
from chatlake.session import ship_package

BITS = 18               # features: 2 ** BITS
ORDERS = (4, 5)         # characters of an n-gram
MAX_ROWS = 12_000       # labelled rows the weights are learned from (about)
MIN_RATIO = 1.5         # log-count ratio that a feature must reach either way
ALPHA = 1.0             # smoothing of the counts
L2 = 10.0
ROUNDS = 80


def grams(text: str):
    """Sorted feature numbers of a text: its n-grams in lower case, with a blank
    at both ends and for every run of white space."""
    import numpy as np

    s = f" {' '.join(text.lower().split())} "
    c = np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32)
    seen = np.zeros(1 << BITS, dtype=bool)
    h = np.full(len(c) + 1, 7, dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):         # h: hashes of all runs of n characters
        if len(c) < n:
            break
        h = (h[:-1] ^ c[n - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            seen[h >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen)


def _count(batches):
    """Feature counts of a task's rows (kind 0) and the sampled rows' features
    (kind 1)."""
    import numpy as np
    import pyarrow as pa

    names = ["kind", "feature", "pos", "neg", "features", "toxic"]
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    n = 0
    for b in batches:
        text, toxic, sampled = (c.to_pylist() for c in b.columns)
        packed, labels = [], []
        for t, y, s in zip(text, toxic, sampled):
            f = grams(t or "")
            counts[y, f] += 1
            n += 1
            if s:
                packed.append(f.astype("<u4").tobytes())
                labels.append(y)
        k, none = len(packed), [None] * len(packed)
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.int64()),
                                          pa.array(none, pa.int64()), pa.array(packed, pa.binary()), pa.array(labels, pa.int32())], names)
    if n:
        f = np.flatnonzero(counts.sum(axis=0)).astype(np.int32)
        none = [None] * len(f)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(f), np.int32)), pa.array(f), pa.array(counts[1, f]), pa.array(counts[0, f]),
                                          pa.array(none, pa.binary()), pa.array(none, pa.int32())], names)


def _weighty(ratio):
    """A mapInArrow function: (features, toxic) with the features that have a ratio."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            rows = [np.frombuffer(p.as_py(), dtype="<u4") for p in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[ratio.value[f] != 0].tobytes() for f in rows], pa.binary()), b.column(1)], b.schema.names)
    return run


def fit(packed: list[bytes], labels, ratio, rounds: int = ROUNDS, l2: float = L2):
    """Weights of scaled presence features and the intercept: logistic loss with
    an L2 term, by Adam over all rows at once."""
    import numpy as np

    y = np.asarray(labels, dtype=np.float64)
    rows = [np.frombuffer(p, dtype="<u4") for p in packed]
    rows = [f[ratio[f] != 0] for f in rows]
    lengths = np.array([len(f) for f in rows])
    of = np.repeat(np.arange(len(rows)), lengths)
    at = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    x = ratio[at]
    w, b = np.ones(len(ratio)) * 0.05, 0.0
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.02
    for t in range(1, rounds + 1):
        z = np.bincount(of, weights=w[at] * x, minlength=len(rows)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(at, weights=g[of] * x, minlength=len(w)) / max(1, len(rows)) + l2 * w / max(1, len(rows))
        gb = g.mean() if len(rows) else 0.0
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 5 * rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * ratio, b


def rates(n: dict[int, int], max_rows: int) -> dict[int, float]:
    """Share of each class's rows to fit on, from its count in ``n``."""
    half = max(1, max_rows // 2)
    take = {y: min(n[y], max(half, max_rows - n[1 - y])) for y in (0, 1)}
    return {y: take[y] / max(n[y], 1) for y in (0, 1)}


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, min_ratio: float = MIN_RATIO,
          id_col: str = "doc_id", text_col: str = "text"):
    """(weight of each feature, intercept) from the rows of ``docs`` that
    ``labels`` (doc_id, toxic) marks 0 or 1 and that are not held out.

    Ratios count all those rows; the weights are fitted, in one task, on about
    ``max_rows`` of them, taken by a hash of the id: up to half of each class,
    more of one where the other has fewer. The intercept is corrected for the two
    rates. Labels NULL or other than 0 and 1, and of documents that are not
    there, count as none; an id marked both ways counts both. Without labels of
    both kinds every score is the smoothed share of toxic rows.
    """
    import numpy as np

    spark = docs.sparkSession
    ship_package(spark)
    marks = (labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("toxic IN (0, 1)").where(~held_out(F.col("label_id"))).distinct())
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    there = marks.join(ids.hint("merge"), F.col("id") == F.col("label_id"), "left_semi").groupBy("toxic").count()
    n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in there.collect()}
    if not (n[0] and n[1]):
        return np.zeros(1 << BITS, np.float32), float(np.log((n[1] + 0.5) / (n[0] + 1.5)))
    rate = rates(n, max_rows)
    sampled = (F.pmod(F.xxhash64("label_id"), F.lit(1 << 40))
               < F.when(F.col("toxic") == 1, int(rate[1] * (1 << 40))).otherwise(int(rate[0] * (1 << 40))))
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
            # labels grow with the documents: the same plan at every size, no broadcast
            .join(marks.hint("merge"), F.col("id") == F.col("label_id")).select("text", "toxic", sampled.alias("sampled")))
    got = written(rows.mapInArrow(_count, "kind int, feature int, pos long, neg long, features binary, toxic int"), "toxic-counts")
    # one row for each of at most 2 ** BITS features
    counts = got.where("kind = 0").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toPandas()
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pos[counts["feature"]], neg[counts["feature"]] = counts["pos"], counts["neg"]
    ratio = np.log((pos + ALPHA) / (pos + ALPHA).sum()) - np.log((neg + ALPHA) / (neg + ALPHA).sum())
    ratio[(pos + neg == 0) | (np.abs(ratio) < min_ratio)] = 0
    shared = spark.sparkContext.broadcast(ratio.astype(np.float32))

    def learn(rows):
        import pandas as pd

        rows = rows.sort_values(["features", "toxic"])      # sums in one order, however the rows came
        w, b = fit(list(rows["features"]), rows["toxic"], shared.value.astype(np.float64))
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "b": [float(b)], "toxic": [int(rows["toxic"].sum())], "n": [len(rows)]})

    # the one task that fits gets the features with a weight, not all of a long text's
    sample = got.where("kind = 1").select("features", "toxic").mapInArrow(_weighty(shared), "features binary, toxic int")
    model = (sample.withColumn("all", F.lit(0)).groupBy("all")
             .applyInPandas(learn, "w binary, b double, toxic long, n long").first())
    return np.frombuffer(model["w"], dtype="<f4"), model["b"] + float(np.log(rate[0] / rate[1]))


def held_out(id_):
    """Rows kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scorer(model):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, b0 = model.value
        for b in batches:
            z = np.array([w[grams(t or "")].sum(dtype=np.float64) + b0 for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.float64)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             [*b.schema.names[:-1], "score", "predicted"])
    return run


def score(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0), from
    the whole text alone. Columns of these names are replaced. NULL and empty
    texts get the score of a text without n-grams."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = without(docs, "score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.select(*cols(docs), F.col(f"`{text_col}`").alias(*fresh(docs, "scored")))
    return rows.mapInArrow(_scorer(shared), f"{kinds}, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those predicted toxic; columns unchanged."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    rows, names = aside(docs)
    return back(score(rows, model, names[text_col]).where("predicted = 0"), names)
