"""An exact search index over stored vectors (CMD-8, O-3): cells that can be skipped.

Unit vectors are gathered to cells around centres, and the table is partitioned
by cell. For unit vectors the cosine falls with the distance, 1 - d^2 / 2, and by
the triangle inequality no row of a cell is nearer to the question than the
centre's distance less the cell's radius. So a search scores the nearest cells
first, and then only those whose bound reaches the k-th score found. The result
is that of the full scan, whatever the centres: these only decide how much is read.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.functions import vectors as vx
from chatlake.operators.search import THRESHOLD, TOP_K, vector_search

MAX_CELLS = 1024        # rows of the cell table that a search reads to the driver
SAMPLE_ROWS = 65_536    # rows, about, that the centres are fitted on
TASK_ROWS = 1 << 18     # rows, about, that a task sorts and writes
SLACK = 1e-6            # for rounding, on distances of unit vectors


def _unit(v, norm):
    return F.transform(v, lambda x: x.cast("double") / norm)


def build(history: DataFrame, path: str, cells: int | None = None, seed: int = 5) -> DataFrame:
    """Write ``history`` (id, vector and others) to ``path`` by cell, every row, and
    return it as stored. The centres are k-means ones of a sample by hash of about
    SAMPLE_ROWS rows; the number of cells is about the root of the rows, at most
    MAX_CELLS. Rows without a direction (NULL, zero or non-finite vectors) are
    stored in cell -1, which no search reads.
    """
    spark = history.sparkSession
    rows = history.withColumn("norm", vx.norm("vector"))
    usable = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))
    n = rows.where(usable).count()
    cells = max(1, min(MAX_CELLS, cells or math.isqrt(n)))
    unit = rows.withColumn("unit", F.when(usable, _unit(F.col("vector"), F.col("norm"))))
    if not n:
        rows.withColumn("cell", F.lit(-1)).write.partitionBy("cell").parquet(path)
        return spark.read.parquet(path)
    spread = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    sample = unit.where(usable & (spread < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))))
    model = KMeans(k=cells, seed=seed, maxIter=8, featuresCol="point", predictionCol="cell").fit(
        sample.select(array_to_vector("unit").alias("point")))
    placed = model.transform(unit.where(usable).withColumn("point", array_to_vector("unit"))).drop("point", "unit")
    none = rows.where(~usable).withColumn("cell", F.lit(-1))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // TASK_ROWS)
    # a cell that holds most rows is written by several tasks
    (placed.unionByName(none).repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")
     .write.partitionBy("cell").parquet(path))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                    "cell int, centre array<double>")
    stored = spark.read.parquet(path)
    cell_sizes(stored, centres).write.parquet(f"{path}/_cells")
    return stored


def cell_sizes(stored: DataFrame, centres: DataFrame) -> DataFrame:
    """(cell, centre, radius, n) of the cells that hold rows. The centres, at most
    MAX_CELLS, go to the rows, and only each task's figures of a cell are shuffled."""
    far = F.sqrt(F.aggregate(F.zip_with(_unit(F.col("vector"), F.col("norm")), "centre", lambda a, b: (a - b) * (a - b)),
                             F.lit(0.0), lambda s, x: s + x))
    sizes = (stored.where("cell >= 0").join(F.broadcast(centres), "cell").groupBy("cell")
             .agg(F.max(far).alias("radius"), F.count("*").alias("n")))
    return sizes.join(F.broadcast(centres), "cell").select("cell", "centre", "radius", "n")


def bounds(spark: SparkSession, path: str, query: list[float]) -> list[tuple[float, int, int]]:
    """(highest cosine possible, cell, rows) of every cell, the best first."""
    size = math.sqrt(sum(x * x for x in query))
    out = []
    if size and spark.read.parquet(path).where("cell >= 0").limit(1).count():
        for c in spark.read.parquet(f"{path}/_cells").collect():
            gap = math.sqrt(sum((x / size - y) ** 2 for x, y in zip(query, c["centre"]))) - c["radius"] - SLACK
            out.append((1 - max(0.0, gap) ** 2 / 2, c["cell"], c["n"]))
    return sorted(out, key=lambda b: (-b[0], b[1]))


def cells_to_read(spark: SparkSession, path: str, query: list[float], k: int = TOP_K, threshold: float = THRESHOLD, **filters) -> list[int]:
    """The cells that can hold one of the ``k`` best rows above ``threshold``."""
    order = [b for b in bounds(spark, path, query) if b[0] > threshold]
    first, rows = [], 0
    for _, cell, n in order:
        if rows >= 4 * k:
            break
        first.append(cell)
        rows += n
    if len(first) == len(order):
        return first
    seen = vector_search(spark.read.parquet(path).where(F.col("cell").isin(first)), query, k, threshold, **filters)
    floor_ = seen.agg(F.count("*").alias("n"), F.min("similarity").alias("low")).first()
    # similarities are rounded to six places
    low = floor_["low"] - 1e-6 if floor_["n"] == k else threshold
    return [cell for bound, cell, _ in order if bound >= low]


def search(spark: SparkSession, path: str, query: list[float], k: int = TOP_K, threshold: float = THRESHOLD, **filters) -> DataFrame:
    """``vector_search`` of the indexed history for one question's vector, reading
    the partitions of the cells that can matter. Same rows as the full scan."""
    wanted = cells_to_read(spark, path, query, k, threshold, **filters)
    return vector_search(spark.read.parquet(path).where(F.col("cell").isin(wanted)), query, k, threshold, **filters)
