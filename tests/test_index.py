"""The pruned index gives the full scan's rows and reads fewer cells."""

import numpy as np
import pytest

from chatlake.operators import index
from chatlake.operators import search as srch
from chatlake.session import run_dir

SCHEMA = "id long, ts timestamp, sender string, channel string, message string, vector array<float>"


def history(spark, vectors):
    import datetime as dt
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1), f"u{i % 3}", f"c{i % 4}", f"m{i}", v) for i, v in enumerate(vectors)], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    out = [[float(x) for x in centres[i % 12] + 0.1 * rng.normal(size=16)] for i in range(1200)]
    return out + [out[0]] * 30 + [[0.0] * 16, None, [float("nan")] * 16]


def test_index_equals_full_scan_and_skips_cells(spark, clustered):
    h = history(spark, clustered)
    path = run_dir(spark, "t_index")
    stored = index.build(h, path)
    assert stored.count() == len(clustered) and "cell" in stored.columns
    cells = spark.read.parquet(f"{path}/_cells").count()
    for query, how in ((clustered[0], {}), (clustered[5], {"exclude_channels": ("c1",)}), (clustered[7], {"bot_name": "u1", "threshold": 0.9}),
                       ([1.0] + [0.0] * 15, {"threshold": -1.0}), (clustered[0], {"k": 3}), ([0.0] * 16, {})):
        assert [tuple(r) for r in index.search(spark, path, query, **how).collect()] == \
            [tuple(r) for r in srch.vector_search(h, query, **how).collect()]
    assert 0 < len(index.cells_to_read(spark, path, clustered[0])) < cells / 2


def test_index_of_nothing_and_of_one_direction(spark):
    path = run_dir(spark, "t_index_none")
    index.build(history(spark, [[0.0, 0.0]]), path)
    assert index.search(spark, path, [1.0, 0.0]).collect() == []
    path = run_dir(spark, "t_index_one")
    index.build(history(spark, [[2.0, 0.0]] * 40), path)
    assert [r["id"] for r in index.search(spark, path, [1.0, 0.0]).collect()] == list(range(20))
    assert index.bounds(spark, path, [1.0, 0.0])[0][2] == 40


def test_rows_are_not_shuffled_for_the_radius_of_their_cell(spark, clustered):
    """All rows once went through one task: only one figure a cell and task may."""
    stored = history(spark, clustered[:1200]).selectExpr("*", "1.0D AS norm", "CAST(id % 3 AS INT) AS cell")
    centres = spark.createDataFrame([(c, [0.0] * 16) for c in range(4)], "cell int, centre array<double>")
    sizes = index.cell_sizes(stored, centres)
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Coalesce" not in plan
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "partial_max" in plan[plan.index("Exchange hashpartitioning"):]
    far = {c: max(sum(x * x for x in v) ** 0.5 for i, v in enumerate(clustered[:1200]) if i % 3 == c) for c in range(3)}
    got = {r["cell"]: r for r in sizes.collect()}
    assert sorted(got) == [0, 1, 2] and all(abs(got[c]["radius"] - far[c]) < 1e-6 and got[c]["n"] == 400 for c in got)
