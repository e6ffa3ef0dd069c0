"""Exact top-k inner products by branch and bound over ball trees, one a shard.

Candidates are dealt into shards of bounded size; a shard's task builds a ball
tree in memory and streams the queries through it in batches. A query descends
only into balls whose upper bound q.c + |q| r can still reach its list, visits
leaves by falling bound, and stops at the first below its k-th score. The k-th
score is shared between shards: a first pass visits each query's best leaf in
every shard, and the k-th best of what it found is the floor of the second.
"""

from __future__ import annotations

import decimal
import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import written
from chatlake.session import ship_package

SHARD_ROWS = 8192       # vectors in a shard's tree, on average
LEAF = 64
BATCH = 1024            # queries scored together


def usable(vector: Column) -> Column:
    """No NULL and no component that is NULL, NaN or infinite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
                      F.lit(False))


def build(points, leaf: int = LEAF):
    """Ball tree over the rows of ``points``: the row order, and for each node
    (parent, from, to, centre, radius); a split halves the widest dimension, so
    equal points end in balls of radius 0."""
    import numpy as np

    order, nodes = np.arange(len(points)), []
    todo = [(-1, 0, len(points))]
    while todo:
        parent, a, z = todo.pop()
        own = points[order[a:z]]
        centre = own.mean(axis=0)
        gap = own - centre
        radius = math.sqrt(float((gap * gap).sum(axis=1).max()))
        nodes.append((parent, a, z, centre, radius))
        if z - a > leaf and radius > 0:
            wide, mid = int(own.var(axis=0).argmax()), (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own[:, wide], mid)]
            todo += [(len(nodes) - 1, a, a + mid), (len(nodes) - 1, a + mid, z)]
    return order, nodes


class Tree:
    """A shard: integer vectors (rows by rising id), searched for the k best of
    each query by (score, smaller id)."""

    def __init__(self, ids, points):
        import numpy as np

        by = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[by], points[by].astype(np.float64)
        self.order, nodes = build(self.points)
        self.children: dict[int, list[int]] = {}
        for i, n in enumerate(nodes):
            self.children.setdefault(n[0], []).append(i)
        self.span = [(n[1], n[2]) for n in nodes]
        self.centre = np.array([n[3] for n in nodes])
        self.radius = np.array([n[4] for n in nodes])
        self.first = np.array([self.order[a:z].min() for a, z in self.span])
        self.shift = 1 << int(len(ids)).bit_length()    # score and place in one integer

    def bound(self, q, norms, node):
        """Upper bound of the keys in a ball; scores are integers."""
        import numpy as np

        top = q @ self.centre[node] + norms * self.radius[node]
        top = np.floor(top + 1e-9 * (1 + np.abs(top)))
        return top.astype(np.int64) * self.shift + (self.shift - 1 - self.first[node])

    def search(self, own_ids, queries, k: int, floor, seed: bool = False):
        """Keys (score * shift + shift - 1 - row) of each query's best, falling;
        -1 << 62 where there are none. ``floor``: scores that are too low."""
        import numpy as np

        none = -(1 << 62)
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        least = np.where(floor > none, floor * self.shift, none)    # keys below are out
        leaves, bounds = [], []
        todo = [(0, np.arange(len(q)), self.bound(q, norms, 0))]
        while todo:
            node, rows, top = todo.pop()
            on = top >= least[rows]
            rows, top = rows[on], top[on]
            if not len(rows):
                continue
            if node in self.children:
                todo += [(c, rows, np.minimum(top, self.bound(q[rows], norms[rows], c))) for c in self.children[node]]
            else:
                b = np.full(len(q), none, dtype=np.int64)
                b[rows] = top
                leaves.append(node)
                bounds.append(b)
        best = np.full((len(q), k), none, dtype=np.int64)
        if not leaves:
            return best
        leaves, bounds = np.array(leaves), np.array(bounds).T
        by = np.argsort(-bounds, axis=1, kind="stable")
        live = np.arange(len(q))
        for j in range(1 if seed else len(leaves)):
            top = bounds[live, by[live, j]]
            live = live[(top > none) & (top >= np.maximum(best[live, -1], least[live]))]
            if not len(live):
                break
            at = by[live, j]
            for leaf in np.unique(at):
                rows = live[at == leaf]
                a, z = self.span[leaves[leaf]]
                places = self.order[a:z]
                keys = np.rint(q[rows] @ self.points[places].T).astype(np.int64) * self.shift + (self.shift - 1 - places)
                keys[own_ids[rows][:, None] == self.ids[places][None, :]] = none
                both = np.concatenate([best[rows], keys], axis=1)
                if both.shape[1] > k:
                    both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                best[rows] = -np.sort(-both, axis=1)
        return best


def _searcher(k: int, seed: bool):
    """Rows sorted by (shard, kind): a shard's candidates, then its queries."""
    def run(batches):
        import numpy as np
        import pandas as pd

        none = -(1 << 62)
        shard, parts, tree, waiting = None, [], None, []

        def flush():
            rows = pd.concat(waiting, ignore_index=True)
            waiting.clear()
            for a in range(0, len(rows), BATCH):
                some = rows.iloc[a:a + BATCH]
                ids = some["vec_id"].to_numpy(np.int64)
                floor = some["floor"].fillna(none).to_numpy(np.float64)
                floor = np.where(floor <= none, none, floor).astype(np.int64)
                keys = tree.search(ids, np.stack(some["vector"].to_numpy()), k, floor, seed)
                row, at = np.nonzero(keys > none)
                score, place = np.divmod(keys[row, at], tree.shift)
                yield pd.DataFrame({"query_id": ids[row], "vec_id": tree.ids[tree.shift - 1 - place], "score": score})

        for b in batches:
            for (s, kind), rows in b.groupby(["shard", "kind"], sort=True):
                if s != shard:
                    if waiting:
                        yield from flush()
                    shard, parts, tree = s, [], None
                if kind == 0:
                    parts.append(rows)
                    continue
                if tree is None and parts:
                    own = pd.concat(parts, ignore_index=True)
                    tree, parts = Tree(own["vec_id"].to_numpy(np.int64), np.stack(own["vector"].to_numpy())), []
                if tree is not None:
                    waiting.append(rows)
                    if sum(map(len, waiting)) >= BATCH:
                        yield from flush()
        if waiting:
            yield from flush()
    return run


def _exact(k: int):
    """Rows sorted by (shard, kind): the ``k`` best of a shard's candidates for each
    query, by Python integers where a product of 64-bit numbers could overflow."""
    def run(batches):
        import numpy as np
        import pandas as pd

        edge, shard, parts = (1 << 63) - 1, None, []

        def scores(points, q):
            most = len(q) * int(max(-points.min(), points.max(), 1)) * int(max(-q.min(), q.max(), 1)) if len(q) else 0
            if most < 1 << 62:
                return (points @ q).tolist()
            return [int(x) for x in points.astype(object) @ q.astype(object)]

        for b in batches:
            for (s, kind), rows in b.groupby(["shard", "kind"], sort=True):
                if s != shard:
                    shard, parts = s, []
                if kind == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                parts = [pd.concat(parts, ignore_index=True)]
                ids = parts[0]["vec_id"].to_numpy(np.int64)
                points = np.stack(parts[0]["vector"].to_numpy()).astype(np.int64)
                out = []
                for own, q in zip(rows["vec_id"], rows["vector"]):
                    best = heapq.nsmallest(k, ((-x, int(i)) for x, i in zip(scores(points, np.asarray(q, np.int64)), ids) if i != own))
                    # the full value in two parts: any size, and in its order
                    out += [(own, i, max(-edge, min(edge, -x)), decimal.Decimal(-x >> 62), -x & (1 << 62) - 1) for x, i in best]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "high", "low"])
    return run


def _wide(v):
    """Whether a vector is beyond the components that the trees' bounds are exact for."""
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    return F.size(v) * top * top >= float(1 << 40)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows
    of ``candidates`` of highest integer inner product, its own id left out, ties
    to the smaller id; all, if there are fewer. Both are (vec_id long, vector
    array<long>).

    Vectors are compared with those of their length only. NULL ids, NULL vectors
    and vectors with a NULL component take no part. Candidates that share an id
    each count; a query's id leaves out all of its id, and rows of ``queries`` that
    share an id share its ``k`` ranks. The trees take the vectors whose squared
    length is surely below 2 ** 40, so that their bounds are exact; pairs with a larger one
    are scored in blocks with integers of any size and ranked with the others. A score
    beyond a long comes back as the nearest long, in the order of its full value.
    """
    ship_package(candidates.sparkSession)

    def tidy(df):
        v = F.col("vector")
        return df.select("vec_id", v.alias("vector")).where(
            F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull()))

    candidates, queries = tidy(candidates), tidy(queries)
    n, wide = candidates.unionAll(queries).select(_wide(F.col("vector")).alias("wide")).agg(
        F.count("*"), F.max("wide")).first()
    shards = max(1, -(-n // shard_rows))
    dim = F.size("vector").cast("long") * (1 << 32)
    if wide:
        large = _wide(F.col("vector"))
        asked = queries.select("vec_id", "vector", large.alias("large"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
        place = F.pmod(F.xxhash64("vec_id"), F.lit(shards))
        # large candidates meet every query; the others the large queries only
        held = candidates.select((2 * (dim + place) + large.cast("int")).alias("shard"), F.lit(0).alias("kind"), "vec_id", "vector")
        asks = asked.select((2 * (dim + F.col("s")) + 1).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector").unionAll(
            asked.where("large").select((2 * (dim + F.col("s"))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector"))
        kinds = "query_id long, vec_id long, score long, high decimal(38,0), low long"
        found = held.unionAll(asks).repartition(2 * shards, "shard").sortWithinPartitions("shard", "kind").mapInPandas(_exact(k), kinds)
        rest = top_k(candidates.where(~large), queries.where(~large), k, shard_rows)
        score = F.col("score")
        every = found.unionByName(rest.select("query_id", "vec_id", "score", F.shiftright(score, 62).cast("decimal(38,0)").alias("high"),
                                              score.bitwiseAND((1 << 62) - 1).alias("low")))
        order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
        return (every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
    dealt = candidates.select((dim + F.pmod(F.xxhash64("vec_id"), F.lit(shards))).alias("shard"), F.lit(0).alias("kind"),
                              "vec_id", "vector", F.lit(None).cast("double").alias("floor"))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(asked: DataFrame, seed: bool) -> DataFrame:
        asked = asked.select("vec_id", "vector", "floor", to_all).select(
            (dim + F.col("s")).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vector", "floor")
        rows = dealt.unionAll(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        found = rows.mapInPandas(_searcher(k, seed), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = written(searched(queries.withColumn("floor", F.lit(None).cast("double")), True), "top-k-first")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    asked = queries.join(floors.distinct(), "vec_id", "left")
    return searched(asked, False).select("query_id", "rank", "vec_id", "score")
