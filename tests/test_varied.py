"""Digests without repeats: copies count once, near copies give way, odd rows."""

import numpy as np

from chatlake.operators import varied

SCHEMA = "id long, channel string, message string"


def _digest(spark, rows, **how):
    got = varied.varied_messages(spark.createDataFrame(rows, SCHEMA), ["channel"], **how).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[1]))


def _filler(n, start=1000):
    # other channels' messages, so that the terms below are rare
    return [(start + i, "other", f"word{i} more{i}") for i in range(n)]


def test_copies_fill_one_place(spark):
    rows = [(i, "a", "Alpha beta, gamma!" if i % 2 else "alpha  BETA gamma") for i in range(1, 31)]
    rows += [(40, "a", "delta epsilon"), (41, "a", "zeta eta theta")] + _filler(400)
    got = [r for r in _digest(spark, rows, k=3) if r[0] == "a"]
    assert sorted((r[2], r[3]) for r in got) == [(1, 30), (40, 1), (41, 1)]


def test_near_copies_come_last(spark):
    near = [(i, "a", f"alpha beta gamma delta epsilon tail{i}") for i in range(1, 5)]
    rows = near + [(9, "a", "one two three four five six")] + _filler(400)
    ids = [r[2] for r in _digest(spark, rows, k=5) if r[0] == "a"]
    assert ids[0] in (1, 2, 3, 4) and ids[1] == 9 and sorted(ids) == [1, 2, 3, 4, 9]


def test_odd_rows(spark):
    rows = [(1, None, "alpha"), (2, "none", None), (3, "none", ""), (4, "none", "!?"), (5, "b", "x"), (6, "b", "x " * 5000)]
    got = _digest(spark, rows)
    assert sorted((str(r[0]), r[2]) for r in got) == [("None", 1), ("b", 5), ("b", 6)]
    assert _digest(spark, rows[:0] or [(1, "a", None)]) == []
    assert varied.varied_messages(spark.createDataFrame([], SCHEMA), ["channel"]).collect() == []


def test_walk_and_choice_against_plain_loops():
    rnd = np.random.default_rng(5)
    for _ in range(40):
        n = int(rnd.integers(1, 9))
        terms = [[f"t{j}" for j in rnd.choice(6, rnd.integers(0, 5), replace=False)] for _ in range(n)]
        weights = [rnd.random(len(t)) for t in terms]
        sim = varied.similarities(terms, weights)
        vec = [dict(zip(t, w)) for t, w in zip(terms, weights)]
        length = [sum(w * w for w in v.values()) ** 0.5 for v in vec]
        for i in range(n):
            for j in range(n):
                dot = sum(w * vec[j].get(t, 0) for t, w in vec[i].items())
                want = dot / length[i] / length[j] if i != j and dot else 0
                assert abs(sim[i, j] - want) < 1e-8
        r = [1 / n] * n
        for _ in range(varied.ROUNDS):
            r = [(1 - varied.WALK) / n + varied.WALK * sum(
                sim[i, j] / sim[:, j].sum() * r[j] for j in range(n) if sim[:, j].sum() > 0) for i in range(n)]
        got = varied.centrality(sim)
        assert np.allclose(got, r)
        chosen = varied.choose(sim, got / got.max(), 3)
        taken = []
        for row, gain in chosen:
            gains = {i: round(varied.BALANCE * got[i] / got.max() - (1 - varied.BALANCE) * max([sim[i, j] for j in taken], default=0), 9)
                     for i in range(n) if i not in taken}
            assert abs(gain - max(gains.values())) < 2e-9 and abs(gains[row] - gain) < 2e-9
            taken.append(row)
        assert len(chosen) == min(3, n)
