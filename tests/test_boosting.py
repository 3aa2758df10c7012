"""Boosted trees: interactions, early stopping, blocks that don't matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.operators import boosting


def table(spark, m, study="s"):
    rows = [(study, f"g{i:02d}", j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "study string, gene string, run long, x double")


@pytest.fixture(scope="module")
def matrix():
    """g11 depends on whether g02 and g09 have the same sign, g10 on g04, g05 on nothing; g07 is constant."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(12, 400))
    m[11] = np.sign(m[2] * m[9]) + 0.15 * rng.normal(size=400) + 0.1 * m[2]
    m[10] = m[4] ** 2 + 0.1 * rng.normal(size=400)
    m[7] = 1.5
    return m


def shares(importance, target):
    got = {r["regulator"]: r["importance"] for r in importance.where(F.col("target") == target).collect()}
    return {g: v / sum(got.values()) for g, v in got.items()}


def test_interactions_that_stumps_miss(spark, matrix):
    x = table(spark, matrix)
    deep = boosting.regulator_importance(x).cache()
    got = shares(deep, "g11")
    assert got["g02"] + got["g09"] > 0.7 and min(got["g02"], got["g09"]) > 0.2
    assert max(shares(deep, "g10").items(), key=lambda kv: kv[1])[0] == "g04" and shares(deep, "g10")["g04"] > 0.6
    stumps = boosting.regulator_importance(x, boosting.Trees(depth=1)).where("target = 'g11'")
    of_both = lambda rows: rows.where("target = 'g11' and regulator in ('g02', 'g09')").agg(F.sum("importance")).first()[0]
    assert of_both(stumps) < 0.6 * of_both(deep)  # stumps don't help, and stop
    # a tree counts 1: noise stops early, what helps goes on
    trees = {r["target"]: r["n"] for r in deep.groupBy("target").agg(F.round(F.sum("importance"), 6).alias("n")).collect()}
    assert 50 >= trees["g11"] > 1.5 * trees["g05"] and trees["g05"] >= 10 and "g07" not in trees
    assert deep.where("regulator = target").count() == 0


def test_blocks_do_not_matter(spark, matrix):
    """A grid of blocks, level by level, grows the trees that one task does."""
    t = boosting.Trees(rounds=4, window=3)
    x = table(spark, matrix[:, :90]).union(table(spark, matrix[:3, :20], "small")).repartition(3)
    want = {(r["study"], r["regulator"], r["target"]): r["importance"] for r in boosting.regulator_importance(x, t).collect()}
    got = {(r["study"], r["regulator"], r["target"]): r["importance"] for r in boosting.regulator_importance(x, t, block=5).collect()}
    assert set(got) == set(want) and {k[0] for k in got} == {"s", "small"}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_splits_against_brute_force():
    rng = np.random.default_rng(5)
    x, t = rng.normal(size=(5, 60)), boosting.Trees()
    codes, res = boosting.binned(x), x[:2] - x[:2].mean(1, keepdims=True)
    node, bag = rng.integers(0, 2, (2, 60)), rng.random((2, 60)) < 0.8
    gain, reg, at = boosting.best_splits(codes, np.arange(5), res, np.arange(2), node, bag, 2, t)
    for k in range(2):
        for v in range(2):
            best = (0.0, 0, 0)
            for r in range(5):
                for b in range(boosting.BINS):
                    mine = bag[k] & (node[k] == v)
                    left, right = res[k][mine & (codes[r] <= b)], res[k][mine & (codes[r] > b)]
                    if r != k and min(len(left), len(right)) >= t.least:
                        g = left.sum() ** 2 / len(left) + right.sum() ** 2 / len(right) - res[k][mine].sum() ** 2 / mine.sum()
                        best = max(best, (round(g, 4), -r, -b))
            assert abs(gain[k, v] - best[0]) < 1e-3 and (reg[k, v], at[k, v]) == (-best[1], -best[2])


def test_empty_and_tiny(spark):
    x = table(spark, np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert boosting.regulator_importance(x).collect() == []
    assert boosting.regulator_importance(x.limit(0)).collect() == []
