import numpy as np
import pytest
from pyspark.sql import functions as F

from weftnet.llm import topk


def brute(rows, every, k):
    def fine(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        out = [int(np.floor(np.float64(x) * 1024)) for x in v]
        return out if sum(x * x for x in out) < 9e18 else None

    have = [(i, vec_id, fine(v)) for i, (vec_id, v) in enumerate(rows) if vec_id is not None and fine(v) is not None]
    out = []
    for i, query, q in have:
        if query % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), vec_id) for j, vec_id, v in have if j != i)
            out += [(query, n + 1, vec_id, -s) for n, (s, vec_id) in enumerate(scores[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 20))
    out = [(k - 40, np.float32(centres[k % 6] + rng.normal(size=20) * 0.2).tolist()) for k in range(700)]
    out += [(1000 + k, np.float32(rng.normal(size=20)).tolist()) for k in range(400)]
    out += [(2000 + 10 * k, out[7][1]) for k in range(40)]  # copies: ties
    out += [(3000, [0.0] * 20), (3010, [0.0] * 20), (3020, None), (3030, [1.0, None] * 10), (3040, [float("nan")] * 20), (3050, [float("inf")] * 20), (3060, []), (3070, [1.5, -2.0]), (3080, [1e30] * 20), (None, out[0][1]), (3090, [2e5] * 20), (3100, [-1e-9] * 20)]
    return out + [out[40], out[40], out[41]]


@pytest.mark.parametrize(("shard", "queries"), [(topk.SHARD, topk.QUERIES), (150, 9)])
def test_against_brute_force(spark, rows, shard, queries, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, row int, shard int, v string")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 7, shard, queries).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 10, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-1.0])], "vec_id long, embedding array<float>")
    one = F.col("vec_id") == 0
    assert [tuple(r) for r in topk.top_k(df, one).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 512), (0, 2, 2, -(1024**2))]
    assert topk.top_k(df.where("vec_id = 0"), one).collect() == []
    assert topk.top_k(df.where("vec_id > 0"), one).collect() == []
    assert topk.top_k(df.limit(0), one).collect() == []
    assert topk.top_k(df.where("vec_id > 0"), one).dtypes == topk.top_k(df, one).dtypes


def test_skips_work():
    """Of clustered vectors, most are never probed; with whole scores nothing changes."""
    rng = np.random.default_rng(2)
    x = np.round((rng.normal(size=(30, 32))[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 32)) * 0.1) * 1024).astype(np.int64)
    shard = topk.Shard(x, np.arange(6000), np.arange(6000), True)
    for row in range(20):
        score, ids = shard.search(x[row], row, 10)
        whole = x @ x[row]
        want = sorted((-int(s), k) for k, s in enumerate(whole) if k != row)[:10]
        assert list(zip((-score).tolist(), ids.tolist())) == want
    assert shard.scored < 20 * x.size / 4
