"""Operators that fold pairs of blocks: the same results as over a table of all pairs, whatever the blocks are."""

import numpy as np
import pytest

from weftnet.operators import graph, likelihood, pairs, prep, qc, significance


@pytest.fixture(scope="module")
def bins(spark):
    rng = np.random.default_rng(6)
    rows = []
    for study, genes, runs in (("a", 23, 40), ("b", 9, 31), ("one", 1, 12), ("two", 2, 12)):
        m = rng.normal(size=(genes, runs))
        m[genes // 2] = m[0] + 0.3 * rng.normal(size=runs)
        if study == "b":
            m[3], m[4] = m[5], 1.0  # a copy, a constant
        rows += [(study, f"g{i:02d}", j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return prep.quantile_bins(spark.createDataFrame(rows, "study string, gene string, run long, x double"), 3).cache()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_likelihood_edges(bins, share):
    whole = pairs.clr(pairs.mutual_information(bins))
    want = {}
    for study, part in whole.toPandas().groupby("study"):
        value = part["clr"].round(9)
        want |= {(study, r.gene_a, r.gene_b): (r.mi, r.clr) for r, v in zip(part.itertuples(), value, strict=True) if v >= np.quantile(value, share)}
    for block in (256, 4):
        got = {(r["study"], r["gene_a"], r["gene_b"]): (r["mi"], r["clr"]) for r in likelihood.edges(bins, share, block).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) for k in got)


def test_likelihood_writes_no_table_of_all_pairs(spark, bins, monkeypatch):
    seen = []
    whole = likelihood.cut
    monkeypatch.setattr(likelihood, "cut", lambda df: seen.append(n := whole(df)) or n)
    likelihood.edges(bins.where("study = 'a'"), 0.95, 4).collect()
    assert max(df.count() for df in seen if "gene_b" in df.columns) <= 16 < 23 * 22 / 2


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    m = np.round(rng.normal(size=(30, 4)), 1)
    m[7] = m[3] = m[21]  # ties at distance 0
    x = spark.createDataFrame([(s, f"g{i:02d}", j, float(v)) for s in ("s", "t") for i, r in enumerate(m[: 30 if s == "s" else 3]) for j, v in enumerate(r)], "study string, gene string, other long, value double")
    want = set()
    for s, n in (("s", 30), ("t", 3)):
        d = np.round(np.sqrt(((m[:n, None] - m[None, :n]) ** 2).sum(2)), 9)
        for i in range(n):
            for j in sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:5]:  # noqa: B023
                want.add((s, f"g{min(i, j):02d}", f"g{max(i, j):02d}"))
    for block in (256, 4):
        assert {tuple(r) for r in graph.neighbours(x, 5, block).collect()} == want


def test_components_by_subspace_iteration(spark):
    """Beyond the limit of the Gram matrix: the same coordinates and shares."""
    rng = np.random.default_rng(12)
    m = rng.normal(size=(30, 2)) @ (rng.normal(size=(2, 45)) * [[3], [2]]) + rng.normal(size=(30, 45))
    m[4] = 1.0  # constant
    for rows in (m, m[:2], m[:, :2]):
        x = spark.createDataFrame([(f"g{i:02d}", j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "gene string, run long, x double")
        (a, share_a), (b, share_b) = qc.principal_components(x), qc.principal_components(x, most=1)
        got, want = (s.orderBy("run").toPandas() for s in (b, a))
        assert np.allclose(got["pc1"], want["pc1"], atol=1e-6)
        assert np.allclose(share_b.orderBy("component").toPandas()["share"][:1], share_a.orderBy("component").toPandas()["share"][:1], atol=1e-8)
        if rows is m:
            assert np.allclose(got["pc2"], want["pc2"], atol=1e-4) and np.allclose(share_b.orderBy("component").toPandas(), share_a.orderBy("component").toPandas(), atol=1e-8)


def test_pair_tests(spark, bins):
    scored = pairs.mutual_information(bins).drop("mi_mm")
    null = significance.pair_null(bins, scored, 12, 5)
    want = {(r["study"], r["gene_a"], r["gene_b"]): r["p_value"] for r in significance.p_values_per_pair(scored, null).collect()}
    for block in (256, 4):
        got = {(r["study"], r["gene_a"], r["gene_b"]): r["p_value"] for r in significance.pair_tests(bins, 12, 5, block=block).collect()}
        assert got == pytest.approx(want) and len(got) == 23 * 22 / 2 + 9 * 8 / 2 + 1
    some = scored.where("gene_a = 'g02' or mi > 0.2").select("study", "gene_a", "gene_b")
    got = {(r["study"], r["gene_a"], r["gene_b"]): r["p_value"] for r in significance.pair_tests(bins, 12, 5, some, 4).collect()}
    assert set(got) == {tuple(r) for r in some.collect()} and got == pytest.approx({k: want[k] for k in got})
    assert significance.pair_tests(bins.limit(0), 12).collect() == []
