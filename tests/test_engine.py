"""Operators against brute force, planted structure and invariants."""

import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftnet.operators import boosting, community, consensus, enrich, graph, normalise, pairs, prep, qc, significance
from weftnet.sources import readers, writers


def long_table(spark, m, study="s"):
    rows = [(study, f"g{i:02d}", j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "study string, gene string, run long, x double")


def bins_of(v, k=5):
    q = np.quantile(v, [j / k for j in range(1, k)])
    edges = sorted({e for e in q if v.min() < e < v.max()})
    return np.array([sum(e <= x for e in edges) for x in v])


def mi_of(a, b):
    n, out = len(a), 0.0
    for x, y in itertools.product(set(a), set(b)):
        c = sum((a == x) & (b == y))
        if c:
            out += c / n * math.log(c * n / (sum(a == x) * sum(b == y)))
    return out


def test_binning_edges_and_information(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(6, 23))
    m[1] = 3.0  # constant
    m[2, :8] = m[2].max() + 1  # repeated maximum
    m[3, :9] = 0.0
    m[5] = m[0] ** 2 + 0.01 * rng.normal(size=23)
    x = long_table(spark, m)
    bins = prep.quantile_bins(x)
    got = {(r["gene"], r["run"]): r["bin"] for r in bins.collect()}
    want = [bins_of(v) for v in m]
    assert all(got[f"g{i:02d}", j] == want[i][j] for i in range(6) for j in range(23))
    for block in (2, 256):
        mi = {(r["gene_a"], r["gene_b"]): (r["mi"], r["mi_mm"]) for r in pairs.mutual_information(bins, block).collect()}
        assert len(mi) == 15
        for i, j in itertools.combinations(range(6), 2):
            v = mi[f"g{i:02d}", f"g{j:02d}"][0]
            assert abs(v - mi_of(want[i], want[j])) < 1e-9 and v > -1e-12
            assert v <= min(mi_of(want[i], want[i]), mi_of(want[j], want[j])) + 1e-9
    assert mi["g00", "g05"][0] > 0.5


def test_correlations(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5, 30)).round(1)
    m[4] = 2.0
    x = long_table(spark, m)
    for method, values in (("pearson", m), ("spearman", np.array([pd.Series(v).rank().to_numpy() for v in m]))):
        r = {(q["gene_a"], q["gene_b"]): q["r"] for q in pairs.correlation(x, method, block=2).collect()}
        for i, j in itertools.combinations(range(5), 2):
            want = 0.0 if 4 in (i, j) else np.corrcoef(values[i], values[j])[0, 1]
            assert abs(r[f"g{i:02d}", f"g{j:02d}"] - want) < 1e-9


def test_clr_equals_loop(spark):
    rng = np.random.default_rng(42)
    n = 20
    m = rng.exponential(0.1, (n, n))
    m = (m + m.T) / 2
    rows = [("s", f"g{i:02d}", f"g{j:02d}", float(m[i, j])) for i, j in itertools.combinations(range(n), 2)]
    got = {(r["gene_a"], r["gene_b"]): r["clr"] for r in pairs.clr(spark.createDataFrame(rows, "study string, gene_a string, gene_b string, mi double")).collect()}
    for i, j in itertools.combinations(range(n), 2):
        z = [(m[i, j] - np.delete(m[k], k).mean()) / np.delete(m[k], k).std() for k in (i, j)]
        assert abs(got[f"g{i:02d}", f"g{j:02d}"] - math.hypot(*z) / math.sqrt(2)) < 1e-4


def test_tiny_studies_have_no_edges(spark):
    rng = np.random.default_rng(2)
    for n in (4, 5, 6):
        x = long_table(spark, rng.permuted(np.tile(np.arange(n, dtype=float), (8, 1)), axis=1))
        bins = prep.quantile_bins(x)
        mi = pairs.mutual_information(bins)
        p = significance.p_values(mi, significance.global_null(bins, 50))
        assert significance.significant(p, 0.001).count() == 0
        assert p.where("p_value < 0 or p_value > 1").count() == 0


def test_window_p_values_equal_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    mi = spark.createDataFrame([("s", f"a{k}", f"b{k}", float(v)) for k, v in enumerate(rng.integers(0, 9, 60) / 7)], "study string, gene_a string, gene_b string, mi double")
    null = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(rng.integers(0, 9, 90) / 7)], "study string, perm int, mi double")
    a = sorted(map(tuple, significance.p_values(mi, null).select("gene_a", "p_value").collect()))
    monkeypatch.setattr(significance, "MOST_BROADCAST", 0)
    assert a == sorted(map(tuple, significance.p_values(mi, null).select("gene_a", "p_value").collect()))


def test_planted_modules(spark):
    rng = np.random.default_rng(4)
    frames = []
    for s in range(3):
        m = rng.normal(size=(40, 40))
        for b in range(3):
            m[10 * b : 10 * b + 10] = rng.normal(size=40) + 0.3 * rng.normal(size=(10, 40))
        frames.append(long_table(spark, m, f"s{s}"))
    x = frames[0].union(frames[1]).union(frames[2])
    bins = prep.quantile_bins(x)
    e = significance.significant(significance.p_values(pairs.mutual_information(bins), significance.global_null(bins, 300)), 0.01)
    net = consensus.consensus(e, 3).select(F.lit(0).alias("graph"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"))
    want = {frozenset(f"g{i:02d}" for i in range(10 * b, 10 * b + 10)) for b in range(3)}
    for modules in (graph.mcode(net), community.communities(net, "leiden"), community.communities(net, "louvain")):
        got = {}
        for r in modules.collect():
            got.setdefault(r["module"], set()).add(r["v"])
        assert {frozenset(v) for v in got.values()} == want


def random_graph(seed, n=16, p=0.25):
    rng = np.random.default_rng(seed)
    return [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < p]


def adjacency(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return adj


def core_of(adj):
    adj, core, k = {v: set(u) for v, u in adj.items()}, {}, 0
    while adj:
        v = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[v]))
        core[v] = k
        for u in adj.pop(v):
            adj[u].discard(v)
    return core


def test_graph_measures(spark):
    graphs = {0: random_graph(1), 1: [(0, 1), (1, 2), (0, 2), (2, 3)], 2: [(0, k) for k in range(1, 6)], 3: list(itertools.combinations(range(5), 2)) + [(4, 5)] + list(itertools.combinations(range(5, 9), 2))}
    df = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e] + [(1, 3, 3), (1, 1, 0)], "graph int, a long, b long")
    core = {(r["graph"], r["v"]): r["core"] for r in graph.coreness(df).collect()}
    dense = {(r["graph"], r["v"]): r["density"] for r in graph.local_density(df).collect()}
    comp = {(r["graph"], r["v"]): r["component"] for r in graph.components(df).collect()}
    for g, e in graphs.items():
        adj = adjacency(e)
        want = core_of(adj)
        for v, near in adj.items():
            assert core[g, v] == want[v]
            inside = near | {v}
            n = sum(a in inside and b in inside for a, b in e)
            assert abs(dense[g, v] - n / (len(inside) * (len(inside) - 1) / 2)) < 1e-12
            seen, todo = {v}, [v]
            while todo:
                for u in adj[todo.pop()] - seen:
                    seen.add(u)
                    todo.append(u)
            assert comp[g, v] == min(seen)
    assert graph.mcode(df.limit(0)).collect() == [] and graph.components(df.limit(0)).collect() == []


def test_path_components(spark):
    n = 200
    df = spark.range(n - 1).select(F.lit(0).alias("graph"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert graph.components(df).agg(F.max("component"), F.count("*")).first()[:] == (0, n)


def test_modularity_of_communities(spark):
    edges = [(a + 6 * k, b + 6 * k) for k in range(4) for a, b in itertools.combinations(range(6), 2)] + [(5, 6), (11, 12), (17, 18)]
    df = spark.createDataFrame([(0, a, b) for a, b in edges], "graph int, a long, b long")
    for method in ("louvain", "leiden"):
        found = community.communities(df, method)
        assert found.groupBy("module").count().select("count").distinct().collect() == [(6,)]
        m = len(edges)
        want = sum(15 / m - (sum(sum(v in e for e in edges) for v in range(6 * k, 6 * k + 6)) / (2 * m)) ** 2 for k in range(4))
        assert abs(community.modularity(df, found).first()["modularity"] - want) < 1e-9
    one = found.select("graph", F.lit(0).alias("module"), "v")
    split, table = community.refine_modules(one, df, 10, "leiden")
    assert split.select("module").distinct().count() == 4 and table.count() == 4


@pytest.mark.parametrize("method", ["louvain", "leiden"])
def test_components_larger_than_a_task(spark, method):
    """Moves over tables come close to the sequential ones; small components stay as they are."""
    rng = np.random.default_rng(11)
    group = rng.integers(0, 8, 160)
    edges = [(0, a, b) for a in range(160) for b in range(a) if rng.random() < (0.35 if group[a] == group[b] else 0.02)]
    edges += [(0, 1000 + a, 1000 + b) for a, b in itertools.combinations(range(5), 2)] 
    df = spark.createDataFrame(edges, "graph int, a long, b long")
    q = lambda m: {r["graph"]: r["modularity"] for r in community.modularity(df, m).collect()}
    alone, spread = community.communities(df, method, least_size=1), community.communities(df, method, least_size=1, task_edges=100).cache()
    want, got = q(alone), q(spread)
    assert all(got[g] >= 0.98 * want[g] for g in want), (want, got)
    assert spread.count() == alone.count() == spread.select("graph", "v").distinct().count()
    five = spread.where("v >= 1000").select("module").distinct().collect()
    assert len(five) == 1 and spread.where((F.col("graph") == 0) & (F.col("module") == five[0][0])).count() == 5
    if method == "louvain":  # not even a merged vertex fits: moves alone
        nothing = community.communities(df, method, least_size=1, task_edges=0).cache()
        assert q(nothing)[0] >= 0.95 * want[0] and nothing.count() == alone.count()
    else:  # connected communities
        inner = graph.induced(df, spread).select(F.concat_ws("|", "graph", "module").alias("graph"), "a", "b")
        assert graph.components(inner).groupBy("graph").agg(F.countDistinct("component").alias("n")).where("n > 1").count() == 0


def test_enrichment_value(spark):
    modules = spark.createDataFrame([(1, f"g{k}") for k in range(8)], "module int, gene string")
    sets = spark.createDataFrame([("S", f"g{k}") for k in list(range(4, 8)) + list(range(20, 26))] + [("outside", "x1"), ("outside", "x2"), ("none", "g20"), ("none", "g21")], "set_name string, gene string")
    bg = spark.createDataFrame([(f"g{k}",) for k in range(30)], "gene string")
    rows = enrich.annotate(modules, sets, bg, fdr=2).collect()
    assert len(rows) == 1 and rows[0]["overlap"] == 4 and abs(rows[0]["p_value"] - 0.2301541537) < 1e-9


def test_name_filters(spark):
    names = "RPL3 rps6 MRPL12A RPLX-1 MIR21 LET-7 MIRO1 ACTB".split()
    got = {r["gene"]: (r["ribosomal"], r["micro"]) for r in prep.name_flags(spark.createDataFrame([(n,) for n in names], "gene string")).collect()}
    assert [n for n in names if got[n][0]] == ["RPL3", "rps6", "MRPL12A"] and [n for n in names if got[n][1]] == ["MIR21", "LET-7", "MIRO1"]


def test_normalisation(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(50, 500, 200)
    m = np.array([rng.poisson(base * s) for s in (1, 2, 0.5, 1, 3)], float).T
    m[:10, 4] *= 20  # a few genes of one run stand out
    rows = [(f"g{i}", f"r{j}", float(m[i, j])) for i in range(200) for j in range(5) if m[i, j]]
    counts = spark.createDataFrame(rows, "gene string, run string, count double")
    lib = m.sum(0)
    for factors in (normalise.tmm_factors(counts), normalise.rle_factors(counts)):
        f = {r["run"]: r["factor"] for r in factors.collect()}
        assert abs(np.prod(list(f.values())) - 1) < 1e-9
        scale = np.array([f[f"r{j}"] for j in range(5)]) * lib
        assert np.allclose(scale / scale[0], [1, 2, 0.5, 1, 3], rtol=0.06)
    tidy = normalise.tidy_values(spark.createDataFrame([(1.0,), (None,), (float("inf"),), (float("-inf"),), (4.0,)], "x double"), "x")
    assert sorted(r[0] for r in tidy.collect()) == [1.0, 1.0, 1.0, 4.0, 4.0]


def test_effective_count():
    assert [consensus.effective_count(3, n) for n in (2, 3, 17)] == [1, 3, 3]
    assert consensus.effective_count(3, 5, 0.5) == 2 and consensus.effective_count(3, 17, 0.3) == 5


def test_empty_networks(spark):
    e = spark.createDataFrame([], "gene_a string, gene_b string")
    assert consensus.compare(e, e).first()["jaccard"] == 0.0


def test_sources(spark, tmp_path):
    d = tmp_path / "counts" / "deep"
    d.mkdir(parents=True)
    (d / "run1_ReadsPerGene.out.tab").write_text("N_unmapped\t1\t1\t1\nN_x\t1\t1\t1\nN_y\t1\t1\t1\nN_z\t1\t1\t1\nA\t5\t1\t1\nB\t0\t2\t3\n")
    assert sorted(map(tuple, readers.star_counts(spark, str(tmp_path / "counts")).collect())) == [("A", "run1", 5.0), ("B", "run1", 0.0)]
    (tmp_path / "m.tsv").write_text("gene\tr1\tr2\nA\t1\t2.5\nB\t3\t\n")
    assert sorted(map(tuple, readers.wide_matrix(spark, str(tmp_path / "m.tsv")).fillna(-1).collect())) == [("A", "r1", 1.0), ("A", "r2", 2.5), ("B", "r1", 3.0), ("B", "r2", -1.0)]
    (tmp_path / "meta.tsv").write_text("Run\tBioProject\nr1\tP\n")
    assert readers.metadata(spark, str(tmp_path / "meta.tsv")).count() == 1
    with pytest.raises(ValueError):
        readers.metadata(spark, str(tmp_path / "m.tsv"))
    (tmp_path / "one.gmt").write_text("S1\t\tA\tB\tA\t\nshort\tx\nS2\tabout\tC\t\n")
    (tmp_path / "two.gmt").write_text("S1\tnew\tD\t\n")
    sets = readers.gmt(spark, [str(tmp_path / "one.gmt"), str(tmp_path / "two.gmt")])
    assert sorted((r["set_name"], r["library"], r["gene"]) for r in enrich.merged_sets(sets).collect()) == [("S1", "two", "D"), ("S2", "one", "C")]
    assert {r["library"]: r["n_genes"] for r in enrich.manifest(sets).collect()} == {"one": 3, "two": 1}
    assert readers.library("one", str(tmp_path)).endswith("one.gmt")
    with pytest.raises(FileNotFoundError):
        readers.library("absent", str(tmp_path))
    (tmp_path / "names.txt").write_text("A\n\n B \n")
    assert sorted(r[0] for r in readers.names(spark, str(tmp_path / "names.txt")).collect()) == ["A", "B"]
    (tmp_path / "map.csv").write_text("k,v\nA,1\nA,2\nB,\n")
    assert {r["k"]: r["v"] for r in enrich.collapsed(readers.sniffed(spark, str(tmp_path / "map.csv")), "k", ["v"]).collect()} == {"A": "1;2", "B": ""}
    slugs = spark.createDataFrame([("a b/c",), ("__x..",), ("!!",), (None,)], "n string").select(enrich.slug(F.col("n")))
    assert [r[0] for r in slugs.collect()] == ["a_b_c", "x", "unknown", "unknown"]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("A", "B", 0.5), ("A", "C&", 0.25)], "gene_a string, gene_b string, w double")
    genes = spark.createDataFrame([("A", 1), ("B", 2), ("C&", 3)], "gene string, ord long")
    writers.matrix_market(e, genes, f"{tmp_path}/m", "w")
    back = readers.matrix_market(spark, f"{tmp_path}/m", genes.select("ord", "gene"))
    assert sorted((r["gene_a"], r["gene_b"], r["value"]) for r in back.collect()) == [("A", "B", 0.5), ("A", "C&", 0.25), ("B", "A", 0.5), ("C&", "A", 0.25)]
    writers.graphml(e, f"{tmp_path}/g", weight="w")
    import xml.etree.ElementTree as ET

    root = ET.fromstring("".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/g").collect()).encode())  # noqa: S314
    assert len(root.findall(".//{*}node")) == 3 and {x.get("target") for x in root.findall(".//{*}edge")} == {"B", "C&"}
    m = spark.createDataFrame([(0, "A"), (1, "B")], "module int, gene string")
    writers.module_table(m, f"{tmp_path}/t")
    assert sorted(map(tuple, readers.modules(spark, f"{tmp_path}/t").collect())) == [(0, "A"), (1, "B")]
    writers.cache(e, f"{tmp_path}/c", "x1")
    assert readers.cached(spark, f"{tmp_path}/c", "x1").count() == 2 and readers.cached(spark, f"{tmp_path}/c", "x2") is None and readers.cached(spark, f"{tmp_path}/none", "x1") is None
    assert writers.report({"n": 1}, {"a": 1.0, "b": 3.0}).splitlines()[1].startswith("b\t3.00 s\t75.0")


def test_settings(tmp_path):
    from weftnet.plans.pipeline import Settings

    (tmp_path / "s.json").write_text(json.dumps({"permutations": 7, "unknown": 1, "modules": {"method": "leiden", "other": 2}}))
    s = readers.settings(Settings(), str(tmp_path / "s.json"))
    assert s.permutations == 7 and s.modules.method == "leiden" and s.modules.least_size == 3


def greedy(far, method):
    """Agglomeration that looks for the nearest two clusters each time; clusters are sets of samples."""
    n, steps = len(far), []
    clusters = {k: [k] for k in range(n)}
    while len(clusters) > 1:

        def apart(a, b):
            x, y = clusters[a], clusters[b]  # noqa: B023
            between = far[np.ix_(x, y)]
            if method == "average":
                return between.mean()
            own = lambda z: (far[np.ix_(z, z)] ** 2).sum() / (2 * len(z) ** 2)
            return math.sqrt(2 * len(x) * len(y) / (len(x) + len(y)) * ((between**2).mean() - own(x) - own(y)))

        h, a, b = min((apart(a, b), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
        clusters[n + len(steps)] = clusters.pop(a) + clusters.pop(b)
        steps.append((a, b, h, len(clusters[n + len(steps)])))
    return steps


def test_rules_in_order(spark):
    rows = spark.createDataFrame([(1, "P10", "x"), (2, "P1", "y"), (3, None, "y"), (4, "Q", None)], "run int, project string, title string")
    rules = [("project", "P1", {"a": "one", "b": "B1"}), ("title", "^y$", {"a": "two"}), ("project", "P1$", {"b": "B2"}), ("project", "P10", {"a": "three"})]
    got = {r["run"]: (r["a"], r["b"], r["c"]) for r in enrich.relabelled(rows, rules, {"a": "A", "b": "B", "c": "C"}).collect()}
    assert got == {1: ("three", "B1", "C"), 2: ("two", "B2", "C"), 3: ("two", "B", "C"), 4: ("A", "B", "C")}


def test_run_log(spark, tmp_path):
    import logging

    from weftnet.plans.runlog import RunLog

    log = logging.getLogger("weftnet.resume")
    before = logging.getLogger("weftnet").level
    with RunLog("weftnet") as run:
        with run.step("score"):
            log.info("3 of %d studies", 5)
        log.debug("not this")
        try:
            with run.step("score"):
                raise ValueError
        except ValueError:
            pass
        run.save(spark, str(tmp_path), {"genes": 7})
    log.info("after the run")
    assert logging.getLogger("weftnet").level == before
    text = [r[0] for r in spark.read.text(f"{tmp_path}/log").collect()]
    assert len(text) == 5 and "3 of 5 studies" in text[1] and "starting: score" in text[0]
    facts = [r[0] for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert facts[0] == "genes: 7" and facts[1].startswith("score\t") and facts[1].endswith("100.0 %") and len(facts) == 2


def test_core_levels_look_at_fewer_and_fewer(spark):
    """A long path falls from its ends: only neighbours of what fell are looked at again."""
    n = 40
    edges = [(0, k, k + 1) for k in range(n)] + [(0, 1000 + a, 1000 + b) for a, b in itertools.combinations(range(6), 2)]
    df = spark.createDataFrame(edges, "graph int, a long, b long")
    touched = []
    core = {r["v"]: r["core"] for r in graph.coreness(df, touched).collect()}
    assert all(core[k] == 1 for k in range(n + 1)) and all(core[1000 + k] == 5 for k in range(6))
    assert touched[0] == n + 7 and max(touched[1:]) <= 2 and len(touched) == n // 2 + 1


def test_diagnostics(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=300)
    df = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(v)], "study string, n int, value double")
    got = {r["pos"]: r for r in qc.rolling(df, "study", "n", "value").collect()}
    w = max(5, min(401, 300 // 50)) | 1
    s = pd.Series(v)
    for name, q in (("median", 0.5), ("q10", 0.1), ("q90", 0.9)):
        want = s.rolling(w, center=True, min_periods=max(3, w // 5)).quantile(q)
        assert all(abs(got[k + 1][name] - want[k]) < 1e-9 for k in range(300))
    m = rng.normal(size=(12, 6))
    x = long_table(spark, m).select("gene", "run", "x")
    scores, share = qc.principal_components(x, 2)
    z = (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
    values = np.linalg.svd(z.T, compute_uv=False)
    assert np.allclose(share.toPandas()["share"], values[:2] ** 2 / (values**2).sum())
    rng = np.random.default_rng(4)
    for method in ("average", "ward"):
        m = rng.random((40, 3))
        far = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
        rows = pd.DataFrame([(i, j, far[i, j]) for j in range(40) for i in range(j)], columns=["run_a", "run_b", "distance"])
        got, want = qc.linkage(rows, method), greedy(far, method)
        assert [s[:2] + s[3:] for s in got] == [s[:2] + s[3:] for s in want] and np.allclose([s[2] for s in got], [s[2] for s in want])
    steps = qc.linkage(pd.DataFrame([(0, 1, 1.0), (0, 2, 4.0), (1, 2, 6.0)], columns=["run_a", "run_b", "distance"]))
    assert steps == [(0, 1, 1.0, 2), (2, 3, 5.0, 3)]


def test_neural_information(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=80)
    z = prep.zscores(long_table(spark, np.array([a, a + 0.1 * rng.normal(size=80), rng.normal(size=80)])))
    p = spark.createDataFrame([("s", "g00", "g01"), ("s", "g00", "g02")], "study string, gene_a string, gene_b string")
    mi = {r["gene_b"]: r["mi"] for r in pairs.neural_information(z, p, epochs=300).collect()}
    assert mi["g01"] > 0.7 > 0.4 > mi["g02"] >= 0


def test_training_is_written_once_and_taken_apart(spark, tmp_path):
    rng = np.random.default_rng(7)
    a = rng.normal(size=60)
    x = long_table(spark, np.array([a, a + 0.1 * rng.normal(size=60), rng.normal(size=60)]))
    z = prep.zscores(x.union(x.withColumn("study", F.lit("t"))))
    p = spark.createDataFrame([(s, "g00", g) for s in "st" for g in ("g01", "g02")], "study string, gene_a string, gene_b string")
    records = pairs.neural_records(z, p, epochs=80)
    scores = writers.training(records, str(tmp_path))
    assert {tuple(r)[:3] for r in scores.collect()} == {tuple(r) for r in p.collect()}
    curve = spark.read.csv(f"{tmp_path}/loss_curve", sep="\t", header=True, inferSchema=True)
    assert curve.groupBy("study").agg(F.count("*").alias("n"), F.min("epoch"), F.max("epoch")).select("n", "min(epoch)", "max(epoch)").distinct().collect() == [(80, 0, 79)]
    assert curve.where("epoch = 79").agg(F.max("mean_loss")).first()[0] < curve.where("epoch = 0").agg(F.min("mean_loss")).first()[0]
    summary = spark.read.csv(f"{tmp_path}/batch_summary", sep="\t", header=True, inferSchema=True)
    assert summary.groupBy("study").agg(F.sum("n_pairs").alias("n")).select("n").distinct().collect() == [(2,)] and summary.where("seconds <= 0").count() == 0
    assert all(r["loss_reduction"] == pytest.approx(r["initial_loss"] - r["final_loss"]) for r in summary.collect())
    raw = spark.read.json(f"{tmp_path}/raw_diagnostics")
    assert {len(r["losses"]) for r in raw.collect()} == {80} and raw.count() == summary.count()
    assert pairs.neural_records(z, p.limit(0)).collect() == []


def test_regulators(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(6, 60))
    m[3] = m[0] + 0.05 * rng.normal(size=60)
    imp = boosting.regulator_importance(long_table(spark, m))
    top = imp.where("target = 'g03'").orderBy(F.desc("importance")).first()
    assert top["regulator"] == "g00" and boosting.importance_edges(imp).where("gene_a = 'g00' and gene_b = 'g03'").count() == 1


def test_streaming_equals_table(spark, tmp_path):
    from weftnet.streaming.diagnostics import windowed_summary

    df = spark.sql("select timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) as ts, concat('e', id % 2) as event_type, cast(id as double) as value from range(100)")
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_summary(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, windowed_summary(df).collect()))


def test_whole_run(spark, tmp_path):
    from weftnet.plans.pipeline import Modules, Settings, likelihood_network, run, save

    rng = np.random.default_rng(9)
    rows, meta = [], []
    for s in range(3):
        m = rng.normal(size=(24, 30))
        for b in range(2):
            m[8 * b : 8 * b + 8] = rng.normal(size=30) + 0.3 * rng.normal(size=(8, 30))
        rows += [(f"g{i:02d}", f"s{s}r{j}", float(m[i, j])) for i in range(24) for j in range(30)]
        meta += [(f"s{s}r{j}", f"study {s}") for j in range(30)]
    x = spark.createDataFrame(rows, "gene string, run string, x double")
    md = spark.createDataFrame([*meta, ("other", "study 9"), ("s0r1", None), ("s0r2", "study 0")], "run string, project string")
    sets = spark.createDataFrame([("lib", f"S{b}", f"g{i:02d}") for b in range(2) for i in range(8 * b, 8 * b + 8)], "library string, set_name string, gene string")
    bg = x.select("gene").distinct()
    for method in ("mcode", "leiden"):
        s = Settings(permutations=200, p_threshold=0.02, modules=Modules(method=method, refine_above=50))
        out = run(x, md, s, sets, background=bg, cache=f"{tmp_path}/{method}-cache")
        got = {}
        for r in out.modules.collect():
            got.setdefault(r["module"], set()).add(r["gene"])
        assert {frozenset(v) for v in got.values()} == {frozenset(f"g{i:02d}" for i in range(8 * b, 8 * b + 8)) for b in range(2)}
        assert {(r["set_name"], r["library"], r["overlap"]) for r in out.annotation.collect()} == {("S0", "lib", 8), ("S1", "lib", 8)}
    save(out, f"{tmp_path}/out")
    assert readers.modules(spark, f"{tmp_path}/out/master_modules").count() == 16
    assert run(x, md, s, cache=f"{tmp_path}/{method}-cache").master.count() == out.master.count()
    edges, modules = likelihood_network(x)
    assert edges.count() >= 13 and modules.count() > 0
