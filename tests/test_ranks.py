"""Ranks, percentiles and adjusted p-values of large groups against plain twins; outputs read back."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftnet.functions import ranks, scratch
from weftnet.operators import community, enrich, graph, normalise, pairs, qc, significance
from weftnet.sources import readers, writers


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(4)
    rows = [("a", k, float(x)) for k, x in enumerate(rng.normal(size=3000))]
    rows += [("b", k, float(x)) for k, x in enumerate(rng.integers(0, 5, 800))]
    rows += [("c", 0, 2.5), ("d", 0, 1.0), ("d", 1, 1.0), ("e", 0, 1e9)] + [("e", k, k / 1e6) for k in range(1, 500)]
    return spark.createDataFrame(rows, "study string, n int, v double")


def test_percentile(values):
    x = values.toPandas()
    for share in (0.0, 0.5, 0.95, 0.999, 1.0):
        got = {r["study"]: r["cut"] for r in ranks.percentile(values, "v", share).collect()}
        want = x.groupby("study")["v"].quantile(share)
        assert set(got) == set(want.index) and all(abs(got[s] - want[s]) < 1e-9 * max(1, abs(want[s])) for s in got)
    assert ranks.percentile(values.limit(0), "v", 0.5).collect() == []


def test_largest(values):
    x = values.toPandas().sort_values(["study", "v", "n"], ascending=[True, False, True])
    for most in (1, 7, 500, 10_000):
        got = sorted(map(tuple, ranks.largest(values, "v", most, ("n",)).collect()))
        assert got == sorted(map(tuple, x.groupby("study").head(most).itertuples(index=False)))


def test_numbered(spark):
    rng = np.random.default_rng(1)
    rows = [("a", int(k), 0) for k in rng.permutation(2000)] + [("b", 5, 1), ("b", None, 2), ("b", -5, 3)]
    df = spark.createDataFrame(rows, "g string, o long, x int")
    got = {(r["g"], r["o"]): r["pos"] for r in ranks.numbered(df, "g", "o").collect()}
    assert all(got["a", k] == k + 1 for k in range(2000)) and [got["b", o] for o in (None, -5, 5)] == [1, 2, 3]


def adjusted(p):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(1, q)
    return out


def test_adjusted_p_values(spark):
    rng = np.random.default_rng(2)
    rows = [("a", f"g{k:04d}", float(x)) for k, x in enumerate(rng.random(500) ** 4)]
    rows += [("b", f"g{k:04d}", float(x)) for k, x in enumerate(np.round(rng.random(500), 2))] + [("b", "none", None), ("c", "g", 0.0), ("c", "h", 1e-300), ("c", "i", 1.0)]
    df = spark.createDataFrame(rows, "study string, gene_a string, p_value double").withColumns({"gene_b": F.lit("z"), "mi": F.lit(1.0)})
    for by in (("study",), ()):
        got = {(r["study"], r["gene_a"]): r["p_adjusted"] for r in significance.bh_adjusted(df, by).collect()}
        assert got.pop(("b", "none")) is None
        frame = pd.DataFrame([r for r in rows if r[2] is not None], columns=["study", "gene_a", "p"])
        frame["want"] = frame.groupby("study")["p"].transform(adjusted) if by else adjusted(frame["p"])
        assert len(got) == len(frame) and all(abs(got[s, g] - w) < 1e-12 for s, g, w in frame[["study", "gene_a", "want"]].itertuples(index=False))
    got = {(r["study"], r["gene_a"]): r["p_adjusted"] for r in significance.bh_edges(df.where("p_value is not null"), 0.4).collect()}
    want = {}
    for s, part in pd.DataFrame([r for r in rows if r[2] is not None], columns=["study", "g", "p"]).groupby("study"):
        part = part.sort_values(["p", "g"]).reset_index(drop=True)
        ok = part.index[part["p"] <= (part.index + 1) / len(part) * 0.4]
        if len(ok):
            kept = part[part["p"] <= part["p"][ok.max()]]
            want |= {(s, g): min(1, p * len(part) / (k + 1)) for k, _, g, p in kept.itertuples()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_p_values_without_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    null = spark.createDataFrame([(s, float(x)) for s in "ab" for x in np.round(rng.random(300), 2)], "study string, mi double")
    tested = spark.createDataFrame([(s, f"g{k}", float(x)) for s in "abc" for k, x in enumerate(np.round(rng.random(50) * 1.4 - 0.2, 2))], "study string, gene_a string, mi double")
    key = lambda rows: sorted((r["study"], r["gene_a"], -1 if r["p_value"] is None else round(r["p_value"], 12)) for r in rows)
    want = key(significance.p_values(tested, null).collect())
    monkeypatch.setattr(significance, "MOST_BROADCAST", 10)
    assert key(significance.p_values(tested, null).collect()) == want
    x = null.toPandas()
    assert all(p == -1 if s == "c" else abs(p - (x[x.study == s]["mi"] >= m - 1e-12).mean()) < 1e-9 for (s, g, p), m in zip(want, [r["mi"] for r in sorted(tested.collect(), key=lambda r: (r["study"], r["gene_a"]))], strict=True))


def test_candidates_are_scored_alone(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(40, 30))
    m[1] = m[0] + 0.1 * rng.normal(size=30)
    x = spark.createDataFrame([("s", f"g{i:02d}", f"r{j:02d}", float(m[i, j])) for i in range(40) for j in range(30)], "study string, gene string, run string, x double")
    few = pairs.prescreen(x, threshold=0.5).select("study", "gene_a", "gene_b")
    want = pairs.correlation(x).where("abs(r) > 0.5")
    assert 0 < few.count() == want.count() < 100 and few.exceptAll(want.select("study", "gene_a", "gene_b")).count() == 0
    from weftnet.operators import prep

    bins = prep.quantile_bins(x)
    every = {(r["gene_a"], r["gene_b"]): r["mi"] for r in pairs.mutual_information(bins, block=8).collect()}
    got = {(r["gene_a"], r["gene_b"]): r["mi"] for r in pairs.mutual_information(bins, block=8, wanted=few).collect()}
    assert got.keys() == {(r["gene_a"], r["gene_b"]) for r in few.collect()} and all(abs(every[k] - got[k]) < 1e-12 for k in got)
    top = pairs.prescreen(x, threshold=0.1, most=10).select("gene_a", "gene_b", "r_abs").collect()
    r = np.abs(np.corrcoef(m))
    best = sorted(((-round(r[i, j], 9), f"g{i:02d}", f"g{j:02d}") for i in range(40) for j in range(i + 1, 40)))[:10]
    assert sorted((a, b) for a, b, _ in map(tuple, top)) == sorted((a, b) for _, a, b in best)


def test_components_by_either_side(spark):
    """More samples than genes and fewer: the same shares, and scores up to rounding."""
    rng = np.random.default_rng(6)
    for shape in ((12, 6), (5, 40)):
        m = rng.normal(size=shape)
        x = spark.createDataFrame([(f"g{i}", j, float(m[i, j])) for i in range(shape[0]) for j in range(shape[1])], "gene string, run int, x double")
        scores, share = qc.principal_components(x, 2)
        z = (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
        u, s, _ = np.linalg.svd(z.T, full_matrices=False)
        got = scores.orderBy("run").toPandas()[["pc1", "pc2"]].to_numpy()
        assert np.allclose(share.toPandas()["share"], s[:2] ** 2 / (s**2).sum()) and np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
        assert all(got[np.abs(got[:, k]).argmax(), k] > 0 for k in range(2))
    about = spark.createDataFrame([(0, "p"), (0, "p"), (1, "q")], "run int, project string")
    assert {r["run"]: r["project"] for r in qc.described(scores, about).collect()} == {j: {0: "p", 1: "q"}.get(j) for j in range(40)}


def test_refined_parts_are_well_connected():
    """Two cliques that a bad label puts together come apart; a clique stays whole."""
    edges = [(a, b, 1.0) for o in (0, 6) for a in range(o, o + 6) for b in range(a + 1, o + 6)] + [(5, 6, 1.0)]
    adj = [{} for _ in range(12)]
    for a, b, w in edges:
        adj[a][b] = adj[b][a] = w
    k = [sum(r.values()) for r in adj]
    part = community._refined(adj, k, sum(k), 1.0, [0] * 12)
    assert not {part[v] for v in range(6)} & {part[v] for v in range(6, 12)}
    found = community.partition(edges, 12, sum(k), 1.0, True)
    assert len(set(found)) == 2 and len(set(found[:6])) == 1


def test_least_ids_and_descriptions(spark):
    modules = spark.createDataFrame([(1, f"g{k}") for k in range(8)] + [(2, f"g{k}") for k in range(3)], "module int, gene string")
    sets = spark.createDataFrame([("lib", "S", "what it is", f"g{k}") for k in range(6)], "library string, set_name string, description string, gene string")
    assert {r["module"] for r in enrich.annotate(modules, sets, fdr=2).collect()} == {1, 2}
    hits = enrich.annotate(modules, sets, fdr=2, least_ids=5)
    assert {(r["module"], r["description"]) for r in enrich.with_library(hits, sets).collect()} == {(1, "what it is")}


def test_outputs(spark, tmp_path):
    e = spark.createDataFrame([("A", "B", 3, 0.5), ("A", "C&", 2, 0.25), ("B", "C&", 2, 0.75)], "gene_a string, gene_b string, n_studies long, edge_weight double")
    genes = spark.createDataFrame([("A", 1), ("B", 2), ("C&", 3)], "gene string, ord long")
    writers.master(e, genes, f"{tmp_path}/m")
    rows = [tuple(r) for r in spark.read.csv(f"{tmp_path}/m/master_edges", sep="\t", header=True).select("gene_a", "gene_b").collect()]
    assert rows == [("A", "B"), ("B", "C&"), ("A", "C&")]
    assert [r["edge_weight"] for r in readers.edge_list(spark, f"{tmp_path}/m/master_weighted_edges").collect()] == [0.75, 0.5, 0.25]
    for name, total in (("adjacency", 6), ("weights", 3), ("n_studies", 14)):
        assert readers.matrix_market(spark, f"{tmp_path}/m/master_{name}_mtx").agg(F.sum("value")).first()[0] == total
    modules = spark.createDataFrame([(0, "A"), (0, "B"), (1, "C&")], "module int, gene string")
    writers.module_graphs(e, modules, f"{tmp_path}/g")
    import xml.etree.ElementTree as ET

    text = {}
    for r in spark.read.text(f"{tmp_path}/g").select("module", "value", F.monotonically_increasing_id().alias("o")).orderBy("o").collect():
        text[r["module"]] = text.get(r["module"], "") + r["value"]
    parsed = {k: ET.fromstring(v) for k, v in text.items()}  # noqa: S314
    assert {k: (len(x.findall(".//{*}node")), len(x.findall(".//{*}edge"))) for k, x in parsed.items()} == {0: (2, 1), 1: (1, 0)}
    writers.node_tables(modules, f"{tmp_path}/n", spark.createDataFrame([("A", "one"), ("A", "two")], "gene string, about string"))
    back = spark.read.csv(f"{tmp_path}/n/master_modules_annotated", sep="\t", header=True)
    assert {r["gene"]: r["about"] for r in back.collect()}["A"] == "one;two"
    hits = spark.createDataFrame([(0, "S", "a b", 0.1)], "module int, set_name string, library string, p_adjusted double")
    writers.enrichment(hits, f"{tmp_path}/h")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/h_columns_used").collect()] == hits.columns
    assert spark.read.csv(f"{tmp_path}/h_methods_used", sep="\t", header=True).first()["slug"] == "a_b"
    writers.first_generation(modules, modules.withColumn("name", F.lit("M0.1")), genes, f"{tmp_path}/f", hits)
    assert spark.read.csv(f"{tmp_path}/f/module_sizes", sep="\t", header=True).count() == 2
    writers.likelihood(e.withColumn("clr", F.col("edge_weight")), modules, genes, f"{tmp_path}/l")
    assert readers.modules(spark, f"{tmp_path}/l/likelihood_modules").count() == 3
    assert readers.edge_list(spark, f"{tmp_path}/l/likelihood_edges", genes.where("gene <> 'C&'")).count() == 1
    assert [r["line"] for r in writers.comparison(e, e.limit(0)).collect()] == ["edges in both: 0", "edges in a alone: 3", "edges in b alone: 0", "Jaccard index: 0.0000"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log_cpm.tsv").write_text("x")
    assert readers.find_inputs([str(tmp_path), str(tmp_path / "in")]) == (str(tmp_path / "in" / "log_cpm.tsv"), None)


def test_cache_knows_its_input(spark, tmp_path):
    from weftnet.plans.pipeline import Settings, scored

    rng = np.random.default_rng(7)
    make = lambda m: spark.createDataFrame([("s", f"g{i}", f"r{j}", float(m[i, j])) for i in range(4) for j in range(20)], "study string, gene string, run string, x double")
    s, a, b = Settings(permutations=20), rng.normal(size=(4, 20)), rng.normal(size=(4, 20))
    first = scored(make(a), s, f"{tmp_path}/c")[0].select("gene_a", "gene_b", "mi").collect()
    other = scored(make(b), s, f"{tmp_path}/c")[0].select("gene_a", "gene_b", "mi").collect()
    assert sorted(first) != sorted(other)


def test_more_runs_are_more_tasks(spark, monkeypatch):
    """The trials of one study meet in tasks of a fixed number of rows; runs that lack genes leave out pairs."""
    from weftnet.operators import significance

    rows = [(0, f"g{g}", r, (g * r * 7 + r // 3) % 4) for g in range(6) for r in range(30) if (g, r) not in {(1, 4), (3, 9), (5, 9)}]
    bins = spark.createDataFrame(rows, "study int, gene string, run long, bin int")
    monkeypatch.setattr(significance, "TRIAL_ROWS", 50)
    null = significance.global_null(bins, 40)
    assert "hashpartitioning(study#" in (plan := null._jdf.queryExecution().executedPlan().toString())
    assert "REPARTITION_BY_NUM" in plan
    at = {(g, r): b for _, g, r, b in rows}
    for trial in significance.trials(bins.select("study", "gene").distinct(), 40).collect():
        names = sorted(range(30), key=lambda r: (hashlib.md5(f"42|0|{trial['perm']}|{r}".encode()).hexdigest(), r))
        pairs = [(at.get((f"g{trial['i']}", r)), at.get((f"g{trial['j']}", names[r]))) for r in range(30)]
        pairs = [p for p in pairs if None not in p]
        joint, a, b = Counter(pairs), Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
        want = sum(c / len(pairs) * math.log(c * len(pairs) / (a[x] * b[y])) for (x, y), c in joint.items())
        got = null.where(f"perm = {trial['perm']}").first()["mi"] if trial["perm"] < 3 else None
        assert got is None or abs(got - want) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, 1, 2.0)], [(1, 1, 2.0), (1, 2, 0.0), (2, 3, 1.5), (3, 1, None), (2, 3, 4.0)], [(None, 1, 2.0), (1, None, 3.0), (1, 2, 4.0)]])
def test_filled_cells_are_counted_without_the_grid(spark, rows):
    """the sums over the filled matrix, and no row for each of its cells."""
    counts = spark.createDataFrame(rows, "gene int, run int, count double")
    grid = normalise.zero_filled(counts).agg(F.count("*"), F.count_if(F.col("count") > 0), F.sum("count")).first()
    assert tuple(normalise.filled_summary(counts).first()) == tuple(grid)


def test_zero_fill_makes_no_grid(spark, tmp_path):
    """as many genes and runs as would make 4 million million cells."""
    from weftnet import queries

    n = 2_000_000
    spark.range(n).selectExpr("id l_partkey", "id l_suppkey", "2.0D l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(queries.QUERIES["zero_fill"](spark, str(tmp_path)).first()) == (n * n, n, 2.0 * n)


def test_linkage_without_a_matrix():
    """the steps of the matrix, and memory in proportion to the samples."""
    import tracemalloc

    from weftnet.operators.pairs import _pearson, _standardised

    rng = np.random.default_rng(8)
    m = rng.normal(size=(300, 12)) + 3 * rng.normal(size=(6, 12)).repeat(50, 0)
    m[7] = 1.0
    d = np.clip(1 - _pearson(m, m)["r"], 0, 2)
    np.fill_diagonal(d, np.inf)
    got, want = qc.agglomerated_means(_standardised(m)), qc.agglomerated(d)
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([h for _, _, h, _ in got], [h for _, _, h, _ in want], atol=1e-9)
    u = _standardised(rng.normal(size=(2000, 8)))
    tracemalloc.start()
    assert len(qc.agglomerated_means(u)) == 1999
    assert tracemalloc.get_traced_memory()[1] < 4_000_000  # a matrix is 32 MB
    tracemalloc.stop()


def test_sample_pairs_in_pieces(spark, monkeypatch):
    """all pairs of samples, a block's in several batches of numbers, ids as they are."""
    monkeypatch.setattr(qc, "SAMPLES", 16)
    monkeypatch.setattr(qc, "PAIRS", 20)
    rng = np.random.default_rng(6)
    m = rng.integers(0, 5, (40, 9)).astype(float)
    m[3] = 2.0
    x = spark.createDataFrame([(r + 10**13, g, float(m[r, g])) for r in range(40) for g in range(9)], "run long, gene int, x double")
    got = {(r["run_a"] - 10**13, r["run_b"] - 10**13): (r["r"], r["distance"]) for r in qc.sample_spearman(x).collect()}
    ranked = pd.DataFrame(m).rank(axis=1).T.corr().fillna(0.0).to_numpy()
    assert sorted(got) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert all(abs(r - ranked[a, b]) < 1e-9 and abs(d - 1 + ranked[a, b]) < 1e-9 for (a, b), (r, d) in got.items())


def test_sample_blocks_are_small(spark, monkeypatch):
    """what pairs of blocks shuffle is one row a block with a byte for each rank; rounding is done in the tasks."""
    seen, whole = [], qc.stored
    monkeypatch.setattr(qc, "stored", lambda df: seen.append(found := whole(df)) or found)
    monkeypatch.setattr(qc, "SAMPLES", 16)
    rng = np.random.default_rng(7)
    m = rng.normal(size=(40, 9)).round(1)
    rows = [(r, g, float(m[r, g])) for r in range(40) for g in range(9)]
    x = spark.createDataFrame([*rows, *((None, g, 1.0) for g in range(9))], "run long, gene int, x double")
    got = {(r["run_a"], r["run_b"]): (r["r"], r["distance"]) for r in qc.sample_spearman(x, places=3).collect()}
    blocks = seen[0].collect()
    assert 3 <= len(blocks) <= 8 and sum(len(b["data"]) for b in blocks) == 40 * 9 and sum(len(b["runs"]) for b in blocks) == 40
    want = {(r["run_a"], r["run_b"]): (r["r"], r["distance"]) for r in qc.sample_spearman(x).collect()}
    assert len(got) == 780 and all(abs(got[k][i] - want[k][i]) < 0.0005001 and round(got[k][i], 3) == got[k][i] for k in want for i in (0, 1))
    assert {k for k, v in want.items() if abs(v[0]) >= 0.5} == {(r["run_a"], r["run_b"]) for r in qc.sample_spearman(x, 0.5).collect()}


def test_tails_of_many_tests_at_once():
    """tails of a batch are summed together, as exact as fractions whatever the background's size."""
    rng = np.random.default_rng(8)
    rows = [(4, 10, 8, 30), (0, 0, 0, 1), (1, 1, 5, 5), (2, 1, 5, 5), (60, 288_000, 60, 7_200_000), (9, 288_000, 60, 7_200_000), (1, 288_000, 60, 7_200_000)]
    for total in rng.integers(1, 90, 400):
        m, n = rng.integers(0, total + 1, 2)
        rows.append((int(rng.integers(0, min(m, n) + 3)), int(m), int(n), int(total)))
    for row, got in zip(rows, scratch._tails(*np.array(rows).T), strict=True):
        x, m, n, total = row
        want = float(Fraction(sum(math.comb(m, j) * math.comb(total - m, n - j) for j in range(max(x, m + n - total, 0), min(m, n) + 1)), math.comb(total, n)))
        assert got == pytest.approx(want, rel=1e-11, abs=1e-300), row


def test_modules_and_tests_are_made_once(spark):
    """the table of modules is read once, however often the adjustment reads the tests."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    rng = np.random.default_rng(9)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (90, 2))})
    modules = spark.createDataFrame(rows, "module long, gene long").mapInPandas(count, "module long, gene long")
    sets = spark.createDataFrame([(f"s{k % 3}", k % 9) for k in range(18)] + [(None, k) for k in range(4)], "set_name string, gene long")
    hits = {(r["module"], r["set_name"]): r for r in enrich.annotate(modules, sets, fdr=2).collect()}
    assert read.value == len(rows)
    bg = {g for _, g in rows}
    of = {s: {k % 9 for k in range(18) if f"s{k % 3}" == s} & bg for s in ("s0", "s1", "s2")}
    of[None] = {0, 1, 2, 3} & bg
    for m in range(12):
        own = {g for k, g in rows if k == m}
        for s, genes in of.items():
            both = sorted(map(str, own & genes))
            assert ((m, s) in hits) == (len(own) >= 2 and len(both) >= 2)
            if (m, s) in hits:
                r = hits[m, s]
                assert (r["n_module"], r["n_set"], r["overlap"], r["genes"], r["n_background"]) == (len(own), len(genes), len(both), ";".join(both), len(bg))


def test_edges_stay_one_row_until_modules_meet(spark):
    """an edge meets its ends' modules as two lists; repeated members and edges count as in plain joins."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 12, (40, 2))], "graph int, a int, b int")
    rows = [(g, int(m), int(v)) for g in (0, 1) for m, v in rng.integers(0, 12, (50, 2))] + [(0, None, 1), (0, None, 2)]
    members = spark.createDataFrame(rows, "graph int, module int, v int")
    found = graph.induced(edges, members)
    want = sorted((g, m, a, b) for g, a, b in edges.collect() for h, m, v in rows for k, n, u in rows if g == h == k and m is not None and m == n and (v, u) == (a, b))
    assert found.columns == ["graph", "module", "a", "b"] and sorted(map(tuple, found.collect())) == want
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
