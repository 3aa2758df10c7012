"""Whole analyses: per-study networks to an annotated consensus, and the whole-matrix likelihood network."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import cut
from weftnet.operators import community, consensus, enrich, graph, likelihood, pairs, prep, significance
from weftnet.sources import readers, writers


@dataclass(frozen=True)
class Prescreen:
    method: str | None = None
    threshold: float = 0.3
    most_pairs: int | None = 500_000


@dataclass(frozen=True)
class Modules:
    method: str = "mcode"
    score: float = 0.2
    least_size: int = 3
    least_density: float = 0.3
    resolution: float = 1.0
    refine_above: int | None = None
    refine_method: str = "mcode"


@dataclass(frozen=True)
class Settings:
    least_samples: int = 3
    top_genes: int | None = None
    remove_ribosomal: bool = False
    remove_micro: bool = False
    pattern: str | None = None
    bins: int = 5
    permutations: int = 1000
    pair_permutations: int | None = None
    seed: int = 42
    p_threshold: float = 0.001
    fdr: float | None = None
    least_studies: int = 3
    study_fraction: float | None = None
    weight: str = "neglog10p"
    clip: tuple[float | None, float | None] = (None, None)
    scale_weights: bool = False
    prescreen: Prescreen = field(default_factory=Prescreen)
    modules: Modules = field(default_factory=Modules)
    enrichment_fdr: float = 0.05
    least_overlap: int = 2

    def fingerprint(self) -> str:
        """Of everything that scores depend on, bins and seed included."""
        keys = ("least_samples", "top_genes", "remove_ribosomal", "remove_micro", "pattern", "bins", "prescreen", "seed")
        return hashlib.md5(json.dumps({k: v for k, v in asdict(self).items() if k in keys}, sort_keys=True).encode()).hexdigest()


@dataclass
class Result:
    edges: DataFrame
    bh: DataFrame | None
    null: DataFrame
    stats: DataFrame
    master: DataFrame
    modules: DataFrame
    parents: DataFrame | None
    annotation: DataFrame | None
    timings: dict[str, float]


def prepared(expression: DataFrame, metadata: DataFrame, s: Settings, excluded: DataFrame | None = None) -> DataFrame:
    """Filtered genes, top genes and studies, in this order: (study, gene, run, x)."""
    x = expression
    if s.remove_ribosomal or s.remove_micro or s.pattern or excluded is not None:
        flags = prep.name_flags(x.select("gene").distinct(), s.pattern, excluded, s.remove_ribosomal, s.remove_micro)
        x = x.join(flags.where("not removed").select("gene"), "gene", "left_semi")
    if s.top_genes:
        x = x.join(prep.top_by_mad(x, s.top_genes).select("gene"), "gene", "left_semi")
    return prep.studies(x, metadata, s.least_samples).select("study", "gene", "run", "x")


def content(x: DataFrame) -> str:
    """A fingerprint of expression values: rows, and the exclusive or of their hashes."""
    r = x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("study", "gene", "run", "x")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


def scored(x: DataFrame, s: Settings, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with mi and p_value, null) of every study; scores come from the cache if it fits settings and input.

    With a prescreen only its candidates are scored.
    """
    bins = cut(prep.quantile_bins(x, s.bins))
    spark = x.sparkSession
    made = f"{s.fingerprint()}-{content(x)}" if cache else ""
    found = readers.cached(spark, cache, made) if cache else None
    if found is None:
        keep = None
        if s.prescreen.method:
            keep = cut(pairs.prescreen(x, s.prescreen.method, s.prescreen.threshold, s.prescreen.most_pairs).select("study", "gene_a", "gene_b"))
        found = pairs.mutual_information(bins, wanted=keep).drop("mi_mm")
        if cache:
            writers.cache(found, cache, made)
            found = readers.cached(spark, cache, made)
        else:
            found = cut(found)
    if s.pair_permutations:
        tested = significance.pair_tests(bins, s.pair_permutations, s.seed, found.select("study", "gene_a", "gene_b") if s.prescreen.method else None)
        return tested, significance.pair_null(bins, found, s.pair_permutations, s.seed)  # the null itself only if it is read
    null = cut(significance.global_null(bins, s.permutations, s.seed))
    return significance.p_values(found, null), null


def run(expression: DataFrame, metadata: DataFrame, settings: Settings = Settings(), sets: DataFrame | None = None, orthologs: DataFrame | None = None, background: DataFrame | None = None, excluded: DataFrame | None = None, cache: str | None = None) -> Result:
    """Every study's network, the consensus over studies, its modules and their enrichment."""
    s, took, at = settings, {}, time.time()

    def lap(name: str) -> None:
        nonlocal at
        took[name] = time.time() - at
        at = time.time()

    x = cut(prepared(expression, metadata, s, excluded))
    lap("load")
    tested, null = scored(x, s, cache)
    tested = cut(tested)
    lap("scores")
    edges = cut(consensus.edge_weights(significance.significant(tested, s.p_threshold), s.weight, s.clip, s.scale_weights))
    bh = significance.bh_edges(tested, s.fdr) if s.fdr else None
    genes = x.select("study", "gene").distinct()
    by_study = edges.select(F.col("study").alias("graph"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"))
    stats = graph.topology(by_study, genes.select(F.col("study").alias("graph"), F.col("gene").alias("v")))
    lap("edges")
    n = genes.select("study").distinct().count()
    shared = consensus.within(edges, consensus.common_genes(genes))
    k = consensus.effective_count(s.least_studies, n, s.study_fraction)
    master = cut(consensus.consensus(shared, k, None if s.weight == "none" else "weight").orderBy(F.desc("n_studies"), F.desc("edge_weight"), "gene_a", "gene_b"))
    lap("consensus")
    net = master.select(F.lit(0).alias("graph"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"), "edge_weight")
    m, parents = s.modules, None
    if m.method == "mcode":
        found = graph.mcode(net, m.score, m.least_size, m.least_density).select("graph", "module", "v")
    else:
        found = community.communities(net, m.method, m.resolution, m.least_size)
    found = cut(found)
    if m.refine_above:
        found, parents = community.refine_modules(found, net.drop("edge_weight"), m.refine_above, m.refine_method)
        found = cut(found)
    modules = found.select("module", F.col("v").alias("gene"))
    lap("modules")
    annotation = None
    if sets is not None:
        mapped = modules if orthologs is None else enrich.mapped_modules(modules, orthologs)
        annotation = cut(enrich.with_library(enrich.annotate(mapped, sets, background, s.enrichment_fdr, s.least_overlap), sets))
        lap("annotation")
    return Result(edges, bh, null, stats, master, modules, parents, annotation, took)


def likelihood_network(expression: DataFrame, bins: int = 5, share: float = 0.95, method: str = "louvain") -> tuple[DataFrame, DataFrame]:
    """The whole-matrix network: information of all pairs over all samples, likelihood, percentile cut, communities."""
    x = expression.select(F.lit("all").alias("study"), "gene", "run", "x")
    edges = cut(likelihood.edges(prep.quantile_bins(x, bins), share))
    net = edges.select(F.lit(0).alias("graph"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"))
    return edges, community.communities(net, method)


def save(result: Result, path: str, about: DataFrame | None = None) -> None:
    """Every table of a run below one folder; about(gene, ...) has metadata of genes for the annotated tables."""
    ends = result.master.select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).distinct()
    genes = ends.withColumn("ord", F.row_number().over(Window.orderBy("gene")))  # genes of a network: tens of thousands
    writers.tsv(result.edges.orderBy("p_value"), f"{path}/edges", by="study")
    writers.tsv(result.stats.orderBy("graph"), f"{path}/study_net_stats")
    writers.master(result.master, cut(genes), path)
    writers.graphml(result.master, f"{path}/master_graphml", weight="edge_weight")
    writers.module_graphs(result.master, result.modules, f"{path}/module_graphml")
    writers.node_tables(result.modules, path, about)
    if result.bh is not None:
        writers.tsv(result.bh, f"{path}/edges_bh_fdr", by="study")
    if result.parents is not None:
        writers.tsv(result.parents.orderBy("parent_module", "child_module"), f"{path}/module_parent_child_mapping")
    if result.annotation is not None:
        writers.enrichment(result.annotation, f"{path}/enrichment")
        writers.tsv(enrich.top_hits(result.annotation), f"{path}/enrichment_top5")
