"""Edges over several studies: weights, consensus graphs, common genes and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_genes(genes: DataFrame) -> DataFrame:
    """Genes that every study has; genes(study, gene)."""
    n = genes.agg(F.countDistinct("study").alias("n"))
    per = genes.groupBy("gene").agg(F.countDistinct("study").alias("k"))
    return per.crossJoin(F.broadcast(n)).where("k = n").select("gene")


def within(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with both ends among the genes."""
    for end in ("gene_a", "gene_b"):
        edges = edges.join(genes.select(F.col("gene").alias(end)), end, "left_semi")
    return edges


def effective_count(least: int, n_studies: int, fraction: float | None = None) -> int:
    """Studies that an edge needs: a share of them (half to even), or the count, or 1 if there are fewer."""
    if fraction is not None:
        return max(1, round(fraction * n_studies))
    return 1 if n_studies < least else least


def edge_weights(edges: DataFrame, mode: str = "neglog10p", clip: tuple[float | None, float | None] = (None, None), normalise: bool = False, eps: float = 1e-12) -> DataFrame:
    """edge_weight as saved, and the weight for the consensus: clipped and scaled to [0, 1] per study on request."""
    raw = {"neglog10p": -F.log10(F.col("p_value") + eps), "mi": F.col("mi"), "none": F.lit(1.0)}[mode]
    out = edges.withColumn("edge_weight", raw)
    w = F.col("edge_weight")
    w = F.greatest(w, F.lit(float(clip[0]))) if clip[0] is not None else w
    w = F.least(w, F.lit(float(clip[1]))) if clip[1] is not None else w
    out = out.withColumn("weight", w)
    if normalise:
        by = Window.partitionBy("study")
        lo, hi = F.min("weight").over(by), F.max("weight").over(by)
        out = out.withColumn("weight", F.when(hi > lo, (F.col("weight") - lo) / (hi - lo)).otherwise(F.col("weight")))
    return out


def tidy_edges(edges: DataFrame) -> DataFrame:
    """G1: smaller end first, no loops, each edge once a study."""
    return edges.where("gene_a <> gene_b").withColumns({"gene_a": F.least("gene_a", "gene_b"), "gene_b": F.greatest("gene_a", "gene_b")}).dropDuplicates(["study", "gene_a", "gene_b"])


def consensus(edges: DataFrame, least: int, weight: str | None = None) -> DataFrame:
    """Edges of at least so many studies; the weight is the mean over them, or their number."""
    value = F.avg(weight) if weight else F.countDistinct("study").cast("double")
    return edges.groupBy("gene_a", "gene_b").agg(F.countDistinct("study").alias("n_studies"), value.alias("edge_weight")).where(F.col("n_studies") >= least)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared edges, edges of one alone, and their Jaccard index, 0 for two empty networks."""
    e = ["gene_a", "gene_b"]
    both = a.select(*e).distinct().withColumn("in_a", F.lit(1)).join(b.select(*e).distinct().withColumn("in_b", F.lit(1)), e, "full_outer")
    n = both.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("n_only_a"), F.count_if(F.col("in_a").isNull()).alias("n_only_b"), F.count("*").alias("n_union"))
    return n.select("n_both", "n_only_a", "n_only_b", F.when(F.col("n_union") > 0, F.col("n_both") / F.col("n_union")).otherwise(0.0).alias("jaccard"))
