"""Preparing long expression tables (study, gene, run, x): filters, studies, scores, ranks and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of ribosomal and micro-RNA gene names.
RIBOSOMAL = r"(?i)^(RPL|RPS|MRPL|MRPS)\d*[A-Z]*$"
MICRO_RNA = r"(?i)^(MIR|MIRLET|LET[-_]?7|MIR[-_]?|MIR\d|miR[-_])"


def name_flags(genes: DataFrame, pattern: str | None = None, excluded: DataFrame | None = None, ribosomal: bool = True, micro: bool = True) -> DataFrame:
    """Which rules remove each gene."""
    out = genes.select("gene", (F.lit(ribosomal) & F.col("gene").rlike(RIBOSOMAL)).alias("ribosomal"), (F.lit(micro) & F.col("gene").rlike(MICRO_RNA)).alias("micro"))
    out = out.withColumn("custom", F.col("gene").rlike("(?i)" + pattern) if pattern else F.lit(False))
    if excluded is None:
        out = out.withColumn("listed", F.lit(False))
    else:
        out = out.join(excluded.select("gene", F.lit(True).alias("listed")).distinct(), "gene", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return out.withColumn("removed", F.col("ribosomal") | F.col("micro") | F.col("custom") | F.col("listed"))


def name_filter_summary(flags: DataFrame) -> DataFrame:
    """Counts per rule, which may overlap, and of their union."""
    return flags.agg(*(F.count_if(c).alias("n_" + c) for c in ("ribosomal", "micro", "custom", "listed", "removed")), F.count("*").alias("n_genes"))


def safe_name(name: Column) -> Column:
    """study names for files."""
    return F.translate(name, " /", "_-")


def studies(expression: DataFrame, metadata: DataFrame, least: int = 3) -> DataFrame:
    """Expression with its study; studies of enough runs that the matrix has, rows without project gone."""
    known = metadata.where("project is not null").dropDuplicates(["run", "project"]).join(expression.select("run").distinct(), "run", "left_semi")
    big = known.withColumn("n_runs", F.count("*").over(Window.partitionBy("project"))).where(F.col("n_runs") >= least)
    return expression.join(big.select("run", safe_name(F.col("project")).alias("study")), "run")


def zscores(x: DataFrame) -> DataFrame:
    """A1: population z-scores per gene within a study; constant genes get 0."""
    s = x.groupBy("study", "gene").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return x.join(s, ["study", "gene"]).select("study", "gene", "run", ((F.col("x") - F.col("mean")) / sd).alias("z"))


def mads(x: DataFrame) -> DataFrame:
    """A2: unscaled median absolute deviation per gene over all samples."""
    mid = x.groupBy("gene").agg(F.median("x").alias("mid"))
    return x.join(mid, "gene").groupBy("gene").agg(F.median(F.abs(F.col("x") - F.col("mid"))).alias("mad"))


def top_by_mad(x: DataFrame, n: int | None) -> DataFrame:
    """The n genes of the largest deviation, ties by name; all of them without a positive n."""
    m = mads(x)
    return m.orderBy(F.col("mad").desc(), "gene").limit(n) if n and n > 0 else m


def average_ranks(x: DataFrame, by: tuple[str, ...] = ("study", "gene"), col: str = "x") -> DataFrame:
    """Ranks within `by`, ties averaged."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(col)) + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2
    return x.withColumn("rank", rank)


def quantile_bins(x: DataFrame, bins: int = 5) -> DataFrame:
    """A5: quantile bins per gene within a study; edges are the distinct inner quantiles between minimum and maximum."""
    at = F.array(*(F.lit((k + 1) / bins) for k in range(bins - 1)))
    edges = x.groupBy("study", "gene").agg(F.percentile("x", at).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    edges = edges.select("study", "gene", F.expr("array_distinct(filter(q, e -> e > lo and e < hi))").alias("edges"))
    return x.join(edges, ["study", "gene"]).select("study", "gene", "run", F.expr("size(filter(edges, e -> e <= x))").alias("bin"))
