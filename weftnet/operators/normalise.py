"""Count normalisation on long tables (gene, run, count): filters, library factors, log counts per million.

With `by`, a table holds several matrices, one for each value of those columns, and each is treated on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _each(df: DataFrame, other: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with the one row that `other` has for its matrix."""
    return df.join(other, list(by)) if by else df.crossJoin(F.broadcast(other))  # one row


def zero_filled(counts: DataFrame) -> DataFrame:
    """Every (gene, run) of the matrix, 0 where a run lacks the gene."""
    grid = counts.select("gene").distinct().crossJoin(counts.select("run").distinct())
    return grid.join(counts, ["gene", "run"], "left").select("gene", "run", F.coalesce("count", F.lit(0.0)).alias("count"))


def filled_summary(counts: DataFrame) -> DataFrame:
    """What `zero_filled` adds up to (n_cells, n_filled, total), without its cells: those that no count fills are 0 and only need to be counted."""
    genes, runs = (counts.select(c).distinct().agg(F.count("*").alias(f"n_{c}")) for c in ("gene", "run"))
    # a null matches nothing, and a second count of a cell is a second row of it
    known = counts.where("gene is not null and run is not null").groupBy("gene", "run").agg(F.count("*").alias("k"), F.count_if(F.col("count") > 0).alias("filled"), F.sum("count").alias("total"))
    sums = known.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("more"), F.coalesce(F.sum("filled"), F.lit(0)).alias("n_filled"), F.sum("total").alias("total"))
    cells = F.col("n_gene") * F.col("n_run")
    total = F.when(cells > 0, F.coalesce(F.col("total").cast("double"), F.lit(0.0)))
    return genes.crossJoin(runs).crossJoin(sums).select((cells + F.col("more")).alias("n_cells"), "n_filled", total.alias("total"))  # one row each


def expressed_genes(counts: DataFrame, least_samples: int = 10, above: float = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """genes with a count above `above` in enough samples."""
    return counts.groupBy(*by, "gene").agg(F.count_if(F.col("count") > above).alias("n_samples")).where(F.col("n_samples") >= least_samples)


def varying_genes(counts: DataFrame, n_runs: int) -> DataFrame:
    """genes whose counts over all runs, absent ones 0, are not constant."""
    g = counts.groupBy("gene").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"), F.count("*").alias("k"))
    var = (F.col("q") - F.col("s") * F.col("s") / n_runs) / (n_runs - 1)
    return g.select("gene", var.alias("variance")).where(F.col("variance") > 1e-12)


def library_sizes(counts: DataFrame, above: float = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Column sums above a limit."""
    return counts.groupBy(*by, "run").agg(F.sum("count").alias("lib_size")).where(F.col("lib_size") > above)


def outlier_runs(libs: DataFrame, low: float = 0.6, high: float = 1.7, mads: float = 3.0) -> DataFrame:
    """runs with a factor out of bounds, or a library size beyond median +- 3 scaled MAD; libs has lib_size, factor."""
    mid = libs.agg(F.median("lib_size").alias("mid"))
    dev = libs.crossJoin(F.broadcast(mid))  # one row
    mad = dev.agg((1.4826 * F.median(F.abs(F.col("lib_size") - F.col("mid")))).alias("mad"))
    out = dev.crossJoin(F.broadcast(mad))
    bad = (F.col("factor") < low) | (F.col("factor") > high) | (F.abs(F.col("lib_size") - F.col("mid")) > mads * F.col("mad"))
    return out.select("run", "lib_size", "factor", bad.alias("is_outlier"))


def rle_factors(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median ratios to the geometric mean over genes present in every run, per library size, with geometric mean 1."""
    runs = counts.select(*by, "run").distinct().groupBy(*by).agg(F.count("*").alias("n_runs"))
    present = counts.where("count > 0")
    genes = _each(present.groupBy(*by, "gene").agg(F.avg(F.ln("count")).alias("log_mean"), F.count("*").alias("k")), runs, by).where("k = n_runs")
    ratio = present.join(genes, [*by, "gene"]).groupBy(*by, "run").agg(F.median(F.exp(F.ln("count") - F.col("log_mean"))).alias("ratio"))
    f = ratio.join(counts.groupBy(*by, "run").agg(F.sum("count").alias("lib_size")), [*by, "run"]).withColumn("raw", F.col("ratio") / F.col("lib_size"))
    centre = f.groupBy(*by).agg(F.exp(F.avg(F.ln("raw"))).alias("centre"))
    return _each(f, centre, by).select(*by, "run", "lib_size", (F.col("raw") / F.col("centre")).alias("factor"))


def tmm_factors(counts: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """Trimmed mean of M values against the run whose upper quartile is nearest to the mean one.

    M and A values of genes present in both runs; genes with a rank of M outside the middle 40 % or of A
    outside the middle 90 % are trimmed (ties by average rank), the rest averaged with inverse variances.
    """
    libs = counts.groupBy("run").agg(F.sum("count").alias("n"))
    x = counts.join(libs, "run")
    # quartiles over the genes that any run has: absent ones are zeros at the low end
    genes = counts.where("count > 0").select("gene").distinct().agg(F.count("*").alias("g"))
    ranked = x.where("count > 0").select("run", "n", "count", F.row_number().over(Window.partitionBy("run").orderBy(F.col("count").desc(), "gene")).alias("rank")).crossJoin(F.broadcast(genes))
    place = 1 + (F.col("g") - 1) * 0.25  # from the top
    quart = ranked.groupBy("run", "n").agg(F.max(F.when(F.col("rank") == F.floor(place), F.col("count"))).alias("upper"), F.max(F.when(F.col("rank") == F.floor(place) + 1, F.col("count"))).alias("lower"), F.first(place - F.floor(place)).alias("part"))
    quart = quart.select("run", "n", ((F.coalesce("upper", F.lit(0.0)) * (1 - F.col("part")) + F.coalesce("lower", F.lit(0.0)) * F.col("part")) / F.col("n")).alias("q"))
    ref = quart.crossJoin(F.broadcast(quart.agg(F.avg("q").alias("mean_q")))).orderBy(F.abs(F.col("q") - F.col("mean_q")), "run").limit(1).select(F.col("run").alias("ref"), F.col("n").alias("ref_n"))
    base = x.join(F.broadcast(ref), x["run"] == ref["ref"]).where("count > 0").select("gene", F.col("count").alias("ref_count"), "ref_n")
    both = x.where("count > 0").join(base, "gene").select(
        "run", "gene", "n",
        F.log2((F.col("count") / F.col("n")) / (F.col("ref_count") / F.col("ref_n"))).alias("m"),
        ((F.log2(F.col("count") / F.col("n")) + F.log2(F.col("ref_count") / F.col("ref_n"))) / 2).alias("a"),
        ((F.col("n") - F.col("count")) / F.col("n") / F.col("count") + (F.col("ref_n") - F.col("ref_count")) / F.col("ref_n") / F.col("ref_count")).alias("v"),
    )
    by_run = Window.partitionBy("run")
    both = both.withColumns({c: F.round(c, 10) for c in ("m", "a")})
    rank = lambda c: F.rank().over(by_run.orderBy(c)) + (F.count("*").over(Window.partitionBy("run", c)) - 1) / 2
    both = both.select("*", rank("m").alias("rm"), rank("a").alias("ra"), F.count("*").over(by_run).alias("k"))
    lo_m, lo_a = F.floor(F.col("k") * trim_m) + 1, F.floor(F.col("k") * trim_a) + 1
    kept = both.where(F.col("rm").between(lo_m, F.col("k") + 1 - lo_m) & F.col("ra").between(lo_a, F.col("k") + 1 - lo_a))
    f = libs.select("run").join(kept.groupBy("run").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("w")), "run", "left")
    f = f.select("run", F.pow(F.lit(2.0), F.coalesce("w", F.lit(0.0))).alias("raw"))
    centre = f.agg(F.exp(F.avg(F.ln("raw"))).alias("centre"))
    return f.crossJoin(F.broadcast(centre)).select("run", (F.col("raw") / F.col("centre")).alias("factor"))


def norm_factors(counts: DataFrame, most_spread: float = 5.0) -> DataFrame:
    """A3: TMM factors, or RLE where the TMM ones spread too far."""
    tmm = tmm_factors(counts)
    spread = tmm.agg((F.max("factor") / F.min("factor")).alias("spread"))
    rle = rle_factors(counts).select("run", F.col("factor").alias("rle"))
    both = tmm.join(rle, "run", "left").crossJoin(F.broadcast(spread))
    return both.select("run", F.when(F.col("spread") > most_spread, F.col("rle")).otherwise(F.col("factor")).alias("factor"))


def log_cpm(counts: DataFrame, libs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A4: log2((count + 2) / (lib * factor + 4) * 1e6); libs has run, lib_size, factor."""
    return counts.join(libs, [*by, "run"]).select(*by, "gene", "run", F.log2((F.col("count") + 2) / (F.col("lib_size") * F.col("factor") + 4) * 1e6).alias("log_cpm"))


def tidy_values(x: DataFrame, col: str) -> DataFrame:
    """Nulls become the least finite value, infinities the largest and least finite ones."""
    v = F.when(~F.isnan(col) & ~F.col(col).isin(float("inf"), float("-inf")), F.col(col))
    ends = x.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    fixed = F.when(F.col(col) == float("inf"), F.col("hi")).when((F.col(col) == float("-inf")) | F.col(col).isNull() | F.isnan(col), F.col("lo")).otherwise(F.col(col))
    return x.crossJoin(F.broadcast(ends)).withColumn(col, fixed).drop("lo", "hi")


def presence(x: DataFrame, least_samples: int = 10) -> DataFrame:
    """F16: genes above 0 in enough samples."""
    return x.groupBy("gene").agg(F.count_if(F.col("x") > 0).alias("n_present")).where(F.col("n_present") >= least_samples)
