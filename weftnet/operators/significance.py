"""Permutation nulls, empirical p-values and false-discovery control.

Random choices come from md5 of portable strings, so any engine can repeat them: a permutation orders the
runs by md5(seed|study|perm|run), a trial picks its genes from md5(seed|study|perm).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.ranks import place
from weftnet.functions.scratch import cut

#: Values that are compared are rounded to this many places first: the last bits of sums must not decide ties.
PLACES = 9
#: Distinct null values that may be broadcast; beyond, bins of values count them.
MOST_BROADCAST = 5_000_000
#: Rows of trials, one for each run of each, that a task has on average.
TRIAL_ROWS = 100_000


def _pick(seed: int, *parts: str | Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def trials(genes: DataFrame, n: int, seed: int = 42, self_pairs: bool = False) -> DataFrame:
    """(study, perm, i, j) gene ordinals of each trial; j differs from i unless self pairs are allowed."""
    size = genes.groupBy("study").agg(F.countDistinct("gene").cast("long").alias("g"))
    t = size.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = t.withColumn("i", _pick(seed, "study", "perm", F.lit("i")) % F.col("g")).withColumn("p", _pick(seed, "study", "perm", F.lit("j")))
    j = F.col("p") % F.col("g") if self_pairs else (F.col("i") + 1 + F.col("p") % (F.col("g") - 1)) % F.col("g")
    return t.where(F.col("g") > (0 if self_pairs else 1)).select("study", "perm", "i", j.alias("j"))


def _information(cells: DataFrame, *keys: str) -> DataFrame:
    """Plug-in information of (keys, bi, bj) rows, one per sample."""
    joint = cells.groupBy(*keys, "bi", "bj").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    joint = joint.select(*keys, "c", F.sum("c").over(by).alias("n"), F.sum("c").over(Window.partitionBy(*keys, "bi")).alias("ci"), F.sum("c").over(Window.partitionBy(*keys, "bj")).alias("cj"))
    return joint.groupBy(*keys).agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("ci") * F.col("cj")))).alias("mi"))


def global_null(bins: DataFrame, n: int, seed: int = 42, self_pairs: bool = False) -> DataFrame:
    """Information of random gene pairs of which one is shuffled: (study, perm, mi).

    A run has one row with its values of the genes that any trial picks, and gives one row for each trial. These meet by
    study and trial, never by study alone, so a task holds some trials of a study and not all of its runs n times.
    """
    names = cut(bins.groupBy("study", "gene").agg(F.count("*").alias("n_runs")))
    ordinal = names.select("study", "gene", (F.row_number().over(Window.partitionBy("study").orderBy("gene")) - 1).cast("long").alias("ord"))
    t = trials(names, n, seed, self_pairs)
    cells = n * (names.groupBy("study").agg(F.max("n_runs").alias("n_runs")).agg(F.sum("n_runs")).first()[0] or 0)
    picked = t.select("study", F.explode(F.array("i", "j")).alias("ord")).distinct()
    picked = picked.withColumn("at", F.row_number().over(Window.partitionBy("study").orderBy("ord")))
    at = lambda k: picked.select("study", F.col("ord").alias(k), F.col("at").alias(f"at_{k}"))
    plan = t.join(at("i"), ["study", "i"]).join(at("j"), ["study", "j"]).groupBy("study").agg(F.collect_list(F.struct("perm", "at_i", "at_j")).alias("trials"))
    plan = plan.join(picked.groupBy("study").agg(F.count("*").cast("int").alias("n_picked")), "study")
    own = bins.join(ordinal.join(picked, ["study", "ord"]).select("study", "gene", "at"), ["study", "gene"], "left")
    rows = own.groupBy("study", "run").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "bin")))).alias("s")).join(plan, "study")
    # a run may lack genes
    values = F.when(F.size("s") == F.col("n_picked"), F.col("s.bin")).otherwise(F.expr("transform(sequence(1, n_picked), k -> get(filter(s, e -> e.at = k), 0).bin)"))
    each = rows.select("study", "run", values.alias("v"), "trials").select("study", "run", "v", F.explode("trials").alias("t"))
    each = each.select("study", "t.perm", "run", F.expr("get(v, t.at_i - 1)").alias("bi"), F.expr("get(v, t.at_j - 1)").alias("bj")).repartition(cells // TRIAL_ROWS + 1, "study", "perm")
    order = F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("study").cast("string"), F.col("perm").cast("string"), F.col("run").cast("string")).cast("binary")))
    by = Window.partitionBy("study", "perm")
    each = each.select("study", "perm", "bi", "bj", F.row_number().over(by.orderBy("run")).alias("first"), F.row_number().over(by.orderBy(order, "run")).alias("second"))
    # the value at a place in the order of names meets the one at that place in the trial's order
    ends = F.array(F.struct(F.col("first").alias("nth"), F.col("bi"), F.lit(None).alias("bj")), F.struct(F.col("second").alias("nth"), F.lit(None).alias("bi"), F.col("bj")))
    met = each.select("study", "perm", F.explode(ends).alias("e")).groupBy("study", "perm", "e.nth").agg(F.max("e.bi").alias("bi"), F.max("e.bj").alias("bj"))
    return _information(met.where("bi is not null and bj is not null"), "study", "perm")


def pair_null(bins: DataFrame, pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Information of each given pair with its second gene shuffled n times: (study, gene_a, gene_b, perm, mi)."""
    vec = bins.groupBy("study", "gene").agg(F.sort_array(F.collect_list(F.struct("run", "bin"))).alias("s")).select("study", "gene", F.col("s.run").alias("runs"), F.col("s.bin").alias("v"))
    a = vec.select("study", F.col("gene").alias("gene_a"), F.col("v").alias("va"))
    b = vec.select("study", F.col("gene").alias("gene_b"), F.col("v").alias("vb"), "runs")
    rows = pairs.select("study", "gene_a", "gene_b").join(a, ["study", "gene_a"]).join(b, ["study", "gene_b"])
    study = bins.schema["study"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        orders: dict = {}
        for rows_ in batches:
            out = []
            for s, ga, gb, va, vb, runs in rows_[["study", "gene_a", "gene_b", "va", "vb", "runs"]].itertuples(index=False):
                if s not in orders:
                    orders = {s: [np.array(sorted(range(len(runs)), key=lambda k: (hashlib.md5(f"{seed}|{s}|{p}|{runs[k]}".encode()).hexdigest(), runs[k]))) for p in range(n)]}
                va, vb = np.asarray(va), np.asarray(vb)
                k = int(max(va.max(), vb.max())) + 1
                size = len(va)
                joint = np.stack([np.bincount(va * k + vb[o], minlength=k * k) for o in orders[s]]).reshape(n, k, k)
                outer = joint.sum(2)[:, :, None] * joint.sum(1)[:, None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    mi = np.where(joint > 0, joint / size * np.log(joint * size / outer), 0).sum((1, 2))
                out.append(pd.DataFrame({"study": s, "gene_a": ga, "gene_b": gb, "perm": np.arange(n), "mi": mi}))
            if out:
                yield pd.concat(out)

    return rows.repartition("study", "gene_a").sortWithinPartitions("study").mapInPandas(run, f"study {study}, gene_a string, gene_b string, perm int, mi double")


def p_values(pairs: DataFrame, null: DataFrame) -> DataFrame:
    """Share of the study's null values at or above each score, which can be 0."""
    null = cut(null.groupBy("study", F.round("mi", PLACES).alias("mi_r")).agg(F.count("*").alias("n")))
    seen = pairs.withColumn("mi_r", F.round("mi", PLACES))
    if null.count() <= MOST_BROADCAST:
        rows = null.toPandas()  # at most MOST_BROADCAST values
        by = {}
        for s, part in rows.groupby("study"):
            part = part.sort_values("mi_r")
            by[s] = part["mi_r"].to_numpy(), np.append(part["n"].to_numpy()[::-1].cumsum()[::-1], 0)
        shared = null.sparkSession.sparkContext.broadcast(by)

        @F.pandas_udf("double")
        def share(study: pd.Series, mi: pd.Series) -> pd.Series:
            out = np.full(len(mi), np.nan)
            for s, at in study.groupby(study).groups.items():
                if s in shared.value:
                    v, above = shared.value[s]
                    k = study.index.get_indexer(at)
                    out[k] = above[np.searchsorted(v, mi.to_numpy()[k], side="left")] / above[0]
            return pd.Series(out)

        return seen.withColumn("p_value", F.nanvl(share("study", "mi_r"), F.lit(None).cast("double"))).drop("mi_r")
    # equal bins between the null's extremes: higher bins count whole, a value's own bin value by value
    ends = null.groupBy("study").agg(F.min("mi_r").alias("lo"), F.max("mi_r").alias("hi"), F.sum("n").alias("all"))
    values = seen.select("study", "mi_r").distinct().withColumn("n", F.lit(0).cast("long")).union(null.select("study", "mi_r", "n"))
    inner = F.least(F.greatest("mi_r", "lo"), F.col("hi"))
    binned = values.join(ends, "study").withColumn("bin", place(inner, F.col("lo"), F.col("hi")))
    higher = F.sum("n").over(Window.partitionBy("study").orderBy(F.col("bin").desc())) - F.col("n")
    bins = binned.groupBy("study", "bin").agg(F.sum("n").alias("n")).select("study", "bin", higher.alias("higher"))
    own = F.sum("n").over(Window.partitionBy("study", "bin").orderBy(F.col("mi_r").desc()).rangeBetween(Window.unboundedPreceding, 0))
    counted = binned.withColumn("own", own).join(bins, ["study", "bin"]).select("study", "mi_r", ((F.col("own") + F.col("higher")) / F.col("all")).alias("p_value")).distinct()
    return seen.join(counted, ["study", "mi_r"], "left").drop("mi_r")


def p_values_per_pair(pairs: DataFrame, null: DataFrame) -> DataFrame:
    """(1 + null values at or above the score) / (1 + permutations), against the pair's own null."""
    keys = ["study", "gene_a", "gene_b"]
    both = null.withColumnRenamed("mi", "mi_null").join(pairs.select(*keys, "mi"), keys)
    hit = F.round("mi_null", PLACES) >= F.round("mi", PLACES)
    return both.groupBy(*keys, "mi").agg(((1 + F.count_if(hit)) / (1 + F.count("*"))).alias("p_value"))


def pair_tests(bins: DataFrame, n: int, seed: int = 42, wanted: DataFrame | None = None, block: int = 256) -> DataFrame:
    """P3, W2 in one: (study, gene_a, gene_b, mi, p_value) of all pairs, or the wanted ones.

    A cell of two blocks of genes scores all its pairs, then again with the second gene's runs in each of n orders,
    and adds up how often the null reaches the score: a row a pair, whatever n is. The orders are those of `pair_null`.
    """
    from weftnet.operators.pairs import _mi, fold, grid, vectors

    cells, vec = grid(bins, "bin", block)
    if wanted is not None:
        at = vec.select("study", "gene", "blk")
        a, b = (at.withColumnsRenamed({"gene": f"gene_{k}", "blk": f"blk_{k}"}) for k in "ab")
        used = wanted.join(a, ["study", "gene_a"]).join(b, ["study", "gene_b"]).select("study", F.least("blk_a", "blk_b").alias("lo"), F.greatest("blk_a", "blk_b").alias("hi")).distinct()
        cells = cells.join(used, ["study", "lo", "hi"], "left_semi")
    # a row of each cell, without a gene, has the study's runs
    runs = bins.groupBy("study").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    heads = cells.select("study", "lo", "hi").distinct().join(runs, "study").select("study", "lo", "hi", F.col("lo").alias("blk"), F.lit(None).cast("string").alias("gene"), F.lit(None).cast("array<double>").alias("v"), "runs")
    cells = cells.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)).union(heads)

    def count(study: object, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        names = next(r for r in a["runs"] if r is not None)
        a, b = a[a["gene"].notna()], b[b["gene"].notna()]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["study", "gene_a", "gene_b", "mi", "p_value"])
        ga, gb, x, y = a["gene"].to_numpy(), b["gene"].to_numpy(), vectors(a), vectors(b)
        mi = _mi(x, y)["mi"]
        score, hits, ahead = np.round(mi, PLACES), np.zeros(mi.shape, np.int64), ga[:, None] < gb[None]
        same = ga[0] == gb[0]
        for p in range(n):
            order = np.array(sorted(range(len(names)), key=lambda k: (hashlib.md5(f"{seed}|{study}|{p}|{names[k]}".encode()).hexdigest(), names[k])))  # noqa: B023
            hits += ahead & (np.round(_mi(x, y[:, order])["mi"], PLACES) >= score)
            if not same and not ahead.all():  # the later name is in the first block
                hits += ~ahead & (np.round(_mi(x[:, order], y)["mi"], PLACES) >= score)
        i, j = np.nonzero(ahead if same else np.ones(mi.shape, bool))
        swap = ga[i] > gb[j]
        return pd.DataFrame({"study": study, "gene_a": np.where(swap, gb[j], ga[i]), "gene_b": np.where(swap, ga[i], gb[j]), "mi": mi[i, j], "p_value": (1 + hits[i, j]) / (1 + n)})

    found = fold(cells, count, "gene_a string, gene_b string, mi double, p_value double")
    return found if wanted is None else found.join(wanted.select("study", "gene_a", "gene_b"), ["study", "gene_a", "gene_b"], "left_semi")


def threshold_at(null: DataFrame, p: float) -> DataFrame:
    """Summary of each study's null and the score that p-value p needs."""
    q = F.percentile("mi", F.array(F.lit(1 - p), F.lit(0.95), F.lit(0.99), F.lit(0.999)))
    return null.groupBy("study").agg(F.count("*").alias("n"), F.avg("mi").alias("mean"), F.stddev_pop("mi").alias("std"), F.min("mi").alias("min"), F.max("mi").alias("max"), q.alias("q")).select("study", "n", "mean", "std", "min", "max", F.col("q")[0].alias("threshold"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), F.col("q")[3].alias("p999"))


def histogram(null: DataFrame, bins: int = 20) -> DataFrame:
    """K5: counts of null values in equal bins between each study's extremes."""
    ends = null.groupBy("study").agg(F.min("mi").alias("lo"), F.max("mi").alias("hi"))
    k = F.least(F.lit(bins - 1), F.floor((F.col("mi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return null.join(ends, "study").select("study", F.when(F.col("hi") > F.col("lo"), k).otherwise(0).cast("int").alias("bin")).groupBy("study", "bin").agg(F.count("*").alias("n"))


def significant(pairs: DataFrame, p: float = 0.001) -> DataFrame:
    """strictly below the threshold."""
    return pairs.where(F.col("p_value") < p)


def _ranked(tests: DataFrame, by: tuple[str, ...], p: str) -> DataFrame:
    """(by, p, n, rank, m, bin): each distinct p with its rows, the rank of the last of them, and all rows.

    Bins of the logarithm of p are counted first, so a window spans the bins of a group or one bin.
    """
    bin_ = F.when(F.col(p) > 0, F.least(F.lit(4096), F.floor(-4 * F.log2(F.col(p))))).otherwise(F.lit(4097)).cast("int")  # falls as p rises
    d = cut(tests.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias(p)).agg(F.count("*").alias("n")).withColumn("bin", bin_))
    of = Window.partitionBy(*by)
    bins = d.groupBy(*by, "bin").agg(F.sum("n").alias("in_bin"))
    bins = bins.select(*by, "bin", (F.sum("in_bin").over(of.orderBy(F.col("bin").desc())) - F.col("in_bin")).alias("before"), F.sum("in_bin").over(of).alias("m"))
    rank = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bin").orderBy(p))
    return d.join(bins, [*by, "bin"]).select(*by, p, "n", rank.alias("rank"), "m", "bin")


def bh_adjusted(tests: DataFrame, by: tuple[str, ...] = (), p: str = "p_value") -> DataFrame:
    """Benjamini-Hochberg p-values, monotone: min(1, least p m / rank from the end); null without a p-value.

    Of equal p-values the last rank decides, so only distinct ones are ranked.
    """
    d = _ranked(tests, by, p).withColumn("q", F.col(p) * F.col("m") / F.col("rank"))
    later = F.min("least").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # bins of larger p
    bins = d.groupBy(*by, "bin").agg(F.min("q").alias("least")).select(*by, "bin", later.alias("later"))
    own = F.min("q").over(Window.partitionBy(*by, "bin").orderBy(F.col(p).desc()))
    adjusted = d.withColumn("own", own).join(bins, [*by, "bin"]).select(*by, p, F.least(F.lit(1.0), "own", "later").alias("p_adjusted"))
    return tests.join(adjusted, [*by, p], "left").select(*tests.columns, "p_adjusted")


def bh_edges(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Edges up to the largest p with p <= rank / m * alpha; p_adjusted = min(1, p m / rank among those).

    Ranks of equal p-values follow the names; a p-value of 0 needs none.
    """
    d = _ranked(pairs, ("study",), "p_value")
    cutoff = d.where(F.col("p_value") <= F.col("rank") / F.col("m") * alpha).groupBy("study").agg(F.max("p_value").alias("cutoff"))
    d = d.join(cutoff, "study").where("p_value <= cutoff").select("study", "p_value", "m", (F.col("rank") - F.col("n")).alias("before"))
    kept = pairs.join(d, ["study", "p_value"])
    out = lambda rows, adjusted: rows.select("study", "gene_a", "gene_b", "mi", "p_value", adjusted.alias("p_adjusted"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("study", "p_value").orderBy("gene_a", "gene_b"))
    return out(kept.where("p_value = 0"), F.lit(0.0)).union(out(kept.where("p_value > 0"), F.least(F.lit(1.0), F.col("p_value") * F.col("m") / rank)))
