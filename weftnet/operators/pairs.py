"""Scores of gene pairs: mutual information, correlation, context likelihood, prescreening.

All pairs of a study are covered by pairs of gene blocks. A row holds a block's vectors; block pairs of a
study meet by an equi-join on the study and on the grid, and a NumPy kernel scores a block pair at once
with a matrix product, so that a task holds two blocks whatever the number of genes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions import ranks
from weftnet.functions.scratch import cut

#: Genes of a block: two blocks of vectors and one product are what a task holds.
BLOCK = 256


def grid(x: DataFrame, col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(study, lo, hi, blk, gene, v): each block of genes in every cell of the upper grid that needs it; and (study, gene, v, blocks, blk)."""
    vec = x.groupBy("study", "gene").agg(F.sort_array(F.collect_list(F.struct("run", F.col(col).cast("double").alias("v")))).alias("s")).select("study", "gene", F.col("s.v").alias("v"))
    per = vec.groupBy("study").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    vec = vec.join(per, "study").withColumn("blk", F.pmod(F.hash("gene"), F.col("blocks")))
    cells = vec.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.select("study", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "gene", "v"), vec


def fold(cells: DataFrame, fn: Callable[[object, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `fn(study, rows of a block, rows of the other)` makes of each cell, genes in order of name; twice the same rows on the diagonal.

    For results that are smaller than all pairs: sums for each gene, the nearest of each gene, pairs above a limit.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gene", kind="stable")
        study, lo, hi = key
        return fn(study, rows[rows["blk"] == lo], rows[rows["blk"] == hi])

    return cells.groupBy("study", "lo", "hi").applyInPandas(run, f"study {cells.schema['study'].dataType.simpleString()}, {schema}")


def vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["v"].tolist())


def block_pairs(x: DataFrame, col: str, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: dict[str, str], block: int = BLOCK, only: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(study, gene_a, gene_b, outputs) of all gene pairs of a study, gene_a < gene_b.

    `kernel(a, b)` gets two blocks of vectors over the study's runs in one order and returns matrices. Pairs
    that `only` masks out never become rows. With wanted(study, gene_a, gene_b), only those pairs, and no cell
    of the grid without any is scored.
    """
    cells, vec = grid(x, col, block)
    if wanted is not None:
        at = vec.select("study", "gene", "blk")
        a, b = (at.withColumnsRenamed({"gene": f"gene_{k}", "blk": f"blk_{k}"}) for k in "ab")
        used = wanted.join(a, ["study", "gene_a"]).join(b, ["study", "gene_b"])
        used = used.select("study", F.least("blk_a", "blk_b").alias("lo"), F.greatest("blk_a", "blk_b").alias("hi")).distinct()
        cells = cells.join(used, ["study", "lo", "hi"], "left_semi")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gene", kind="stable")
        study, lo, hi = key
        a, b = (rows[rows["blk"] == k] for k in (lo, hi))
        ga, gb = a["gene"].to_numpy(), b["gene"].to_numpy()
        found = kernel(np.array(a["v"].tolist()), np.array(b["v"].tolist()))
        keep = ga[:, None] < gb[None] if lo == hi else np.ones((len(ga), len(gb)), bool)
        if only is not None:
            keep = keep & only(found)
        i, j = np.nonzero(keep)
        x, y = ga[i], gb[j]
        swap = x > y
        out = {"study": np.full(len(i), study), "gene_a": np.where(swap, y, x), "gene_b": np.where(swap, x, y)}
        return pd.DataFrame(out | {name: m[i, j] for name, m in found.items()})

    schema = f"study {x.schema['study'].dataType.simpleString()}, gene_a string, gene_b string, " + ", ".join(f"{n} {t}" for n, t in outputs.items())
    scored = cells.groupBy("study", "lo", "hi").applyInPandas(run, schema)
    return scored if wanted is None else scored.join(wanted.select("study", "gene_a", "gene_b"), ["study", "gene_a", "gene_b"], "left_semi")


def _contingency(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joint counts (i, j, ka, kb), counts of a, counts of b, samples)."""
    k = int(max(a.max(), b.max())) + 1
    hot = [(m[:, None, :] == np.arange(k)[None, :, None]).astype(np.float32).reshape(-1, m.shape[1]) for m in (a, b)]
    joint = (hot[0] @ hot[1].T).astype(np.float64).reshape(len(a), k, len(b), k).transpose(0, 2, 1, 3)
    return joint, hot[0].sum(1).reshape(len(a), k).astype(float), hot[1].sum(1).reshape(len(b), k).astype(float), a.shape[1]


def _mi(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    joint, ca, cb, n = _contingency(a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(joint > 0, joint / n * np.log(joint * n / (ca[:, None, :, None] * cb[None, :, None, :])), 0)
    cells = (joint > 0).sum((2, 3))
    correction = ((ca > 0).sum(1)[:, None] + (cb > 0).sum(1)[None] - cells - 1) / (2 * n)
    return {"mi": terms.sum((2, 3)), "mi_mm": terms.sum((2, 3)) + correction}


def mutual_information(bins: DataFrame, block: int = BLOCK, wanted: DataFrame | None = None) -> DataFrame:
    """Plug-in mutual information in nats (mi) and with Miller-Madow entropies (mi_mm)."""
    return block_pairs(bins, "bin", _mi, {"mi": "double", "mi_mm": "double"}, block, wanted=wanted)


def _standardised(m: np.ndarray) -> np.ndarray:
    """Centred rows of length 1, constant ones 0."""
    c = m - m.mean(1, keepdims=True)
    norm = np.sqrt((c**2).sum(1, keepdims=True))
    return np.divide(c, norm, out=np.zeros_like(c), where=norm > 1e-12)


def _pearson(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    return {"r": np.clip(_standardised(a) @ _standardised(b).T, -1, 1)}


def correlation(x: DataFrame, method: str = "pearson", block: int = BLOCK, above: float | None = None) -> DataFrame:
    """Correlation of every pair, 0 for constant genes; with `above`, of those with a larger |r|."""
    only = None if above is None else (lambda found: np.abs(found["r"]) > above)
    if method == "spearman":
        from weftnet.operators.prep import average_ranks

        return block_pairs(average_ranks(x), "rank", _pearson, {"r": "double"}, block, only)
    return block_pairs(x, "x", _pearson, {"r": "double"}, block, only)


def prescreen(x: DataFrame, method: str = "pearson", threshold: float = 0.3, most: int | None = None) -> DataFrame:
    """Pairs with |r| above the threshold; per study at most `most` of the largest."""
    kept = correlation(x, method, above=threshold).withColumn("r_abs", F.abs("r"))
    if most:
        kept = cut(kept.withColumn("place", F.round("r_abs", 9)))
        kept = ranks.largest(kept, "place", most, ("gene_a", "gene_b")).drop("place")
    return kept


def all_pairs(genes: DataFrame) -> DataFrame:
    """Unordered gene pairs of each study."""
    b = genes.select("study", F.col("gene").alias("gene_b"))
    return genes.select("study", F.col("gene").alias("gene_a")).join(b, "study").where("gene_a < gene_b")


def clr(pairs: DataFrame, col: str = "mi") -> DataFrame:
    """Context likelihood: sqrt(z_a^2 + z_b^2) / sqrt 2 against each gene's other scores."""
    both = pairs.select("study", F.col("gene_a").alias("gene"), col).union(pairs.select("study", F.col("gene_b").alias("gene"), col))
    s = both.groupBy("study", "gene").agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    a, b = (s.select("study", F.col("gene").alias(f"gene_{k}"), F.col("mean").alias(f"mean_{k}"), F.col("sd").alias(f"sd_{k}")) for k in "ab")
    z = lambda k: F.pow((F.col(col) - F.col(f"mean_{k}")) / F.col(f"sd_{k}"), 2)
    value = F.sqrt(z("a") + z("b")) / F.sqrt(F.lit(2.0))
    return pairs.join(a, ["study", "gene_a"]).join(b, ["study", "gene_b"]).select("study", "gene_a", "gene_b", col, F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("clr"))


def above_percentile(pairs: DataFrame, col: str, share: float = 0.95) -> DataFrame:
    """Pairs at or above a percentile of their study."""
    pairs = cut(pairs)  # scored once, read by each step of the percentile
    return pairs.join(ranks.percentile(pairs, col, share), "study").where(F.col(col) >= F.col("cut"))


def sparsify(pairs: DataFrame, col: str, share: float = 0.95) -> DataFrame:
    """Per gene, scores below its own quantile (its row includes a zero for itself) become 0; one row per direction."""
    both = pairs.select("study", F.col("gene_a").alias("gene"), F.col("gene_b").alias("other"), col).union(pairs.select("study", F.col("gene_b").alias("gene"), F.col("gene_a").alias("other"), col))
    own = both.select("study", "gene").distinct().select("study", "gene", F.col("gene").alias("other"), F.lit(0.0).alias(col))
    whole = both.union(own)
    own_cut = whole.groupBy("study", "gene").agg(F.percentile(col, share).alias("cut"))  # of one gene's row
    return whole.join(own_cut, ["study", "gene"]).select("study", "gene", "other", F.when(F.col(col) >= F.col("cut"), F.col(col)).otherwise(0.0).alias("value"))


def _neural(width: int, epochs: int, rate: float, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Donsker-Varadhan bound by one small network per pair; a batch of pairs trains at once.

    Gives a row for each pair, and one for the batch, named by its first pair: losses and bounds of each epoch (means
    over its pairs), seconds, and the mean, deviation and largest of its results.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            began, losses = time.time(), []
            x, y = (np.array(rows[c].tolist()) for c in ("va", "vb"))
            p, n = x.shape
            rng = np.random.default_rng(seed)
            w = [rng.normal(0, 1, (p, 2, width)) * 0.7, rng.normal(0, 1 / np.sqrt(width), (p, width, width)), rng.normal(0, 1 / np.sqrt(width), (p, width, 1))]
            c = [np.zeros((p, 1, width)), np.zeros((p, 1, width)), np.zeros((p, 1, 1))]
            m, v = [np.zeros_like(q) for q in w + c], [np.zeros_like(q) for q in w + c]
            ema = np.ones((p, 1))

            def shuffled(values: np.ndarray) -> np.ndarray:
                """Every pair's values in an order of its own."""
                return np.take_along_axis(values, rng.random(values.shape).argsort(1), 1)

            def forward(z: np.ndarray) -> list[np.ndarray]:
                out = [z]
                for k in range(3):
                    s = out[-1] @ w[k] + c[k]
                    out.append(np.where(s > 0, s, np.exp(np.minimum(s, 0)) - 1) if k < 2 else s)
                return out

            def backward(acts: list[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
                gw, gc = [], []
                for k in (2, 1, 0):
                    gw.insert(0, acts[k].transpose(0, 2, 1) @ d)
                    gc.insert(0, d.sum(1, keepdims=True))
                    if k:
                        d = (d @ w[k].transpose(0, 2, 1)) * np.where(acts[k] > 0, 1, acts[k] + 1)
                return gw + gc

            for step in range(1, epochs + 1):
                joint = forward(np.stack([x, y], 2))
                apart = forward(np.stack([x, shuffled(y)], 2))
                e = np.exp(np.clip(apart[-1][..., 0], -20, 20))
                losses.append(float((np.log(e.mean(1)) - joint[-1][..., 0].mean(1)).mean()))
                ema = e.mean(1, keepdims=True) if step == 1 else 0.99 * ema + 0.01 * e.mean(1, keepdims=True)
                up = backward(joint, np.full((p, n, 1), -1 / n))
                down = backward(apart, (e / n / np.maximum(ema, 1e-6))[..., None])
                grads = [a + b for a, b in zip(up, down, strict=True)]
                norm = np.sqrt(sum((g**2).sum((1, 2), keepdims=True) for g in grads))  # of each pair's whole gradient
                for k, g in enumerate(grads):
                    g = g * np.minimum(1, 1 / np.maximum(norm, 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    q = w[k] if k < 3 else c[k - 3]
                    q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            t = forward(np.stack([x, y], 2))[-1][..., 0].mean(1)
            bounds = [t - np.log(np.exp(np.clip(forward(np.stack([x, shuffled(y)], 2))[-1][..., 0], -20, 20)).mean(1)) for _ in range(5)]
            mi = np.maximum(0, np.mean(bounds, 0))
            yield rows[["study", "gene_a", "gene_b"]].assign(mi=mi, n_pairs=None, seconds=None, mi_std=None, mi_max=None, losses=None)
            about = {"mi": mi.mean(), "n_pairs": p, "seconds": time.time() - began, "mi_std": mi.std(), "mi_max": mi.max(), "losses": [losses]}
            yield rows[["study", "gene_a", "gene_b"]].iloc[:1].assign(**about)

    return run


def neural_information(z: DataFrame, pairs: DataFrame, width: int = 16, epochs: int = 100, rate: float = 0.01, seed: int = 42) -> DataFrame:
    """A neural lower bound of mutual information for given pairs of standardised genes (study, gene, run, z)."""
    return neural_scores(neural_records(z, pairs, width, epochs, rate, seed))


def neural_scores(records: DataFrame) -> DataFrame:
    return records.where("n_pairs is null").select("study", "gene_a", "gene_b", "mi")


def neural_records(z: DataFrame, pairs: DataFrame, width: int = 16, epochs: int = 100, rate: float = 0.01, seed: int = 42) -> DataFrame:
    """Scores of pairs, and a row for each batch that was trained together (n_pairs is not null there).

    Training is what costs, so both kinds come from one run: write the records once, and take them apart after that.
    """
    vec = z.groupBy("study", "gene").agg(F.sort_array(F.collect_list(F.struct("run", "z"))).alias("s")).select("study", "gene", F.col("s.z").alias("v"))
    a, b = (vec.select("study", F.col("gene").alias(f"gene_{k}"), F.col("v").alias(f"v{k}")) for k in "ab")
    rows = pairs.select("study", "gene_a", "gene_b").join(a, ["study", "gene_a"]).join(b, ["study", "gene_b"]).select("study", "gene_a", "gene_b", "va", "vb")
    # batches of pairs of one length: partitions hold whole studies' pairs in order
    parts = rows.repartition("study", F.pmod(F.hash("gene_a", "gene_b"), F.lit(16))).sortWithinPartitions("study", "gene_a", "gene_b")

    def same_length(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _neural(width, epochs, rate, seed)
        for rows_ in batches:
            for _, group in rows_.groupby(["study"], sort=False):
                for lo in range(0, len(group), 512):
                    yield from one(iter([group.iloc[lo : lo + 512]]))

    study = z.schema["study"].dataType.simpleString()
    return parts.mapInPandas(same_length, f"study {study}, gene_a string, gene_b string, mi double, n_pairs int, seconds double, mi_std double, mi_max double, losses array<double>")


def batches_of(records: DataFrame) -> DataFrame:
    """K7: (study, batch, n_pairs, seconds, losses and bounds before and after, results) of each batch, numbered by first pair."""
    nth = F.row_number().over(Window.partitionBy("study").orderBy("gene_a", "gene_b")) - 1
    first, last = F.element_at("losses", 1), F.element_at("losses", -1)
    return records.where("n_pairs is not null").select(
        "study", nth.alias("batch"), "n_pairs", "seconds", first.alias("initial_loss"), last.alias("final_loss"), (first - last).alias("loss_reduction"),
        (-first).alias("initial_train_mi"), (-last).alias("final_train_mi"), F.col("mi").alias("mi_mean"), "mi_std", "mi_max", "losses",
    )


def loss_curve(records: DataFrame) -> DataFrame:
    """Mean and deviation over batches of the loss and the bound after each epoch; values that are no numbers don't count."""
    each = records.where("n_pairs is not null").select("study", F.posexplode("losses").alias("epoch", "loss"))
    loss = F.when(~F.isnan("loss"), F.col("loss"))
    return each.groupBy("study", "epoch").agg(F.avg(loss).alias("mean_loss"), F.stddev_pop(loss).alias("std_loss"), F.avg(-loss).alias("mean_train_mi"), F.stddev_pop(-loss).alias("std_train_mi"))
