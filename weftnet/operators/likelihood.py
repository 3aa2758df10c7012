"""The context-likelihood network without a table of all pairs (A12, T3 fused with A6).

Information is scored three times, by the same block kernel, and each time only what is needed leaves a cell: moments
of each gene's scores, then counts of likelihoods in bins, then the pairs from the bin of the percentile upwards. The
bins are the leading bits of the numbers, so counts of any cells add up without knowing the range beforehand; inside
the bin of the percentile the exact rank decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import cut
from weftnet.operators.pairs import BLOCK, _mi, fold, grid, vectors

#: Leading bits of a number that make its bin: the exponent and 9 bits of the fraction, so bins are 0.2 % wide.
DROP = 43
#: Places that likelihoods are rounded to before they are compared.
PLACES = 9


def _bin(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.float64).view(np.int64) >> DROP  # rises with the number, from 0 on


def _scores(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(information, which pairs count): each pair of genes once."""
    mi = _mi(vectors(a), vectors(b))["mi"]
    same = a["gene"].iloc[0] == b["gene"].iloc[0]
    return mi, np.triu(np.ones(mi.shape, bool), 1) if same else np.ones(mi.shape, bool)


def moments(cells: DataFrame) -> DataFrame:
    """(study, gene, mean, sd) of each gene's scores with all others; deviations without spread are 1."""

    def sums(study: object, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            mi, use = _scores(a, b)
            for rows, m, u in ((a, mi, use), (b, mi.T, use.T)):
                n = u.sum(1)
                mean = np.divide(np.where(u, m, 0).sum(1), n, out=np.zeros(len(n)), where=n > 0)
                out.append(pd.DataFrame({"study": study, "gene": rows["gene"].to_numpy(), "n": n, "mean": mean, "m2": np.where(u, (m - mean[:, None]) ** 2, 0).sum(1)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["study", "gene", "n", "mean", "m2"])

    part = cut(fold(cells, sums, "gene string, n long, mean double, m2 double").where("n > 0"))
    whole = part.groupBy("study", "gene").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    var = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)) / F.sum("n")
    s = part.join(whole, ["study", "gene"]).groupBy("study", "gene").agg(F.first("grand").alias("mean"), F.sqrt(var).alias("sd"))
    return s.withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0))


def _likelihood(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mi, use = _scores(a, b)
    za = (mi - a["mean"].to_numpy()[:, None]) / a["sd"].to_numpy()[:, None]
    zb = (mi - b["mean"].to_numpy()[None]) / b["sd"].to_numpy()[None]
    return mi, np.nan_to_num(np.sqrt(za**2 + zb**2) / np.sqrt(2.0), nan=0.0, posinf=0.0, neginf=0.0), use


def edges(bins: DataFrame, share: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(study, gene_a, gene_b, mi, clr) of the pairs at or above a percentile of their study's likelihoods; bins(study, gene, run, bin)."""
    cells, vec = grid(bins, "bin", block)
    about = cut(moments(cells))
    # means and deviations come with their genes
    cells = cells.join(about, ["study", "gene"]).select("study", "lo", "hi", "blk", "gene", "v", "mean", "sd")

    def counts(study: object, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["study", "bin", "n"])
        _, clr, use = _likelihood(a, b)
        bin_, n = np.unique(_bin(np.round(clr[use], PLACES)), return_counts=True)
        return pd.DataFrame({"study": study, "bin": bin_, "n": n})

    seen = fold(cells, counts, "bin long, n long").groupBy("study", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("study")
    seen = cut(seen.select("study", "bin", "n", (F.sum("n").over(of.orderBy("bin")) - F.col("n")).alias("before"), ((F.sum("n").over(of) - 1) * F.lit(share)).alias("at")))
    hit = seen.where("(floor(at) >= before and floor(at) < before + n) or (ceil(at) >= before and ceil(at) < before + n)")
    hit = cut(hit.groupBy("study").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.min("before").alias("before"), F.first("at").alias("at")))

    def kept(study: object, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["study", "gene_a", "gene_b", "mi", "clr", "place", "bin"])
        mi, clr, use = _likelihood(a, b)
        place = np.round(clr, PLACES)
        i, j = np.nonzero(use & (_bin(place) >= a["first"].iloc[0]))
        ga, gb = a["gene"].to_numpy()[i], b["gene"].to_numpy()[j]
        swap = ga > gb
        return pd.DataFrame({"study": study, "gene_a": np.where(swap, gb, ga), "gene_b": np.where(swap, ga, gb), "mi": mi[i, j], "clr": clr[i, j], "place": place[i, j], "bin": _bin(place[i, j])})

    near = cut(fold(cells.join(hit.select("study", "first"), "study"), kept, "gene_a string, gene_b string, mi double, clr double, place double, bin long"))
    # the exact percentile, between two ranks of the few values in its bins
    inside = near.join(hit, "study").where("bin <= last").groupBy("study", "place", "before", "at").agg(F.count("*").alias("n"))
    ahead = F.col("before") + F.sum("n").over(of.orderBy("place")) - F.col("n")
    inside = inside.select("study", "place", "at", "n", ahead.alias("ahead"))
    at = lambda k: F.max(F.when((F.col("ahead") <= k(F.col("at"))) & (k(F.col("at")) < F.col("ahead") + F.col("n")), F.col("place")))
    limit = inside.groupBy("study", "at").agg(at(F.floor).alias("low"), at(F.ceil).alias("high"))
    limit = limit.select("study", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("cut"))
    return near.join(limit, "study").where(F.col("place") >= F.col("cut")).select("study", "gene_a", "gene_b", "mi", "clr")
