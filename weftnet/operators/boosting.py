"""Regulators of genes by boosted regression trees over histograms (M1, M2).

Every gene is a target, all other genes of its study are regulators. Regulators are cut into quantile bins once. A
tree grows level by level: of each regulator and node, the sums and counts of residuals in its bins come from one
matrix product for a block of targets and a block of regulators, and the best split over all blocks wins. A part of
the runs is left out of each tree; a target whose trees no longer help those runs stops.

A study of at most `REGULATORS` genes is grown in tasks that hold a block of targets and those genes. In a larger
one, targets and regulators meet as blocks in a grid of tasks, level by level, and only the splits and the residuals
of targets move between steps; results are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import cut
from weftnet.operators.pairs import above_percentile

#: Bins of a regulator, regulators and targets of a block, runs of one product.
BINS, REGULATORS, TARGETS, RUNS = 8, 256, 16, 8192


@dataclass(frozen=True)
class Trees:
    """Trees of a target, levels, learning rate, share of runs that a tree sees, trees that early stopping looks at, least runs of a leaf."""

    rounds: int = 50
    depth: int = 3
    rate: float = 0.1
    bag: float = 0.9
    window: int = 10
    least: int = 2
    seed: int = 42


def binned(x: np.ndarray) -> np.ndarray:
    """The quantile bin of each run, a row for each gene."""
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=1)
    return np.stack([np.searchsorted(e, v) for e, v in zip(edges.T, x, strict=True)]).astype(np.uint8)


def in_bag(study: object, target: int, turn: int, n: int, t: Trees) -> np.ndarray:
    return np.random.default_rng((t.seed, zlib.crc32(str(study).encode()), target, turn)).random(n) < t.bag


def best_splits(codes: np.ndarray, regulators: np.ndarray, res: np.ndarray, targets: np.ndarray, node: np.ndarray, bag: np.ndarray, nodes: int, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, regulator, bin) of the best split of each target's nodes among these regulators; runs up to the bin go left."""
    r, n, m = len(codes), codes.shape[1], len(res)
    sums, counts = np.zeros((r * BINS, m * nodes)), np.zeros((r * BINS, m * nodes))
    for lo in range(0, n, RUNS):
        part = slice(lo, lo + RUNS)
        hot = (codes[:, None, part] == np.arange(BINS)[None, :, None]).reshape(r * BINS, -1).astype(np.float32)
        mine = (bag[:, None, part] & (node[:, None, part] == np.arange(nodes)[None, :, None])).reshape(m * nodes, -1)
        sums += hot @ (mine * np.repeat(res[:, part], nodes, axis=0)).astype(np.float32).T
        counts += hot @ mine.astype(np.float32).T
    shape = (r, BINS, m, nodes)
    s, c = sums.reshape(shape).cumsum(1), np.round(counts).reshape(shape).cumsum(1)
    whole, size = s[:, -1:], c[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s**2 / c + (whole - s) ** 2 / (size - c) - whole**2 / size
    gain = np.where((c >= t.least) & (size - c >= t.least), gain, 0.0)
    own = regulators[:, None] == targets[None]
    gain = np.where(own[:, None, :, None], 0.0, gain).transpose(2, 3, 0, 1).reshape(m, nodes, r * BINS)
    at = gain.argmax(2)
    return np.take_along_axis(gain, at[..., None], 2)[..., 0], regulators[at // BINS], at % BINS


def leaves(res: np.ndarray, node: np.ndarray, bag: np.ndarray, t: Trees) -> tuple[np.ndarray, float]:
    """(residuals after a tree, what it did for the runs that it has not seen; nan if it has seen all)."""
    many = 1 << t.depth
    sums, counts = (np.bincount(node[bag], w, many) for w in (res[bag], None))
    value = np.divide(sums, counts, out=np.zeros(many), where=counts > 0)
    after = res - t.rate * value[node]
    return after, float((res[~bag] ** 2).mean() - (after[~bag] ** 2).mean()) if (~bag).any() else float("nan")


def goes_on(helped: list[float], t: Trees) -> bool:
    """Whether a target gets another tree."""
    last = [h for h in helped[-t.window :] if h == h]
    return len(helped) < t.rounds and (len(helped) < t.window or not last or sum(last) > 0)


def _least_gain(res: np.ndarray) -> float:
    return 1e-7 * float((res**2).sum())


def _small(x: DataFrame, t: Trees) -> DataFrame:
    """Whole trees of blocks of targets; x(study, gene, ord, v, n_genes), studies of at most REGULATORS genes."""
    blocks = F.ceil(F.col("n_genes") / TARGETS).cast("int")
    cells = x.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("mine", F.floor(F.col("ord") / TARGETS) == F.col("block"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        v, at = np.array(rows["v"].tolist()), np.flatnonzero(rows["mine"].to_numpy())
        codes, everyone = binned(v), np.arange(len(v))
        res = v[at] - v[at].mean(1, keepdims=True)
        helped: list[list[float]] = [[] for _ in at]
        gains = np.zeros((len(at), len(v)))
        alive = np.flatnonzero((res**2).sum(1) > 1e-12)
        while len(alive):
            bag = np.stack([in_bag(key[0], int(at[k]), len(helped[k]), v.shape[1], t) for k in alive])
            node, tree = np.zeros(bag.shape, np.int64), np.zeros((len(alive), len(v)))
            for level in range(t.depth):
                gain, reg, cut_at = best_splits(codes, everyone, res[alive], at[alive], node, bag, 1 << level, t)
                for i, k in enumerate(alive):
                    ok = gain[i] > _least_gain(res[k])
                    np.add.at(tree[i], reg[i][ok], gain[i][ok])
                    right = ok[node[i]] & (codes[reg[i][node[i]], np.arange(v.shape[1])] > cut_at[i][node[i]])
                    node[i] = node[i] * 2 + right
            for i, k in enumerate(alive):
                res[k], gained = leaves(res[k], node[i], bag[i], t)
                helped[k].append(gained)
                gains[k] += tree[i] / (tree[i].sum() or 1)
            alive = np.array([k for k in alive if goes_on(helped[k], t)], np.int64)
        i, j = np.nonzero(gains)
        return pd.DataFrame({"study": key[0], "regulator": j, "target": at[i], "importance": gains[i, j]})

    return cells.groupBy("study", "block").applyInPandas(run, f"study {x.schema['study'].dataType.simpleString()}, regulator long, target long, importance double")


def _large(x: DataFrame, t: Trees, block: int) -> DataFrame:
    """The same for studies of any number of genes: a step for each level of each tree, blocks of both sides in a grid."""
    study = x.schema["study"].dataType.simpleString()
    base = x.select("study", "ord", "n_genes", "v", F.floor(F.col("ord") / block).cast("int").alias("blk"))

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(codes=[binned(np.array([v]))[0].tobytes() for v in rows["v"]])[["study", "ord", "blk", "codes"]]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            v = [np.asarray(v, float) for v in rows["v"]]
            res = [(a - a.mean()).tobytes() for a in v]
            yield rows.assign(res=res, node=[np.zeros(len(a), np.uint8).tobytes() for a in v], helped=[[] for _ in v])[STATE][[np.frombuffer(r).var() > 1e-12 / len(a) for r, a in zip(res, v, strict=True)]]

    STATE = ["study", "ord", "blk", "n_genes", "res", "node", "helped"]
    state_schema = f"study {study}, ord long, blk int, n_genes long, res binary, node binary, helped array<double>"
    codes = cut(base.mapInPandas(cut_up, f"study {study}, ord long, blk int, codes binary"))
    state = cut(base.mapInPandas(start, state_schema))
    found = None

    def search(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        return lambda key, rows: searched(key, rows, level)

    def searched(key: tuple, rows: pd.DataFrame, level: int) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        targets, regs = rows[rows["codes"].isna()], rows[rows["codes"].notna()]
        if not len(targets) or not len(regs):
            return pd.DataFrame(columns=["study", "target", "node", "gain", "regulator", "bin"])
        c = np.stack([np.frombuffer(b, np.uint8) for b in regs["codes"]])
        res = np.stack([np.frombuffer(b) for b in targets["res"]])
        node = np.stack([np.frombuffer(b, np.uint8) for b in targets["node"]])
        at = targets["ord"].to_numpy()
        bag = np.stack([in_bag(key[0], int(k), len(h), c.shape[1], t) for k, h in zip(at, targets["helped"], strict=True)])
        gain, reg, bin_ = best_splits(c, regs["ord"].to_numpy(), res, at, node, bag, 1 << level, t)
        i, k = np.nonzero(gain > np.array([_least_gain(r) for r in res])[:, None])
        return pd.DataFrame({"study": key[0], "target": at[i], "node": k, "gain": gain[i, k], "regulator": reg[i, k], "bin": bin_[i, k]})

    def move(level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        return lambda batches: moved(batches, level)

    def moved(batches: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                node, res, helped = np.frombuffer(r.node, np.uint8), np.frombuffer(r.res), list(r.helped)
                right = np.zeros(len(node), bool)
                for s in [] if r.splits is None else r.splits:
                    right |= (node == s["node"]) & (np.frombuffer(s["codes"], np.uint8) > s["bin"])
                node = (node * 2 + right).astype(np.uint8)
                if level == t.depth - 1:
                    bag = in_bag(r.study, r.ord, len(helped), len(node), t)
                    res, gained = leaves(res, node.astype(np.int64), bag, t)
                    helped.append(gained)
                    node = np.zeros_like(node)
                    if not goes_on(helped, t):
                        continue
                out.append((r.study, r.ord, r.blk, r.n_genes, res.tobytes(), node.tobytes(), helped))
            yield pd.DataFrame(out, columns=STATE)

    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_genes") / block).cast("int") - 1))
    sides = cut(base.select("study", "blk").distinct())
    for turn in range(t.rounds):
        if not state.limit(1).count():
            break
        for level in range(t.depth):
            left = state.select("study", F.col("blk").alias("tb"), blocks.alias("rb"), "ord", "res", "node", "helped", F.lit(None).cast("binary").alias("codes"))
            right = codes.join(sides.select("study", F.col("blk").alias("tb")), "study").select("study", "tb", F.col("blk").alias("rb"), "ord", F.lit(None).cast("binary").alias("res"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast("array<double>").alias("helped"), "codes")
            each = left.union(right).groupBy("study", "tb", "rb").applyInPandas(search(level), f"study {study}, target long, node int, gain double, regulator long, bin int")
            best = cut(each.groupBy("study", "target", "node").agg(F.max_by(F.struct("gain", "regulator", "bin"), F.struct("gain", -F.col("regulator"))).alias("s")).select("study", "target", "node", "s.*"))
            row = best.select("study", F.lit(turn).alias("turn"), "target", "regulator", "gain")
            found = row if found is None else found.union(row)
            moves = best.join(codes.select("study", F.col("ord").alias("regulator"), "codes"), ["study", "regulator"]).groupBy("study", F.col("target").alias("ord")).agg(F.collect_list(F.struct("node", "bin", "codes")).alias("splits"))
            state = cut(state.join(moves, ["study", "ord"], "left").select(*STATE, "splits").mapInPandas(move(level), state_schema))
        found = cut(found)
    if found is None:
        found = base.limit(0).select("study", F.lit(0).alias("turn"), F.col("ord").alias("target"), F.col("ord").alias("regulator"), F.lit(0.0).alias("gain"))
    tree = found.groupBy("study", "turn", "target").agg(F.sum("gain").alias("whole"))
    shares = found.join(tree, ["study", "turn", "target"])
    return shares.groupBy("study", "regulator", "target").agg(F.sum(F.col("gain") / F.col("whole")).alias("importance"))


def regulator_importance(x: DataFrame, trees: Trees = Trees(), block: int = REGULATORS) -> DataFrame:
    """M1: (study, regulator, target, importance): the shares of a regulator in the gain of each of the target's trees, summed."""
    vec = x.groupBy("study", "gene").agg(F.sort_array(F.collect_list(F.struct("run", F.col("x").cast("double").alias("x")))).alias("s")).select("study", "gene", F.col("s.x").alias("v"))
    vec = vec.withColumn("ord", (F.row_number().over(Window.partitionBy("study").orderBy("gene")) - 1).cast("long"))
    vec = cut(vec.join(vec.groupBy("study").agg(F.count("*").alias("n_genes")), "study"))
    out = _small(vec.where(F.col("n_genes") <= block), trees)
    large = vec.where(F.col("n_genes") > block)
    if large.limit(1).count():
        out = out.union(_large(large, trees, block))
    a, b = (vec.select("study", F.col("ord").alias(k), F.col("gene").alias(f"{k}_gene")) for k in ("regulator", "target"))
    return out.join(a, ["study", "regulator"]).join(b, ["study", "target"]).select("study", F.col("regulator_gene").alias("regulator"), F.col("target_gene").alias("target"), "importance")


def importance_edges(importance: DataFrame, share: float = 0.95) -> DataFrame:
    """M2: undirected edges of the importances at or above a percentile."""
    kept = above_percentile(importance, "importance", share)
    return kept.where("regulator <> target").select("study", F.least("regulator", "target").alias("gene_a"), F.greatest("regulator", "target").alias("gene_b")).distinct()
