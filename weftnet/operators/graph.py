"""Graphs as edge lists (graph, a, b): many graphs at once, keyed by `graph` (a study, a module, or one constant).

Loops cut their lineage with reliable checkpoints every round; all state stays in tables. Where `edges` may be a packed graph
(see `dense`), no step makes a row for a link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import cut, stored
from weftnet.operators import dense
from weftnet.operators.dense import plain

#: Vertices and links of a block at most, on average; vertices whose lists meet a block at once; columns of a product.
BLOCK_VERTICES, BLOCK_LINKS, BLOCK_LISTS, BLOCK_COLUMNS = 512, 1_000_000, 2048, 8192


def both_ways(edges: DataFrame) -> DataFrame:
    """(graph, v, u) of each edge from either end, without loops and repeats."""
    e = edges.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return e.select("graph", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("graph", "e.v", "e.u")


def degrees(edges: DataFrame) -> DataFrame:
    """G2."""
    if dense.is_packed(edges):
        return dense.degrees(edges)
    return both_ways(edges).groupBy("graph", "v").agg(F.count("*").alias("degree"))


def blocks(both: DataFrame) -> DataFrame:
    """(graph, v, blk) of the vertices of both(graph, v, u): blocks of vertices that share many neighbours.

    Vertices whose closed neighbourhoods have the same least hash are together, in several blocks if they are many; few
    share blocks with others.
    """
    near = both.groupBy("graph", "v").agg(F.count("*").alias("n"), F.min(F.xxhash64("u")).alias("m")).withColumn("m", F.least("m", F.xxhash64("v")))
    many = F.ceil(F.greatest(F.sum("n") / BLOCK_LINKS, F.count("*") / BLOCK_VERTICES))
    pieces = near.groupBy("graph", "m").agg(many.alias("pieces"))
    small = near.join(pieces.where("pieces = 1"), ["graph", "m"], "left_semi").groupBy("graph").agg(many.alias("shared"))
    blk = F.when(F.col("pieces") > 1, F.xxhash64("m", F.pmod(F.hash("v"), F.col("pieces")))).otherwise(F.pmod("m", "shared"))
    return near.join(pieces, ["graph", "m"]).join(small, "graph", "left").select("graph", "v", blk.cast("long").alias("blk"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles at each vertex; a vertex lists its neighbours of a larger degree, so hubs list few.

    A block of vertices meets the lists of all that its own lists name, in as many parts as these lists need, and matrix
    products count: there is no row for a wedge.
    """
    if dense.is_packed(edges):
        return dense.triangles(edges)
    both = stored(both_ways(edges))
    d = stored(both.groupBy("graph", "v").agg(F.count("*").alias("degree")))
    e = both.where("v < u").join(d.withColumnRenamed("degree", "dv"), ["graph", "v"]).join(d.withColumnsRenamed({"v": "u", "degree": "du"}), ["graph", "u"])
    first = F.col("dv") <= F.col("du")
    o = e.select("graph", F.when(first, F.col("v")).otherwise(F.col("u")).alias("v"), F.when(first, F.col("u")).otherwise(F.col("v")).alias("t"))
    lists = stored(o.groupBy("graph", "v").agg(F.collect_list("t").alias("list")))
    rows = stored(lists.join(blocks(both), ["graph", "v"]))
    named = stored(rows.select("graph", "blk", F.explode("list").alias("v")).distinct().join(lists.select("graph", "v", F.size("list").alias("n")), ["graph", "v"]))
    parts = named.groupBy("graph", "blk").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_LINKS, F.count("*") / BLOCK_LISTS)).cast("int").alias("parts"))
    own = rows.join(parts, ["graph", "blk"]).select("graph", "blk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("own"), "v", "list")
    met = named.join(parts, ["graph", "blk"]).join(lists, ["graph", "v"]).select("graph", "blk", F.pmod(F.hash("v"), F.col("parts")).alias("part"), F.lit(False).alias("own"), "v", "list")

    def count(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s, t = part[part["own"]], part[~part["own"]]
        at_s, at_t, found = np.zeros(len(s)), np.zeros(len(t)), []
        if len(s) and len(t):
            line = lambda x: np.repeat(np.arange(len(x)), x["list"].str.len())
            names, to_s = np.unique(np.concatenate(s["list"].tolist()), return_inverse=True)
            ends, row_s, row_t = np.concatenate(t["list"].tolist()), line(s), line(t)
            to_t = np.minimum(np.searchsorted(names, ends), len(names) - 1)
            known = names[to_t] == ends
            to_t, row_t = to_t[known], row_t[known]
            link = np.zeros((len(s), len(names)), bool)
            link[row_s, to_s] = True
            link = link[:, np.searchsorted(names, t["v"].to_numpy())].astype(np.float32)
            for lo in range(0, len(names), BLOCK_COLUMNS):
                hi = min(lo + BLOCK_COLUMNS, len(names))
                x, y = np.zeros((len(s), hi - lo), np.float32), np.zeros((len(t), hi - lo), np.float32)
                for m, row, to in ((x, row_s, to_s), (y, row_t, to_t)):
                    here = (to >= lo) & (to < hi)
                    m[row[here], to[here] - lo] = 1
                third = (link @ y) * x
                at_s += third.sum(1, dtype=float)
                at_t += ((link.T @ x) * y).sum(1, dtype=float)
                found.append(pd.DataFrame({"v": names[lo:hi], "n": third.sum(0, dtype=float)}))
        out = pd.concat([pd.DataFrame({"v": s["v"], "n": at_s}), pd.DataFrame({"v": t["v"], "n": at_t}), *found])
        out = out[out["n"] > 0]
        return plain(pd.DataFrame({"graph": [key[0]] * len(out), "v": out["v"].to_numpy(), "n": out["n"].to_numpy().astype(np.int64)}))

    kind = {c: both.schema[c].dataType.simpleString() for c in ("graph", "v")}
    found = own.union(met).groupBy("graph", "blk", "part").applyInPandas(count, f"graph {kind['graph']}, v {kind['v']}, n long")
    return found.groupBy("graph", "v").agg(F.sum("n").alias("triangles"))


def local_density(edges: DataFrame) -> DataFrame:
    """Edges within the closed neighbourhood over all possible ones: (degree + triangles) / C(degree + 1, 2)."""
    d = degrees(edges).join(triangles(edges), ["graph", "v"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return d.select("graph", "v", "degree", "triangles", ((F.col("degree") + F.col("triangles")) / (F.col("degree") * (F.col("degree") + 1) / 2)).alias("density"))


def coreness(edges: DataFrame, touched: list[int] | None = None) -> DataFrame:
    """The fixpoint of h-indices over neighbours' values, which is the core level.

    Levels only fall, so after the first round only vertices are looked at again of which a neighbour fell below their
    own level; the others' h-index cannot have changed. Neighbours are counted by value first, so a hub is as many rows
    as its neighbours have levels. `touched` gets the number of vertices that each round looked at.
    """
    if dense.is_packed(edges):
        return dense.coreness(edges, touched)
    both = stored(both_ways(edges))
    level = stored(both.groupBy("graph", "v").agg(F.count("*").cast("long").alias("core")))
    again = level.select("graph", "v")
    while True:
        of = both.join(again, ["graph", "v"], "left_semi").join(level.select("graph", F.col("v").alias("u"), F.col("core").alias("c")), ["graph", "u"])
        seen = of.groupBy("graph", "v", "c").agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("graph", "v").orderBy(F.col("c").desc()))
        now = seen.withColumn("rank", at_least).groupBy("graph", "v").agg(F.max(F.least("c", "rank")).cast("long").alias("now"))
        if touched is not None:
            touched.append(again.count())
        fell = stored(now.join(level, ["graph", "v"]).where("now < core").select("graph", "v", "now"))
        if not fell.limit(1).count():
            return level
        level = stored(level.join(fell, ["graph", "v"], "left").select("graph", "v", F.coalesce("now", "core").alias("core")))
        near = both.join(fell.select("graph", F.col("v").alias("u"), "now"), ["graph", "u"]).join(level, ["graph", "v"]).where("now < core")
        again = near.select("graph", "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(graph, v, component), the smallest vertex of each component; alternating large and small stars."""
    if dense.is_packed(edges):
        edges = dense.spanning(edges, dense.vertices(edges).withColumn("c", F.lit(0)))
    now = stored(edges.where("a <> b").select("graph", "a", "b"))
    while True:  # repeats do no harm
        ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))
        both = now.select("graph", F.explode(ends).alias("e")).select("graph", "e.v", "e.u")
        low = both.groupBy("graph", "v").agg(F.min("u").alias("m")).select("graph", "v", F.least("v", "m").alias("m"))
        large = cut(both.join(low, ["graph", "v"]).where("u > v").select("graph", F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b").distinct())
        least = large.groupBy("graph", "b").agg(F.min("a").alias("m"))
        small = large.join(least, ["graph", "b"]).select("graph", F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        now = cut(small.select("graph", "e.a", "e.b").where("a <> b").distinct())
        several = now.groupBy("graph", "b").count().where("count > 1").select("graph", "b")
        chained = now.select("graph", "a").join(now.select("graph", F.col("b").alias("a")), ["graph", "a"], "left_semi")
        if not several.union(chained).limit(1).count():
            break
    return now.select("graph", F.col("b").alias("v"), F.col("a").alias("component")).union(now.select("graph", F.col("a").alias("v"), F.col("a").alias("component")).distinct())


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(graph, module, a, b): edges with both ends in one module; members(graph, module, v).

    A vertex has one row with its modules, so an edge stays one row until both ends' modules have met, however many they are.
    """
    whole = members.where("module is not null").groupBy("graph", "v").agg(F.collect_list("module").alias("m"))
    a, b = (whole.select("graph", F.col("v").alias(k), F.col("m").alias(f"m{k}")) for k in "ab")
    met = edges.join(a, ["graph", "a"]).join(b, ["graph", "b"])
    # a vertex that is twice in a module counts twice
    once = (F.size(F.array_distinct("ma")) == F.size("ma")) & (F.size(F.array_distinct("mb")) == F.size("mb"))
    shared = F.when(once, F.array_intersect("ma", "mb")).otherwise(F.expr("flatten(transform(ma, x -> filter(mb, y -> y = x)))"))
    return met.select("graph", "a", "b", shared.alias("shared")).where(F.size("shared") > 0).select("graph", F.explode("shared").alias("module"), "a", "b")


def mcode(edges: DataFrame, score: float = 0.2, least_size: int = 3, least_density: float = 0.3) -> DataFrame:
    """(graph, module, v, weight): dense modules, numbered by falling largest weight and smallest name.

    A vertex weighs core level times density of its closed neighbourhood; modules are the components among the
    vertices of at least `score` times the largest weight.
    """
    packed = dense.is_packed(edges)
    edges = edges if packed else stored(edges.select("graph", "a", "b"))
    w = coreness(edges).join(local_density(edges), ["graph", "v"]).select("graph", "v", (F.col("core") * F.col("density")).alias("weight"))
    w = cut(w.withColumn("top", F.max("weight").over(Window.partitionBy("graph"))).where((F.col("weight") >= score * F.col("top")) & (F.col("top") > 0)).drop("top"))
    if packed:
        comp = cut(components(dense.spanning(edges, w.select("graph", "v", F.lit(0).alias("c")))))
        linked = dense.inside(edges, comp.select("graph", "v", F.col("component").alias("c")))
        e = linked.groupBy("graph", F.col("c").alias("component")).agg((F.sum("inside") / 2).alias("edges"))
    else:
        kept = edges.join(w.select("graph", F.col("v").alias("a")), ["graph", "a"], "left_semi").join(w.select("graph", F.col("v").alias("b")), ["graph", "b"], "left_semi").select("graph", "a", "b")
        comp = cut(components(kept))
        e = kept.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(comp.select("graph", F.col("v").alias("a"), "component"), ["graph", "a"]).groupBy("graph", "component").agg(F.count("*").alias("edges"))
    size = comp.groupBy("graph", "component").agg(F.count("*").alias("size"))
    good = size.join(e, ["graph", "component"]).where((F.col("size") >= least_size) & (F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2) >= least_density))
    members = comp.join(good, ["graph", "component"], "left_semi").join(w, ["graph", "v"])
    order = Window.partitionBy("graph").orderBy(F.round("top", 9).desc(), "component")
    ids = members.groupBy("graph", "component").agg(F.max("weight").alias("top")).select("graph", "component", (F.row_number().over(order) - 1).alias("module"))
    return members.join(ids, ["graph", "component"]).select("graph", "module", "v", "weight")


def membership(modules: DataFrame) -> DataFrame:
    """The largest module of each vertex, the lowest id on ties."""
    sized = modules.withColumn("size", F.count("*").over(Window.partitionBy("graph", "module")))
    first = F.row_number().over(Window.partitionBy("graph", "v").orderBy(F.col("size").desc(), "module"))
    return sized.withColumn("nth", first).where("nth = 1").select("graph", "v", "module")


def topology(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Size, density and components per graph; genes(graph, v) without edges are components of their own."""
    n = genes.groupBy("graph").agg(F.countDistinct("v").alias("n_nodes"))
    e = edges.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy("graph").agg(F.count("*").alias("n_edges"))
    c = components(edges).groupBy("graph", "component").agg(F.count("*").alias("size")).groupBy("graph").agg(F.count("*").alias("linked"), F.max("size").alias("giant"), F.sum("size").alias("touched"))
    out = n.join(e, "graph", "left").join(c, "graph", "left").fillna(0, ["n_edges", "linked", "giant", "touched"])
    alone = F.col("n_nodes") - F.col("touched")
    giant = F.greatest(F.col("giant"), F.when(F.col("n_nodes") > 0, 1).otherwise(0))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    return out.select("graph", "n_nodes", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(0.0).alias("density"), (F.col("linked") + alone).alias("n_components"), giant.alias("giant_size"), (giant / F.col("n_nodes")).alias("giant_fraction"), alone.alias("n_singletons"))


def neighbours(x: DataFrame, k: int = 15, block: int = 256) -> DataFrame:
    """Undirected k-nearest-neighbour edges by Euclidean distance; x(study, gene, other, value) are rows of a matrix.

    A pair of blocks gives the k nearest of each gene in the other block, and these are merged: never all pairs.
    """
    import numpy as np
    import pandas as pd

    from weftnet.operators.pairs import fold, grid, vectors

    def nearest(study, a, b):  # noqa: ANN001, ANN202
        """The k nearest in the other block of each gene of either block, ties by name."""
        x, y = vectors(a), vectors(b)
        d = np.round(np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)), 9)
        same = len(a) and len(b) and a["gene"].iloc[0] == b["gene"].iloc[0]
        if same:
            np.fill_diagonal(d, np.inf)
        out = []
        for rows, others, m in ((a, b, d),) if same else ((a, b, d), (b, a, d.T)):
            at = np.argsort(m, axis=1, kind="stable")[:, : min(k, m.shape[1])]
            near = np.take_along_axis(m, at, 1)
            i, j = np.nonzero(np.isfinite(near))
            out.append(pd.DataFrame({"study": study, "v": rows["gene"].to_numpy()[i], "u": others["gene"].to_numpy()[at[i, j]], "d": near[i, j]}))
        return pd.concat(out)

    cells, _ = grid(x.select("study", "gene", F.col("other").alias("run"), "value"), "value", block)
    found = fold(cells, nearest, "v string, u string, d double")
    near = found.withColumn("nth", F.row_number().over(Window.partitionBy("study", "v").orderBy("d", "u"))).where(F.col("nth") <= k)
    return near.select("study", F.least("v", "u").alias("gene_a"), F.greatest("v", "u").alias("gene_b")).distinct()


def top_by_degree(edges: DataFrame, most: int) -> DataFrame:
    """T5: the vertices of the largest degree, then in order of name."""
    nth = F.row_number().over(Window.partitionBy("graph").orderBy(F.col("degree").desc(), "v"))
    return degrees(edges).withColumn("nth", nth).where(F.col("nth") <= most).select("graph", "v", "degree").orderBy("graph", "v")
