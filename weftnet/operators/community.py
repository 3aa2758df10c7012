"""Communities by modularity: Louvain and Leiden per connected component, refinement of large modules.

Communities never span components, so each component is one group; its share of the whole graph's weight
comes along, so that gains are those of the whole graph. A component of at most `TASK_EDGES` edges is searched in
one task, as the method is sequential. A larger one is first made smaller by moves over tables: in each round
every community has one of two colours, and vertices only move from communities of the first to those of the
second, so no community gains and loses at once and neighbours in different communities never move together.
When moves no longer help, communities (for Leiden: their connected pieces) become vertices, until what is left
of the component fits a task or nothing moves any more.

Links are packed once for all rounds: a row has a block of vertices that share neighbours, with all their links as
arrays. A round sends it the communities of its vertices and neighbours, so no round makes a row for a link. A packed graph
(see `dense`) comes with such rows, its links as bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import cut, stored
from weftnet.operators import dense
from weftnet.operators.dense import blockwise, plain
from weftnet.operators.graph import blocks, components, induced, mcode


#: Edges of a component that one task searches; the least rise of modularity that makes a round worth it, and
#: how many rounds without one end the moves.
TASK_EDGES, RISE, PATIENCE = 500_000, 1e-4, 3
#: Sums of a vertex and a community that a block has in memory at once.
BLOCK_SUMS = 4_000_000


def _move(adj: list[dict[int, float]], k: list[float], two_m: float, resolution: float, label: list[int]) -> bool:
    """Local moves in fixed order until none gains."""
    total: dict[int, float] = {}
    for v, c in enumerate(label):
        total[c] = total.get(c, 0) + k[v]
    any_moved = moved = True
    first = True
    while moved:
        moved = False
        for v in range(len(adj)):
            c = label[v]
            total[c] -= k[v]
            to: dict[int, float] = {c: 0.0}
            for u, w in adj[v].items():
                if u != v:
                    to[label[u]] = to.get(label[u], 0) + w
            gain = lambda d: to[d] - resolution * k[v] * total[d] / two_m  # noqa: B023, E731
            best = max(sorted(to), key=lambda d: (round(gain(d), 12), d == c))
            label[v] = best
            total[best] = total.get(best, 0) + k[v]
            moved |= best != c
        any_moved = moved if first else any_moved
        first = False
    return any_moved


def _merged(adj: list[dict[int, float]], k: list[float], label: list[int]) -> tuple[list[dict[int, float]], list[float], list[int]]:
    names = {c: i for i, c in enumerate(dict.fromkeys(label))}
    new = [names[c] for c in label]
    out: list[dict[int, float]] = [{} for _ in names]
    weight = [0.0] * len(names)
    for v, row in enumerate(adj):
        weight[new[v]] += k[v]
        for u, w in row.items():
            out[new[v]][new[u]] = out[new[v]].get(new[u], 0) + w
    return out, weight, new


def _refined(adj: list[dict[int, float]], k: list[float], two_m: float, resolution: float, label: list[int]) -> list[int]:
    """Split communities into well-connected parts: lone vertices join a part of their community with the largest gain.

    Both must be well connected: at least `resolution * K (S - K) / 2m` of weight goes to the rest of the community,
    where K and S are the degrees of the vertex or part, and of the community.
    """
    whole: dict[int, float] = {}
    for v, c in enumerate(label):
        whole[c] = whole.get(c, 0) + k[v]
    out = [sum(w for u, w in row.items() if u != v and label[u] == label[v]) for v, row in enumerate(adj)]  # weight to the rest, by part
    own, part, total, alone = list(out), list(range(len(adj))), list(k), [True] * len(adj)
    bound = lambda degree, c: resolution * degree * (whole[c] - degree) / two_m - 1e-12
    for v, row in enumerate(adj):
        c = label[v]
        if not alone[v] or own[v] < bound(k[v], c):
            continue
        to: dict[int, float] = {}
        for u, w in row.items():
            if u != v and label[u] == c:
                to[part[u]] = to.get(part[u], 0) + w
        gains = {d: w - resolution * k[v] * total[d] / two_m for d, w in to.items() if d != v and out[d] >= bound(total[d], c)}
        best = max(sorted(gains), key=lambda d: round(gains[d], 12), default=None)  # noqa: B023
        if best is not None and gains[best] >= 0:
            part[v], alone[v], alone[best] = best, False, False
            total[best] += k[v]
            out[best] += own[v] - 2 * to[best]
    return part


def partition(edges: list[tuple[int, int, float]], n: int, two_m: float, resolution: float = 1.0, refine: bool = False) -> list[int]:
    """Community labels of vertices 0..n-1; `refine` splits communities before they are merged (Leiden)."""
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0) + w
        adj[b][a] = adj[b].get(a, 0) + w
    k = [sum(r.values()) for r in adj]
    where, label = list(range(n)), list(range(n))
    while True:  # every round but the last has fewer vertices
        before = list(label)
        _move(adj, k, two_m, resolution, label)
        fine = _refined(adj, k, two_m, resolution, label) if refine else label
        coarse: dict[int, int] = dict(zip(fine, label, strict=True))
        order = list(dict.fromkeys(fine))
        smaller = len(order) < len(adj)
        if not smaller and label == before:
            break
        adj, k, new = _merged(adj, k, fine)
        where = [new[x] for x in where]
        label = [coarse[c] for c in order]
        first: dict[int, int] = {}
        label = [first.setdefault(c, i) for i, c in enumerate(label)]
        if not smaller:
            break
    return [label[x] for x in where]


def _packed(both: DataFrame) -> DataFrame:
    """(graph, blk, names, at, to, w): a row for each block of vertices with its links names[at] - names[to], in order of `at`."""
    links = both.where("v <> u")
    rows = links.join(blocks(links), ["graph", "v"]).select("graph", "blk", "v", "u", "w")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names, where = np.unique(np.concatenate([part["v"].to_numpy(), part["u"].to_numpy()]), return_inverse=True)
        at, to = where[: len(part)], where[len(part) :]
        order = np.lexsort((to, at))
        return plain(pd.DataFrame({"graph": [key[0]], "blk": [key[1]], "names": [names], "at": [at[order].astype(np.int32)], "to": [to[order].astype(np.int32)], "w": [part["w"].to_numpy(float)[order]]}))

    kind = {c: both.schema[c].dataType.simpleString() for c in ("graph", "v")}
    return stored(rows.groupBy("graph", "blk").applyInPandas(pack, f"graph {kind['graph']}, blk long, names array<{kind['v']}>, at array<int>, to array<int>, w array<double>"))


def _pieces(block: dict[str, np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Some vertices of a block at a time, that have `width` sums each: their places, and of their links which of them, to where, weights (none: 1)."""
    if "bits" in block:
        n = len(block["names"])
        for some, m in dense.lines(block, max(1, BLOCK_SUMS // max(width, n)) * n):
            nth, to = np.nonzero(m)
            yield some, nth, to, None
        return
    at, to, w = block["at"], block["to"], block["w"]
    mine, step = np.unique(at), max(1, BLOCK_SUMS // width)
    for some in np.split(mine, range(step, len(mine), step)):
        lo, hi = np.searchsorted(at, some[0], "left"), np.searchsorted(at, some[-1], "right")
        yield some, np.searchsorted(some, at[lo:hi]), to[lo:hi], w[lo:hi]


def _best(block: dict[str, np.ndarray], resolution: float) -> pd.DataFrame:
    """Of each vertex of a block: the weight to its own community, and the best gain among others of the second colour, ties to the last name."""
    names, c = np.unique(block["c"], return_inverse=True)
    total, second = np.zeros(len(names)), np.zeros(len(names), bool)
    total[c], second[c] = block["total"], block["second"]
    parts = []
    for some, nth, to, w in _pieces(block, len(names)):
        key = nth * len(names) + c[to]
        size = len(some) * len(names)
        sums = np.bincount(key, w, size).reshape(len(some), -1)
        linked = (sums if w is None else np.bincount(key, minlength=size).reshape(sums.shape)) > 0
        gain = sums - resolution * block["k"][some][:, None] * total / block["two_m"][some][:, None]
        gain = np.where(linked & second & (np.arange(len(names)) != c[some][:, None]), np.round(gain, 12), -np.inf)
        best = len(names) - 1 - gain[:, ::-1].argmax(1)
        parts.append(pd.DataFrame({"v": block["names"][some], "inside": sums[np.arange(len(some)), c[some]], "gain": gain[np.arange(len(some)), best], "d": names[best]}))
    return pd.concat(parts) if parts else pd.DataFrame({"v": [], "inside": [], "gain": [], "d": []})


def _merged_links(block: dict[str, np.ndarray]) -> pd.DataFrame:
    """Weights between merged vertices."""
    names, x = np.unique(block["x"], return_inverse=True)
    if "bits" in block:
        order, parts = np.argsort(x[block["own"]], kind="stable"), []
        for some, nth, to, _ in _pieces(block | {"own": block["own"][order], "bits": block["bits"][order]}, len(names)):
            mine, line = np.unique(x[some], return_inverse=True)
            sums = np.bincount(line[nth] * len(names) + x[to], minlength=len(mine) * len(names))
            found = np.nonzero(sums)[0]
            parts.append(pd.DataFrame({"v": names[mine[found // len(names)]], "u": names[found % len(names)], "w": sums[found].astype(float)}))
        return pd.concat(parts) if parts else pd.DataFrame({"v": [], "u": [], "w": []})
    pairs, nth = np.unique(x[block["at"]].astype(np.int64) * len(names) + x[block["to"]], return_inverse=True)
    return pd.DataFrame({"v": names[pairs // len(names)], "u": names[pairs % len(names)], "w": np.bincount(nth, block["w"])})


def _joined(block: dict[str, np.ndarray]) -> pd.DataFrame:
    """Links that join what the block's links within communities join, at most one for each vertex."""
    if "bits" in block:
        return dense._spanning(block)
    _, c = np.unique(block["c"], return_inverse=True)
    inner = c[block["at"]] == c[block["to"]]
    a, b = block["at"][inner], block["to"][inner]
    root, before = np.arange(len(c)), None
    while before is None or (root != before).any():
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for ends in (root[a], root[b], a, b):  # the roots too, so long paths need few rounds
            np.minimum.at(root, ends, low)
        root = root[root]
    away = np.nonzero(root != np.arange(len(c)))[0]
    return pd.DataFrame({"a": block["names"][root[away]], "b": block["names"][away]})


def _moved(packed: DataFrame, nodes: DataFrame, resolution: float) -> DataFrame:
    """(graph, v, component, k, two_m, c): communities c of vertices after rounds of coloured moves from those in `nodes`."""
    best, best_q, idle, turn = nodes, float("-inf"), 0, 0
    now, kind = nodes, nodes.schema["v"].dataType.simpleString()
    while True:
        total = now.groupBy("graph", "c").agg(F.sum("k").alias("own"))
        own = now.join(total, ["graph", "c"])
        colour = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c).cast("string")), F.lit(2))  # noqa: B023, E731
        about = own.select("graph", "v", "c", F.col("own").alias("total"), (colour("c") == 1).alias("second"), "k", "two_m")
        seen = blockwise(packed, about, lambda block: _best(block, resolution), f"v {kind}, inside double, gain double, d {kind}")
        keys = ["graph", "v", "component", "k", "two_m", "c", "own"]
        pick = own.join(seen, ["graph", "v"], "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
        held = F.col("inside") - resolution * F.col("k") * (F.col("own") - F.col("k")) / F.col("two_m")
        goes = (colour("c") == 0) & F.col("d").isNotNull() & (F.col("gain") > F.round(held, 12) + 1e-12)
        pick = stored(pick.select(*keys, "inside", F.coalesce(goes, F.lit(False)).alias("goes"), "d"))
        # modularity before the moves, but for the weight inside vertices, which no move changes
        q, moves = pick.agg(F.sum((F.col("inside") - resolution * F.col("k") * F.col("own") / F.col("two_m")) / F.col("two_m")), F.count_if("goes")).first()
        if q is None:
            return nodes
        idle = 0 if q > best_q + RISE else idle + 1
        if q > best_q:
            best, best_q = now, q
        if idle >= PATIENCE or (not moves and idle):
            return best
        now = pick.select("graph", "v", "component", "k", "two_m", F.when(F.col("goes"), F.col("d")).otherwise(F.col("c")).alias("c"))
        turn += 1


def _both(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, component, two_m, v, u, w) of e(graph, component, a, b, w, two_m) from either end, and its vertices."""
    both = stored(e.select("graph", "component", "two_m", "w", F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("graph", "component", "two_m", "e.v", "e.u", "w"))
    return both, stored(both.groupBy("graph", "v", "component", "two_m").agg(F.sum("w").alias("k")).select("graph", "v", "component", "k", "two_m", F.col("v").alias("c")))


def _shrunk(both: DataFrame | None, packed: DataFrame | None, nodes: DataFrame, method: str, resolution: float, task_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components that are too large for a task, made smaller: their nodes(graph, v, component, k, two_m, c) and links, both ways or packed.

    Gives (graph, component, a, b, w, two_m) over merged vertices, for those that fit a task now; (graph, v, x): the merged
    vertex of each vertex; and (graph, v, seed): communities of merged vertices where nothing moves any more.
    """
    where = nodes.select("graph", "v", F.col("v").alias("x"))
    fits = done = None
    kind = nodes.schema["v"].dataType.simpleString()
    while True:
        packed = packed or _packed(both)
        moved = stored(_moved(packed, nodes, resolution))
        if method == "leiden":
            pieces = components(blockwise(packed, moved.select("graph", "v", "c"), _joined, f"a {kind}, b {kind}"))
            moved = stored(moved.drop("c").join(pieces.withColumnRenamed("component", "c"), ["graph", "v"], "left").withColumn("c", F.coalesce("c", "v")))
        # a name for each merged vertex: its smallest one
        least = moved.groupBy("graph", "c").agg(F.min("v").alias("x"))
        to = stored(moved.join(least, ["graph", "c"]).select("graph", "v", "x"))
        counts = nodes.groupBy("graph", "component").agg(F.count("*").alias("before")).join(moved.groupBy("graph", "component").agg(F.countDistinct("c").alias("after")), ["graph", "component"])
        where = stored(where.withColumnRenamed("x", "v0").join(to.withColumnRenamed("v", "v0"), ["graph", "v0"], "left").select("graph", "v", F.coalesce("x", "v0").alias("x")))
        inside = both and both.where("v = u").join(to, ["graph", "v"]).select("graph", F.col("x").alias("v"), F.col("x").alias("u"), "w")
        links = blockwise(packed, to, _merged_links, f"v {kind}, u {kind}, w double")
        links = (links.union(inside) if inside else links).groupBy("graph", "v", "u").agg(F.sum("w").alias("w"))
        both = stored(links.join(nodes.select("graph", "v", "component", "two_m"), ["graph", "v"]).select("graph", "component", "two_m", "v", "u", "w"))
        nodes = stored(both.groupBy("graph", "v", "component", "two_m").agg(F.sum("w").alias("k")).select("graph", "v", "component", "k", "two_m", F.col("v").alias("c")))
        size = both.groupBy("graph", "component").agg(F.count("*").alias("edges")).join(counts, ["graph", "component"])
        state = stored(size.select("graph", "component", (F.col("edges") <= 2 * task_edges).alias("fits"), (F.col("after") == F.col("before")).alias("still")))
        mine = lambda rows, which: rows.join(state.where(which).select("graph", "component"), ["graph", "component"], "left_semi")  # noqa: B023, E731
        small, stuck = mine(both, "fits"), mine(nodes, "still and not fits").select("graph", "v", F.col("v").alias("seed"))
        fits, done = (small, stuck) if fits is None else (fits.union(small), done.union(stuck))
        if not state.where("not fits and not still").limit(1).count():
            break
        both, nodes, packed = stored(mine(both, "not fits and not still")), stored(mine(nodes, "not fits and not still")), None
    # either direction of an edge is one row; weight inside a vertex counts twice in its degree, as for sequential merging
    fits = fits.where("v <= u").select("graph", "component", F.col("v").alias("a"), F.col("u").alias("b"), F.when(F.col("v") == F.col("u"), F.col("w") / 2).otherwise(F.col("w")).alias("w"), "two_m")
    return stored(fits), where, stored(done)


def communities(edges: DataFrame, method: str = "leiden", resolution: float = 1.0, least_size: int = 3, weight: str | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(graph, module, v), modules numbered by falling size, then smallest name."""
    where = done = None
    if dense.is_packed(edges):
        d = stored(dense.degrees(edges).select("graph", "v", F.col("degree").cast("double").alias("k")))
        nodes = d.join(components(edges), ["graph", "v"]).join(d.groupBy("graph").agg(F.sum("k").alias("two_m")), "graph")
        nodes = stored(nodes.select("graph", "v", "component", "k", "two_m", F.col("v").alias("c")))
        large = cut(nodes.groupBy("graph", "component").agg(F.sum("k").alias("k")).where(F.col("k") > 2 * task_edges).select("graph", "component"))
        small = nodes.join(large, ["graph", "component"], "left_anti")
        rows = dense.links(edges, small).join(small.select("graph", F.col("v").alias("a"), "component", "two_m"), ["graph", "a"]).select("graph", "component", "a", "b", F.lit(1.0).alias("w"), "two_m")
        if large.limit(1).count():
            fits, where, done = _shrunk(None, edges, stored(nodes.join(large, ["graph", "component"], "left_semi").select(*nodes.columns)), method, resolution, task_edges)
            rows = rows.union(fits)
    else:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        e = edges.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("w")).groupBy("graph", "a", "b").agg(F.max("w").alias("w"))
        e = stored(e)
        comp = components(e)
        total = e.groupBy("graph").agg((2 * F.sum("w")).alias("two_m"))
        rows = stored(e.join(comp.select("graph", F.col("v").alias("a"), "component"), ["graph", "a"]).join(total, "graph").select("graph", "component", "a", "b", "w", "two_m"))
        large = cut(rows.groupBy("graph", "component").count().where(F.col("count") > task_edges).select("graph", "component"))
        if large.limit(1).count():
            both, nodes = _both(rows.join(large, ["graph", "component"], "left_semi"))
            fits, where, done = _shrunk(both, None, nodes, method, resolution, task_edges)
            rows = rows.join(large, ["graph", "component"], "left_anti").union(fits)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["a", "b"])
        names = sorted(set(part["a"]) | set(part["b"]))
        at = {v: i for i, v in enumerate(names)}
        label = partition([(at[a], at[b], float(w)) for a, b, w in part[["a", "b", "w"]].itertuples(index=False)], len(names), float(part["two_m"].iloc[0]), resolution, method == "leiden")
        least: dict[int, str] = {}
        for v, c in zip(names, label, strict=True):
            least.setdefault(c, v)
        return pd.DataFrame({"graph": key[0], "v": names, "seed": [least[c] for c in label]})

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("graph", "a")}
    found = rows.groupBy("graph", "component").applyInPandas(run, f"graph {kind['graph']}, v {kind['a']}, seed {kind['a']}")
    if where is not None:
        found = cut(found.union(done))
        merged = where.join(found.withColumnRenamed("v", "x"), ["graph", "x"])
        whole = found.join(where.select("graph", F.col("x").alias("v")), ["graph", "v"], "left_anti")  # of components that fit a task at once
        found = cut(merged.select("graph", "v", "seed").union(whole.select("graph", "v", "seed")))
    size = found.groupBy("graph", "seed").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    ids = size.select("graph", "seed", (F.row_number().over(Window.partitionBy("graph").orderBy(F.col("size").desc(), "seed")) - 1).alias("module"))
    return found.join(ids, ["graph", "seed"]).select("graph", "module", "v")


def modularity(edges: DataFrame, modules: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity per graph; vertices without module are modules of their own."""
    if dense.is_packed(edges):
        named = dense.degrees(edges).join(modules.select("graph", "v", F.concat(F.lit("m"), F.col("module").cast("string")).alias("c")), ["graph", "v"], "left")
        seen = stored(dense.inside(edges, named.select("graph", "v", F.coalesce("c", F.concat(F.lit("v"), F.col("v").cast("string"))).alias("c"))))
        sums = seen.groupBy("graph", "c").agg(F.sum("k").alias("s"), F.sum("inside").alias("inside")).groupBy("graph").agg(F.sum("inside").alias("inside"), F.sum("s").alias("two_m"), F.sum(F.col("s") * F.col("s")).alias("sq"))
        return sums.select("graph", (F.col("inside") / F.col("two_m") - resolution * F.col("sq") / F.col("two_m") / F.col("two_m")).alias("modularity"))
    e = edges.where("a <> b").select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    d = e.select("graph", F.explode(F.array("a", "b")).alias("v")).groupBy("graph", "v").agg(F.count("*").alias("k"))
    named = d.join(modules.select("graph", "v", F.concat(F.lit("m"), F.col("module").cast("string")).alias("m")), ["graph", "v"], "left").withColumn("m", F.coalesce("m", F.concat(F.lit("v"), F.col("v").cast("string"))))
    inside = e.join(named.select("graph", F.col("v").alias("a"), F.col("m").alias("ma")), ["graph", "a"]).join(named.select("graph", F.col("v").alias("b"), F.col("m").alias("mb")), ["graph", "b"]).groupBy("graph").agg(F.count_if(F.col("ma") == F.col("mb")).alias("inside"), F.count("*").alias("m"))
    sums = named.groupBy("graph", "m").agg(F.sum("k").alias("s")).groupBy("graph").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    return inside.join(sums, "graph").select("graph", (F.col("inside") / F.col("m") - resolution * F.col("sq") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def refine_modules(modules: DataFrame, edges: DataFrame, larger_than: int, method: str = "mcode", **options: object) -> tuple[DataFrame, DataFrame]:
    """Split modules above a size on their induced graphs; (modules renumbered, parent-child table).

    A module that yields no submodules stays. New ids follow parent ids, then submodule ids. The table has a row
    for every new module: parent_module, child_module, parent_size, child_size, refined, and name, which is
    `M<parent>.<nth>` for submodules and `M<parent>` for modules that stay.
    """
    sized = modules.withColumn("size", F.count("*").over(Window.partitionBy("graph", "module")))
    large = sized.where(F.col("size") > larger_than).select("graph", "module", "v")
    packed = dense.is_packed(edges)
    sub_edges = (dense.induced if packed else induced)(edges, large)
    sub_edges = sub_edges.select(F.to_json(F.struct("graph", "module")).alias("graph"), *(c for c in sub_edges.columns if c not in ("graph", "module")))
    if packed:
        sub_edges = stored(sub_edges)
    found = (mcode(sub_edges, **options) if method == "mcode" else communities(sub_edges, method, **options)).select(F.from_json("graph", f"graph {edges.schema['graph'].dataType.simpleString()}, module int").alias("g"), F.col("module").alias("child"), "v")
    found = cut(found.select("g.graph", F.col("g.module").alias("parent"), "child", "v"))
    split = found.select("graph", F.col("parent").alias("module")).distinct()
    rest = modules.join(split, ["graph", "module"], "left_anti").select("graph", F.col("module").alias("parent"), F.lit(-1).alias("child"), "v")
    both = found.union(rest)
    ids = both.groupBy("graph", "parent", "child").agg(F.count("*").alias("child_size")).withColumn("module", F.row_number().over(Window.partitionBy("graph").orderBy("parent", "child")) - 1)
    out = both.join(ids, ["graph", "parent", "child"])
    before = modules.groupBy("graph", F.col("module").alias("parent")).agg(F.count("*").alias("parent_size"))
    nth = F.row_number().over(Window.partitionBy("graph", "parent").orderBy("child"))
    name = F.when(F.col("child") >= 0, F.concat(F.lit("M"), F.col("parent").cast("string"), F.lit("."), nth.cast("string"))).otherwise(F.concat(F.lit("M"), F.col("parent").cast("string")))
    table = ids.join(before, ["graph", "parent"]).select("graph", F.col("parent").alias("parent_module"), F.col("module").alias("child_module"), "parent_size", "child_size", (F.col("child") >= 0).alias("refined"), name.alias("name"))
    return out.select("graph", "module", "v"), table
