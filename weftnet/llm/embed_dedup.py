"""Embedding near-duplicates by sorted projection passes.

A pass gives every vector the signs of random projections as one long hash, sorts all vectors by label and
hash, and compares each with a bounded number of neighbours in that order, across partition borders too.
Pairs at or above the threshold (cosine in double precision) are united within and across passes. The number
of passes follows from the wanted recall and the size of the largest label, so it grows with the data
(about n ** 0.18 at a cosine of 0.93). Equal vectors of a label are one weighted vector from the start.

Where vectors cluster, more of them share the leading bits than a window holds. Such ranges are compared whole,
in blocks, so a pair that shares the leading bits in some pass is found however the vectors lie, and the recall
doesn't depend on an even spread. A label whose ranges would take more comparisons than all its pairs is
compared whole once instead. Both are quadratic in a cluster.

Links are then counted exactly inside every component: a component whose vectors all lie within half the
threshold's angle of their mean links completely and is counted without comparing; every other component is
compared in blocks. Only vectors of one component can link, up to pairs that all passes missed.

Vectors link only if their labels are equal and not null and they have equal lengths. Vectors that are null,
empty, zero, or hold nulls or non-finite values, and rows with a null vec_id, link with nothing: no links, and
their own id as component. Repeated rows are copies that link with one another. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, components, persist, runs, united

THRESHOLD = 0.93
WINDOW = 32
RECALL = 0.9995
BLOCK = 256
RANGE_BLOCK = 2048
SEED = 5
HASH_BITS = 64


def _fields(*names: str) -> list[T.StructField]:
    kinds = {"l": T.LongType(), "b": T.BinaryType(), "i": T.IntegerType(), "d": T.DoubleType(), "n": T.BooleanType()}
    return [T.StructField(n[2:], kinds[n[0]]) for n in names]


ROW = T.StructType(_fields("l vec_id", "l label", "b vec"))
SORTED = T.StructType(_fields("i pass", "l label", "b hash", "l cid", "b vec"))
RANGE = T.StructType(_fields("i pass", "l label", "b prefix", "l cid"))
FOUND = T.StructType(_fields("l a", "l b", "l border", "i side", "i place", "i pass", "l label", "b vec"))


def prefix_bits(largest: int, window: int = WINDOW) -> int:
    """Leading hash bits that leave at most about a window of evenly spread vectors."""
    return min(HASH_BITS, max(1, math.ceil(math.log2(max(2, largest) / window))))


def passes_for(largest: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has met with the wanted probability.

    A pair meets in a pass if the leading bits are equal on both sides.
    """
    same = 1 - math.acos(threshold) / math.pi
    meet = same ** prefix_bits(largest, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def tidy(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): vec is the vector's doubles, null where it can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
            for k, x in enumerate(batch.column("embedding")):
                v = None
                if ids[k] is not None and labels[k] is not None and x.is_valid and len(x) and not x.values.null_count:
                    y = np.asarray(x.values, np.float64)
                    y = y / (np.abs(y).max() or 1) if np.isfinite(y).all() else y
                    n = float(np.sqrt(y @ y))
                    v = (y / n).tobytes() if np.isfinite(n) and n > 0 else None
                out.append(v)
            yield {"vec_id": batch.column("vec_id"), "label": labels, "vec": pa.array(out, pa.binary())}

    cols = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return persist(arrow_map(cols, run, ROW))


def _hashed(classes: DataFrame, passes: int, bits: int | None = None) -> DataFrame:
    """A row for each vector and pass: with the whole hash and the vector, or with the leading bits alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vecs):
                by_size.setdefault(len(v), []).append(k)
            for size, mine in by_size.items():
                x = np.frombuffer(b"".join(vecs[k] for k in mine)).reshape(len(mine), -1)
                part = batch.take(pa.array(mine))
                for p in range(passes):
                    if (p, size) not in planes:
                        planes[p, size] = np.random.default_rng((SEED, p, size)).normal(size=(size // 8, HASH_BITS))
                    signs = np.packbits((x @ planes[p, size] > 0)[:, :bits], axis=1)
                    # vectors of another length sort apart: their length leads the hash
                    hashes = [size.to_bytes(4, "big") + b.tobytes() for b in signs]
                    yield {"pass": np.full(len(mine), p), "label": part.column("label"), "hash": hashes, "prefix": hashes, "cid": part.column("cid"), "vec": part.column("vec")}

    return arrow_map(classes, run, SORTED if bits is None else RANGE)


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _neighbours(passes: np.ndarray, labels: np.ndarray, ids: np.ndarray, vecs: list[bytes], threshold: float, window: int, split: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the linked pairs among rows at most `window` apart in order.

    With `split`, only pairs with one row on each side of it.
    """
    sizes = np.array(list(map(len, vecs)))
    x = np.zeros((len(vecs), max(sizes) // 8))
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        x[mine, : size // 8] = np.frombuffer(b"".join(vecs[k] for k in mine)).reshape(len(mine), -1)
    union = _Union()
    for d in range(1, min(window, len(ids) - 1) + 1):
        ok = (passes[d:] == passes[:-d]) & (labels[d:] == labels[:-d]) & (sizes[d:] == sizes[:-d]) & (np.einsum("ij,ij->i", x[d:], x[:-d]) >= threshold)
        for k in np.flatnonzero(ok).tolist():
            if (split is None or k < split <= k + d) and union.join(int(ids[k]), int(ids[k + d])):
                yield int(ids[k]), int(ids[k + d])


def link(classes: DataFrame, passes: int, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(a, b) edges that unite all linked pairs that meet in some pass; `classes` has cid, label, vec."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def border(t: pa.Table, side: int, place: int) -> dict:
            n = t.num_rows
            return {"a": t["cid"].combine_chunks(), "b": [None] * n, "border": np.full(n, pid - 1 + side), "side": np.full(n, side), "place": np.arange(place, place + n), "pass": t["pass"].combine_chunks(), "label": t["label"].combine_chunks(), "vec": t["vec"].combine_chunks()}

        first = True
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [*([tail] if tail is not None else []), pa.Table.from_batches([batch])]
            t = pa.concat_tables(held)
            if first:
                yield border(t.slice(0, window), 0, 0)
                first = False
            pairs = list(_neighbours(*(np.asarray(t[c]) for c in ("pass", "label", "cid")), t["vec"].to_pylist(), threshold, window))
            if pairs:
                a, b = np.array(pairs, np.int64).T
                none = [None] * len(a)
                yield {"a": a, "b": b} | dict.fromkeys(("border", "side", "place", "pass", "label", "vec"), none)
            tail = t.slice(max(0, t.num_rows - window))
        if tail is not None:
            yield border(tail, 1, 0)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("border",)):
            split = int(np.count_nonzero(np.asarray(t["side"]) == 1))
            pairs = list(_neighbours(*(np.asarray(t[c]) for c in ("pass", "label", "a")), t["vec"].to_pylist(), threshold, window, split))
            if pairs:
                a, b = np.array(pairs, np.int64).T
                yield {"a": a, "b": b}

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "hash", "cid"]
    found = persist(arrow_map(_hashed(classes, passes).repartitionByRange(n, *order).sortWithinPartitions(*order), within, FOUND))
    pairs = found.where("b is not null").select("a", "b")
    borders = found.where("b is null").drop("b").repartition(n, "border").sortWithinPartitions(F.col("border"), F.col("side").desc(), "place")
    return pairs.union(arrow_map(borders, across, T.StructType(_fields("l a", "l b"))))


def _united(x: np.ndarray, y: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that unite the linked pairs of a row of x and a row of y; ids of x's rows, then of y's."""
    return united(np.vstack([x[k : k + 512] @ y.T >= threshold for k in range(0, len(x), 512)]), ids)


def link_dense(classes: DataFrame, passes: int, bits: int, threshold: float = THRESHOLD, window: int = WINDOW, block: int = RANGE_BLOCK) -> DataFrame:
    """(a, b) edges that unite all linked pairs in ranges of equal leading bits that no window holds."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["pass", "label", "prefix"]
    hashed = persist(_hashed(classes, passes, bits))
    dense = persist(hashed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > window + 1))
    size = F.col("prefix").substr(1, 4).alias("size")
    pairs = F.sum(F.col("n").cast("double") * F.col("n"))
    total = hashed.where("pass = 0").groupBy("label", size).agg(F.count("*").alias("all"))
    whole = persist(dense.groupBy("label", size).agg(pairs.alias("pairs")).join(total, ["label", "size"]).where(F.col("pairs") >= F.col("all").cast("double") * F.col("all")).select("label", "size", "all"))
    some = hashed.join(dense, keys).withColumn("size", size).join(whole.drop("all"), ["label", "size"], "left_anti").select(*keys, "cid", "n")
    every = hashed.where("pass = 0").withColumn("size", size).join(whole, ["label", "size"]).select("pass", "label", F.col("size").alias("prefix"), "cid", F.col("all").alias("n"))
    dealt = some.union(every).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("label", "cid", "vec"), ["label", "cid"]).where(F.length("vec") == F.conv(F.hex(F.col("prefix").substr(1, 4)), 16, 10).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*keys, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cid", "vec")
    order = [*keys, "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, tuple(order)):
            x = np.frombuffer(b"".join(t["vec"].to_pylist())).reshape(t.num_rows, -1)
            cid, mine = np.asarray(t["cid"]), np.asarray(t["mine"])
            one, two = mine == t["lo"][0].as_py(), mine == t["hi"][0].as_py()
            a, b = _united(x[one], x[two], np.concatenate([cid[one], cid[two]]), threshold)
            yield {"a": a, "b": b}

    return arrow_map(dealt.repartition(n, *order).sortWithinPartitions(*order), compare, T.StructType(_fields("l a", "l b")))


COUNT = T.StructType(_fields("l cid", "l links"))


def count_links(members: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(cid, links) within components; `members` is a written table of component, cid, weight, vec."""
    sizes = persist(members.groupBy("component").agg(F.count("*").alias("n"), F.sum("weight").alias("total")))
    small = sizes.where(f"n <= {block}").select("component", F.lit(1).alias("blocks"))

    # large components: the mean, and whether all lie within half the angle of it
    large = members.join(sizes.where(f"n > {block}").select("component", "total"), "component")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            comp = np.asarray(batch.column("component"))
            vecs = [np.frombuffer(v) for v in batch.column("vec").to_pylist()]
            for c in np.unique(comp):
                total = np.sum([vecs[k] for k in np.flatnonzero(comp == c)], axis=0)
                yield {"component": np.full(len(total), c), "place": np.arange(len(total)), "x": total}

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            cos = []
            for v, m in zip(batch.column("vec").to_pylist(), batch.column("mean").to_pylist(), strict=True):
                m = np.asarray(m)
                cos.append(float(np.frombuffer(v) @ m / (np.sqrt(m @ m) or 1)))
            yield {"component": batch.column("component"), "cos": cos}

    big = persist(large)
    sums = arrow_map(big.select("component", "vec"), unpack, T.StructType(_fields("l component", "i place", "d x"))).groupBy("component", "place").agg(F.sum("x").alias("x"))
    means = persist(sums.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("m")).select("component", F.col("m.x").alias("mean")))
    cosines = arrow_map(big.select("component", "vec").join(means, "component"), angle, T.StructType(_fields("l component", "d cos")))
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    tight = persist(cosines.groupBy("component").agg((F.min("cos") >= half).alias("tight")))
    certain = big.join(tight.where("tight").select("component"), "component").select("cid", (F.col("total") - 1).alias("links"))

    loose = sizes.join(tight.where("not tight").select("component"), "component").select("component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    todo = persist(small.union(loose))
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = members.join(todo, "component").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cid", "weight", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("component", "lo", "hi")):
            x = np.frombuffer(b"".join(t["vec"].to_pylist())).reshape(t.num_rows, -1)
            weight, cid, side = (np.asarray(t[c]) for c in ("weight", "cid", "mine"))
            lo, hi = int(t["lo"][0].as_py()), int(t["hi"][0].as_py())
            ok = x @ x.T >= threshold
            np.fill_diagonal(ok, False)
            if lo != hi:
                ok &= side[:, None] != side
                own = 0
            else:
                own = weight - 1
            yield {"cid": cid, "links": ok @ weight + own}

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["component", "lo", "hi"]
    counted = arrow_map(dealt.repartition(n, *keys).sortWithinPartitions(*keys), compare, COUNT).groupBy("cid").agg(F.sum("links").alias("links"))
    return counted.union(certain)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding, label)."""
    rows = tidy(vectors)
    rows_key = F.xxhash64("label", "vec"), F.md5(F.col("vec"))
    classes = persist(rows.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("cid"), F.count("*").alias("weight")))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, threshold, recall, window)
    edges = link(classes, passes, threshold, window).union(link_dense(classes, passes, prefix_bits(largest, window), threshold, window))
    joined = components(edges)
    members = persist(classes.join(joined.withColumnRenamed("node", "cid"), "cid").select("component", "cid", "weight", "vec"))
    links = count_links(members, threshold)
    known = classes.select("cid", "weight", rows_key[0].alias("k1"), rows_key[1].alias("k2"))
    known = known.join(members.select("cid", "component"), "cid", "left").join(links, "cid", "left")
    known = persist(known.select("k1", "k2", F.coalesce("component", "cid").alias("component_id"), F.coalesce(F.col("links"), F.col("weight") - 1).alias("n_links")))
    out = rows.select("vec_id", rows_key[0].alias("k1"), rows_key[1].alias("k2"), F.col("vec").isNotNull().alias("valid"))
    out = out.join(known, ["k1", "k2"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
