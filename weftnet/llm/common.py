"""Shared pieces of the corpus operators: scratch tables, batched Arrow maps and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows with whole texts in an Arrow batch; bytes of a row group of scratch tables.
BATCH_ROWS, ROW_GROUP = 1000, 16 << 20

#: Seconds after which an idle Python worker gives up what it keeps between tasks.
IDLE_SECONDS = 3

_STATE: dict = {}
_LOCK = threading.Lock()
_TASK = {"turn": 0, "map": ""}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks of one map: one state at a time, dropped when the worker is idle.

    `key` must name the content (a path, a uuid made on the driver), not a memory address.
    """
    if key not in _STATE:
        _STATE.clear()
        release()
        _STATE[key] = make()
    return _STATE[key]


def _begin(name: str) -> None:
    """A task of the named map begins: what other maps left behind goes."""
    with _LOCK:
        _TASK["turn"] += 1
        if _TASK["map"] != name:
            _STATE.clear()
            release()
        _TASK["map"] = name


def _end() -> None:
    """A task ends: freed memory goes back at once, and the state with it if no task follows soon."""
    release()
    turn = _TASK["turn"]

    def forget() -> None:
        time.sleep(IDLE_SECONDS)
        with _LOCK:
            if _TASK["turn"] == turn:
                _STATE.clear()
        release()

    if _STATE:
        threading.Thread(target=forget, daemon=True).start()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is made only where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="weftnet-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def persist(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage with a written table in the shared folder; the result survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/weftnet-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns; empty outputs are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out, name = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(name)
        yield from records(batches)
        _end()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=f.type, from_pandas=True) for x, f in ((cols[f.name], f) for f in out)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into slices of a bounded number of text bytes; the binary column `text` comes as bytes, null as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        sizes = np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(col), 0)), nan=0).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            start = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, start + most_bytes, side="right")))
            part = batch.slice(lo, hi - lo)
            yield part, [x or b"" for x in col.slice(lo, hi - lo).to_pylist()]
            lo = hi


def as_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the whole text as UTF-8 bytes.

    Whole texts come in small Arrow batches from here on, so that workers hold a few MB at a time.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(*keep, F.col("text").cast("binary").alias("text"))


def private(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table lacks, by Spark's rule that case doesn't count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def united(ok: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that unite the linked pairs of a matrix; ids of its rows, then of its columns."""
    rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
    size = len(ok)
    ok = ok[np.ix_(rows, cols)]
    ids = ids[np.concatenate([rows, size + cols])]
    top, left = np.arange(len(rows), dtype=np.int32), np.arange(len(rows), len(ids), dtype=np.int32)
    none, moved = np.int32(len(ids)), bool(len(rows))
    while moved:
        low = np.min([np.where(ok[k : k + 512], top[k : k + 512, None], none).min(0) for k in range(0, len(top), 512)], axis=0)
        low = np.minimum(left, low)
        high = np.minimum(top, np.concatenate([np.where(ok[k : k + 512], low, none).min(1) for k in range(0, len(top), 512)]))
        moved = bool((low < left).any() or (high < top).any())
        top, left = high, low
    roots = np.concatenate([top, left])
    use = ids != ids[roots]
    return ids[use], ids[roots][use]


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A spanning forest, as (root, node), of each bounded chunk of edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def flush() -> dict:
        nodes = [x for x in parent if find(x) != x]
        return {"a": np.array([parent[x] for x in nodes], np.int64), "b": np.array(nodes, np.int64)}

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                parent.setdefault(a, a)
        if len(parent) > 500_000:
            yield flush()
            parent.clear()
    yield flush()


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Edges of which one task makes the last forest, instead of rounds of shuffles.
ONE_TASK = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component = smallest node.

    Partition-local forests shrink the edges, then alternating large-star and small-star rounds
    join every node to its smallest neighbour until nothing moves. All state is distributed; each
    round is a written table. Once no more than `ONE_TASK` edges are left, one task unites them.
    Nulls and self-loops are ignored; nodes without edges are absent.
    """
    tidy = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = persist(arrow_map(tidy, _forest, EDGE).distinct())
    while True:
        if now.limit(ONE_TASK + 1).count() <= ONE_TASK:
            now = persist(arrow_map(now.coalesce(1), _forest, EDGE))
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = persist(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # large star: neighbours above a node move to the smallest node around it
        large = both.join(low.hint("merge"), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = persist(arrow_map(large, _forest, EDGE).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = persist(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least.hint("merge"), "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = persist(small)
        several = after.groupBy("b").count().where("count > 1").limit(1).count()
        roots = after.select("a").distinct().join(after.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() if not several else 1
        discard(low, large, least, now)
        now = after
        if not several and not roots:  # every node has one parent that is no child: stars
            break
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The tables of equal integer keys in rows that come sorted by them; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or tuple(c[0] for c in cols) != last
        starts = np.flatnonzero(change).tolist()
        if starts and starts[0] == 0 and held:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *[s for s in starts if s], batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
