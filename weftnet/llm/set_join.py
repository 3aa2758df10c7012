"""N-gram Jaccard join with set-relation skipping.

Equal sets are one class. Classes link when 100 * |A and B| >= 75 * |A or B|; the join finds the connected
components of all links and loses none of them:

1. Similar sets first: classes that share one of a few min-hashes are sorted by it and by size; of close
   neighbours the two that look most alike by their lowest hashes are verified. The components found so far
   are the answers that later steps need not derive again.
2. Frequent shingles: two fixed predicates over shingles, `common` and `frequent`, are filters over what a
   sample of the classes holds several times. They choose an order (common ones late) and what is not indexed
   (frequent ones). Any predicate gives the same links, so sampling costs no result; it bounds the lists.
3. Index: linked sets either have a shingle in common that is not frequent, or their frequent shingles alone
   reach the threshold. For the former, the others in the global order give a prefix that any linked set's
   prefix must share; prefix postings are dealt by hash as packed blocks. A list is skipped as a whole if its
   sets are one component by now. In what is left, blocks of postings sorted by size and position are skipped
   when their sizes or positions rule a link out, and only pairs from different components become candidates.
   A pair needs as many common prefix shingles as its sets' remaining shingles leave open.
4. Cores: only sets of which frequent shingles are 75 % or more can link by these alone (texts that are mostly
   one common passage). Sets of one size with equal cores have the same answers, so one stands for all. These
   few are compared by families that share core prefixes, in blocks that yield a spanning forest of the links.
5. Candidates are verified on their sets. Of candidates (S, T0), (S, T1), ... with T0 and T1 of one component
   the overlap with T1 is derived from that with T0 by the shingles in which T0 and T1 differ.

Null and empty texts, and those of white space only, have the empty set and link with nothing. A row with a
null doc_id takes part only through rows of equal sets. Repeated rows are copies. Extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, components, discard, persist, private, runs, text_slices, united
from weftnet.llm.shingles import Hasher, mix, set_key

#: Percent of the union that the intersection must reach.
PERCENT = 75
CHUNKS = 16
#: Neighbours looked at, min-hashes, and lowest hashes kept of a set.
NEAR, BANDS, LOWEST = 8, 8, 48
FILTER_BITS = 1 << 24
#: One class in SAMPLE is looked at for shingles that COMMON or FREQUENT classes of the sample hold.
SAMPLE, COMMON, FREQUENT = 4, 2, 10
#: Postings in a block of a list.
BLOCK = 64
#: Candidates of one set that are verified by one copy of it.
PER_TASK = 64
#: One shingle in so many is indexed beyond the least prefix.
EXTRA = 16
#: Postings that a bucket of the index holds if there are partitions enough, and pairs that it tallies at once.
BUCKET_POSTINGS, TALLY = 1_500_000, 2_000_000
#: Sets in a block of a family: the fewest, the most, and the blocks of a family from which on they grow.
CORE_BLOCK, MOST_BLOCK, BLOCKS = 256, 4096, 64
#: Shingles in a slice of a block's matrix.
CORE_SLICE = 2048
#: Text bytes that are hashed at once.
SLICE_BYTES = 1 << 20


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


def prefix_size(n: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles that are indexed, of a set of size n of which so many are frequent and not indexed.

    A linked set has at least `75 % of n - frequent` of the others in common, or else one, if the frequent ones
    alone don't reach the threshold. A few shingles more tell near pairs from linked ones.
    """
    rest = n - frequent
    least = np.maximum(1, -(-PERCENT * n // 100) - frequent)
    return np.minimum(rest, rest - least + 1 + n // EXTRA)


def linked(overlap: int, a: int, b: int) -> bool:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


# ---------------------------------------------------------------- fixed-size summaries of a column
def _merged(rows: DataFrame) -> list:
    """Merge (chunk, part, data) rows of bits on the executors; the driver gets CHUNKS rows of a fixed size."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint8)
                total[chunk] = total[chunk] | x if chunk in total else x
        for chunk, x in total.items():
            yield {"chunk": [chunk], "data": [x.tobytes()]}

    # two levels, so that no task merges what all partitions sent
    salted = rows.repartition(CHUNKS * 4, "chunk", F.pmod(F.col("part"), F.lit(8)))
    schema = _schema("chunk:int data:binary")
    merged = arrow_map(arrow_map(salted, merge, schema).repartition(CHUNKS, "chunk"), merge, schema)
    return sorted((r["chunk"], bytes(r["data"])) for r in merged.collect())


def _bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(keys.astype(np.int64).view(np.uint64))
    return (x % np.uint64(FILTER_BITS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def member_filter(keys: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: np.asarray(batch.column(0))) -> np.ndarray:
    """A Bloom filter of fixed size over the keys that `of` gives: false hits cost shuffle, never a result."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _bits_of(of(batch)):
                bits[at] = True
        packed = np.packbits(bits).reshape(CHUNKS, -1)
        some = [k for k in range(CHUNKS) if packed[k].any()]
        yield {"chunk": some, "part": [TaskContext.get().partitionId()] * len(some), "data": [packed[k].tobytes() for k in some]}

    out = np.zeros((CHUNKS, FILTER_BITS // CHUNKS // 8), np.uint8)
    for k, data in _merged(arrow_map(keys, partial, _schema("chunk:int part:int data:binary"))):
        out[k] = np.frombuffer(data, np.uint8)
    return out.ravel()


def maybe_in(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in _bits_of(keys):
        ok &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def parted(docs: DataFrame, packed: np.ndarray, of: Callable[[pa.RecordBatch], np.ndarray], key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key, by `of`, is surely not in a filter, and the others, which need a join to tell.

    With `key`, the others get a column of that name with their keys.
    """
    packed = docs.sparkSession.sparkContext.broadcast(packed)
    fields = {f.name: f for f in docs.schema}

    def side(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                keys = of(batch)
                ok = maybe_in(packed.value, keys) == inside
                yield {c: batch.column(c).filter(pa.array(ok)) for c in batch.schema.names} | ({key: keys[ok]} if key else {})

        extra = [T.StructField(key, T.LongType())] if inside and key else []
        schema = T.StructType([fields[c] if c != "text" else T.StructField("text", T.BinaryType()) for c in docs.columns] + extra)
        rows = arrow_map(as_bytes(docs, *(c for c in docs.columns if c != "text")).select(*docs.columns), run, schema)
        return rows.withColumn("text", F.col("text").cast("string")) if "text" in fields else rows

    return side(False), side(True)


# ---------------------------------------------------------------- sets of documents
PROFILE = _schema("doc_id:long n:int k:long lows:binary some:binary")
_TURNS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(BANDS)]


def profiles(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document its set's size, name and min-hashes; `some` has the set of a sampled class, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher, given = Hasher(), set()
        for batch, texts in text_slices(batches, SLICE_BYTES):
            sets = hasher.sets(texts)
            flat = mix(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            sizes = np.array(list(map(len, sets)))
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            lows: list[bytes | None] = [None] * len(sets)
            kept: list[bytes | None] = [None] * len(sets)
            names = [set_key(x) if len(x) else None for x in sets]
            given = given if len(given) < 100_000 else set()
            if len(some):
                bands = np.stack([np.minimum.reduceat(mix(flat ^ turn), starts) for turn in _TURNS], 1)
                for i, a, row in zip(some.tolist(), starts.tolist(), bands, strict=True):
                    x = flat[a : a + sizes[i]]
                    lows[i] = row.tobytes() + np.sort(np.partition(x, LOWEST - 1)[:LOWEST] if len(x) > LOWEST else x).tobytes()
                    if names[i] % sample == 0 and names[i] not in given:
                        given.add(names[i])
                        kept[i] = _short(sets[i]).tobytes()
            yield {"doc_id": batch.column("doc_id"), "n": sizes, "k": names, "lows": lows, "some": kept}

    return persist(arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), run, PROFILE))


def _short(s: np.ndarray) -> np.ndarray:
    """32 bits of each shingle, which the predicates go by."""
    return (mix(s) >> np.uint64(32)).astype(np.uint32)


def frequent_shingles(sampled: DataFrame, common: int = COMMON, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Filters over the shingles that so many classes of sampled(k, some) hold."""
    buckets = int(sampled.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint32) for x in batch.column("some").to_pylist()]
            flat = np.concatenate(sets)
            owner = np.repeat(np.asarray(batch.column("k")), list(map(len, sets)))
            to = flat % np.uint32(buckets)
            order = np.argsort(to, kind="stable")
            ends = np.cumsum(np.bincount(to, minlength=buckets)).tolist()
            parts = [(bucket, order[lo:hi]) for bucket, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) if hi > lo]
            yield {"bucket": [x for x, _ in parts], "owners": [owner[x].tobytes() for _, x in parts], "data": [flat[x].tobytes() for _, x in parts]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("bucket",)):
            held = np.zeros(sum(map(len, t["data"].to_pylist())) // 4, [("h", "<u4"), ("k", "<i8")])
            held["h"] = np.frombuffer(b"".join(t["data"].to_pylist()), np.uint32)
            held["k"] = np.frombuffer(b"".join(t["owners"].to_pylist()), np.int64)
            held = held[np.lexsort((held["k"], held["h"]))]
            once = np.ones(len(held), bool)  # classes that several tasks have given count once
            once[1:] = held[1:] != held[:-1]
            h, n = np.unique(held["h"][once], return_counts=True)
            yield {"h": h[n >= common].astype(np.int64), "n": n[n >= common]}

    dealt = arrow_map(sampled, deal, _schema("bucket:int owners:binary data:binary"))
    counts = persist(arrow_map(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket"), count, _schema("h:long n:int")))
    found = member_filter(counts.select("h")), member_filter(counts.where(F.col("n") >= frequent).select("h"))
    discard(counts)
    return found


def chosen_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, s): the sets of the wanted (k, doc_id), read from their documents."""
    spark = docs.sparkSession
    key = lambda k, d: k ^ (d * np.int64(0x1E3779B97F4A7C15))
    packed = spark.sparkContext.broadcast(member_filter(wanted.select("k", "doc_id"), lambda b: key(np.asarray(b.column(0)), np.asarray(b.column(1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = Hasher()
        for batch, texts in text_slices(batches, SLICE_BYTES):
            sets = hasher.sets(texts)
            names = np.array([set_key(x) for x in sets], np.int64)
            ids = batch.column("doc_id")
            ok = maybe_in(packed.value, key(names, np.asarray(ids.fill_null(0)))) & np.asarray(ids.is_valid()) & np.array([len(x) > 0 for x in sets])
            mine = np.flatnonzero(ok)
            yield {"k": names[mine], "doc_id": ids.take(pa.array(mine)), "s": [sets[i].tobytes() for i in mine]}

    found = arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), run, _schema("k:long doc_id:long s:binary"))
    named = wanted.select("k", F.col("doc_id").alias("from"))
    return found.join(named.hint("merge"), "k").where(F.col("doc_id") == F.col("from")).dropDuplicates(["k"]).select("k", "s")


EDGE = _schema("a:long b:long")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard index of two sets by their lowest hashes."""
    both = np.union1d(a, b)[: min(LOWEST, max(len(a), len(b)))]
    return float(np.isin(both, a, assume_unique=True).__and__(np.isin(both, b, assume_unique=True)).mean())


def similar_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links among close neighbours in the order of min-hashes and sizes: most of what near copies have."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lows = np.stack([np.frombuffer(x, np.int64, BANDS) for x in batch.column("lows").to_pylist()]) if batch.num_rows else np.zeros((0, BANDS), np.int64)
            for band in range(BANDS):
                yield {"band": np.full(len(lows), band), "low": lows[:, band], "k": batch.column("k")}

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[tuple[int, int], int, int, np.ndarray]] = []
        for batch in batches:
            out = []
            for band, low, n, k, lows in zip(*(batch.column(c).to_pylist() for c in ("band", "low", "n", "k", "lows")), strict=True):
                mine = np.frombuffer(lows, np.uint64, -1, 8 * BANDS)
                held = [x for x in held[-NEAR:] if x[0] == (band, low)]
                best = sorted(((-alike(mine, other), i, name) for i, (_, name, m, other) in enumerate(reversed(held)) if 100 * m >= PERCENT * n))
                out += [(min(name, k), max(name, k)) for score, _, name in best[:2] if score <= -0.7]
                held.append(((band, low), k, n, mine))
            if out:
                a, b = np.array(out, np.int64).T
                yield {"a": a, "b": b}

    bands = persist(arrow_map(classes.select("k", "lows"), unfold, _schema("band:int low:long k:long")))
    shared = persist(bands.groupBy("band", "low").count().where("count > 1").select("band", "low"))
    near = persist(bands.join(shared.hint("merge"), ["band", "low"]))
    rows = near.join(classes.select("k", "n", "lows").hint("merge"), "k")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = arrow_map(rows.repartitionByRange(n, "band", "low", "n", "k").sortWithinPartitions("band", "low", "n", "k"), propose, EDGE)
    return verify(docs, classes, persist(pairs.distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))))


# ---------------------------------------------------------------- the index
POSTED = _schema("bucket:int data:binary k:long n:int core:binary")
FOUND = _schema("a:long b:long ca:long cb:long na:int nb:int fa:int fb:int hits:int whole:int core:binary")
_DOC = np.dtype([("k", "<i8"), ("comp", "<i8"), ("n", "<u4"), ("f", "<u4"), ("here", "<u4")])
_POST = np.dtype([("h", "<u4"), ("at", "<u2")])


def postings(docs: DataFrame, reps: DataFrame, common: np.ndarray, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Packed prefix postings of each class, dealt by shingle hash; and the cores of sets that can link by them."""
    shared = docs.sparkSession.sparkContext.broadcast((common, frequent))
    rows = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).join(reps.select("doc_id", F.col("k"), "comp"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hasher = Hasher()
        for batch, texts in text_slices(batches, SLICE_BYTES):
            heads, posts, dealt, cores = [], [], [], []
            sets = hasher.sets(texts)
            short = _short(np.concatenate(sets)).astype(np.int64) if sets else np.zeros(0, np.int64)
            later, dropped = (maybe_in(x, short) for x in shared.value)
            ends = np.cumsum(list(map(len, sets))).tolist()
            for s, end, k, comp in zip(sets, ends, batch.column("k").to_pylist(), batch.column("comp").to_pylist(), strict=True):
                n = len(s)
                if not n or set_key(s) != k:  # another row with this doc_id
                    continue
                out = dropped[end - n : end]
                f = int(np.count_nonzero(out))
                if 100 * f >= PERCENT * n:
                    cores.append((k, n, s[out].tobytes()))
                s, late = mix(s[~out]), later[end - n : end][~out]
                order = np.lexsort((s, late))[: int(prefix_size(np.int64(n), np.int64(f)))]
                p = np.zeros(len(order), _POST)
                p["h"] = (s[order] >> np.uint64(32)).astype(np.uint32)
                p["at"] = np.minimum(np.arange(len(order)), 65535)
                heads.append((k, comp, n, f))
                posts.append(p)
                dealt.append((s[order] % np.uint64(buckets)).astype(np.int64))
            if cores:
                k, n, core = zip(*cores, strict=True)
                yield {"bucket": [x % buckets for x in k], "data": [None] * len(k), "k": k, "n": n, "core": core}
            if not heads:
                continue
            owner = np.repeat(np.arange(len(heads)), list(map(len, posts)))
            flat, dealt = np.concatenate(posts), np.concatenate(dealt)
            order = np.argsort(dealt, kind="stable")
            flat, owner, ends = flat[order], owner[order], np.cumsum(np.bincount(dealt, minlength=buckets))
            table = np.array(heads, np.int64)
            out, lo = [], 0
            for bucket, hi in enumerate(ends.tolist()):
                if hi > lo:
                    who, here = np.unique(owner[lo:hi], return_counts=True)
                    d = np.zeros(len(who), _DOC)
                    d["k"], d["comp"], d["n"], d["f"], d["here"] = *table[who].T, here
                    out.append((bucket, len(d).to_bytes(4, "little") + d.tobytes() + flat[lo:hi].tobytes()))
                lo = hi
            yield {"bucket": [x[0] for x in out], "data": [x[1] for x in out]} | dict.fromkeys(("k", "n", "core"), [None] * len(out))

    return arrow_map(rows, run, POSTED)


def _list_pairs(comp: np.ndarray, n: np.ndarray, f: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list's postings (sorted by size) that sizes, positions and components leave.

    Linked sets have at most min(i, j) common shingles before places i and j, at most as many from there on as
    either has left, and of frequent ones at most as many as either has, so every common prefix shingle of
    linked sets passes.
    """
    left = n - f - at
    blocks = [slice(a, min(a + BLOCK, len(n))) for a in range(0, len(n), BLOCK)]
    bounds = [(int(n[b][0]), int(n[b][-1]), int(at[b].max()), int(left[b].max()), int(f[b].max()), int(comp[b].min()), int(comp[b].max())) for b in blocks]
    for i, a in enumerate(blocks):
        for j in range(i, len(blocks)):
            (lo_a, hi_a, at_a, left_a, f_a, c0, c1), (lo_b, _, at_b, left_b, f_b, d0, d1) = bounds[i], bounds[j]
            if 100 * hi_a < PERCENT * lo_b:
                break  # later blocks only have larger sets
            if c0 == c1 == d0 == d1 or (100 + PERCENT) * (min(at_a, at_b) + min(left_a, left_b) + min(f_a, f_b)) < PERCENT * (lo_a + lo_b):
                continue
            b = blocks[j]
            na, nb = n[a][:, None], n[b][None]
            room = np.minimum(at[a][:, None], at[b][None]) + np.minimum(left[a][:, None], left[b][None]) + np.minimum(f[a][:, None], f[b][None])
            ok = (100 * na >= PERCENT * nb) & (100 * nb >= PERCENT * na) & ((100 + PERCENT) * room >= PERCENT * (na + nb)) & (comp[a][:, None] != comp[b][None])
            if i == j:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            if len(x):
                yield x + a.start, y + b.start


def candidates(posted: DataFrame, buckets: int) -> DataFrame:
    """Pairs of classes from different components that share prefix shingles in a bucket, and the cores (b is null).

    A pair that needs more hits than there are buckets has two in one of them; buckets where such a pair has but
    one don't name it, and `whole` counts those that do.
    """

    def merge(t: pa.Table) -> Iterator[dict]:
        docs, posts = [], []
        for data in t["data"].to_pylist():
            size = int.from_bytes(data[:4], "little")
            docs.append(np.frombuffer(data, _DOC, size, 4))
            posts.append(np.frombuffer(data, _POST, -1, 4 + size * _DOC.itemsize))
        d, p = np.concatenate(docs), np.concatenate(posts)
        owner = np.repeat(np.arange(len(d), dtype=np.int32), d["here"])
        order = np.argsort(p["h"], kind="stable").astype(np.int32)
        h = p["h"][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(first, len(h)))
        comp = d["comp"][owner[order]]
        # lists of one component have nothing to add
        several = np.maximum.reduceat(comp, first) != np.minimum.reduceat(comp, first)
        name = np.unique(d["k"], return_inverse=True)[1].astype(np.int64)  # a class may have come in several blocks
        some = np.zeros(int(name.max()) + 1, np.int64)
        some[name] = np.arange(len(d))
        held: list[np.ndarray] = []
        codes, hits, whole = np.zeros(0, np.int64), np.zeros(0, np.int64), True

        def tally() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([hits, times]), len(both)).astype(np.int64)

        waiting = 0
        for a, m in zip(first[several].tolist(), size[several].tolist(), strict=True):
            o = order[a : a + m]
            who, at = owner[o], p["at"][o].astype(np.int64)
            n, f = d["n"][who].astype(np.int64), d["f"][who].astype(np.int64)
            by = np.lexsort((at, n))
            who, at, n, f = who[by], at[by], n[by], f[by]
            for x, y in _list_pairs(d["comp"][who], n, f, at):
                i, j = name[who[x]], name[who[y]]
                held.append(np.minimum(i, j) * len(some) + np.maximum(i, j))
                waiting += len(x)
            if waiting > TALLY:
                codes, hits = tally()
                held, waiting = [], 0
                if len(codes) > TALLY:  # too many pairs to hold: name them all
                    yield pairs(d, some, codes, hits, False)
                    codes, hits, whole = codes[:0], hits[:0], False
        codes, hits = tally()
        if len(codes):
            yield pairs(d, some, codes, hits, whole)

    def pairs(d: np.ndarray, some: np.ndarray, codes: np.ndarray, hits: np.ndarray, whole: bool) -> dict:
        i, j = d[some[codes // len(some)]], d[some[codes % len(some)]]
        na, nb, fa, fb = (x.astype(np.int64) for x in (i["n"], j["n"], i["f"], j["f"]))
        ra, rb = na - fa - prefix_size(na, fa), nb - fb - prefix_size(nb, fb)
        need = -(-PERCENT * (na + nb) // (100 + PERCENT)) - np.maximum(ra, rb) - np.minimum(fa, fb)
        ok = (hits > 1) | (need <= buckets) | (not whole)
        out = {"a": i["k"], "b": j["k"], "ca": i["comp"], "cb": j["comp"], "na": na.astype(np.int32), "nb": nb.astype(np.int32), "fa": fa.astype(np.int32), "fb": fb.astype(np.int32), "hits": hits.astype(np.int32), "whole": np.full(len(hits), int(whole), np.int32)}
        return {c: x[ok] for c, x in out.items()} | {"core": [None] * int(ok.sum())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        batches = iter(batches)
        for batch in batches:  # cores come first
            data = batch.column("data")
            split = data.null_count
            if split:
                part = batch.slice(0, split)
                yield {"a": part.column("k"), "na": part.column("n"), "core": part.column("core")} | dict.fromkeys(("b", "ca", "cb", "nb", "fa", "fb", "hits", "whole"), [None] * split)
            if split < batch.num_rows:
                for t in runs(chain([batch.slice(split)], batches), ("bucket",)):
                    yield from merge(t)

    return persist(arrow_map(posted.repartition(2 * buckets, "bucket").sortWithinPartitions(F.col("data").isNotNull(), "bucket"), run, FOUND))


def likely(found: DataFrame, buckets: int) -> DataFrame:
    """(a, b, ca, cb) of the candidates that have hits enough.

    All common indexed shingles up to the end of the prefix that ends first are hits; after it that set has so
    many left. Pairs that need more hits than there are buckets may have one more in each bucket that is silent.
    """
    pairs = found.where("b is not null").groupBy("a", "b").agg(*(F.max(c).alias(c) for c in ("ca", "cb", "na", "nb", "fa", "fb")), F.sum("hits").alias("hits"), F.sum("whole").alias("named"))
    least = "greatest(1, ({p} * {n} + 99) div 100 - {f})"
    left = [f"greatest(0, {least} - 1 - {{n}} div {EXTRA})".format(p=PERCENT, n=n, f=f) for n, f in (("na", "fa"), ("nb", "fb"))]
    known = f"(greatest({left[0]}, {left[1]}) + least(fa, fb))"
    need = f"(({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT} - {known})"
    return pairs.where(f"hits + if({need} > {buckets}, greatest(0, {buckets} - named), 0) >= {need}").select("a", "b", "ca", "cb")


# ---------------------------------------------------------------- cores
def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Common elements of each set of one list and each of the other."""
    out = np.zeros((len(one), len(two)), np.float32)
    a, b = np.concatenate(one), np.concatenate(two)
    words = np.intersect1d(a, b)
    if not len(words):
        return out
    sides = []
    for flat, sets in ((a, one), (b, two)):
        row, at = np.repeat(np.arange(len(sets)), list(map(len, sets))), np.searchsorted(words, flat)
        ok = words[np.minimum(at, len(words) - 1)] == flat
        order = np.argsort(at[ok], kind="stable")
        sides.append((row[ok][order], at[ok][order], len(sets)))
    for lo in range(0, len(words), CORE_SLICE):
        width = min(CORE_SLICE, len(words) - lo)
        parts = []
        for row, at, size in sides:
            x = np.zeros((size, width), np.float32)
            i, j = np.searchsorted(at, [lo, lo + width])
            x[row[i:j], at[i:j] - lo] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def core_links(cores: DataFrame, block: int = CORE_BLOCK) -> DataFrame:
    """Edges that unite the sets of cores(k, n, core) whose frequent shingles alone reach the threshold.

    Sets of one size with equal cores link with the same others: one stands for them, and they follow it if it
    links with any. A link's two core prefixes share a shingle, so families that don't can't link.
    """
    n = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = persist(cores.select("k", "n", "core", F.md5("core").alias("name")))
    lead = named.groupBy("n", "name").agg(F.min("k").alias("lead"))
    named = persist(named.join(lead, ["n", "name"]).withColumn("self", F.expr(f"{100 + PERCENT} * (length(core) div 8) >= 2 * {PERCENT} * n")))
    leads = persist(named.where("k = lead").select("k", "n", "core"))

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Edges from the first set that a task sees with a shingle, and that set's name for other tasks."""
        first: dict[int, int] = {}
        for batch in batches:
            edges = []
            for k, size, core in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "core")), strict=True):
                s = np.frombuffer(core, np.uint64)
                tops = {first.setdefault(h, k) for h in s[: len(s) + PERCENT * -size // 100 + 1].tolist()}
                edges += [(x, k) for x in tops if x != k]
            if edges:
                a, b = np.array(edges, np.int64).T
                yield {"a": a, "b": b, "h": [None] * len(a)}
        names = np.array(list(first), np.uint64).view(np.int64)
        yield {"a": list(first.values()), "b": [None] * len(first), "h": names}

    starred = persist(arrow_map(leads, stars, _schema("a:long b:long h:long")))
    tops = starred.where("b is null").groupBy("h").agg(F.min("a").alias("b"))
    across = starred.where("b is null").select("a", "h").join(tops, "h").select("a", "b")
    family = components(starred.where("b is not null").select("a", "b").union(across))
    grouped = persist(leads.join(family.select(F.col("node").alias("k"), F.col("component").alias("family")), "k"))
    each = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(block), F.ceil(F.count("*") / BLOCKS)))
    sizes = grouped.groupBy("family").agg(F.ceil(F.count("*") / each).cast("int").alias("blocks"))
    dealt = grouped.join(sizes, "family").withColumn("mine", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["family", "lo", "hi"]
    dealt = dealt.select("family", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "k", "n", "core")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, tuple(keys)):
            mine, k, size = (np.asarray(t[c]) for c in ("mine", "k", "n"))
            sets = [np.frombuffer(x, np.uint64) for x in t["core"].to_pylist()]
            one, two = (np.flatnonzero(mine == t[c][0].as_py()) for c in ("lo", "hi"))
            if len(one) and len(two):
                ok = (100 + PERCENT) * _overlaps([sets[i] for i in one], [sets[i] for i in two]) >= PERCENT * (size[one][:, None] + size[two][None])
                ok &= k[one][:, None] != k[two][None]
                a, b = united(ok, np.concatenate([k[one], k[two]]))
                yield {"a": a, "b": b}

    links = persist(arrow_map(dealt.repartition(n, *keys).sortWithinPartitions(*keys), compare, EDGE))
    active = links.select(F.explode(F.array("a", "b")).alias("lead")).distinct().withColumn("links", F.lit(True))
    follow = named.where("k <> lead").select("k", "lead", "self").join(active, "lead", "left").where("self or links")
    edges = persist(links.union(follow.select(F.col("lead").alias("a"), F.col("k").alias("b"))))
    discard(named, leads, starred, grouped, links)
    return edges


def verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs(a, b, ca, cb) that link, where one link of two components stands for the rest."""
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).alias("salts"))
    todo = persist(pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b", "ca", "cb"))
    firsts = todo.select("a", "salt").distinct().select(F.col("a").alias("k"), "a", "salt", F.lit(0).alias("role"), *(F.lit(None).cast("long").alias(c) for c in ("ca", "cb")))
    roles = persist(firsts.union(todo.select(F.col("b").alias("k"), "a", "salt", F.lit(1).alias("role"), "ca", "cb")))
    wanted = persist(classes.join(roles.select("k").distinct(), "k", "left_semi").select("k", "doc_id"))
    rows = chosen_sets(docs, wanted).join(roles.hint("merge"), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done: set[tuple[int, int]] = set()
        a, s, comp, base, common = None, np.zeros(0, np.uint64), None, np.zeros(0, np.uint64), 0
        for batch in batches:
            out = []
            for key, role, ca, cb, k, data in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "ca", "cb", "k", "s")), strict=True):
                if role == 0:
                    a, s, comp = key, np.frombuffer(data, np.uint64), None
                    continue
                if (ca, cb) in done:
                    continue
                t = np.frombuffer(data, np.uint64)
                if comp == cb:
                    # from the answer of a similar set: what only one of the two has
                    gone, new = np.setdiff1d(base, t, assume_unique=True), np.setdiff1d(t, base, assume_unique=True)
                    common += overlap(new, s) - overlap(gone, s)
                else:
                    common = overlap(t, s)
                comp, base = cb, t
                if linked(common, len(s), len(t)):
                    out.append((a, k))
                    done = done if len(done) < 100_000 else set()
                    done.add((ca, cb))
            if out:
                x, y = np.array(out, np.int64).T
                yield {"a": x, "b": y}

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(rows.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role", "cb", "k"), run, EDGE)


def _relabel(classes: DataFrame, comps: DataFrame) -> DataFrame:
    return classes.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("component", "k")).drop("component")


def join(docs: DataFrame, sample: int = SAMPLE, common: int = COMMON, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = profiles(docs, sample)
    filters = frequent_shingles(rows.where("some is not null").select("k", "some"), common, frequent)

    classes = persist(rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("lows").alias("lows")))
    named = classes.where("doc_id is not null")
    postings_ = int(classes.agg(F.sum("n")).first()[0] or 0) // 3
    buckets = max(8, min(int(spark.conf.get("spark.sql.shuffle.partitions")), postings_ // BUCKET_POSTINGS))
    links = persist(similar_first(docs, named))
    labelled = persist(_relabel(named, components(links)))
    found = candidates(postings(docs, labelled, *filters, buckets), buckets)
    links = links.union(persist(verify(docs, named, persist(likely(found, buckets)))))  # written first: one Python map a task
    cores = found.where("b is null").select(F.col("a").alias("k"), F.col("na").alias("n"), "core")
    if cores.limit(1).count():
        links = links.union(core_links(cores))
    comps = persist(components(links))
    discard(found)
    member = persist(_relabel(classes, comps).select("k", "comp", "doc_id"))
    least = persist(member.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    name = persist(member.join(least, "comp").select("k", "component_id"))
    out = rows.join(name, "k", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with one document of each component: that with its smallest doc_id.

    Rows that share a doc_id are one document, of which the first by text stays; rows with a null doc_id stay.
    Extra columns are kept as they are, whatever their names.
    """
    groups = persist(join(docs, **options))
    key, nth = private(docs, "key"), private(docs, "nth")
    ids = persist(groups.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("rows")))
    dropped, again = ids.where("not stays").select(key), ids.where("stays and rows > 1").select(key)
    sure, unsure = parted(docs, member_filter(dropped.union(again)), lambda batch: np.asarray(batch.column("doc_id").fill_null(-1)))
    unsure = unsure.join(dropped, F.col("doc_id") == F.col(key), "left_anti")
    if again.limit(1).count():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        unsure = unsure.withColumn(nth, place).where(F.col("doc_id").isNull() | (F.col(nth) == 1)).drop(nth)
    return sure.union(unsure)
