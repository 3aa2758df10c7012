"""Suffix-array deduplication: a common-prefix-aware distributed merge sort of sampled suffixes.

A 50-byte string that stands in two documents has the same minimiser in both: the least hashed 20-gram among
its 31. Suffixes that start at minimisers are therefore enough to find every repeated string, together with
the up to 30 bytes before them.

1. Equal texts: all but the smallest doc_id repeat it whole.
2. Duplicate detection on hashed prefixes, as packed postings dealt by hash: suffixes whose 20-gram no other
   document has are never exchanged.
3. The others are sorted in each slice of documents into runs (50 bytes from the minimiser, then up to 30
   bytes before it, backwards), equal ones joined with their smallest doc_id, and the runs are exchanged
   front-coded, dealt by 20-gram.
4. A loser tree per bucket merges the runs; every entry carries the length of the prefix it shares with the
   last one put out, so that contestants with different lengths are ordered without looking at a byte and
   others are compared from that length on. The shared lengths delimit equal suffixes and equal 20-grams,
   and each 50-byte string around a minimiser gets the smallest doc_id that has it.
5. The answers return to the slices, which join them into spans.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller doc_id.
Null and empty texts have no bytes; rows with a null doc_id rank after all others; repeated rows (equal
doc_id and text) are judged alike and don't remove one another. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, persist, runs, text_slices
from weftnet.llm.set_join import maybe_in, member_filter, parted
from weftnet.llm.shingles import _BASE, _INVERSE, _powers, mix

LENGTH, GRAM = 50, 20
BACK = LENGTH - GRAM
KEY = LENGTH + BACK + 2  # the suffix, what stands before it backwards, and how many bytes each has
LAST = (1 << 63) - 1
SLICE_BYTES = 2 << 20
_TURN = 0x1E3779B97F4A7C15


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(text).digest()[:8], "little", signed=True)


# ---------------------------------------------------------------- minimisers
class Minimisers:
    """Places of minimisers in many texts at once."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in it, hash of the gram there) of each minimiser."""
        sizes = np.array(list(map(len, texts)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        if not (sizes >= LENGTH).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(data)
        if len(self.up) <= n:
            self.up, self.down = _powers(_BASE, n + n // 8 + 1), _powers(_INVERSE, n + n // 8 + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], dtype=np.uint64, out=run[1:])
        grams = mix((run[GRAM:] - run[:-GRAM]) * self.down[: n - GRAM + 1])
        bits = np.uint64(max(1, int(n).bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        for step in (1, 2, 4, 8, BACK + 1 - 16):
            low = np.minimum(low[:-step], low[step:])
        # strings that lie within one text
        inside = np.ones(len(low), bool)
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            inside[max(end - size, end - LENGTH + 1) : end] = False
        chosen = low[inside] & ((np.uint64(1) << bits) - np.uint64(1))
        place = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])].astype(np.int64)
        text = np.searchsorted(ends, place, side="right")
        return text, place - (ends - sizes)[text], grams[place]


# ---------------------------------------------------------------- profiles and candidates
PROFILE = _schema("doc_id:long k:long n_bytes:long sha256:string")


def profiles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches):
            yield {"doc_id": batch.column("doc_id"), "k": list(map(text_key, texts)), "n_bytes": list(map(len, texts)), "sha256": [hashlib.sha256(t).hexdigest() for t in texts]}

    return persist(arrow_map(_rows(docs), run, PROFILE))


def _rows(docs: DataFrame) -> DataFrame:
    return as_bytes(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"))


def _row_key(doc_id: np.ndarray, k: np.ndarray) -> np.ndarray:
    return k ^ (doc_id * np.int64(_TURN))


def _filter(wanted: DataFrame) -> np.ndarray:
    return member_filter(wanted.select("doc_id", "k"), lambda b: _row_key(np.asarray(b.column(0)), np.asarray(b.column(1))))


def _chosen(packed: np.ndarray, batch: pa.RecordBatch, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc_id, k, text) of the rows that a filter lets through."""
    ids, k = np.asarray(batch.column("doc_id")), np.array(list(map(text_key, texts)), np.int64)
    mine = np.flatnonzero(maybe_in(packed, _row_key(ids, k)))
    return ids[mine], k[mine], [texts[i] for i in mine]


def some_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, k, text) of at least the wanted (doc_id, k): a filter of fixed size lets few others through.

    Joins with it are merged, so that a task has one Python map and an executor no more workers than cores.
    """
    packed = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches):
            ids, k, mine = _chosen(packed.value, batch, texts)
            yield {"doc_id": ids, "k": k, "text": mine}

    return arrow_map(_rows(docs), run, _schema("doc_id:long k:long text:binary"))


_POSTED = np.dtype([("doc", "<i8"), ("k", "<i8"), ("here", "<u4")])
_PLACED = np.dtype([("doc", "<i8"), ("k", "<i8"), ("at", "<u4")])
BLOB = _schema("bucket:int data:binary")


def _dealt(buckets: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of each bucket that has rows."""
    order = np.argsort(buckets, kind="stable")
    ends = np.cumsum(np.bincount(buckets, minlength=count))
    for b, (lo, hi) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)):
        if hi > lo:
            yield b, order[lo:hi]


def shared_places(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, k, places): minimisers of each wanted document whose gram other documents have too."""
    packed = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        find = Minimisers()
        for batch, slice_ in text_slices(batches, SLICE_BYTES):
            ids, ks, slice_ = _chosen(packed.value, batch, slice_)
            text, place, gram = find(slice_)
            out = []
            for b, rows in _dealt((gram % np.uint64(buckets)).astype(np.int64), buckets):
                who, here = np.unique(text[rows], return_counts=True)
                d = np.zeros(len(who), _POSTED)
                d["doc"], d["k"], d["here"] = ids[who], ks[who], here
                out.append((b, len(d).to_bytes(4, "little") + d.tobytes() + (gram[rows] >> np.uint64(32)).astype("<u4").tobytes() + place[rows].astype("<u4").tobytes()))
            yield {"bucket": [x[0] for x in out], "data": [x[1] for x in out]}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("bucket",)):
            docs, grams, places = [], [], []
            for data in t["data"].to_pylist():
                m = int.from_bytes(data[:4], "little")
                d = np.frombuffer(data, _POSTED, m, 4)
                n = int(d["here"].sum())
                docs.append(np.repeat(d, d["here"]))
                grams.append(np.frombuffer(data, "<u4", n, 4 + m * _POSTED.itemsize))
                places.append(np.frombuffer(data, "<u4", n, 4 + m * _POSTED.itemsize + 4 * n))
            d, g, p = np.concatenate(docs), np.concatenate(grams), np.concatenate(places)
            order = np.argsort(g, kind="stable")
            g = g[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            doc = d["doc"][order]
            several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            keep = order[np.repeat(several, np.diff(np.append(first, len(g))))]
            out = np.zeros(len(keep), _PLACED)
            out["doc"], out["k"], out["at"] = d["doc"][keep], d["k"][keep], p[keep]
            home = (mix(out["k"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            parts = [(b, _pack(out[rows])) for b, rows in _dealt(home, buckets)]
            yield {"bucket": [x[0] for x in parts], "data": [x[1] for x in parts]}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("bucket",)):
            x = np.concatenate([np.frombuffer(_unpack(d), _PLACED) for d in t["data"].to_pylist()])
            x = x[np.lexsort((x["at"], x["k"], x["doc"]))]
            first = np.flatnonzero(np.concatenate([[True], (x["doc"][1:] != x["doc"][:-1]) | (x["k"][1:] != x["k"][:-1])]))
            yield {"doc_id": x["doc"][first].copy(), "k": x["k"][first].copy(), "places": [np.unique(part["at"]).astype("<u4").tobytes() for part in np.split(x, first[1:])]}

    posted = arrow_map(_rows(docs), post, BLOB).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    homes = arrow_map(posted, shared, BLOB).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return persist(arrow_map(homes, gather, _schema("doc_id:long k:long places:binary")))


# ---------------------------------------------------------------- runs of suffixes
RUN = _schema("slice:long bucket:int run:binary owners:binary")


def suffix_keys(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of KEY bytes for each suffix at `at` of a text in data[start:end]."""
    keys = np.zeros((len(at), KEY), np.uint8)
    right, left = np.minimum(LENGTH, end - at), np.minimum(BACK, at - start)
    for j in range(LENGTH):
        ok = j < right
        keys[ok, j] = data[at[ok] + j]
    for j in range(BACK):
        ok = j < left
        keys[ok, LENGTH + j] = data[at[ok] - 1 - j]
    keys[:, KEY - 2], keys[:, KEY - 1] = right, left
    return keys


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared prefix of each sorted key with the one before, the remaining bytes of all)."""
    shared = np.zeros(len(keys), np.uint8)
    for lo in range(1, len(keys), 1 << 16):
        part = keys[lo - 1 : lo + (1 << 16)]
        differ = part[1:] != part[:-1]
        shared[lo : lo + (1 << 16)] = np.where(differ.any(1), differ.argmax(1), KEY)
    return shared, keys[np.arange(KEY) >= shared[:, None]]


def sorted_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Front-coded sorted runs of each slice of documents; bucket -1 has the slice's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch, slice_ in text_slices(batches, SLICE_BYTES):
            places = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("places").to_pylist()]
            sizes = np.array(list(map(len, slice_)))
            ends = np.cumsum(sizes)
            doc = np.repeat(np.arange(len(slice_)), list(map(len, places)))
            at = np.concatenate(places) + (ends - sizes)[doc]
            data = np.frombuffer(b"".join(slice_), np.uint8)
            keys = suffix_keys(data, at, (ends - sizes)[doc], ends[doc])
            gram = np.zeros(len(at), np.uint64)
            for j in range(GRAM):
                gram = gram * np.uint64(_BASE) + keys[:, j].astype(np.uint64) + np.uint64(1)
            ids = np.asarray(batch.column("doc_id"))
            out = [(-1, b"", _pack(ids, np.asarray(batch.column("k"))))]
            for b, rows in _dealt((mix(gram) % np.uint64(buckets)).astype(np.int64), buckets):
                mine, entry = np.unique(np.ascontiguousarray(keys[rows]).view(f"V{KEY}").ravel(), return_inverse=True)
                least = np.full(len(mine), LAST, np.int64)
                np.minimum.at(least, entry, ids[doc[rows]])
                shared, rest = front_code(mine.view(np.uint8).reshape(-1, KEY))
                head = np.array([len(mine)], "<u4")
                out.append((b, _pack(head, least, shared, rest), _pack(head, entry.astype("<u4"), doc[rows].astype("<u4"), (at - (ends - sizes)[doc])[rows].astype("<u4"))))
            yield {"slice": [number] * len(out), "bucket": [x[0] for x in out], "run": [x[1] for x in out], "owners": [x[2] for x in out]}
            number += 1

    return persist(arrow_map(texts, run, RUN), "uncompressed")


class LoserTree:
    """Merges sorted runs of (shared prefix with the run's last key, key) without re-comparing known prefixes.

    Each contestant knows the prefix it shares with the last key put out. The longer shared prefix is the
    smaller key; only at equal lengths are bytes compared, from there on.
    """

    def __init__(self, sources: list[Iterator[tuple[int, bytes]]]) -> None:
        self.sources = sources
        self.width = 1
        while self.width < len(sources):
            self.width *= 2
        self.keys: list[bytes] = [b""] * self.width
        self.shared = [-1] * self.width  # -1: at its end
        for k, source in enumerate(sources):
            self._next(k, source)
            self.shared[k] = min(self.shared[k], 0)
        self.losers = [0] * self.width
        self.winner = self._build(1)

    def _next(self, k: int, source: Iterator[tuple[int, bytes]]) -> None:
        item = next(source, None)
        if item is None:
            self.shared[k] = -1
        else:
            self.shared[k], self.keys[k] = item

    def _less(self, a: int, b: int) -> bool:
        """Whether contestant a is to be put out before b; the loser's shared length becomes that with the winner."""
        la, lb = self.shared[a], self.shared[b]
        if la != lb:
            return la > lb
        if la < 0:
            return True
        x, y = self.keys[a][la:], self.keys[b][la:]
        first = x <= y
        if x == y:
            common = len(x)
        else:
            common = len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)
        self.shared[b if first else a] = la + common
        return first

    def _build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won = self._less(a, b)
        self.losers[node] = b if won else a
        return a if won else b

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(run, shared prefix with the key before, key) in sorted order."""
        losers, shared, less = self.losers, self.shared, self._less
        while shared[self.winner] >= 0:
            w = self.winner
            yield w, shared[w], self.keys[w]
            self._next(w, self.sources[w])
            node = w + self.width >> 1
            while node:
                o = losers[node]
                if not less(w, o):
                    losers[node], w = w, o
                node >>= 1
            self.winner = w


def read_run(data: bytes) -> tuple[np.ndarray, Iterator[tuple[int, bytes]]]:
    """(smallest doc_id of each key, the keys) of a front-coded run."""
    raw = _unpack(data)
    n = int.from_bytes(raw[:4], "little")
    least = np.frombuffer(raw, "<i8", n, 4)
    shared = raw[4 + 8 * n : 4 + 9 * n]

    def keys() -> Iterator[tuple[int, bytes]]:
        at, key = 4 + 9 * n, b""
        for m in shared:
            to = at + KEY - m
            key = key[:m] + raw[at:to]
            at = to
            yield m, key

    return least, keys()


def first_owners(keys: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For distinct suffixes, the smallest doc_id that has the string starting d bytes before each: (d, suffix)."""
    right, left = keys[:, KEY - 2].astype(np.int64), keys[:, KEY - 1].astype(np.int64)
    out = np.tile(least, (BACK + 1, 1))
    size = np.bincount(group)
    several = np.flatnonzero(size[group] > 1)
    if len(several):
        k, mine = keys[several].astype(np.uint64) + np.uint64(1), least[several]
        forward = np.zeros((BACK + 1, len(several)), np.uint64)
        run = group[several].astype(np.uint64) * np.uint64(_BASE)
        for j in range(LENGTH):
            run = mix(run + k[:, j])
            if j + 1 >= GRAM:
                forward[LENGTH - j - 1] = run
        back = np.zeros(len(several), np.uint64)
        for d in range(BACK + 1):
            if d:
                back = mix(back + k[:, LENGTH + d - 1])
            name = forward[d] + back * np.uint64(_INVERSE)
            order = np.argsort(name)
            name = name[order]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            low = np.minimum.reduceat(mine[order], first)
            got = np.empty(len(several), np.int64)
            got[order] = np.repeat(low, np.diff(np.append(first, len(name))))
            out[d, several] = got
    for d in range(BACK + 1):
        out[d, (left < d) | (right < LENGTH - d)] = LAST  # no such string
    return out


def merged(found: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, reply): for each run's entries the first owners of the strings around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("bucket",)):
            opened = [read_run(x) for x in t["run"].to_pylist()]
            source, shared, keys = [], [], []
            for r, m, key in LoserTree([x[1] for x in opened]):
                source.append(r)
                shared.append(m)
                if m < KEY:
                    keys.append(key)
            source, shared = np.array(source), np.array(shared)
            distinct = np.cumsum(shared < KEY) - 1
            new = np.flatnonzero(shared < KEY)
            # entries of a run come out in its order
            order = np.argsort(source, kind="stable")
            least = np.empty(len(source), np.int64)
            least[order] = np.concatenate([x[0] for x in opened])
            group = np.cumsum(shared[new] < GRAM) - 1
            owners = first_owners(np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY), group, np.minimum.reduceat(least, new))
            ends = np.cumsum([len(x[0]) for x in opened])
            yield {"slice": t["slice"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "run": [None] * len(opened), "owners": [_pack(owners[:, distinct[part]]) for part in np.split(order, ends[:-1])]}

    rows = found.where("bucket >= 0").select("slice", "bucket", "run")
    return arrow_map(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice"), run, RUN)


SPANS = _schema("doc_id:long k:long n_removed:long n_spans:long spans:binary")


def spans(found: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, k, n_removed, n_spans, spans): maximal removed runs of each document that has any."""
    both = found.select("slice", "bucket", F.lit(0).alias("kind"), "owners").union(replies.select("slice", "bucket", F.lit(1).alias("kind"), "owners"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in runs(batches, ("slice",)):
            ids, ks, docs, starts, held = None, None, [], [], None
            for kind, data in zip(t["kind"].to_pylist(), t["owners"].to_pylist(), strict=True):
                raw = _unpack(data)
                if ids is None:
                    ids, ks = np.frombuffer(raw, np.int64).reshape(2, -1)
                elif kind == 0:
                    held = raw
                else:
                    n = int.from_bytes(held[:4], "little")
                    entry, doc, at = np.frombuffer(held, "<u4", -1, 4).reshape(3, -1).astype(np.int64)
                    first = np.frombuffer(raw, np.int64).reshape(BACK + 1, n)
                    d, who = np.nonzero(first[:, entry] < ids[doc])
                    docs.append(doc[who])
                    starts.append(at[who] - d)
            doc, start = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(starts or [np.zeros(0, np.int64)])
            if not len(doc):
                continue
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + LENGTH)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            who, a, b = doc[first], start[first], start[last] + LENGTH
            cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            pairs = np.stack([a, b], 1)
            yield {"doc_id": ids[who[cut]], "k": ks[who[cut]], "n_removed": np.add.reduceat(b - a, cut), "n_spans": np.diff(np.append(cut, len(who))), "spans": [x.tobytes() for x in np.split(pairs, cut[1:])]}

    return persist(arrow_map(both.repartition(buckets, "slice").sortWithinPartitions("slice", "bucket", "kind"), run, SPANS).dropDuplicates(["doc_id", "k"]))


def kept_parts(text: bytes, spans_: np.ndarray) -> bytes:
    """What is left of a text without the spans."""
    edges = [0, *spans_.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per row doc_id, k, n_bytes, sha256, copy; the spans of rows that repeat others in part)."""
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = profiles(docs)
    classes = persist(rows.where(f"n_bytes >= {LENGTH}").groupBy("k").agg(F.min("doc_id").alias("doc_id")))
    places = shared_places(docs, classes, groups)
    found = sorted_runs(some_texts(docs, places).join(places.hint("merge"), ["doc_id", "k"]), groups)
    removed = spans(found, merged(found, groups), groups)
    first = classes.withColumnRenamed("doc_id", "first")
    rows = persist(rows.join(first, "k", "left").select("doc_id", "k", "n_bytes", "sha256", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")))
    return rows, removed


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs(doc_id, text)."""
    rows, removed = find_repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "k": batch.column("k"), "left": [hashlib.sha256(kept_parts(t, np.frombuffer(s, np.int64))).hexdigest() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]}

    left = arrow_map(some_texts(docs, removed).join(removed.select("doc_id", "k", "spans").hint("merge"), ["doc_id", "k"]), run, _schema("doc_id:long k:long left:string"))
    left = persist(left.dropDuplicates(["doc_id", "k"]).join(removed.drop("spans"), ["doc_id", "k"]))
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.join(left, ["doc_id", "k"], "left")
    pick = lambda whole, part, none: F.when(F.col("copy"), whole).otherwise(F.coalesce(part, none))
    return out.select(
        F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"),
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(nothing), F.col("left"), F.col("sha256")).alias("kept_sha256"),
    )


def cut(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, n_chars, ...) without the removed bytes.

    What a cut leaves of a character becomes U+FFFD, n_chars follows the new text, and rows of which nothing
    but white space is left go. Rows that repeat nothing stay as they are. Extra columns are kept as they are,
    whatever their names.
    """
    named, docs = docs, docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"_{k}" for k, c in enumerate(docs.columns)))
    rows, removed = find_repeats(docs)
    whole = rows.where("copy").select("doc_id", "k", F.lit(None).cast("binary").alias("spans"))
    changes = persist(removed.select("doc_id", "k", "spans").join(whole, ["doc_id", "k"], "left_anti").union(whole.distinct()))

    def key(batch: pa.RecordBatch) -> np.ndarray:
        k = np.array([text_key(x or b"") for x in batch.column("text").to_pylist()], np.int64)
        return _row_key(np.asarray(batch.column("doc_id").fill_null(LAST)), k)

    same, other = parted(docs, _filter(changes), key, "row_key")
    columns, schema_out = docs.columns, docs.schema

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = batch.column("doc_id")
            yield {"rank": ids, "row_key": _row_key(np.asarray(ids), np.asarray(batch.column("k"))), "spans": batch.column("spans")}

    changed = arrow_map(changes, keyed, _schema("rank:long row_key:long spans:binary")).withColumn("known", F.lit(True))
    rank = F.coalesce(F.col("doc_id"), F.lit(LAST))
    joined = other.withColumn("rank", rank).join(changed.hint("merge"), ["row_key", "rank"], "left").drop("row_key", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            chars = batch.column("n_chars").to_pylist()
            for i, (s, known) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("known").to_pylist(), strict=True)):
                if known:
                    texts[i] = kept_parts(texts[i].encode(), np.frombuffer(s, np.int64)).decode("utf-8", "replace") if s is not None else ""
                    chars[i] = len(texts[i])
                    if not texts[i].strip():
                        continue
                keep.append(i)
            rows_ = batch.take(pa.array(keep, pa.int64()))
            yield {c: rows_.column(c) for c in columns} | {"text": [texts[i] for i in keep], "n_chars": [chars[i] for i in keep]}

    return same.union(arrow_map(joined, run, schema_out)).toDF(*named.columns)
