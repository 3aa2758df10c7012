"""Best-fit packing by bin completion branch-and-bound over the histogram of piece lengths.

Piece lengths are whole numbers up to the capacity, so the packing problem is its histogram: at most
`capacity` counts, whatever the input's size. The driver solves that and hands back patterns (fillings
with a number of repeats); each pattern uses up at least one length, so there are at most `capacity`
patterns, of at most about sqrt(2 * capacity) lengths each (a little more where the search stops a pattern early). Pieces then find their place by their rank
among the pieces of their length, which is counted in hashed buckets so that no length is one task.

Null and empty texts are one piece with only the end id. A null doc_id is packed like any other, repeated
rows are pieces of their own, extra columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, persist, text_slices
from weftnet.llm.tokens import END_ID, encode_texts

CAPACITY = 4096
#: Work after which the best packing found is kept: a node is 1, one that looks k times as far k squared.
NODES = 3000
#: Fillings that a node tries first, and lengths looked at when one is extended; both double whenever they are used up.
WIDTH, REACH = 6, 24
#: Incumbents of the first round: how many of their bins plain best fit fills before bins are completed with least waste.
INCUMBENTS = 17

#: Chunks that a worker remembers the ids of, and text bytes that are encoded at once.
MEMO, SLICE_BYTES = 200_000, 1 << 19

Pattern = tuple[tuple[tuple[int, int], ...], int]


# ---------------------------------------------------------------- the histogram's packing
def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that are needed at least.

    Martello and Toth's L2: by the total, and by the large pieces with what fits beside them. And by weights of
    `b + a * size` for the pieces from some size up, where no bin may hold pieces of more than weight 1 together.
    """
    n = np.zeros(capacity + 1, np.int64)
    for size, c in counts.items():
        n[size] = c
    size = np.arange(capacity + 1)
    many, total = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        alone = int(many[capacity] - many[capacity - k])  # larger than capacity - k
        half = int(many[capacity - k] - many[capacity // 2])
        free = half * capacity - int(total[capacity - k] - total[capacity // 2])
        small = int(total[capacity // 2] - (total[k - 1] if k else 0))
        best = max(best, alone + half + max(0, -(-(small - free) // capacity)))
    top = max(counts)
    for least in sorted(counts):
        most = capacity // least
        if most > 6:
            continue
        pieces, sizes = (int(x[-1] - x[least - 1]) if least else int(x[-1]) for x in (many, total))
        full = [(k, min(capacity, k * top)) for k in range(1, most + 1)]  # pieces in a bin, and their size at most
        best = max(best, -(-pieces // most))
        for x, (k, room) in enumerate(full):
            for j, other in full[:x]:
                d, a, b = j * room - k * other, j - k, room - other  # both at weight 1
                if d < 0:
                    d, a, b = -d, -a, -b
                if d and a >= 0 and all(n * b + r * a <= d for n, r in full):
                    best = max(best, -(-(pieces * b + sizes * a) // d))
    return best


class _Sizes:
    """Remaining lengths in ascending order with their counts."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = dict(counts)
        self.order = sorted(self.left)

    def take(self, filling: dict[int, int], times: int) -> None:
        for size, k in filling.items():
            self.left[size] -= k * times
            if not self.left[size]:
                del self.left[size]
                del self.order[bisect_right(self.order, size) - 1]

    def put_back(self, filling: dict[int, int], times: int) -> None:
        for size, k in filling.items():
            if size not in self.left:
                self.order.insert(bisect_right(self.order, size), size)
                self.left[size] = 0
            self.left[size] += k * times

    def repeats(self, filling: dict[int, int]) -> int:
        return min(self.left[size] // k for size, k in filling.items())

    def at_most(self, room: int, used: dict[int, int]) -> int | None:
        """The largest length that fits and is not used up by this filling."""
        k = bisect_right(self.order, room) - 1
        while k >= 0 and used.get(self.order[k], 0) >= self.left[self.order[k]]:
            k -= 1
        return self.order[k] if k >= 0 else None


def _best_fit(sizes: _Sizes, capacity: int, filling: dict[int, int] | None = None) -> tuple[dict[int, int], int]:
    """Complete a bin with the largest lengths that fit; (filling, waste)."""
    filling = dict(filling or {sizes.order[-1]: 1})
    room = capacity - sum(s * k for s, k in filling.items())
    while room and (size := sizes.at_most(room, filling)) is not None:
        k = min(room // size, sizes.left[size] - filling.get(size, 0))
        filling[size] = filling.get(size, 0) + k
        room -= k * size
    return filling, room


def _dominates(a: list[int], b: list[int]) -> bool:
    """Whether the lengths of b fit into those of a as bins: largest first into the tightest place."""
    room = list(a)
    for size in b:
        place = min((r for r in room if r >= size), default=None)
        if place is None:
            return False
        room[room.index(place)] = place - size
    return True


def completions(sizes: _Sizes, capacity: int, width: int = WIDTH, reach: int = REACH) -> list[tuple[dict[int, int], int]]:
    """Undominated fillings around the largest piece, least waste first."""
    largest = sizes.order[-1]
    room = capacity - largest
    found: dict[tuple, tuple[dict[int, int], int]] = {}

    def add(filling: dict[int, int]) -> None:
        filling, waste = _best_fit(sizes, capacity, filling)
        found[tuple(sorted(filling.items()))] = (filling, waste)

    add({largest: 1})
    top = bisect_right(sizes.order, room)
    for size in sizes.order[max(0, top - reach) : top][::-1]:
        used = {largest: 1}
        if size == largest and sizes.left[size] < 2:
            continue
        used[size] = used.get(size, 0) + 1
        add(used)
        rest = room - size
        k = bisect_right(sizes.order, rest)
        for second in sizes.order[max(0, k - reach // 4) : k][::-1]:
            if used.get(second, 0) >= sizes.left[second]:
                continue
            add({**used, second: used.get(second, 0) + 1})
            want = rest - second
            if want in sizes.left and used.get(want, 0) + (want == second) < sizes.left[want]:
                exact = {**used, second: used.get(second, 0) + 1}
                exact[want] = exact.get(want, 0) + 1
                add(exact)
        if any(not w for _, w in found.values()) and len(found) >= 4 * width:
            break
    kept: list[tuple[dict[int, int], int, list[int]]] = []
    for filling, waste in sorted(found.values(), key=lambda x: (x[1], sum(x[0].values()), sorted(x[0], reverse=True))):
        rest = sorted((s for s, k in filling.items() for _ in range(k - (s == largest))), reverse=True)
        if len(rest) > 12 or not any(_dominates(r, rest) for *_, r in kept):
            kept.append((filling, waste, rest))
        if len(kept) == width:
            break
    return [(f, w) for f, w, _ in kept]


def lazily(sizes: _Sizes, capacity: int, work: list[int]) -> Iterator[tuple[dict[int, int], int]]:
    """The fillings around the largest piece, a few at first and more whenever the search comes back for them."""
    width, reach, seen = WIDTH, REACH, set()
    while True:
        work[0] += (reach // REACH) ** 2
        for filling, waste in completions(sizes, capacity, width, reach):
            key = tuple(sorted(filling.items()))
            if key not in seen:
                seen.add(key)
                yield filling, waste
        if reach >= len(sizes.order):
            return
        width, reach = 2 * width, 2 * reach


def incumbent(counts: dict[int, int], capacity: int, first: int) -> list[tuple[dict[int, int], int]]:
    """A packing: `first` bins by best fit, then the largest piece of each bin with the two that waste least."""
    n = np.zeros(capacity + 1, np.int64)
    for size, c in counts.items():
        n[size] = c
    found, bins = [], 0
    while len(have := np.flatnonzero(n)):
        filling = {int(have[-1]): 1}
        room = capacity - int(have[-1])

        def put(size: int, filling: dict[int, int] = filling) -> int:
            filling[size] = filling.get(size, 0) + 1
            return size

        n[have[-1]] -= 1
        if bins >= first and len(one := have[: bisect_right(have, room)][n[have[: bisect_right(have, room)]] > 0]):
            at = np.searchsorted(one, room - one, side="right") - 1  # the largest second piece beside each first one
            at -= (at >= 0) & (one[at] == one) & (n[one] < 2)
            two = np.where(at >= 0, one[at], 0)
            k = int(np.lexsort((np.abs(one - two), room - one - two))[0])
            for size in (int(one[k]), int(two[k])):
                if size:
                    room -= put(size)
                    n[size] -= 1
        while room and len(fits := np.flatnonzero(n[: room + 1])):
            size = int(fits[-1])
            room -= put(size)
            n[size] -= 1
        for size, k in filling.items():
            n[size] += k
        times = int(min(n[size] // k for size, k in filling.items()))
        if bins < first:
            times = min(times, first - bins)
        for size, k in filling.items():
            n[size] -= k * times
        found.append((filling, times))
        bins += times
    return found


def _incumbents(counts: dict[int, int], capacity: int, need: int, best: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """The best of packings with more and more bins by best fit, tried more finely around the best of them."""
    bins = lambda x: sum(t for _, t in x)
    step = max(1, bins(best) // (INCUMBENTS - 1))
    tried, middle = {}, None
    while bins(best) > need and step:
        starts = range(0, bins(best) + 1, step) if middle is None else (middle - step, middle + step)
        for first in starts:
            if first >= 0 and first not in tried and bins(best) > need:
                made = incumbent(counts, capacity, first)
                tried[first] = bins(made)
                best = min(best, made, key=bins)
        middle = min(tried, key=lambda k: (tried[k], k))
        step //= 2
    return best


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns ((length, copies)..., repeats) that pack all pieces into as few bins as the search finds."""
    counts = {int(s): int(c) for s, c in counts.items() if c > 0}
    if not counts:
        return []
    need = lower_bound(counts, capacity)
    sizes = _Sizes(counts)
    best: list[tuple[dict[int, int], int]] = []
    while sizes.order:
        filling, _ = _best_fit(sizes, capacity)
        times = sizes.repeats(filling)
        best.append((filling, times))
        sizes.take(filling, times)
    if sum(t for _, t in best) > need:
        best = _incumbents(counts, capacity, need, best)
    least = sum(t for _, t in best)
    total = sum(s * c for s, c in counts.items())
    sizes, path = _Sizes(counts), []
    work = [0]
    stack: list[Iterator] = [lazily(sizes, capacity, work)] if least > need else []
    wasted = used = 0
    while stack and least > need and work[0] < nodes:
        filling, waste = next(stack[-1], (None, 0))
        if filling is None:
            stack.pop()
            if path:
                filling, times, waste = path.pop()
                sizes.put_back(filling, times)
                wasted -= waste * times
                used -= times
            continue
        times = sizes.repeats(filling)
        # waste that a packing with one bin fewer than the incumbent may have
        if wasted + waste * times > (least - 1) * capacity - total:
            # a filling that wastes too much when repeated may be right a few times
            times = ((least - 1) * capacity - total - wasted) // waste if waste else times
            if times < 1:
                continue
        sizes.take(filling, times)
        path.append((filling, times, waste))
        wasted += waste * times
        used += times
        if not sizes.order:
            if used < least:
                least, best = used, [(f, t) for f, t, _ in path]
            stack.append(iter(()))
            continue
        stack.append(lazily(sizes, capacity, work))
    return [(tuple(sorted(f.items(), reverse=True)), t) for f, t in best]


def placement(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: sorted by (length, first rank)."""
    rows, ranks, base = [], {}, 0
    for filling, times in patterns:
        offset = 0
        for size, k in filling:
            rank = ranks.get(size, 0)
            rows.append((size, rank, k, base, offset))
            ranks[size] = rank + k * times
            offset += size * k
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "copies", "base", "offset"), cols, strict=True))


# ---------------------------------------------------------------- documents
PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
PLACED = T.StructType([*PIECE.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids, cut into pieces of the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches, SLICE_BYTES):
            rows: dict[str, list] = {f.name: [] for f in PIECE}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(tokenizer, texts, end_id, MEMO), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        rows[name].append(x)
            yield rows

    return arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), cut, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES) -> DataFrame:
    """Pieces of docs(doc_id, text) with their sequence and place in it."""
    spark = docs.sparkSession
    cut = persist(pieces(docs, tokenizer, capacity, end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(placement(pack_counts(counts, capacity, nodes)))

    buckets = max(64, sum(counts.values()) // 50_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = persist(sums.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.join(before, ["length", "bucket"]).select(*PIECE.names, (F.col("before") + rank).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at = where.value
        keys = at["length"] << 44 | at["rank"]
        for batch in batches:
            length, r = (np.asarray(batch.column(k)) for k in ("length", "rank"))
            k = np.searchsorted(keys, length.astype(np.int64) << 44 | r, side="right") - 1
            nth, copies = r - at["rank"][k], at["copies"][k]
            yield {n: batch.column(n) for n in PIECE.names} | {"sequence_id": at["base"][k] + nth // copies, "offset": at["offset"][k] + nth % copies * length}

    return arrow_map(ranked, place, PLACED)
