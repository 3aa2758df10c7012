"""Token ids of whole texts, and their binary form: Simple-8b words in independent blocks.

`encode_texts` runs the tokenizers library over white-space chunks and memoises them; for vocabularies
that drop white space the ids of a text are the ids of its chunks in order. Texts that hold the opening
of a special token are encoded whole.

The file form (`pack_shard`) is little-endian: a header, doc ids, a null mask, ids per document, word
offsets per block, escapes per block, then 64-bit words. A block of 512 ids has words of its own, whose
low four bits select how many ids of which width follow (60 x 1 bit ... 1 x 60 bits); selector 15 stands
for one id wider than 60 bits, which lies at the end of its block. Blocks decode independently and all
at once.

Null and empty texts have only the end id. Rows with a null doc_id come first and keep the null; repeated
rows are kept in any order among equals. Extra columns are ignored; an empty table makes no shards.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, persist, text_slices, worker_state

END_ID = 1
BLOCK = 512
#: Bytes of ids, before packing, of a part of a shard.
PART_BYTES = 3 << 18
#: Fixed values: (ids, bits) of each selector of the 60-bit payload.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQII")
PUNCTUATION = string.punctuation.encode()


# ---------------------------------------------------------------- ids of texts
class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, with a bounded memo of frequent chunks.

    New chunks of letters only are encoded many at a time: each is one word, whose last id is one that ends
    a word. They are lowered and composed here, so that only the vocabulary's merges are left to do. A run of
    ASCII punctuation after letters is a word of its own, of which there are few.
    """

    longest, together, at_once, most_marks = 64, 1000, 16, 1000

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads cost it more than they save
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for x, k in vocab.items() if x.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only."""
        out: list[bytes] = []
        parts = [words[k : k + self.together] for k in range(0, len(words), self.together)]
        joined = [" ".join(p).lower() for p in parts]
        encoder = self.merges if all(x.isascii() or is_normalized("NFC", x) and "\u03c3" not in x and "\u03c2" not in x for x in joined) else self.tokenizer
        # a few at once: an encoding takes far more room than its ids
        found = (np.array(x.ids, "<u4") for k in range(0, len(joined), self.at_once) for x in encoder.encode_batch_fast(joined[k : k + self.at_once], add_special_tokens=False))
        for part, ids in zip(parts, found, strict=True):
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(part) + 1 and cuts[-1] == len(data) else self._ids(part)
        return out

    def _new(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the memo lacks."""
        bare = [x.rstrip(PUNCTUATION) for x in chunks]
        texts = list(dict.fromkeys(bare))
        words = b" ".join(texts).decode("utf-8", "replace").split(" ")
        plain = [x.isalpha() for x in words]
        ids = dict(zip(compress(texts, plain), self._words(list(compress(words, plain))), strict=True))
        tails = list({c[len(b) :] for c, b in zip(chunks, bare, strict=True) if len(b) < len(c) and b in ids})
        found = {x: self.marks[x] for x in tails if x in self.marks}
        lacking = [x for x in tails if x not in found]
        made = dict(zip(lacking, self._ids([x.decode() for x in lacking]), strict=True))
        self.marks.update((x, made[x]) for x in lacking[: max(0, self.most_marks - len(self.marks))] if len(x) <= self.longest)
        found |= made | {b"": b""}
        other = [c for c, b in zip(chunks, bare, strict=True) if b not in ids]
        rest = dict(zip(other, self._ids([x.decode("utf-8", "replace") for x in other]), strict=True))
        return {c: ids[b] + found[c[len(b) :]] if b in ids else rest[c] for c, b in zip(chunks, bare, strict=True)}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        chunks: list[bytes] = []
        ends = [0]
        for x in texts:
            if b"<|" not in x:
                chunks += x.lower().split()
            ends.append(len(chunks))
        found = list(map(self.known.get, chunks))
        gaps = [k for k, x in enumerate(found) if x is None]
        if gaps:
            new = self._new(list({chunks[k] for k in gaps}))
            for k in gaps:
                found[k] = new[chunks[k]]
            room = self.most - len(self.known)
            self.known.update((x, ids) for x, ids in islice(new.items(), max(0, room)) if len(x) <= self.longest)
        return [b"".join(found[a:b]) if b"<|" not in x else self._ids([x.decode("utf-8", "replace")])[0] for x, a, b in zip(texts, ends, ends[1:], strict=False)]


def encode_texts(path: str, texts: list[bytes], end_id: int = END_ID, most: int = 600_000) -> list[bytes]:
    """Ids of each text with the end id, as bytes; one memo of at most `most` chunks per Python worker."""
    encoder = worker_state(("tokens", path, most), lambda: ChunkEncoder(path, most))
    end = np.array([end_id], "<u4").tobytes()
    return [x + end for x in encoder.encode(texts)]


# ---------------------------------------------------------------- Simple-8b
def _bit_lengths(x: np.ndarray) -> np.ndarray:
    """Bits of each integer, 16 at a time."""
    bits = _SHORT[(x & np.uint64(0xFFFF)).astype(np.uint16)]
    for shift in (16, 32, 48):
        part = x >> np.uint64(shift)
        if not part.any():
            break
        part = (part & np.uint64(0xFFFF)).astype(np.uint16)
        bits = np.where(part > 0, _SHORT[part] + np.uint8(shift), bits)
    return bits


_SHORT = np.concatenate([[0], np.floor(np.log2(np.arange(1, 1 << 16))) + 1]).astype(np.uint8)


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word offsets of each block and the end, escapes of each block, words) of unsigned integers."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(1, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    pad = SELECTORS[0][0]
    v = np.zeros((blocks, BLOCK + pad), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    v[:, :BLOCK] = full.reshape(blocks, BLOCK)
    flat, width = v.ravel(), v.shape[1]
    bits = _bit_lengths(flat)
    # the widest selector that fits at each place: if one fits, every selector of fewer ids does too
    choice = np.where(bits > 60, np.uint8(ESCAPE), np.uint8(len(SELECTORS) - 1))
    top, seen = bits.copy(), 1
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, wide = SELECTORS[s]
        while seen < count:
            np.maximum(top[:-seen], bits[seen:], out=top[:-seen])
            seen += 1
        fits = top <= wide
        if not fits.any():
            break
        choice[fits] = s
    per = np.ones(16, np.int64)
    per[: len(SELECTORS)] = [c for c, _ in SELECTORS]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    taken_block, taken_at, taken_step = [], [], []
    step = 0
    while len(live):
        place = live * width + at[live]
        taken_block.append(live)
        taken_at.append(place)
        taken_step.append(np.full(len(live), step))
        at[live] += per[choice[place]]
        live = live[at[live] < lengths[live]]
        step += 1
    owner, place, step_of = map(np.concatenate, (taken_block, taken_at, taken_step))
    order = np.lexsort((step_of, owner))
    owner, place = owner[order], place[order]
    sel = choice[place]
    words = sel.astype(np.uint64)
    for s, (count, wide) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        for j in range(count if len(mine) else 0):
            words[mine] |= flat[place[mine] + j] << np.uint64(4 + j * wide)
    escaped = np.flatnonzero(sel == ESCAPE)
    n_words, n_escapes = np.bincount(owner, minlength=blocks), np.bincount(owner[escaped], minlength=blocks)
    offsets = np.concatenate([[0], np.cumsum(n_words + n_escapes)])
    out = np.zeros(offsets[-1], np.uint64)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    out[offsets[owner] + np.arange(len(owner)) - first[owner]] = words
    if len(escaped):
        eo = owner[escaped]
        e_first = np.concatenate([[0], np.cumsum(n_escapes)])[:-1]
        out[offsets[eo] + n_words[eo] + np.arange(len(eo)) - e_first[eo]] = flat[place[escaped]]
    return offsets.astype(np.uint32), n_escapes.astype(np.uint32), out


def unpack_words(n: int, offsets: np.ndarray, escapes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The integers that pack_words was given."""
    blocks = len(escapes)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    offsets, escapes = offsets.astype(np.int64), escapes.astype(np.int64)
    owner = np.repeat(np.arange(blocks), np.diff(offsets))
    plain = np.arange(len(words)) < (offsets[1:] - escapes)[owner]
    w, owner_w = words[plain], owner[plain]
    sel = (w & np.uint64(15)).astype(np.int64)
    per = np.ones(16, np.int64)
    per[: len(SELECTORS)] = [c for c, _ in SELECTORS]
    count = per[sel]
    start = np.cumsum(count) - count
    first = np.searchsorted(owner_w, np.arange(blocks))
    place = owner_w * BLOCK + start - start[first][owner_w]
    end = np.minimum((owner_w + 1) * BLOCK, n)
    for s, (c, wide) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        mask = np.uint64((1 << wide) - 1)
        for j in range(c):
            to = place[mine] + j
            ok = to < end[mine]
            out[to[ok]] = (w[mine[ok]] >> np.uint64(4 + j * wide)) & mask
    out[place[sel == ESCAPE]] = words[~plain]
    return out


def pack_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One self-contained piece of a token file."""
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    offsets, escapes, words = pack_words(np.frombuffer(b"".join(ids), "<u4"))
    head = HEADER.pack(MAGIC, len(ids), int(lengths.sum()), BLOCK, len(escapes))
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(), lengths.tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of pack_shard's bytes."""
    magic, docs, n, block, blocks = HEADER.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token shard")
    at = HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, dtype, count, at)
        at += x.nbytes
        return x

    doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    offsets, escapes = take("<u4", blocks + 1), take("<u4", blocks)
    ids = unpack_words(n, offsets, escapes, take("<u8", int(offsets[-1])))
    return [None if z else int(x) for x, z in zip(doc_ids, nulls, strict=True)], lengths, ids.astype("<u4")


# ---------------------------------------------------------------- files
SHARD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])
FOUND = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of docs(doc_id, text) in ascending doc_id order; returns the written shards.

    A range partition is a shard, written in parts of about half a MB of packed words each.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        for batch, texts in text_slices(batches):
            ids, doc_ids = encode_texts(tokenizer, texts, end_id), batch.column("doc_id").to_pylist()
            ends = np.cumsum(list(map(len, ids)))
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], PART_BYTES), side="left")).tolist() + [len(ids)]
            cuts[0] = 0
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    yield {"shard": [shard], "part": [part], "n_ids": [sum(map(len, ids[lo:hi])) // 4], "data": [pack_shard(doc_ids[lo:hi], ids[lo:hi])]}
                    part += 1

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return persist(arrow_map(ordered, encode, SHARD), "snappy")  # the words are packed already


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the written shards."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for shard, part, data in zip(*(batch.column(k).to_pylist() for k in ("shard", "part", "data")), strict=True):
                doc_ids, lengths, ids = unpack_shard(data)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield {"shard": np.full(len(doc_ids), shard), "part": np.full(len(doc_ids), part), "doc_id": doc_ids, "within": starts, "n_tokens": lengths.astype(np.int64), "ids_crc32": crcs}

    sums = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    parts = shards.select("shard", "part", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")).alias("part_base"))
    places = persist(parts.join(bases, "shard").select("shard", "part", (F.col("base") + F.col("part_base")).alias("base")))
    found = arrow_map(shards.select("shard", "part", "data"), decode, FOUND)
    return found.join(places, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


