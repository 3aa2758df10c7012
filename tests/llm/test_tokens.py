import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftnet.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=1500))
def test_words_round_trip(values):
    ids = np.array(values, np.uint64)
    assert (tokens.unpack_words(len(ids), *tokens.pack_words(ids)) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_memo_equals_whole_texts(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    whole = [x.ids + [1] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_texts(PATH, [t.encode() for t in texts])] == whole


def test_punctuation_after_letters():
    """Letters with any run of ASCII punctuation after them are encoded with the other words, not one by one."""
    tails = ["", ",", "!!", "***", "$$$", "'", "'!", "..'", ",%%%", "<", "_-", '")']
    words = ["letters", "la\u00e8auxon", "\u03c3\u03bf\u03c6\u03cc\u03c2", "na\u0308chste", "don't", "7", "a=\u0338"]
    text = " ".join(w + x for w in words for x in tails)
    encoder, alone = tokens.ChunkEncoder(PATH), []
    whole, encoder._ids = encoder._ids, lambda texts: alone.extend(texts) or whole(texts)
    assert encoder.encode([text.encode()]) == whole([text]) == encoder.encode([text.encode()])
    assert not [x for x in alone if x.startswith(("letters", "la"))] and len(alone) == len(set(alone))


def brute(rows):
    t = Tokenizer.from_file(PATH)
    return [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in rows]


def test_files(spark, odd_docs):
    got = tokens.read_tokens(tokens.write_tokens(odd_docs, PATH)).collect()
    want, start = [], 0
    for doc_id, ids in sorted(brute(odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert tokens.read_tokens(tokens.write_tokens(odd_docs.limit(0), PATH)).collect() == []


def test_packing(spark, odd_docs):
    got = packing.pack(odd_docs, PATH, capacity=64).collect()
    want = []
    for doc_id, ids in brute(odd_docs.collect()):
        want += [(doc_id, k, 64 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids[i : i + 64] for i in range(0, len(ids), 64))]
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert check_bins(got, 64) == packing.lower_bound({n: sum(r["length"] == n for r in got) for n in {r["length"] for r in got}}, 64)
    assert packing.pack(odd_docs.limit(0), PATH).collect() == []


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 400) if seed % 2 else rng.integers(20, 71, 120)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
    patterns = packing.pack_counts(counts, 100)
    used = {}
    for filling, times in patterns:
        assert sum(s * k for s, k in filling) <= 100
        for s, k in filling:
            used[s] = used.get(s, 0) + k * times
    assert used == counts
    bins, least = sum(t for _, t in patterns), packing.lower_bound(counts, 100)
    assert least <= bins <= least + 1


def fewest(sizes, capacity):
    """The least number of bins, by trying all places of each piece."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                rooms[i] -= sizes[k]
                place(k + 1, rooms)
                rooms[i] += sizes[k]
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("low, high", [(1, 100), (26, 42), (18, 52), (34, 60)])
def test_bound_and_search_against_all_packings(low, high):
    rng = np.random.default_rng(low)
    for _ in range(12):
        sizes = sorted(rng.integers(low, high + 1, 10).tolist(), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        least = fewest(sizes, 100)
        assert packing.lower_bound(counts, 100) <= least == sum(t for _, t in packing.pack_counts(counts, 100))


@pytest.mark.parametrize("low, high, n, gap", [(1100, 1700, 3000, 0.02), (1100, 1700, 300_000, 0.02), (800, 2100, 2000, 0.015)])
def test_lengths_that_best_fit_packs_badly(low, high, n, gap):
    """About a tenth more sequences than the bound by best fit alone, a fiftieth after the search."""
    sizes, copies = np.unique(np.random.default_rng(1).integers(low, high + 1, n), return_counts=True)
    counts = dict(zip(sizes.tolist(), copies.tolist(), strict=True))
    patterns = packing.pack_counts(counts)
    assert all(sum(s * k for s, k in f) <= packing.CAPACITY for f, _ in patterns)
    used = {}
    for filling, times in patterns:
        for s, k in filling:
            used[s] = used.get(s, 0) + k * times
    assert used == counts
    assert sum(t for _, t in patterns) <= (1 + gap) * packing.lower_bound(counts, packing.CAPACITY)
