import hashlib

import numpy as np

from weftnet.llm import suffix_dedup as sd


def brute(rows):
    """By definition: the smallest doc_id of every 50-byte string."""
    last = 1 << 63
    rows = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in rows:
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], last + 1), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < d:
                gone[k : k + 50] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(t) else 0
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((None if d == last else d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdé \n")
    word = lambda n: "".join(rng.choice(letters, n))
    passages = [word(int(rng.integers(45, 200))) for _ in range(6)]
    rows = []
    for _ in range(150):
        t = word(int(rng.integers(0, 400)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(6))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2).tolist()) if rng.random() < 0.4 else (0, len(p))
            at = int(rng.integers(len(t) + 1))
            t = t[:at] + p[a:b] + t[at:]
        rows.append(t)
        if rng.random() < 0.3:
            c = list(t)
            for _ in range(int(rng.integers(0, 4))):
                if c:
                    c[int(rng.integers(len(c)))] = str(rng.choice(letters))
            rows.append("".join(c))
    rows += ["x" * 300, "y" + "x" * 200, "ab" * 100, "ab" * 60 + "c" + "ab" * 60, "z" * 49, "z" * 50, "z" * 50, "", None]
    order = rng.permutation(len(rows))
    out = [(int(3 * k), rows[i]) for k, i in enumerate(order)]
    return out + [out[5], out[9], (out[7][0], out[8][1]), (None, out[3][1]), (None, passages[0] * 2)]


def test_against_brute_force(spark, odd_docs):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, k long, sha256 string")
        assert sorted(map(tuple, sd.dedup(docs).collect()), key=str) == brute(rows)
    assert sorted(map(tuple, sd.dedup(odd_docs).collect()), key=str) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert sd.dedup(odd_docs.limit(0)).collect() == []


def test_loser_tree():
    rng = np.random.default_rng(0)
    for runs in (1, 2, 3, 7, 16):
        lists = [sorted({bytes(rng.integers(0, 3, sd.KEY).astype(np.uint8)[: sd.KEY - 10]) + bytes(10) for _ in range(int(rng.integers(0, 40)))}) for _ in range(runs)]
        if runs > 3:
            lists[2] = list(lists[1])
        source = []
        for x in lists:
            shared, rest = sd.front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, sd.KEY))
            data = sd._pack(np.array([len(x)], "<u4"), np.zeros(len(x), "<i8"), shared, rest)
            source.append(sd.read_run(data)[1])
        got = list(sd.LoserTree(source))
        keys = [k for *_, k in got]
        assert keys == sorted(k for x in lists for k in x)
        for (_, m, b), a in zip(got[1:], keys, strict=False):
            assert m == next((k for k in range(sd.KEY) if a[k] != b[k]), sd.KEY)


def test_minimisers_meet():
    """Every 50-byte string has a minimiser, at the same place wherever the string stands."""
    rng = np.random.default_rng(1)
    core = bytes(rng.integers(97, 100, 50).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, int(rng.integers(0, 90))).astype(np.uint8)) + core + bytes(rng.integers(97, 123, 40).astype(np.uint8)) for _ in range(20)]
    text, place, _ = sd.Minimisers()(texts)
    offsets = []
    for k, t in enumerate(texts):
        at = t.index(core)
        offsets.append({int(p) - at for p in place[text == k] if at <= p <= at + 30})
    assert set.intersection(*offsets)
