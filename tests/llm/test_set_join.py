import re

import numpy as np

from weftnet.llm import set_join, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    n, up = len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)]) for i in range(n))


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = list(rng.choice(vocabulary, 60))
    rows = []
    for _ in range(120):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 150))))
        if rng.random() < 0.4:
            at = int(rng.integers(len(base) + 1))
            base[at:at] = passage
        rows.append(base)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(copy) // 20) + 1))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append(copy)
    hot = list(rng.choice(vocabulary, 200))
    for _ in range(150):
        copy = list(hot)
        for _ in range(int(rng.integers(0, 9))):
            copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
        rows.append(copy)
    order = rng.permutation(len(rows))
    return [(int(k), " ".join(w.upper() if rng.random() < 0.1 else w for w in rows[i])) for k, i in enumerate(order)]


def test_against_brute_force(spark, odd_docs):
    rows = corpus(1) + [(9001, ""), (9002, None), (9003, " \n\t"), (9004, "one two"), (9005, "ONE\ttwo"), (9006, "a b c d e"), (9007, "a b c d e f"), (9007, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, k string, n int")
    got = sorted(map(tuple, set_join.join(docs).collect()))
    assert got == brute(rows)
    odd = set_join.join(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {(r["doc_id"], r["component_id"]) for r in odd} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None)}
    assert set_join.join(odd_docs.limit(0)).collect() == []


def test_hashed_sets():
    texts = ["", "a", "a b c d", "a b c d e", "A b\tC d e f", "é à b c d e é à b c d e é à b c d e", "x " * 50]
    sets = shingles.Hasher().sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert set(sets[3].tolist()) < set(sets[4].tolist())


def test_list_pairs_lose_nothing():
    rng = np.random.default_rng(2)
    n = np.sort(rng.integers(10, 60, 300))
    at, comp, f = rng.integers(0, 5, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300)
    got = {(int(i), int(j)) for x, y in set_join._list_pairs(comp, n, f, at) for i, j in zip(x, y, strict=True)}
    room = lambda i, j: min(at[i], at[j]) + min((n - f - at)[i], (n - f - at)[j]) + min(f[i], f[j])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if comp[i] != comp[j] and 100 * n[i] >= 75 * n[j] and 175 * room(i, j) >= 75 * (n[i] + n[j])}
    assert got == want


def passages(seed, many):
    """Texts of which one of two passages, whole, cut or edited, is 60 to 100 %, and some without."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(50000)]
    kept = [list(rng.choice(vocabulary, 80)), list(rng.choice(vocabulary, 40))]
    rows = []
    for _ in range(many):
        part = list(kept[int(rng.integers(2))])
        if rng.random() < 0.3:
            part = part[: int(rng.integers(20, len(part)))]
        if rng.random() < 0.3:
            part[int(rng.integers(len(part)))] = str(rng.choice(vocabulary))
        around = list(rng.choice(vocabulary[:300] if rng.random() < 0.5 else vocabulary, int(len(part) * rng.choice([0, 0.05, 0.1, 0.2, 0.3, 0.6]))))
        at = int(rng.integers(len(around) + 1))
        rows.append(around[:at] + part + around[at:])
    rows += [list(rng.choice(vocabulary, 30)) for _ in range(many // 10)]
    return [(k, " ".join(map(str, r))) for k, r in enumerate(rows)]


def test_texts_that_are_mostly_a_passage(spark):
    rows = passages(5, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({x for *_, x in want}) > 100  # many groups that only partly unite
    for options in ({"sample": 1, "common": 2, "frequent": 4}, {"sample": 1, "common": 2, "frequent": 40}, {"sample": 2, "common": 1, "frequent": 1}):
        assert sorted(map(tuple, set_join.join(docs, **options).collect())) == want, options


def test_core_links_in_blocks(spark):
    rng = np.random.default_rng(3)
    cores = []
    for k in range(150):
        core = np.unique(rng.choice(60 if k % 3 else 3000, int(rng.integers(20, 50)))).astype(np.uint64)
        cores.append((k, int(len(core) + rng.integers(0, 6)), core.tobytes()))
    cores += [(k + 200, n, c) for k, n, c in cores[:40]]
    cores = [c for c in cores if 100 * len(c[2]) // 8 >= 75 * c[1]]
    frame = spark.createDataFrame(cores, "k long, n int, core binary")
    got = {(min(r), max(r)) for r in map(tuple, set_join.core_links(frame, block=16).collect())}
    sets = {k: (n, set(np.frombuffer(c, np.uint64).tolist())) for k, n, c in cores}
    want = {(a, b) for a in sets for b in sets if a < b and 175 * len(sets[a][1] & sets[b][1]) >= 75 * (sets[a][0] + sets[b][0])}

    def roots(edges):
        up = {k: k for k in sets}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[max(find(a), find(b))] = min(find(a), find(b))
        return {k: find(k) for k in sets}

    assert want and roots(got) == roots(want)


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (3, "x y", 7, 8, 9), (3, "z", 7, 8, 9), (None, "q", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, nth int, k int")
    kept = set_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
