import zlib

import numpy as np
import pytest

from weftnet.llm import quality, toxicity


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    n = y.sum()
    return (rank[y].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of two qualities, some with words that only toxic texts have."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(500)]
    bad = ["zog", "vexik", "brukk"]
    rows, labels = [], []
    for k in range(700):
        words = list(rng.choice(vocabulary, rng.integers(5, 120)))
        good, toxic = k % 3 > 0, k % 5 == 0
        if toxic:
            words[int(rng.integers(len(words)))] = bad[k % 3]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" if k % 2 else w + "$%#" for w in words)
        rows.append((k, text, "en"))
        labels.append((k, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "x", "en"), (9000, None, None), (9001, "", "en"), (9001, "", "en")], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize("module, column, least", [(quality, 1, 0.95), (toxicity, 2, 0.95)])
def test_held_out(corpus, module, column, least):
    docs, labels, rows = corpus
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= (0.3 if module is quality else 0.5)) for r in got)
    scores = {r["doc_id"]: r["score"] for r in got if r["held_out"]}
    y = {r[0]: r[column] for r in rows}
    ids = [k for k in scores if k in y]
    assert auc(np.array([y[k] for k in ids], bool), np.array([scores[k] for k in ids])) > least
    assert module.classify(docs, labels.limit(0)).count() == len(got)
    assert module.classify(docs.limit(0), labels).collect() == []


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 0, 3, 2, 5]), np.array([2.0, 2, 4, 4, 5]))
    assert np.allclose(got, [0.25, 0.25, 0.625, 0.625, 1])


def inputs(net, words):
    return net.inputs(net.rows_of(words), toxicity.Grams(words))


def test_gradients():
    """Backpropagation against finite differences."""
    net = toxicity.Network({b"a": 1, b"b": 2}, np.array([0.5, -0.5]))
    index, lengths, y = np.array([[0, 1, 2, 1], [2, 2, 0, 0]]), np.array([4, 2]), np.array([1.0, 0])
    vectors = inputs(net, [b"zz", b"a", b"b"])
    _, grad, d_v = net.learn(vectors, index, lengths, y, np.ones(2))
    for name, g in grad.items():
        p = net.p[name].reshape(-1)
        for k in (0, len(p) // 2, len(p) - 1):
            kept, p[k] = p[k], p[k] + 1e-5
            up = net.learn(vectors, index, lengths, y, np.ones(2))[0]
            p[k] = kept - 1e-5
            down = net.learn(vectors, index, lengths, y, np.ones(2))[0]
            p[k] = kept
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-6
    vectors[1, 3] += 1e-5
    up = net.learn(vectors, index, lengths, y, np.ones(2))[0]
    vectors[1, 3] -= 2e-5
    assert abs((up - net.learn(vectors, index, lengths, y, np.ones(2))[0]) / 2e-5 - d_v[1, 3]) < 1e-6


def test_scoring_equals_training_pass():
    net = toxicity.Network({b"a": 1, b"b": 2}, np.array([0.5, -0.5]))
    words = [b"zz", b"a", b"b", b"q1"]
    index, lengths = np.array([[0, 1, 2, 3], [2, 2, 0, 0]]), np.array([4, 2])
    table = net.projections(words)
    vectors = inputs(net, words)
    logit = net.logits(table, index, lengths)
    for k in range(2):
        loss = net.learn(vectors, index[k : k + 1], lengths[k : k + 1], np.ones(1), np.ones(1))[0]
        assert abs(np.log1p(np.exp(-logit[k])) - loss) < 1e-4


def test_windows_cover():
    counts = np.array([0, 1, 24, 25, 36, 37, 100])
    text, first, length = toxicity.windows(counts)
    for k, n in enumerate(counts):
        mine = text == k
        seen = {p for a, m in zip(first[mine], length[mine]) for p in range(a, a + m)}
        assert seen == set(range(n)) and mine.any()


def test_unspaced_text_is_read_to_its_end():
    """Toxic wording late in a text without ASCII blanks moves the score."""
    rng = np.random.default_rng(5)
    signs = [chr(0x4E00 + 7 * k) for k in range(200)]
    texts, toxic = [], np.arange(600) % 3 == 0
    for y in toxic:
        t = list(rng.choice(signs, rng.integers(150, 400)))
        at = int(rng.integers(100, len(t)))
        texts.append("".join(t[:at] + list("毒骂恶贱") * bool(y) + t[at:]).encode())
    scorer = toxicity.Scorer(toxicity.train(texts[:450], toxic[:450]))
    assert auc(toxic[450:], scorer(texts[450:])) > 0.95
    for text in ("漢字\u3000" * 300, "wort\u00a0" * 300, "x" * 3000):
        a, b = (scorer([t.encode()])[0] for t in (text, text[:-40] + "毒骂恶贱" * 3 + text[-40:]))
        assert a != b
    whole = "".join(signs).encode()
    assert b"".join(toxicity.words_of(whole)) == whole and max(map(len, toxicity.words_of(whole))) <= toxicity.LONGEST
    assert b"".join(toxicity.words_of(b"\x80" * 100)) == b"\x80" * 100
    assert toxicity.words_of("a\u00a0B\u3000c".encode()) == [b"a", b"b", b"c"]


def grams_of(word):
    """Buckets of a word's n-grams, byte by byte."""
    w, out = b"<%b>" % word, []
    for n in toxicity.GRAMS:
        for k in range(len(w) - n + 1):
            h = 0
            for b in w[k : k + n]:
                h = (h * 16777619 ^ b) & 0xFFFFFFFF
            h = ((h ^ (n * 2654435 & 0xFFFF)) * 2246822519) & 0xFFFFFFFF
            out.append((h >> 12) % toxicity.CHAR_BUCKETS)
    return out or [0]


def test_grams():
    """Means and gradients of trigram vectors equal those word by word."""
    rng = np.random.default_rng(1)
    words = [b"", b"a", b"abc", b"abcabcabc", b"zebra"]
    grams, vectors = toxicity.Grams(words), rng.normal(size=(toxicity.CHAR_BUCKETS, 3))
    assert np.allclose(grams.means(vectors), [vectors[grams_of(w)].mean(0) for w in words])
    pick = np.array([3, 1, 4])
    assert np.allclose(grams.some(pick).means(vectors), grams.means(vectors)[pick])
    d, want = rng.normal(size=(3, 3)), np.zeros_like(vectors)
    for g, k in zip(d, pick, strict=True):
        for gram in grams_of(words[k]):
            want[gram] += g / len(grams_of(words[k]))
    assert np.allclose(grams.some(pick).spread(d, toxicity.CHAR_BUCKETS), want)


def slow_logit(net, words):
    """One window's logit, step by step, from the definition."""
    p, h = net.p, toxicity.HIDDEN
    x = []
    for w in words:
        x.append(np.concatenate([p["word"][net.vocabulary.get(w, 0)], p["char"][grams_of(w)].mean(0)]))
    states = {}
    for way in "fb":
        s, out = np.zeros(h), {}
        for k in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g, u = x[k] @ p["x" + way] + p["c" + way], p["u" + way]
            z = 1 / (1 + np.exp(-(g[:h] + s @ u[:, :h])))
            r = 1 / (1 + np.exp(-(g[h : 2 * h] + s @ u[:, h : 2 * h])))
            c = np.tanh(g[2 * h :] + r * (s @ u[:, 2 * h :]))
            s = (1 - z) * c + z * s
            out[k] = s
        states[way] = out
    both = [np.concatenate([states["f"][k], states["b"][k]]) for k in range(len(x))]
    a = np.exp([b @ p["query"] for b in both])
    return float(sum(w * b for w, b in zip(a / a.sum(), both, strict=True)) @ p["out"] + p["bias"][0])


def test_query_equals_a_slow_twin(corpus):
    """Every row's score from a network fitted on the same sample, window by window and step by step."""
    docs, labels, _ = corpus
    net, slope, shift = toxicity.fit(*toxicity.sample(docs, labels))
    got = toxicity.classify(docs, labels).collect()
    texts = sorted(((str(r["doc_id"]), r["text"]) for r in docs.collect()), key=str)
    want = []
    for doc_id, text in texts[::5] + texts[-5:]:
        words = toxicity.words_of((text or "").encode())
        ends = range(min(toxicity.WINDOW, len(words)), len(words) + 1)
        best = max(slow_logit(net, words[max(0, e - toxicity.WINDOW) : e] or [b""]) if words else net.logits(np.zeros((2, 1, 3 * toxicity.HIDDEN), np.float32), np.zeros((1, toxicity.WINDOW), int), np.array([0]))[0] for e in ends)
        want.append((doc_id, 1 / (1 + np.exp(-(slope * best + shift)))))
    scores = {}
    for r in got:
        scores.setdefault(str(r["doc_id"]), []).append(r["score"])
    assert want and all(min(abs(x - s) for x in scores[d]) < 1e-4 for d, s in want)


def test_every_start_equals_single_windows():
    """Windows that step together have the logits of windows taken one by one, whatever the chunk."""
    rng = np.random.default_rng(0)
    net = toxicity.Network({b"a": 1, b"b": 2}, np.array([0.5, -0.5]))
    for p in net.p.values():
        p += rng.normal(0, 0.5, p.shape)
    table, rows, width = net.projections([b"zz", b"a", b"b", b"q1"]), rng.integers(0, 4, 300), toxicity.WINDOW
    want = net.logits(table, rows[np.arange(300 - width + 1)[:, None] + np.arange(width)], np.full(300 - width + 1, width))
    for size in (7, 289, 1000):
        assert np.abs(net.every(table, rows, size=size) - want).max() < 1e-4
    assert len(net.every(table, rows[: width - 1])) == 0


def test_short_passages_are_found_wherever_they_stand():
    """Passages of three words whose order is toxic, at every place of clean texts, some near their ends."""
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), rng.integers(3, 9))) for _ in range(300)]
    texts, toxic = [], np.arange(900) % 3 == 0
    for k, y in enumerate(toxic):
        words = list(rng.choice(vocabulary, 20 + k % 60))
        at = int(rng.integers(len(words) + 1))
        texts.append(" ".join(words[:at] + ["zog", "vexik", "brukk"] * bool(y) + words[at:]).encode())
    scorer = toxicity.Scorer(toxicity.train(texts, toxic))
    plain = [" ".join(rng.choice(vocabulary, 60)).encode() for _ in range(60)]
    planted = []
    for k, x in enumerate(plain):
        words = x.split()
        planted.append(b" ".join(words[:k] + [b"zog", b"vexik", b"brukk"] + words[k:]))
    cut = scorer(plain).max()
    assert (scorer(planted) > cut).mean() >= 0.95
    slow = [scorer([x])[0] for x in planted[:20]]
    assert np.allclose(scorer(planted)[:20], slow, atol=1e-4)  # neighbours in a slice don't matter


def test_sample_is_bounded(corpus, monkeypatch):
    docs, labels, _ = corpus
    whole = toxicity.sample(docs, labels)[0]
    monkeypatch.setattr(toxicity, "MOST_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "MOST_TEXT", 500)
    some = toxicity.sample(docs.union(docs), labels)[0]
    assert len(whole) > len(some) > 20 and sum(map(len, some)) <= 20_000 and max(map(len, some)) <= 500


def test_quality_equals_a_plain_twin(corpus):
    """The whole path in one process: one matrix of features, one solve, isotonic rates by the min-max formula."""
    docs, labels, _ = corpus
    got = quality.classify(docs, labels).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    marks = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            marks.setdefault(r["doc_id"], []).append(r["quality"])
    x = np.array([quality.statistics(t.encode()) for _, t in rows], np.float32).astype(float)
    rest = np.array([zlib.crc32(str(d).encode()) % quality.FOLDS if d is not None else -1 for d, _ in rows])
    known = np.array([d in marks and f != quality.HELD_OUT for (d, _), f in zip(rows, rest, strict=True)])
    y = np.array([np.mean(marks.get(d, [0])) for d, _ in rows])
    mean, scale = x[known].mean(0), x[known].std(0)
    rng = np.random.default_rng(quality.SEED)
    project = rng.normal(0, 1 / (quality.WIDTH * np.sqrt(x.shape[1])), (x.shape[1], quality.FOURIER))
    phase = rng.uniform(0, 2 * np.pi, quality.FOURIER)
    z = np.clip((x - mean) / np.where(scale > 1e-6, scale, 1), -4, 4)
    f = np.hstack([np.cos(z @ project + phase) * np.sqrt(2 / quality.FOURIER), z / 10, np.ones((len(x), 1))])
    fitted, held = known & (rest != quality.CALIBRATION), known & (rest == quality.CALIBRATION)
    w = np.linalg.solve(f[fitted].T @ f[fitted] + quality.RIDGE * known.sum() / f.shape[1] * np.eye(f.shape[1]), f[fitted].T @ y[fitted])
    raw = f @ w
    bins = np.clip(((raw + 1) / 3 * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(bins[held])
    n = np.array([(bins[held] == b).sum() for b in used], float)
    wins, at = (np.array([v[held][bins[held] == b].sum() for b in used]) for v in (y, raw))
    rate = lambda i, j: (wins[i : j + 1] + 0.01).sum() / (n[i : j + 1] + 0.02).sum()
    level = [max(min(rate(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    score = 0.998 * np.interp(raw, at / n, level) + 0.002 / (1 + np.exp(-4 * (raw - 0.5)))
    want = sorted((str(d), round(float(s), 4)) for (d, _), s in zip(rows, score, strict=True))
    assert np.allclose([s for _, s in want], [s for _, s in sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got)], atol=2e-3)
