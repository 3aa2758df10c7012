"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a learned vector of the word (for the words that training kept) and the mean of learned
vectors of its hashed character n-grams. Two gated recurrent passes, one each way, read every window of
`WINDOW` words of a text, whatever word it starts at; attention pools their states into one logit per window,
and a text's score comes from its highest window. Training picks its windows among those that start at every second word.
The network is trained on the driver on a bounded sample of labelled rows (`MOST_TOXIC`,
`MOST_CLEAN`, `MOST_BYTES` in all, none longer than `MOST_TEXT`; of rows with one doc_id the first by text),
where a text stands for its highest window (multiple-instance learning), and calibrated on a
part of that sample with weights that restore the share of toxic rows. Scoring goes over all windows of all
whole texts; labels, lang, source and doc_id are no inputs. Words part at ASCII blanks and punctuation and at
Unicode blanks; a word of more than `LONGEST` bytes (text written without blanks) becomes consecutive pieces
that are words of their own, so windows slide over all of it.

Null and empty texts are one empty window. Labels that are null are ignored; a document with several labels
is toxic if most of them say so. Rows with a null doc_id are scored, never trained on, never held out.
Without labels of both kinds every score is 0. Extra columns are ignored by `classify` and kept as they are by
`drop_toxic`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, release, text_slices, worker_state
from weftnet.llm.quality import HELD_OUT, fold, labelled

#: Most labelled rows that training reads of each kind.
MOST_TOXIC, MOST_CLEAN = 2500, 3500
#: Most bytes of all texts that training reads, and of one.
MOST_BYTES, MOST_TEXT = 24 << 20, 256 << 10
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 6, 1 << 14
#: Bytes of the character n-grams, borders of words included.
GRAMS = (3, 4, 5, 6)
WINDOW, APART = 12, 2
MOST_WORDS, LEAST_DOCS = 4000, 3
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.02, 11
THRESHOLD = 0.5
MOST_KNOWN = 150_000

#: Word bytes are ASCII letters and digits and anything beyond ASCII; A-Z are lowered.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


#: Blanks beyond ASCII, which part words as ASCII blanks do.
BLANKS = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Words of more bytes than LONGEST are cut into pieces of at most 12 bytes, between UTF-8 characters where they are whole.
LONGEST = 40
PIECE = re.compile(rb".{1,12}(?![\x80-\xbf])|.{1,12}", re.DOTALL)


def words_of(text: bytes) -> list[bytes]:
    words = (text if text.isascii() else BLANKS.sub(b" ", text)).translate(TABLE).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [x for w in words for x in (PIECE.findall(w) if len(w) > LONGEST else (w,))]


class Grams:
    """The buckets of many words' character n-grams, flat, with where each word's begin; a word has one at least."""

    def __init__(self, words: list[bytes]) -> None:
        sizes, parts = [np.zeros(0, np.int32)], [np.zeros(0, np.uint16)]
        for k in range(0, len(words), 10_000):
            size, flat = _hashed(words[k : k + 10_000])
            sizes.append(size)
            parts.append(flat)
        self.size = np.concatenate(sizes)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.flat = np.concatenate(parts)

    def some(self, words: np.ndarray) -> "Grams":
        """Those of the words with these numbers."""
        out = object.__new__(Grams)
        out.size = self.size[words]
        out.start = np.cumsum(out.size, dtype=np.int64) - out.size
        out.flat = self.flat[np.repeat(self.start[words] - out.start, out.size) + np.arange(out.size.sum())]
        return out

    def means(self, vectors: np.ndarray) -> np.ndarray:
        return np.add.reduceat(vectors[self.flat], self.start) / self.size[:, None] if len(self.size) else np.zeros((0, vectors.shape[1]))

    def spread(self, grads: np.ndarray, buckets: int) -> np.ndarray:
        """Gradients of the n-gram vectors from those of the means."""
        each = np.repeat(grads / self.size[:, None], self.size, axis=0)
        return np.stack([np.bincount(self.flat, each[:, k], buckets) for k in range(grads.shape[1])], 1)


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each of some words has, and their buckets."""
    raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint32)
    long = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), long)
    room = np.cumsum(long)[word] - np.arange(len(raw))  # bytes to the end of the word
    hashed, owner, held = [], [], np.zeros(len(raw), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        held = held[: len(raw) - n + 1] * np.uint32(16777619) ^ raw[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room[: len(held)] >= n)
            h = (held[at] ^ np.uint32(n * 2654435 & 0xFFFF)) * np.uint32(2246822519)
            hashed.append((h >> np.uint32(12)) % np.uint32(CHAR_BUCKETS))
            owner.append(word[at])
    for k in np.flatnonzero(long < min(GRAMS)):  # the empty word
        hashed.append(np.zeros(1, np.uint32))
        owner.append(np.array([k]))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=len(words)).astype(np.int32), np.concatenate(hashed)[order].astype(np.uint16)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# ---------------------------------------------------------------- the network
def _halved(u: np.ndarray) -> np.ndarray:
    """The matrix that gives u @ s from (1 - s) / 2 with a row of ones below."""
    return np.hstack([-2 * u, u.sum(1, keepdims=True)])


class Network:
    """Weights and passes. Gates are in the order update, reset, candidate."""

    def __init__(self, vocabulary: dict[bytes, int], prior: np.ndarray, grams: np.ndarray | None = None, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        d = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.p = {
            "word": rng.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM)),
            "query": rng.normal(0, 0.5, 2 * HIDDEN), "out": rng.normal(0, 0.5, 2 * HIDDEN), "bias": np.zeros(1),
        }
        self.p["word"][1:, 0] = prior
        self.p["word"][0] = 0
        if grams is not None:
            self.p["char"][:, 0] = grams
        for way in "fb":
            self.p["x" + way] = rng.normal(0, 1 / np.sqrt(d), (d, 3 * HIDDEN))
            self.p["u" + way] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
            self.p["c" + way] = np.zeros(3 * HIDDEN)

    def inputs(self, rows: np.ndarray, grams: "Grams") -> np.ndarray:
        """Vectors of words with these word rows and n-grams."""
        return np.hstack([self.p["word"][rows], grams.means(self.p["char"])])

    def projections(self, words: list[bytes]) -> np.ndarray:
        """Both passes' gate inputs of distinct words, for scoring."""
        return self.projected(self.rows_of(words), Grams(words))

    def projected(self, rows: np.ndarray, grams: "Grams") -> np.ndarray:
        v = self.inputs(rows, grams)
        return np.stack([v @ self.p["x" + way] + self.p["c" + way] for way in "fb"]).astype(np.float32)

    def rows_of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    # -- training: forward and backward over windows of word indices (n, t) and lengths
    def learn(self, vectors: np.ndarray, index: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        p, h = self.p, HIDDEN
        n, t = index.shape
        mask = (np.arange(t) < lengths[:, None]).astype(float)
        x = vectors[index]
        states, kept = [], {}
        for way in "fb":
            g = x @ p["x" + way] + p["c" + way]
            s, out, steps = np.zeros((n, h)), np.zeros((n, t, h)), []
            for k in range(t) if way == "f" else range(t - 1, -1, -1):
                m = mask[:, k, None]
                zr = sigmoid(g[:, k, : 2 * h] + s @ p["u" + way][:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                un = s @ p["u" + way][:, 2 * h :]
                c = np.tanh(g[:, k, 2 * h :] + r * un)
                to = m * ((1 - z) * c + z * s) + (1 - m) * s
                steps.append((k, s, z, r, un, c, m))
                s = to
                out[:, k] = s
            states.append(out)
            kept[way] = steps
        both = np.concatenate(states, 2)
        e = np.where(mask > 0, both @ p["query"], -30)
        a = np.exp(e - e.max(1, keepdims=True)) * np.maximum(mask, 1e-9)
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * both).sum(1)
        logit = pooled @ p["out"] + p["bias"]
        prob = sigmoid(logit)
        loss = -float((weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())
        d = weight * (prob - y) / weight.sum()
        grad = {"out": d @ pooled, "bias": np.array([d.sum()])}
        d_pool = d[:, None] * p["out"]
        d_a = (both * d_pool[:, None]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d_both = a[:, :, None] * d_pool[:, None] + d_e[:, :, None] * p["query"]
        grad["query"] = (d_e[:, :, None] * both).sum((0, 1))
        d_x = np.zeros_like(x)
        for w, way in enumerate("fb"):
            d_out, carry = d_both[:, :, w * h : (w + 1) * h], np.zeros((n, h))
            u = p["u" + way]
            d_g, d_u = np.zeros((n, t, 3 * h)), np.zeros_like(u)
            for k, s, z, r, un, c, m in reversed(kept[way]):
                top = carry + d_out[:, k]
                d_c = m * top * (1 - z) * (1 - c**2)
                d_z = m * top * (s - c) * z * (1 - z)
                d_r = d_c * un * r * (1 - r)
                carry = top * (m * z + 1 - m) + np.hstack([d_z, d_r]) @ u[:, : 2 * h].T + (d_c * r) @ u[:, 2 * h :].T
                d_u[:, : 2 * h] += s.T @ np.hstack([d_z, d_r])
                d_u[:, 2 * h :] += s.T @ (d_c * r)
                d_g[:, k] = np.hstack([d_z, d_r, d_c])
            grad["u" + way] = d_u
            grad["x" + way] = np.tensordot(x, d_g, ((0, 1), (0, 1)))
            grad["c" + way] = d_g.sum((0, 1))
            d_x += d_g @ p["x" + way].T
        flat = d_x.reshape(-1, d_x.shape[2])
        d_v = np.stack([np.bincount(index.ravel(), flat[:, k], len(vectors)) for k in range(flat.shape[1])], 1)
        return loss, grad, d_v

    # -- scoring
    def logits(self, table: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits of windows: gate inputs by pass and word row, word rows (n, t), lengths."""
        h, p = HIDDEN, {k: self.p[k].astype(np.float32) for k in ("uf", "ub", "query", "out", "bias")}
        n, t = index.shape
        both = np.empty((t, n, 2 * h), np.float32)
        ragged = bool((lengths < t).any())
        for w, way in enumerate("fb"):
            half = table[w]
            u = p["u" + way]
            s = np.zeros((n, h), np.float32)
            for k in range(t) if way == "f" else range(t - 1, -1, -1):
                g = half[index[:, k]]
                su = s @ u
                zr = g[:, : 2 * h] + su[:, : 2 * h]
                np.negative(zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                c = zr[:, h:] * su[:, 2 * h :]
                c += g[:, 2 * h :]
                c *= 2
                np.exp(c, out=c)
                c += 1
                np.reciprocal(c, out=c)
                c *= -2
                c += 1
                to = c + zr[:, :h] * (s - c)
                s = np.where((k < lengths)[:, None], to, s) if ragged else to
                both[k, :, w * h : (w + 1) * h] = s
        e = both @ p["query"]
        if ragged:
            e[np.arange(t)[:, None] >= lengths] = -30
        a = np.exp(e - e.max(0))
        if ragged:
            a *= np.maximum(np.arange(t)[:, None] < lengths, np.float32(1e-9))
        a /= a.sum(0)
        return (a * (both @ p["out"])).sum(0) + p["bias"]


    def every(self, table: np.ndarray, rows: np.ndarray, width: int = WINDOW, size: int = 2048) -> np.ndarray:
        """Logits of the windows at every start of a run of word rows, each with states of its own.

        The windows of a chunk take their steps together, so a step's gate inputs are one slice of the chunk's.
        States are held as (1 - state) / 2 with a row of ones below, so that signs and scales are in the weights.
        """
        h, out = HIDDEN, np.empty(max(0, len(rows) - width + 1), np.float32)
        sign = np.repeat(np.float32([-1, -1, 2]), h)[:, None]  # of update and reset, of the candidate
        steps = [_halved(self.p["u" + way].T.astype(np.float32) * sign) for way in "fb"]
        read = [_halved(np.stack([self.p[k][w * h : (w + 1) * h] for k in ("query", "out")]).astype(np.float32)) for w in range(2)]
        for at in range(0, len(out), size):
            n = min(size, len(out) - at)
            part = rows[at : at + n + width - 1]
            seen = np.zeros((width, 2, n), np.float32)  # attention and output of each step's states
            su, zr, q, one = (np.empty((k, n), np.float32) for k in (3 * h, 2 * h, h, 2))
            for w in range(2):
                g = table[w][part].T * sign
                s = np.full((h + 1, n), 0.5, np.float32)
                s[h] = 1
                half = s[:h]
                for k in range(width) if w == 0 else range(width - 1, -1, -1):
                    np.matmul(steps[w], s, out=su)
                    np.add(su[: 2 * h], g[: 2 * h, k : k + n], out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[h:], su[2 * h :], out=q)
                    q += g[2 * h :, k : k + n]
                    np.exp(q, out=q)
                    q += 1
                    np.reciprocal(q, out=q)
                    half -= q
                    half *= zr[:h]
                    half += q
                    np.matmul(read[w], s, out=one)
                    seen[k] += one
            a = np.exp(seen[:, 0] - seen[:, 0].max(0))
            out[at : at + n] = (a * seen[:, 1]).sum(0) / a.sum(0)
        return out + np.float32(self.p["bias"][0])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of the windows that training looks at, of texts with so many words."""
    per = np.maximum(1, -(-(counts - WINDOW) // APART) + 1)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = np.maximum(0, np.minimum(nth * APART, counts[text] - WINDOW))
    return text, first, np.minimum(WINDOW, counts[text])


class Scorer:
    """Highest window logits of texts, with a bounded memo of frequent words' gate inputs."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((2, 1, 3 * HIDDEN), np.float32)

    def __call__(self, texts: list[bytes], size: int = 2048) -> np.ndarray:
        words: list[bytes] = []
        ends = [0]
        for x in texts:
            words += words_of(x)
            ends.append(len(words))
        found = list(map(self.known.get, words))
        gaps = [k for k, x in enumerate(found) if x is None]
        table = self.table
        if gaps:
            new = {w: table.shape[1] + k for k, w in enumerate(dict.fromkeys(words[k] for k in gaps))}
            for k in gaps:
                found[k] = new[words[k]]
            table = np.concatenate([table, self.net.projections(list(new))], 1)
            room = MOST_KNOWN - len(self.known)
            if room > 0:
                self.known.update(list(new.items())[:room])
                self.table = table[:, : len(self.known) + 1].copy()
        rows = np.array(found, np.int64)
        counts, best = np.diff(ends), np.full(len(texts), -np.inf)
        short = np.flatnonzero(counts < WINDOW)
        if len(short):
            index = np.zeros((len(short), WINDOW), np.int64)
            for k, t in enumerate(short):
                index[k, : counts[t]] = rows[ends[t] : ends[t + 1]]
            best[short] = self.net.logits(table, index, counts[short])
        whole = np.flatnonzero(counts >= WINDOW)
        if len(whole):
            run = rows[np.repeat(counts >= WINDOW, counts)]
            level = np.concatenate([self.net.every(table, run, WINDOW, size), np.full(1, -np.inf, np.float32)])
            first = np.cumsum(counts[whole]) - counts[whole]
            # windows across two texts lie between the pairs of bounds
            bounds = np.stack([first, first + counts[whole] - WINDOW + 1], 1).ravel()
            best[whole] = np.maximum.reduceat(level, bounds)[::2]
        return best


# ---------------------------------------------------------------- training
def _gram_odds(grams: Grams, kinds: list[list[np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Damped log odds of toxic texts by the buckets of their words' n-grams, to start from."""
    clean, bad = np.zeros(CHAR_BUCKETS), np.zeros(CHAR_BUCKETS)
    for counts, texts in zip((clean, bad), kinds, strict=True):
        for words in texts:
            counts[np.unique(grams.some(words).flat)] += 1
    held = clean + bad
    odds = (np.log((bad + 0.5) / (toxic.sum() + 2)) - np.log((clean + 0.5) / ((~toxic).sum() + 2))) * held / (held + 8)
    odds[held < LEAST_DOCS] = 0
    return np.clip(odds, -3, 6) / 2


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Fit the network; each text stands for its highest window under the network so far."""
    rng = np.random.default_rng(SEED)
    number: dict[bytes, int] = {b"": 0}
    parts, kinds = [], [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
    for x, y in zip(texts, toxic, strict=True):
        words = words_of(x)
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        kinds[int(y)].append(np.unique(parts[-1]))
    distinct = list(number)
    del number
    clean, bad = (np.bincount(np.concatenate(x), minlength=len(distinct)) for x in kinds)  # documents with each word
    held = clean + bad
    odds = (np.log((bad + 0.5) / (toxic.sum() + 2)) - np.log((clean + 0.5) / ((~toxic).sum() + 2))) * held / (held + 8)
    odds[held < LEAST_DOCS] = 0
    known = np.flatnonzero(held >= LEAST_DOCS).tolist()
    chosen = sorted(known, key=lambda k: (-abs(odds[k]) * np.sqrt(held[k]), distinct[k]))[:MOST_WORDS]
    grams = Grams(distinct)
    net = Network({distinct[k]: i + 1 for i, k in enumerate(chosen)}, np.clip(odds[chosen], -3, 6) / 2, _gram_odds(grams, kinds, toxic))
    flat = np.concatenate([*parts, np.zeros(WINDOW, np.int32)])
    counts = np.array(list(map(len, parts)))
    del parts, kinds
    text, first, lengths = windows(counts)
    first = first + (np.cumsum(counts) - counts)[text]
    run = np.concatenate([[0], np.cumsum(np.maximum(0, odds)[flat])])
    level = run[first + lengths] - run[first]
    del run
    moments: dict[str, list[np.ndarray]] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    rows_of = net.rows_of(distinct)
    table = np.zeros((2, len(distinct), 3 * HIDDEN), np.float32)
    del distinct
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    for epoch in range(epochs):
        if epoch % 2:  # every other epoch the windows are ranked anew
            for k in range(1, table.shape[1], 20_000):
                some = np.arange(k, min(k + 20_000, table.shape[1]))
                table[:, some] = net.projected(rows_of[some], grams.some(some))
            level = np.concatenate([net.logits(table, flat[first[k : k + 4096, None] + np.arange(WINDOW)], lengths[k : k + 4096]) for k in range(0, len(text), 4096)])
        order = np.lexsort((-level, text))
        pick = np.concatenate([order[starts], rng.choice(np.flatnonzero(~toxic[text]), min(len(texts) // 2, int((~toxic[text]).sum())), replace=False)])
        rng.shuffle(pick)
        for k in range(0, len(pick), BATCH):
            part = pick[k : k + BATCH]
            index = flat[first[part, None] + np.arange(WINDOW)]
            index[np.arange(WINDOW) >= lengths[part, None]] = 0
            used, local = np.unique(index, return_inverse=True)
            mine, rows = grams.some(used), rows_of[used]
            vectors = net.inputs(rows, mine)
            if not used[0]:
                vectors[0] = 0
            _, grad, d_v = net.learn(vectors, local.reshape(index.shape), lengths[part], toxic[text[part]].astype(float), np.ones(len(part)))
            grad["word"] = np.stack([np.bincount(rows, d_v[:, j], len(net.p["word"])) for j in range(WORD_DIM)], 1)
            grad["word"][0] = 0
            grad["char"] = mine.spread(d_v[:, WORD_DIM:], CHAR_BUCKETS)
            step += 1
            rate = RATE * (1 - epoch / epochs) + 0.002
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g**2 - v)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def calibrate(level: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit."""
    a, b = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(a * level + b)
        w = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * level).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum()])
        h = np.array([[(w * level**2).sum() + 1e-3, (w * level).sum()], [(w * level).sum(), w.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.05, a - move[0]), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A bounded sample of labelled rows in a fixed random order: texts, labels and row weights."""
    known = labelled(labels, target).select("doc_id", (F.col("y") >= 0.5).alias("toxic"))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.md5(F.col("doc_id").cast("string").cast("binary"))
    parts = [known.where(F.col("toxic") == kind).orderBy(place, "doc_id").limit(most) for kind, most in ((True, MOST_TOXIC), (False, MOST_CLEAN))]
    ids = [(r["doc_id"], r["toxic"]) for p in parts for r in p.collect()]
    if not ids:
        return [], np.zeros(0, bool), np.zeros(0)
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic boolean")  # at most MOST_TOXIC + MOST_CLEAN rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_TEXT)
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sofar = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(place, "doc_id"))  # over the chosen rows alone
    rows = one.withColumn("sofar", sofar).where(F.col("sofar") <= MOST_BYTES).select("doc_id", "toxic", "text").collect()
    rows = [(r["doc_id"], r["toxic"], bytes(r["text"] or b"")) for r in rows]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    toxic = np.array([r[1] for r in rows], bool)
    share = {kind: total.get(kind, 0) / max(1, int((toxic == kind).sum())) for kind in (True, False)}
    return [r[2] for r in rows], toxic, np.array([share[bool(t)] for t in toxic])


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> tuple[Network, float, float] | None:
    """The network and its calibration: trained on four fifths, calibrated on the rest."""
    kept = np.arange(len(texts)) % 5 == 4
    if not toxic[~kept].any() or toxic[~kept].all():
        return None
    net = train([t for t, k in zip(texts, kept, strict=True) if not k], toxic[~kept])
    use = kept if toxic[kept].any() and not toxic[kept].all() else ~kept
    scorer = Scorer(net)
    chosen = [t for t, k in zip(texts, use, strict=True) if k]
    level = np.concatenate([scorer(chosen[k : k + 64]) for k in range(0, len(chosen), 64)])
    return net, *calibrate(level, toxic[use].astype(float), weight[use])


def _shared(docs: DataFrame, labels: DataFrame, target: str) -> tuple[Broadcast, str]:
    """The fitted network on every executor, and a name of it; what training took goes back to the system."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, target)))
    release()
    return fitted, uuid.uuid4().hex


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text)."""
    fitted, name = _shared(docs, labels, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = fitted.value
        scorer = worker_state(("toxicity", name), lambda: Scorer(model[0])) if model else None
        for batch, texts in text_slices(batches):
            score = sigmoid(model[1] * scorer(texts) + model[2]) if model else np.zeros(len(texts))
            yield {"doc_id": batch.column("doc_id"), "score": score}

    scored = arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), run, SCORED)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that score below the threshold, unchanged."""
    fitted, name = _shared(docs, labels, target)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = fitted.value
        scorer = worker_state(("toxicity", name), lambda: Scorer(model[0])) if model else None
        for batch, texts in text_slices(batches):
            ok = sigmoid(model[1] * scorer(texts) + model[2]) < threshold if model else np.ones(len(texts), bool)
            yield {c: batch.column(c).filter(pa.array(ok)) for c in batch.schema.names}

    kept = arrow_map(as_bytes(docs, *rest), run, T.StructType([*(docs.schema[c] for c in rest), T.StructField("text", T.BinaryType())]))
    return kept.select(*(F.col(c).cast("string").alias(c) if c == "text" else c for c in docs.columns))
