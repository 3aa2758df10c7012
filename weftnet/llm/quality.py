"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics are computed from each whole text once. They are standardised with corpus-wide moments, mapped
by random Fourier features that approximate a Gaussian kernel, and fitted by normal equations that every
partition sums over its own rows. A part of the training rows is kept for the isotonic calibration, which
works on a histogram of raw scores. Nothing of a score depends on labels, lang, source or doc_id.

Null texts count as empty and are scored like any other. Labels that are null are ignored, repeated labels
of a document are averaged. Rows with a null doc_id are scored, never trained on and not held out. Without
labels every score is 0.5. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, persist, text_slices

FOURIER = 192
RIDGE = 1e-3
#: Gaussian kernel width in units of the square root of the number of statistics.
WIDTH = 0.8
BINS = 4096
SEED = 7
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
THRESHOLD = 0.3


# ---------------------------------------------------------------- statistics of a text
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SPACE = [9, 10, 11, 12, 13, 32]
_STOPS = [ord(c) for c in ".!?"]
_MARKS = [ord(c) for c in ",;:'\"()-"]
_ODD = [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]
NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "spaces", "stops", "marks", "odd", "bang", "bar", "controls", "beyond_ascii", "byte_entropy", "distinct_words", "top_word", "repeated_run", "lines", "line_length", "distinct_lines", "odd_words", "shouted_words", "short_words", "long_words", "ended", "sentences", "distinct_pairs")


def statistics(text: bytes) -> list[float]:
    """The document statistics of one text, in the order of NAMES."""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [float(np.log1p(n))] + [0.0] * (len(NAMES) - 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count[count > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lines = text.splitlines()
    shouted = sum(map(bytes.isupper, words))
    last = np.array([x[-1] for x in words], np.uint8)
    odd = np.zeros(256, bool)
    odd[_ODD] = True
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    spaces = max(1, int(count[_SPACE].sum()))
    ink = max(1, n - spaces)
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(lengths.mean()), float(lengths.std()),
        count[_UPPER].sum() / ink, count[_DIGIT].sum() / ink, spaces / n, count[_STOPS].sum() / w, count[_MARKS].sum() / w, count[_ODD].sum() / w,
        count[33] / w, count[124] / w, (count[:32].sum() - count[9:14].sum()) / n, count[128:].sum() / ink, float(-(share * np.log2(share)).sum()),
        len(tally) / w**0.8, max(tally.values()) / w, same / w, float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), len(set(lines)) / len(lines),
        float(odd[last].mean()), shouted / w, float((lengths <= 2).mean()), float((lengths >= 15).mean()), float(text.rstrip()[-1:] in b".!?"), float(np.log1p(count[_STOPS].sum() / len(lines))),
        len(set(zip(words, words[1:], strict=False))) / w,
    ]


STATS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType(), False))])


def document_statistics(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, texts in text_slices(batches):
            yield {"doc_id": batch.column("doc_id"), "x": matrix_column(np.array([statistics(t) for t in texts], np.float32))}

    return arrow_map(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), run, STATS)


def matrix_column(x: np.ndarray) -> pa.Array:
    field = pa.field("element", pa.float32(), nullable=False)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()), type=pa.list_(field))


def column_matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(np.float64)


# ---------------------------------------------------------------- the model
@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    level: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        f = np.cos(z @ self.project + self.phase) * np.sqrt(2 / self.project.shape[1])
        return np.hstack([f, z / 10, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated score; the raw score orders what the calibration leaves equal."""
        raw = self.raw(x)
        level = np.interp(raw, self.cuts, self.level) if len(self.cuts) else np.full(len(raw), 0.5)
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1) if len(self.cuts) else level


def isotonic(wins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing rates nearest to wins / rows."""
    blocks: list[list[float]] = []
    for a, n in zip(wins.tolist(), rows.tolist(), strict=True):
        blocks.append([a, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.repeat([a / n for a, n, _ in blocks], [int(k) for *_, k in blocks])


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def labelled(labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from: one per document, none held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y")).where("doc_id is not null and y is not null")
    return known.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.avg("y").alias("y"))


SUMS = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.BinaryType())])


def summed(rows: DataFrame, of, slots: int = 16) -> np.ndarray | None:
    """The sum over all rows of the matrices that of(batch) gives: by partition, by slot, then on the driver.

    The driver gets at most `slots` matrices of a fixed size.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total, n = (part if total is None else total + part), n + batch.num_rows
        if n:
            yield {"slot": [TaskContext.get().partitionId() % slots], "n": [n], "sums": [total.tobytes()]}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, data in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(data)
        for slot, x in total.items():
            yield {"slot": [slot], "n": [1], "sums": [x.tobytes()]}

    parts = arrow_map(arrow_map(rows, partial, SUMS).repartition(slots, "slot"), merge, SUMS).select("sums").collect()
    return sum(np.frombuffer(r["sums"]) for r in parts) if parts else None


def fit(stats: DataFrame, known: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE) -> Model:
    """Fit on the statistics of labelled rows; `stats` is a written table."""
    d = len(NAMES)
    rng = np.random.default_rng(SEED)
    project = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, fourier))
    phase = rng.uniform(0, 2 * np.pi, fourier)
    rows = persist(stats.join(known, "doc_id").select("x", "y", (fold(F.col("doc_id")) == CALIBRATION).alias("calibration")))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = column_matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    m = summed(rows.select("x"), moments)
    empty = Model(np.zeros(d), np.ones(d), project, phase, np.zeros(fourier + d + 1), np.zeros(0), np.zeros(0))
    if m is None:
        return empty
    mean = m[1 : d + 1] / m[0]
    scale = np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0))
    blank = Model(mean, np.where(scale > 1e-6, scale, 1), project, phase, empty.weights, empty.cuts, empty.level)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = blank.fourier(column_matrix(batch.column(0))), np.asarray(batch.column(1))
        return np.hstack([z.T @ z, (z.T @ y)[:, None]]).ravel()

    size = fourier + d + 1
    sums = summed(rows.where("not calibration").select("x", "y"), normal)
    if sums is None:
        return empty
    a = sums.reshape(size, size + 1)
    weights = np.linalg.solve(a[:, :size] + ridge * m[0] / size * np.eye(size), a[:, size])
    model = Model(mean, blank.scale, project, phase, weights, empty.cuts, empty.level)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = model.raw(column_matrix(batch.column(0))), np.asarray(batch.column(1))
        k = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, minlength=BINS), np.bincount(k, raw, minlength=BINS)]).astype(float)

    h = summed(rows.where("calibration").select("x", "y"), histogram)
    if h is None:
        h = summed(rows.select("x", "y"), histogram)
    n, wins, raws = h.reshape(3, BINS)
    some = n > 0
    level = isotonic(wins[some] + 0.01, n[some] + 0.02)
    return Model(mean, blank.scale, project, phase, weights, raws[some] / n[some], level)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    stats = persist(document_statistics(docs))
    model = spark.sparkContext.broadcast(fit(stats, labelled(labels, target)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch.column(0), "score": model.value.score(column_matrix(batch.column(1)))}

    scored = arrow_map(stats, run, SCORED)
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
