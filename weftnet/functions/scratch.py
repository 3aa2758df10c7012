"""Cutting lineage in loops, and hypergeometric tails."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder; a local one only where the session names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftnet-"))
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; a local one only where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="weftnet-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A written table in the shared folder, read back: for long loops, as a checkpoint keeps a plan's constraints, which pile up."""
    path = folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: log n! less Stirling's formula for small n; a series gives it beyond.
STIRLING = np.array([0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 32))])


def _stirling(n: np.ndarray) -> np.ndarray:
    k = np.maximum(n, 31).astype(float)
    return np.where(n < 32, STIRLING[np.minimum(n, 31)], (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / k**2) / k**2) / k**2) / k)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) - x + mean, without loss where they are close."""
    d = (x - mean) / mean
    return mean * ((1 + d) * np.log1p(d) - d)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The log probability of x of n with p = 1 - q, by the saddle point: numbers of the size of log n! never meet."""
    inner = (x > 0) & (x < n)
    y, m = np.where(inner, x, 1), np.where(inner, n, 2)
    out = _stirling(m) - _stirling(y) - _stirling(m - y) - _deviance(y, m * p) - _deviance(m - y, m * q) - 0.5 * (np.log(2 * np.pi * y) + np.log1p(-y / m))
    end = np.where(x > 0, q, p)  # what the outcome at either end never is
    return np.where(inner, out, n * np.where(end < 0.5, np.log1p(-end), np.log(1 - end)))


def _tails(x: np.ndarray, m: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P(X >= x) of all rows at once: terms are added from x on away from the mode, so they only fall."""
    least, most = np.maximum(0, m + n - total), np.minimum(m, n)
    out = np.where(x <= least, 1.0, 0.0)
    at = np.nonzero((x > least) & (x <= most))[0]
    up = x[at] > (m[at] + 1) * (n[at] + 1) // (total[at] + 2)
    for rising in (True, False):
        some = at[up == rising]
        b, c, t = m[some], n[some], total[some]
        j = x[some] if rising else x[some] - 1
        p, q = c / t, (t - c) / t
        term = np.exp(_log_binomial(j, b, p, q) + _log_binomial(c - j, t - b, p, q) - _log_binomial(c, t, p, q))
        sums, left, j = term.copy(), np.arange(len(some)), j.astype(float)
        while len(left):
            term = term * ((b - j) * (c - j) / ((j + 1) * (t - b - c + j + 1)) if rising else j * (t - b - c + j) / ((b - j + 1) * (c - j + 1)))
            sums[left] += term
            go = term > 1e-17 * sums[left]
            left, term, b, c, t = left[go], term[go], b[go], c[go], t[go]
            j = j[go] + (1 if rising else -1)
        out[some] = np.minimum(1.0, sums) if rising else np.maximum(0.0, 1 - sums)
    return out


@F.pandas_udf(T.DoubleType())
def hypergeometric_tail(x: pd.Series, m: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
    """P(X >= x) drawing n of `total` of which m are marked; 1 at x = 0."""
    return pd.Series(_tails(*(c.to_numpy(np.int64) for c in (x, m, n, total))), dtype="float64")
