"""Exact top-k search by MaxScore over sharded postings of quantised vectors.

A component x counts as floor(1024 x). A term is a place of the vector with a sign: its postings in a block are the
vectors with a component of that sign there, its impacts their sizes. A query component adds to the score of the
postings of its own sign and takes from those of the other, so a term's bound is its weight times the block's
largest impact of that sign. A query walks the blocks of a shard with its k-th best score so far as the threshold:
terms by falling bound are essential until the bounds of the rest cannot reach it; essential postings are traversed,
vectors in none of them are never scored, and the remaining terms are probed, a few at a time, for vectors that are
still competitive. The best of each shard are merged, ties to the smaller vec_id.

Queries and candidates meet in cells of a shard and a block of queries, both of bounded size. Vectors are sharded by
the signs of their leading components, so that bounds are close.

Vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part; nor do vectors
whose squared length does not fit a long, as scores with them need not fit one either. Vectors of different lengths
meet in the components that both have. Each row is a candidate of its own, and a query of its own, so repeated rows
find one another and have ranks of their own. Fewer candidates than k: all of them. Extra columns are ignored; an
empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.llm.common import persist

#: Candidates of a shard, of a block of it, queries of a cell, and terms that are probed at once.
SHARD, BLOCK, QUERIES, PROBE = 8192, 1024, 2048, 8
#: Leading components whose signs order the vectors.
SIGNS = 16
#: Squared lengths up to here fit a long; scores below EXACT are exact in doubles.
MOST, EXACT = 9e18, 2.0**52


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component, of the vectors that take part."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = x.where("vec_id is not null and x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('inf') or abs(c) > 1e9)")
    rows = fine.select("vec_id", F.expr("transform(x, c -> floor(1024 * c))").alias("v"))
    return rows.where(F.expr(f"aggregate(v, 0D, (s, c) -> s + double(c) * double(c)) < {MOST}"))


def _matrix(rows: pa.Table, width: int) -> np.ndarray:
    v = rows["v"].combine_chunks()
    sizes = np.asarray(v.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(v.flatten(), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """Blocks of postings, as rows of impacts, with the largest impact of either sign of each place."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, exact: bool) -> None:
        order = np.argsort((x[:, :SIGNS] > 0) @ (1 << np.arange(x.shape[1])[:SIGNS]), kind="stable")
        self.blocks = []
        for lo in range(0, len(order), BLOCK):
            at = order[lo : lo + BLOCK]
            terms = np.ascontiguousarray(x[at].T).astype(np.float64 if exact else np.int64)
            self.blocks.append((terms, terms.max(1).astype(float), terms.min(1).astype(float), ids[at], rows[at]))
        self.kind = np.float64 if exact else np.int64
        #: Bounds are sums of doubles: a little more than they can be off.
        self.slack = 1.0 if exact else 1e5
        self.scored = 0

    def search(self, q: np.ndarray, row: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best other rows."""
        best, names, rows = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = q.astype(self.kind)
        for terms, top, low, ids, own in self.blocks:
            bound = np.maximum(np.where(q > 0, q * top, q * low), 0.0)
            order = np.argsort(-bound, kind="stable")
            rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]]) * (1 + 1e-9) + self.slack  # of terms from each on
            least = float(best[-1]) if len(best) == k else -math.inf
            if rest[0] < least - self.slack:
                continue
            # the rest cannot reach the threshold without an essential term
            split = int(np.argmax(rest < least)) if rest[-1] < least else len(order)
            use = order[:split]
            score = q[use] @ terms[use]
            alive = own != row
            if split < len(order):
                hit = np.abs(q[use]) @ np.maximum(terms[use] * np.sign(q[use])[:, None], 0) > 0  # in some essential postings
                alive &= hit & (score + rest[split] >= least)
            at, score = np.flatnonzero(alive), score[alive]
            while split < len(order) and len(at):
                use = order[split : split + PROBE]
                split += len(use)
                self.scored += len(at) * len(use)
                score = score + q[use] @ terms[np.ix_(use, at)]
                still = score + rest[split] >= least
                at, score = at[still], score[still]
            best, names, rows = (np.concatenate(x) for x in ((best, score), (names, ids[at]), (rows, own[at])))
            first = np.lexsort((rows, names, -best))[:k]
            best, names, rows = best[first], names[first], rows[first]
        return best.astype(np.int64), names


def _cell(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        is_query = np.asarray(part["query"].combine_chunks().fill_null(False)).astype(bool)
        queries, rest = part.filter(pa.array(is_query)), part.filter(pa.array(~is_query))
        out: list[tuple[int, int, int, int]] = []
        if queries.num_rows and rest.num_rows:
            width = max(1, int(np.asarray(part["v"].combine_chunks().value_lengths()).max()))
            x, q = _matrix(rest, width), _matrix(queries, width)
            length = lambda m: np.sqrt((m.astype(float) ** 2).sum(1).max())
            shard = Shard(x, np.asarray(rest["vec_id"]), np.asarray(rest["row"]), bool(length(x) * length(q) < EXACT))
            for name, row, one in zip(queries["vec_id"].to_pylist(), queries["row"].to_pylist(), q, strict=True):
                out += [(row, name, int(b), int(a)) for a, b in zip(*shard.search(one, row, k), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product with each row that `is_query` (of vec_id) takes."""
    places = max(1, math.ceil(vectors.count() / shard))
    rows = quantised(vectors).withColumn("signs", F.expr(f"aggregate(slice(v, 1, {SIGNS}), 0L, (s, c) -> s * 2 + if(c > 0, 1L, 0L))"))
    rows = rows.repartitionByRange(places, "signs", "vec_id").select("vec_id", "v", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("shard"))
    rows = persist(rows)
    asked = rows.where(is_query)
    n = asked.count()
    found = rows.agg(F.max("shard")).first()[0]
    sides = math.ceil(n / queries)
    if not n:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("row").alias("score"))
    upto = lambda last: F.explode(F.sequence(F.lit(0), F.lit(last)))
    left = rows.select("shard", upto(sides - 1).alias("side"), F.lit(False).alias("query"), "row", "vec_id", "v")
    right = asked.select(upto(found).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(sides)).cast("int").alias("side"), F.lit(True).alias("query"), "row", "vec_id", "v")
    each = left.union(right).groupBy("shard", "side").applyInArrow(_cell(k), "row long, query_id long, vec_id long, score long")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return each.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_sql(every: int = 100, k: int = 10) -> str:
    """DuckDB SQL for the queries whose vec_id is divisible by `every`."""
    return f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rank FROM e q JOIN e c ON c.row <> q.row WHERE q.vec_id % {every} = 0) WHERE rank <= {k}"""
