"""Source divergence audit by a two-pass vocabulary automaton.

The first pass counts, exactly, the documents of each language that have each term; terms in at least `least`
of them are kept. The second pass reads all texts again through an Aho-Corasick automaton of the language's
kept terms, each padded with delimiters on both sides so that only whole words match, and counts every
occurrence by language and source. Only (language, source, term) postings with occurrences exist from then on:
distances of sources come from them and from the constant share of absent terms.

Terms are runs of ASCII letters and of anything beyond ASCII, with A-Z lowered. Null text, lang and source
are empty strings. An automaton holds at most `MOST_BYTES` of terms, whatever the vocabulary: a larger one
takes several passes over the texts, each with a part of it. Very long texts are read in pieces cut at
delimiters. Repeated rows and rows with a null doc_id are documents of their own; extra columns are ignored;
an empty table gives no rows. Groups of a language without kept terms have distance 0 and no term rows. Ties
of a rank go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.llm.common import arrow_map, as_bytes, binary_array, discard, persist, text_slices, worker_state

#: Documents of a language that have a kept term; ranks of terms that are reported.
LEAST, TOP = 30, 50
#: Parts of a share, and what is added to each count.
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of terms of an automaton, and of a piece of text; counts that a task holds before it hands them on.
MOST_BYTES, PIECE, MOST_COUNTS = 4 << 20, 4 << 20, 300_000
#: Postings of a bucket of terms, and sources of a tile, that one task compares; products held at once.
BUCKET, TILE, PRODUCTS = 200_000, 256, 1 << 20

#: Bytes that are no word bytes become spaces; A-Z are lowered.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

SEEN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType())])
COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.BinaryType()), T.StructField("n", T.LongType())])


def pieces(text: bytes) -> Iterator[bytes]:
    """The text's words between spaces, in pieces that end between words."""
    words = text.translate(TABLE)
    lo = 0
    while lo < len(words):
        hi = words.find(b" ", lo + PIECE)
        hi = len(words) if hi < 0 else hi
        yield words[lo:hi]
        lo = hi


def _named(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), "text")


def _repeated(values: list[str], many: list[int]) -> pa.Array:
    return pa.chunked_array([pa.repeat(pa.scalar(v, pa.string()), n) for v, n in zip(values, many, strict=True)], pa.string()).combine_chunks()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Documents of each language with each term, of bounded chunks of documents."""
    seen: dict[str, Counter] = {}

    def flush() -> dict:
        sizes = list(map(len, seen.values()))
        out = {"lang": _repeated(list(seen), sizes), "term": binary_array([t for c in seen.values() for t in c]), "n": np.fromiter(chain.from_iterable(c.values() for c in seen.values()), np.int64, sum(sizes))}
        seen.clear()
        return out

    for batch, texts in text_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            own: set[bytes] = set()
            for piece in pieces(text):
                own.update(piece.split())
            seen.setdefault(lang, Counter()).update(own)
        if sum(map(len, seen.values())) > MOST_COUNTS:
            yield flush()
    yield flush()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, n_docs) of the terms that at least `least` documents of the language have; term is UTF-8 bytes."""
    seen = arrow_map(as_bytes(_named(docs), "lang"), _frequencies, SEEN)
    return seen.groupBy("lang", "term").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= least)


def _parts(kept: DataFrame, most: int) -> DataFrame:
    """The vocabulary with the number of the automaton that each term belongs to; languages stay together."""
    per = kept.groupBy("lang").agg(F.sum(F.octet_length("term") + 8).alias("size"))
    per = per.withColumn("before", F.sum("size").over(Window.orderBy("lang")) - F.col("size"))
    share = F.pmod(F.xxhash64("term"), F.lit(1 << 20)) / (1 << 20)
    return kept.join(per, "lang").select("lang", "term", F.floor((F.col("before") + F.col("size") * share) / most).cast("int").alias("part"))


def _automaton(terms: list[bytes]) -> object:
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        out.add_word(f" {term.decode('latin-1')} ", k)  # a character for each byte
    out.make_automaton()
    return out


def _recounter(shared: object, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        automata, names = worker_state(name, lambda: ({lang: _automaton(terms) for lang, terms in shared.value.items()}, {lang: binary_array(terms) for lang, terms in shared.value.items()}))
        found: dict[tuple[str, str], Counter] = {}

        def flush() -> dict:
            sizes = list(map(len, found.values()))
            out = {
                "lang": _repeated([k[0] for k in found], sizes),
                "source": _repeated([k[1] for k in found], sizes),
                "term": pa.chunked_array([names[k[0]].take(pa.array(list(c), pa.int64())) for k, c in found.items()], pa.binary()).combine_chunks(),
                "n": np.fromiter(chain.from_iterable(c.values() for c in found.values()), np.int64, sum(sizes)),
            }
            found.clear()
            return out

        for batch, texts in text_slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                if lang in automata:
                    own = found.setdefault((lang, source), Counter())
                    for piece in pieces(text):
                        own.update(map(itemgetter(1), automata[lang].iter(f" {piece.decode('latin-1')} ")))
            if sum(map(len, found.values())) > MOST_COUNTS:
                yield flush()
        yield flush()

    return run


def occurrences(docs: DataFrame, kept: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms in each source, where there are any; kept is a written table."""
    spark = docs.sparkSession
    parts, out = _parts(kept, most_bytes), None
    last = parts.agg(F.max("part")).first()[0]
    texts = as_bytes(_named(docs), "lang", "source")
    for k in range(0 if last is None else last + 1):
        terms: dict[str, list[bytes]] = {}
        rows = parts.where(F.col("part") == k).select("lang", "term").toArrow()  # about `most_bytes` at most
        for lang, term in zip(rows["lang"].to_pylist(), rows["term"].to_pylist(), strict=True):
            terms.setdefault(lang, []).append(term)
        one = arrow_map(texts, _recounter(spark.sparkContext.broadcast(terms), uuid.uuid4().hex), COUNTED)
        out = one if out is None else out.union(one)
    if out is None:
        return spark.createDataFrame([], COUNTED)
    return out.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: str | Column, size: str, v: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (size + PRIOR * v)), exact; 0 without terms."""
    n = F.col(n) if isinstance(n, str) else n
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    below = (F.col(size) + PRIOR * F.col(v)).cast("decimal(20,0)")
    return F.when(F.col(v) > 0, F.lit(1) + F.call_function("div", above, below)).otherwise(F.lit(0)).cast("long")


def _compare(part: pa.Table) -> pa.Table:
    """What the terms of a bucket add to the distances from the sources of a tile, beyond the share of absent terms.

    The sum of |p - q| over the terms is, with p0 and q0 for absent terms: over a's terms |p - q0| - |p0 - q0|, the
    same for b's terms, and over common terms |p - q| - |p - q0| - |p0 - q| + |p0 - q0|; and |p0 - q0| for each term.
    """
    lang, tile = part["lang"][0].as_py(), part["tile"][0].as_py()
    idx, p = (np.asarray(part[c].combine_chunks(), np.int64) for c in ("idx", "p"))
    terms = part["term"].combine_chunks()
    absent = np.asarray(terms.is_null())
    p0 = np.zeros(int(absent.sum()), np.int64)
    p0[idx[absent]] = p[absent]
    code = np.asarray(terms.dictionary_encode().indices.fill_null(-1), np.int64)[~absent]
    idx, p = idx[~absent], p[~absent]
    order = np.argsort(code, kind="stable")
    code, idx, p = code[order], idx[order], p[order]
    first = tile * TILE
    height = min(TILE, len(p0) - first)
    out = np.zeros((height, len(p0)), np.int64)
    for a in range(height):
        mine = np.sort(p[idx == first + a])
        if len(mine):
            sums = np.concatenate([[0], np.cumsum(mine)])
            k = np.searchsorted(mine, p0)
            out[a] = p0 * (2 * k - len(mine)) + sums[-1] - 2 * sums[k] - len(mine) * np.abs(p0[first + a] - p0)
    common = np.zeros(height * len(p0), np.int64)
    mine = np.flatnonzero((idx >= first) & (idx < first + height))
    lo, hi = np.searchsorted(code, code[mine]), np.searchsorted(code, code[mine], side="right")
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, side="right")))
        many = (hi - lo)[at:to]
        x = np.repeat(mine[at:to], many)
        y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[at:to], many)
        a, b = p0[idx[x]], p0[idx[y]]
        more = np.abs(p[x] - p[y]) - np.abs(p[x] - b) - np.abs(a - p[y]) + np.abs(a - b)
        common += np.bincount((idx[x] - first) * len(p0) + idx[y], more, len(common)).astype(np.int64)  # below 2 ** 53: exact
        at = to
    a, b = np.divmod(np.arange(len(common)), len(p0))
    keep = a + first != b
    a, b, alone, common = a[keep] + first, b[keep], out.ravel()[keep], common[keep]
    cols = (np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([alone + common, alone]))
    return pa.table({"lang": pa.array([lang] * len(cols[0]), pa.string()), "a": cols[0], "b": cols[1], "value": cols[2]})


def distances(groups: DataFrame, counts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language; groups(lang, source, terms, v, p0), counts with p."""
    nth, of = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"), Window.partitionBy("lang")
    buckets = F.greatest(F.lit(1), F.ceil(F.sum("terms").over(of) / bucket)).cast("int")
    sources = persist(groups.select("lang", "source", "v", "p0", nth.alias("idx"), buckets.alias("buckets"), F.ceil(F.count("*").over(of) / TILE).cast("int").alias("tiles")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    posts = counts.select("lang", "source", "term", "p").join(sources.select("lang", "source", "idx", "buckets", "tiles"), ["lang", "source"])
    posts = posts.select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), upto("tiles").alias("tile"), "idx", "term", "p")
    ends = sources.withColumn("bucket", upto("buckets")).select("lang", "bucket", upto("tiles").alias("tile"), "idx", F.lit(None).cast("binary").alias("term"), F.col("p0").alias("p"))
    sums = posts.union(ends).groupBy("lang", "bucket", "tile").applyInArrow(_compare, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    a = sources.select("lang", F.col("idx").alias("a"), "source", "v", F.col("p0").alias("p0_a"))
    b = sources.select("lang", F.col("idx").alias("b"), F.col("source").alias("item"), F.col("p0").alias("p0_b"))
    value = F.col("value") + F.col("v") * F.abs(F.col("p0_a") - F.col("p0_b"))
    return sums.join(a, ["lang", "a"]).join(b, ["lang", "b"]).select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source to the others, and its most typical terms."""
    kept = persist(vocabulary(docs, least))
    counts = persist(occurrences(docs, kept))
    per = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    groups = _named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(per, "lang", "left").fillna(0, ["size", "terms", "v"])
    # the language's size comes along with each source, so postings, of which a language may have most, meet no table by language alone
    groups = persist(groups.withColumns({"p0": _share(F.lit(0), "size", "v"), "whole": F.sum("size").over(Window.partitionBy("lang"))}))
    discard(kept)
    own = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "v", "whole", _share("n", "size", "v").alias("p"))
    whole = own.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.first("whole").alias("size"), F.first("v").alias("v")).select("lang", "term", _share("n", "size", "v").alias("q"))
    order = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int"))
    typical = own.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    apart = distances(groups, own).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return order(apart).union(order(typical).where(F.col("rank") <= top))


def audit_sql(least: int = LEAST, top: int = TOP) -> str:
    """DuckDB SQL for the same rows, dense over kept terms."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
  w AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  k AS MATERIALIZED (SELECT lang, term FROM (SELECT DISTINCT row, lang, term FROM w) GROUP BY 1, 2 HAVING count(*) >= {least}),
  g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
  c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
  v AS MATERIALIZED (SELECT lang, count(*) AS v FROM k GROUP BY 1),
  full_c AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  p AS MATERIALIZED (SELECT full_c.*, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * v) AS p FROM full_c JOIN v USING (lang)),
  q AS MATERIALIZED (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang) + {PRIOR} * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) JOIN v USING (lang)),
  f AS MATERIALIZED (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
  SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {top}"""
