"""The corpus pipeline: five stages over documents, each written and reread as the next one's input.

Stages take (spark, docs, sf_dir) with docs(doc_id, text, lang, source, n_chars) and return the same columns;
the last returns the packed pieces.

- toxicity: documents that the classifier rejects (score >= 0.5) go.
- jaccard: one document of each group of near duplicates stays, the one with the smallest doc_id.
- repeats: bytes of passages that stand in a document with a smaller doc_id go; a document of which nothing
  but white space is left goes. Bytes that a cut leaves as no valid UTF-8 become U+FFFD.
- mix: each document is repeated or cut to the words that the mix takes of it (`taken`); a document of which
  nothing is taken goes.
- pack: the ids of what is left, as pieces in sequences.

Rows with a null text or doc_id pass the first two stages as any other row (their groups are their own);
repeated rows are near duplicates with one doc_id: one of them stays. Extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftnet.llm import mixing, packing, set_join, suffix_dedup, toxicity
from weftnet.llm.common import persist, table
from weftnet.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity network rejects."""
    return toxicity.drop_toxic(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return set_join.representatives(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in documents with smaller doc_ids."""
    return suffix_dedup.cut(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or cut documents to the words that the mix takes."""
    return mixing.apply(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the ids into sequences."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxic), ("jaccard", jaccard), ("repeats", repeats), ("mix", mix), ("pack", pack)]

#: Trained scores, minimiser runs and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist(docs)
    return docs
