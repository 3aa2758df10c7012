"""Studies that are scored once: networks of only those studies whose values or settings are new.

A study's version names its values (rows and hashes of them) and all settings that its edges depend on. Edges are
written below their study and version, and a commit of (study, version) follows when they are all there. A version
is current if the input has it now; what isn't committed is scored, everything else is read back. So a run that
broke off leaves nothing behind that counts, a study that changes back finds its old edges, and studies that left
the input drop out. The consensus over the current versions is kept in the same way.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftnet.functions.scratch import cut
from weftnet.operators import consensus, graph, significance
from weftnet.plans.pipeline import Settings, prepared, scored

log = logging.getLogger("weftnet.resume")

#: Settings that edges of a study depend on; the consensus depends on the others of `MASTER`, too.
SCORES = ("bins", "permutations", "pair_permutations", "seed", "p_threshold", "prescreen", "weight", "clip", "scale_weights")
MASTER = ("least_studies", "study_fraction")


def _schema(*names: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n[2:], kinds[n[0]]) for n in names])


EDGES = _schema("s gene_a", "s gene_b", "d mi", "d p_value", "d weight", "s study", "s version")
COMMITS = _schema("s study", "s version", "l n_runs", "l n_genes", "l n_edges", "d density", "l n_components", "l giant_size")
CONSENSUS = _schema("s gene_a", "s gene_b", "l n_studies", "d edge_weight", "s version")
CONSENSUS_COMMITS = _schema("s version", "l n_edges")


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that earlier runs have written, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def _made_with(s: Settings, names: tuple[str, ...]) -> str:
    return hashlib.md5(json.dumps({k: v for k, v in asdict(s).items() if k in names}, sort_keys=True).encode()).hexdigest()


def versions(x: DataFrame, made_with: str) -> DataFrame:
    """(study, version, n_runs, n_genes) of expression values (study, gene, run, x): independent of the order of rows."""
    row = F.xxhash64("gene", "run", "x")
    per = x.groupBy("study").agg(F.count("*").alias("n"), F.bit_xor(row).alias("a"), F.sum(F.pmod(F.xxhash64(row, F.lit(1)), F.lit(1 << 31))).alias("b"), F.countDistinct("run").alias("n_runs"), F.countDistinct("gene").alias("n_genes"))
    return per.select("study", F.md5(F.concat_ws("|", F.lit(made_with), *(F.col(c).cast("string") for c in ("n", "a", "b"))).cast("binary")).alias("version"), "n_runs", "n_genes")


def _write(df: DataFrame, path: str, *by: str) -> None:
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


@dataclass
class Resumed:
    """Edges and statistics of the current studies, the consensus, and the studies that this run scored."""

    edges: DataFrame
    stats: DataFrame
    consensus: DataFrame
    scored: DataFrame


def run(expression: DataFrame, metadata: DataFrame, path: str, settings: Settings = Settings(), excluded: DataFrame | None = None) -> Resumed:
    """Bring the networks below `path` up to date and read them back; a version of a study is scored once at most."""
    spark, s = expression.sparkSession, settings
    x = cut(prepared(expression, metadata, s, excluded))
    now = cut(versions(x, _made_with(s, SCORES)))
    done = table(spark, f"{path}/commits", COMMITS).select("study", "version")
    todo = cut(now.join(done, ["study", "version"], "left_anti"))
    names = [r[0] for r in todo.select("study").orderBy("study").limit(20).collect()]  # for the log
    log.info("%d of %d studies are new or changed: %s", todo.count(), now.count(), ", ".join(names) or "none")
    if names:
        mine = cut(x.join(todo.select("study"), "study", "left_semi"))
        tested, _ = scored(mine, s)
        edges = cut(consensus.edge_weights(significance.significant(tested, s.p_threshold), s.weight, s.clip, s.scale_weights))
        _write(edges.select("gene_a", "gene_b", "mi", "p_value", "weight", "study").join(todo.select("study", "version"), "study"), f"{path}/edges", "study", "version")
        by_study = edges.select(F.col("study").alias("graph"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"))
        stats = graph.topology(by_study, mine.select(F.col("study").alias("graph"), F.col("gene").alias("v")).distinct())
        stats = todo.join(stats.withColumnRenamed("graph", "study"), "study", "left").select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMITS))
        stats.coalesce(1).write.mode("append").parquet(f"{path}/commits")  # a row for each study, after its edges
        log.info("wrote the edges of %d studies to %s/edges", todo.count(), path)
    current = now.select("study", "version")
    known = table(spark, f"{path}/commits", COMMITS).join(current, ["study", "version"], "left_semi").dropDuplicates(["study"])
    edges = table(spark, f"{path}/edges", EDGES).join(current, ["study", "version"], "left_semi")
    return Resumed(edges, known, _consensus(edges, current, x.select("study", "gene").distinct(), path, s), todo.select("study"))


def _consensus(edges: DataFrame, current: DataFrame, genes: DataFrame, path: str, s: Settings) -> DataFrame:
    """Over the current studies, among the genes that all of them have; made only if a study or a setting is new."""
    spark = edges.sparkSession
    row = F.xxhash64("study", "version")
    r = current.agg(F.count("*").alias("n"), F.bit_xor(row).alias("a"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("b")).first()
    version = hashlib.md5(f"{_made_with(s, MASTER + SCORES)}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()
    if not table(spark, f"{path}/consensus_commits", CONSENSUS_COMMITS).where(F.col("version") == version).limit(1).count():
        k = consensus.effective_count(s.least_studies, r["n"], s.study_fraction)
        found = cut(consensus.consensus(consensus.within(edges, consensus.common_genes(genes)), k, None if s.weight == "none" else "weight"))
        found = found.select("gene_a", "gene_b", F.col("n_studies").cast("long").alias("n_studies"), "edge_weight", F.lit(version).alias("version"))
        n = found.count()
        _write(found, f"{path}/consensus", "version")
        spark.createDataFrame([(version, n)], CONSENSUS_COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/consensus_commits")
        log.info("wrote a consensus of %d edges over %d studies to %s/consensus", n, r["n"], path)
    return table(spark, f"{path}/consensus", CONSENSUS).where(F.col("version") == version).drop("version")
