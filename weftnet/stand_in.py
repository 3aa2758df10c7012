"""The tables of a data folder in the roles of the engine's inputs.

expression: `embeddings`, gene = place in the vector, run = vec_id, study = label; counts: `lineitem`, gene =
part, run = supplier; metadata: suppliers and their nations; gene sets: parts by brand, type and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_expression(table(spark, sf_dir, "embeddings"))


def as_expression(vectors: DataFrame) -> DataFrame:
    """(study, gene, run, x) of vectors (label, vec_id, embedding)."""
    e = vectors.select(F.col("label").alias("study"), F.col("vec_id").alias("run"), F.posexplode("embedding").alias("pos", "x"))
    return e.select("study", F.concat(F.lit("G"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("gene"), "run", F.col("x").cast("double").alias("x"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("run")).agg(F.sum("l_quantity").alias("count"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("run"), F.col("n_name").alias("project"))


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    libs = [("brands", F.col("p_brand")), ("types", F.col("p_type")), ("sizes", F.concat(F.lit("size "), F.col("p_size").cast("string")))]
    out = None
    for k, (name, value) in enumerate(libs):
        rows = p.select(F.lit(k).alias("ordinal"), F.lit(k).cast("long").alias("line_no"), F.lit(name).alias("library"), value.alias("set_name"), F.lit("").alias("description"), F.col("p_partkey").alias("gene"))
        out = rows if out is None else out.union(rows)
    return out


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a supplier delivers: one module for each supplier."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("gene")).distinct()
