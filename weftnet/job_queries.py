"""The jobs as registered queries: each runs twice into one new folder and returns the whole output after that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import study_networks, term_counts
from weftnet.functions.scratch import folder
from weftnet.oracles import PERMS, SEED, P, with_parts


def job1_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "job1")
    settings = term_counts.Settings()
    for _ in range(2):
        out = term_counts.run(spark, f"{sf_dir}/documents.parquet", f"{path}/out", f"{path}/checkpoint", settings)
    return out.select("study", "gene", "run", "count", (F.round("log_cpm", 6) + 0.0).alias("log_cpm"))


def job2_study_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "job2")
    settings = study_networks.Settings(permutations=PERMS, seed=SEED, p_threshold=P, least_studies=2)
    for _ in range(2):
        out = study_networks.run(spark, f"{sf_dir}/embeddings.parquet", path, settings)
    return out.select("study", "gene_a", "gene_b", "n_studies", F.round("value", 6).alias("value"), (F.round("p_value", 6) + 0.0).alias("p_value"))


QUERIES = {"job1_term_counts": job1_term_counts, "job2_study_networks": job2_study_networks}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NAME = "CASE WHEN coalesce({c}, '') = '' THEN 'unknown' ELSE translate({c}, ' /', '_-') END"

ORACLES = {
    "job1_term_counts": " ".join(
        f"""WITH words AS (SELECT {_NAME.format(c="lang")} AS study, {_NAME.format(c="source")} AS run, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{term_counts.WORD}')) AS gene FROM documents),
  n AS MATERIALIZED (SELECT study, run, gene, count(*) AS count FROM words GROUP BY 1, 2, 3),
  expressed AS MATERIALIZED (SELECT * FROM n WHERE (study, gene) IN (SELECT (study, gene) FROM n GROUP BY study, gene HAVING count(*) FILTER (count > 1) >= 3)),
  libs AS MATERIALIZED (SELECT study, run, sum(count) AS lib_size FROM expressed GROUP BY 1, 2 HAVING sum(count) > 100),
  kept AS MATERIALIZED (SELECT expressed.* FROM expressed JOIN libs USING (study, run)),
  everywhere AS MATERIALIZED (SELECT study, gene, avg(ln(count)) AS log_mean FROM kept k GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM libs l WHERE l.study = k.study)),
  raw AS MATERIALIZED (SELECT study, run, median(exp(ln(count) - log_mean)) / any_value(lib_size) AS raw FROM kept JOIN everywhere USING (study, gene) JOIN libs USING (study, run) GROUP BY 1, 2),
  factors AS MATERIALIZED (SELECT study, run, raw / exp(avg(ln(raw)) OVER (PARTITION BY study)) AS factor FROM raw)
  SELECT study, gene, run, count, round(log2((count + 2) / (lib_size * coalesce(factor, 1) + 4) * 1e6), 6) + 0.0 AS log_cpm FROM kept JOIN libs USING (study, run) LEFT JOIN factors USING (study, run)""".split()
    ),
    "job2_study_networks": with_parts(
        "SELECT study::VARCHAR AS study, gene_a, gene_b, 1::BIGINT AS n_studies, round(mi, 6) AS value, round(p_value, 6) + 0.0 AS p_value FROM sig UNION ALL SELECT NULL, gene_a, gene_b, n_studies, round(mean_nlp, 6), NULL FROM cons"
    ),
}
