"""Job 2: association networks of studies, in which only new or changed studies are scored.

Scoring all pairs of a study and its permutations is what an analysis spends its time on, and a collection of
studies grows by a study at a time. This job compares the version of each study (its values and the settings)
with those that are committed in the output, scores the others, and brings the consensus up to date.

    python -m jobs.study_networks --vectors PATH --output DIR --config jobs/study_networks.json

Input: Parquet of vectors (vec_id, label, embedding): a label is a study, a vector is a sample, a place of the
vectors is a gene. Output: `edges` (gene_a, gene_b, mi, p_value, weight), partitioned by study and version;
`commits` with a row for each study and version that is complete (runs, genes, edges, topology); `consensus`,
partitioned by version, and `consensus_commits`.

Rerunning is safe at any point: edges count only once their version is committed, and a version that is written
again replaces its own partition with the same rows. A study that changes gets a new version, one that changes
back is read again, one that leaves the input leaves the result. Vectors that are null, and rows without an id
or a label, are in no study; labels of fewer than `least_samples` vectors are none.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from weftnet.plans import pipeline, resume
from weftnet.stand_in import as_expression

log = logging.getLogger("jobs.study_networks")


@dataclass(frozen=True)
class Settings:
    """The settings of an analysis that this job takes."""

    least_samples: int = 3
    bins: int = 5
    permutations: int = 1000
    seed: int = 42
    p_threshold: float = 0.001
    least_studies: int = 3
    weight: str = "neglog10p"

    def analysis(self) -> pipeline.Settings:
        return pipeline.Settings(**vars(self))


def run(spark: SparkSession, vectors: str, output: str, settings: Settings = Settings()) -> DataFrame:
    """Bring the networks up to date; (study, gene_a, gene_b, n_studies, value, p_value) of edges, then of the consensus.

    The value of an edge is its information, that of an edge of the consensus (study is null) its mean weight.
    """
    rows = spark.read.parquet(vectors).where("vec_id is not null and label is not null and embedding is not null")
    about = rows.select(F.col("vec_id").alias("run"), F.col("label").cast("string").alias("project"))
    log.info("read %d vectors of %s", rows.count(), vectors)
    found = resume.run(as_expression(rows).drop("study"), about, output, settings.analysis())
    one, null = F.lit(1).cast("long"), F.lit(None)
    edges = found.edges.select("study", "gene_a", "gene_b", one.alias("n_studies"), F.col("mi").alias("value"), "p_value")
    shared = found.consensus.select(null.cast("string").alias("study"), "gene_a", "gene_b", "n_studies", F.col("edge_weight").alias("value"), null.cast("double").alias("p_value"))
    return edges.union(shared)


def main() -> None:
    paths = {"vectors": "Parquet of vectors", "output": "folder of the output", "config": "JSON file of settings"}
    common.command(__doc__, paths, lambda spark, a: run(spark, a.vectors, a.output, common.settings(spark, Settings, a.config)))


if __name__ == "__main__":
    main()
