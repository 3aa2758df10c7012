"""Job 1: from new documents to normalised term matrices, one for each language.

The first step of every analysis here is a matrix of counts: genes by samples, filtered and made comparable.
This job keeps such matrices of texts up to date: a language is a study, a source is a sample (run), a word is
a gene. Documents arrive as files. A file stream with a checkpoint takes only files that no run has seen and
appends their counts by batch; then the studies that got new counts, and only those, are filtered and
normalised again from all their counts (size factors depend on every sample of a study).

    python -m jobs.term_counts --documents DIR --output DIR --checkpoint DIR --config jobs/term_counts.json

Output: `counts` (study, run, gene, n), partitioned by batch; `matrix` (gene, run, count, log_cpm), partitioned by
study; `mark` with the last batch that the matrix has and the settings that it was made with.

Rerunning is safe at any point: a batch that is run again replaces its own partition, a study replaces its own,
and the mark is written last. Other settings make every study again; the counts don't depend on them. Files are
taken once by name: a file that is changed in place is not read again. Counts only grow, so a study that has
rows keeps some. Words are runs of ASCII letters and of anything beyond ASCII, A-Z lowered; null texts have none;
null or empty languages and sources are `unknown`. A study without a word that all of its samples have gets
size factors of 1.
"""

from __future__ import annotations

import hashlib
import json
import logging
import sys
from dataclasses import asdict, dataclass
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs import common
from weftnet.operators import normalise, prep

log = logging.getLogger("jobs.term_counts")

COUNTS = T.StructType([T.StructField(n, k) for n, k in (("study", T.StringType()), ("run", T.StringType()), ("gene", T.StringType()), ("n", T.LongType()), ("batch", T.LongType()))])
MATRIX = T.StructType([T.StructField(n, k) for n, k in (("gene", T.StringType()), ("run", T.StringType()), ("count", T.LongType()), ("log_cpm", T.DoubleType()), ("study", T.StringType()))])
MARK = T.StructType([T.StructField("batch", T.LongType()), T.StructField("settings", T.StringType())])

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: what a word is.
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    """Samples with a count above `above` that a gene needs; words that a sample needs; files of a batch."""

    least_samples: int = 3
    above: float = 1
    least_library: float = 100
    files_per_batch: int = 1000

    def fingerprint(self) -> str:
        values = {k: v for k, v in asdict(self).items() if k != "files_per_batch"}
        return hashlib.md5(json.dumps(values, sort_keys=True).encode()).hexdigest()


def _name(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit("unknown")).otherwise(prep.safe_name(F.col(c)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(study, run, gene, n): occurrences of each word in each sample."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    rows = docs.where("text is not null").select(_name("lang").alias("study"), _name("source").alias("run"), F.explode(words).alias("gene"))
    return rows.groupBy("study", "run", "gene").agg(F.count("*").alias("n"))


def matrix(counts: DataFrame, s: Settings) -> DataFrame:
    """(gene, run, count, log_cpm, study) of the expressed genes of large enough samples, normalised within each study."""
    by = ("study",)
    counts = counts.groupBy("study", "run", "gene").agg(F.sum("n").alias("count"))
    kept = counts.join(normalise.expressed_genes(counts, s.least_samples, s.above, by).select("study", "gene"), ["study", "gene"], "left_semi")
    libs = normalise.library_sizes(kept, s.least_library, by)
    kept = kept.join(libs.select("study", "run"), ["study", "run"], "left_semi")
    factors = libs.join(normalise.rle_factors(kept, by).select("study", "run", "factor"), ["study", "run"], "left").fillna(1.0, ["factor"])
    values = normalise.log_cpm(kept, factors, by)
    return kept.join(values, ["study", "gene", "run"]).select("gene", "run", "count", "log_cpm", "study")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> DataFrame:
    """Take the new files of `documents` (a folder, or one file), bring the matrices up to date and return them."""
    schema = spark.read.parquet(documents).schema
    documents = documents.rstrip("/")
    itself = f"{documents[:-1]}[{documents[-1]}]"  # as a pattern, which a stream also takes for a single file
    # no file is too old: one that arrives late counts as any other
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings.files_per_batch).option("maxFileAge", "36500d").parquet(itself)

    def take(batch: DataFrame, number: int) -> None:
        common.write_parts(term_counts(batch).withColumn("batch", F.lit(number).cast("long")), f"{output}/counts", ("batch",))

    stream = files.select("text", "lang", "source").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %d new documents of %s in %d batches", sum(p["numInputRows"] for p in stream.recentProgress), documents, len({p["batchId"] for p in stream.recentProgress if p["numInputRows"]}))

    counts = common.known(spark, f"{output}/counts", COUNTS)
    mark = common.known(spark, f"{output}/mark", MARK).orderBy(F.desc("batch")).first()
    made = settings.fingerprint()
    after = mark["batch"] if mark and mark["settings"] == made else -1
    last = counts.agg(F.max("batch")).first()[0]
    if last is None or last <= after:
        log.info("nothing new: the matrices stay as they are")
    else:
        new = counts.where(F.col("batch") > after).select("study").distinct()
        common.write_parts(matrix(counts.join(new, "study", "left_semi"), settings), f"{output}/matrix", ("study",))
        spark.createDataFrame([(last, made)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{output}/mark")
        log.info("wrote the matrices of %d studies to %s/matrix, up to batch %d", new.count(), output, last)
    return common.known(spark, f"{output}/matrix", MATRIX)


def main() -> None:
    paths = {"documents": "folder of Parquet files (text, lang, source), or one such file", "output": "folder of the output", "checkpoint": "folder of the stream's checkpoint", "config": "JSON file of settings"}
    common.command(__doc__, paths, lambda spark, a: run(spark, a.documents, a.output, a.checkpoint, common.settings(spark, Settings, a.config)))


if __name__ == "__main__":
    main()
