"""What the jobs share: settings from a small file, tables that may not be there yet, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def settings(spark: SparkSession, kind: type, path: str | None) -> object:
    """The dataclass `kind` with the values of a JSON file; a name it lacks is an error."""
    if not path:
        return kind()
    values = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**values)


def known(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the job's own, empty where no run has written it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_parts(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Replace the partitions that df has rows of and leave all others alone.

    Rows meet by partition, so small ones are one file; those that outgrow the advisory size are split over tasks.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def command(doc: str, arguments: dict[str, str], work: Callable[[SparkSession, argparse.Namespace], object]) -> None:
    """Parse plain path arguments, make a session, work, stop the session."""
    parser = argparse.ArgumentParser(description=doc)
    for name, about in arguments.items():
        parser.add_argument(f"--{name}", help=about, required=name != "config")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"  # of workers
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        work(spark, given)
    finally:
        spark.stop()
