"""Sources: count files, matrices, metadata, gene sets, maps, edges and modules."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from pathlib import Path
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gene-set libraries that can be asked for by name.
LIBRARIES = ("KEGG_2021_Human", "MSigDB_Hallmark_2020", "WikiPathway_2023_Human", "GO_Biological_Process_2023", "Reactome_2022")


def star_counts(spark: SparkSession, path: str, suffix: str = "_ReadsPerGene.out.tab") -> DataFrame:
    """(gene, run, count) of count files below a folder: the unstranded column without summary rows."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*" + suffix).csv(path, sep="\t", schema="gene string, unstranded double, forward double, reverse double")
    return rows.where(~F.col("gene").startswith("N_")).select("gene", F.regexp_replace("_metadata.file_name", suffix.replace(".", r"\.") + "$", "").alias("run"), F.col("unstranded").alias("count"))


def wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long (gene, run, x) of a tab-separated matrix with genes in the first column."""
    rows = spark.read.csv(path, sep="\t", header=True)
    gene, *runs = rows.columns
    return rows.withColumnRenamed(gene, "gene").unpivot("gene", runs, "run", "x").withColumn("x", F.col("x").cast("double"))


def metadata(spark: SparkSession, path: str, required: tuple[str, ...] = ("Run", "BioProject")) -> DataFrame:
    """S3: tab-separated metadata; missing columns are an error."""
    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    return rows


def names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, blank lines ignored."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''").distinct()


def gmt(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ordinal, line_no, library, set_name, description, gene) of gene-set files in the order given."""
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
        rows = rows.select("line_no", F.split(F.regexp_replace(F.trim("value"), r"\t+$", ""), "\t").alias("f")).where(F.size("f") >= 3)
        genes = F.expr("array_distinct(filter(transform(slice(f, 3, size(f)), g -> trim(g)), g -> g <> ''))")
        library = Path(path).name.removesuffix(".gmt")
        rows = rows.select(F.lit(k).alias("ordinal"), "line_no", F.lit(library).alias("library"), F.col("f")[0].alias("set_name"), F.col("f")[1].alias("description"), F.explode(genes).alias("gene"))
        out = rows if out is None else out.union(rows)
    return out


def library(name: str, cache: str, tries: int = 3, address: str | None = None) -> str:
    """The path of a library's file in the cache; fetched from `address` (with {name}) if it is not there."""
    path = Path(cache) / f"{name}.gmt"
    if path.exists() and path.stat().st_size:
        return str(path)
    if not address:
        raise FileNotFoundError(f"{path}: not cached, and no address to fetch it from")
    error: Exception | None = None
    for _ in range(tries):
        try:
            with urlopen(address.format(name=quote(name)), timeout=60) as r:  # noqa: S310
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(r.read())
                return str(path)
        except OSError as e:
            error = e
    raise ConnectionError(f"{name}: {error}")


def ortholog_map(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """S9."""
    from weftnet.operators.enrich import tidy_map

    return tidy_map(spark.read.csv(path, sep="\t", header=True), source, target)


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """A table separated by tabs or commas, as its header tells."""
    header = spark.read.text(path).first()[0]
    return spark.read.csv(path, sep="\t" if header.count("\t") >= header.count(",") and "\t" in header else ",", header=True)


def matrix_market(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """(i, j, value), 1-based; with genes(ord, gene) the names of both ends."""
    lines = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''")
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n"))  # the size line is the first of the first part
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f"), place.alias("at"))
    first = f.agg(F.min("at").alias("at")).first()["at"]
    rows = f.where((F.col("at.file") > first["file"]) | ((F.col("at.file") == first["file"]) & (F.col("at.n") > first["n"]))).select(F.col("f")[0].cast("long").alias("i"), F.col("f")[1].cast("long").alias("j"), F.coalesce(F.expr("try_element_at(f, 3)").cast("double"), F.lit(1.0)).alias("value"))
    if genes is None:
        return rows
    a, b = (genes.select(F.col("ord").alias(o), F.col("gene").alias(g)) for o, g in (("i", "gene_a"), ("j", "gene_b")))
    return rows.join(a, "i").join(b, "j")


def edge_list(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """An edge table, within the genes if given."""
    from weftnet.operators.consensus import within

    rows = spark.read.csv(path, sep="\t", header=True)
    rows = rows.withColumnsRenamed({"gene_A": "gene_a", "gene_B": "gene_b", "MI_MINE": "mi"})
    rows = rows.withColumns({c: F.col(c).cast("double") for c in ("mi", "p_value", "edge_weight") if c in rows.columns})
    return rows if genes is None else within(rows, genes)


def modules(spark: SparkSession, path: str) -> DataFrame:
    """(module, gene) of a module table whose header is Gene, Module."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if rows.columns[:2] != ["Gene", "Module"]:
        raise ValueError("the header must be Gene, Module")
    return rows.select(F.regexp_replace("Module", "^M", "").cast("int").alias("module"), F.col("Gene").alias("gene"))


def cached(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """A cached table, if it was made under the same settings."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    first = rows.select("fingerprint").first()
    return rows.drop("fingerprint") if first and first[0] == fingerprint else None


def find_inputs(folders: list[str], counts: tuple[str, ...] = ("counts.tsv", "log_cpm.tsv"), about: tuple[str, ...] = ("metadata.tsv",)) -> tuple[str | None, str | None]:
    """The first counts and metadata files in the folders."""
    pick = lambda names_: next((str(Path(d) / n) for d in folders for n in names_ if (Path(d) / n).exists()), None)
    return pick(counts), pick(about)


def settings(default: object, path: str) -> object:
    """Nested dataclasses from JSON; unknown keys are ignored."""

    def merge(obj: object, values: dict) -> object:
        known = {f.name for f in fields(obj)}
        new = {k: merge(getattr(obj, k), v) if is_dataclass(getattr(obj, k)) and isinstance(v, dict) else v for k, v in values.items() if k in known}
        return type(obj)(**{f.name: new.get(f.name, getattr(obj, f.name)) for f in fields(obj)})

    return merge(default, json.loads(Path(path).read_text()))


