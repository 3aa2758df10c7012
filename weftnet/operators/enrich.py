"""Gene-set enrichment of modules, ortholog and metadata maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions.scratch import hypergeometric_tail, stored
from weftnet.operators.significance import bh_adjusted


def slug(name: Column) -> Column:
    """library names for files."""
    s = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unknown")).otherwise(s)


def merged_sets(sets: DataFrame) -> DataFrame:
    """sets(ordinal, line_no, library, set_name, description, gene): the last row of a name wins."""
    last = sets.select("set_name", "ordinal", "line_no").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("set_name").orderBy(F.col("ordinal").desc(), F.col("line_no").desc()))).where("nth = 1").drop("nth")
    return sets.join(last, ["set_name", "ordinal", "line_no"]).select("library", "set_name", "description", "gene").distinct()


def manifest(sets: DataFrame) -> DataFrame:
    """Sets and genes of each library, before overriding."""
    return sets.groupBy("library").agg(F.countDistinct("set_name").alias("n_sets"), F.countDistinct("gene").alias("n_genes")).withColumn("slug", slug(F.col("library")))


def annotate(modules: DataFrame, sets: DataFrame, background: DataFrame | None = None, fdr: float = 0.05, least: int = 2, least_ids: int | None = None) -> DataFrame:
    """modules(module, gene) x sets(set_name, gene) against background(gene), by default all module genes.

    Modules of fewer than `least_ids` background genes (by default `least`) are not tested.

    Pairs without overlap never exist: a gene of a module meets the list of its sets, as one row until all rows of a module
    are together. Tests are written once, as the adjustment, over the rows with enough overlap, reads them several times.
    """
    m = stored(modules.select("module", "gene").distinct())
    if background is not None:
        m = m.join(background.select("gene").distinct(), "gene", "left_semi")
    bg = (m if background is None else background).select("gene").distinct()
    total = bg.agg(F.count("*").alias("n_background"))
    sizes = m.groupBy("module").agg(F.count("*").alias("n_module")).where(F.col("n_module") >= (least if least_ids is None else least_ids))
    s = sets.groupBy("gene").agg(F.collect_set(F.struct("set_name")).alias("names")).join(bg, "gene", "left_semi")  # a null name is one too
    n_set = s.select(F.explode("names.set_name").alias("set_name")).groupBy("set_name").agg(F.count("*").alias("n_set"))
    met = m.join(s, "gene").select("module", F.col("gene").cast("string").alias("gene"), "names").repartition("module")
    hit = met.select("module", F.explode("names.set_name").alias("set_name"), "gene").groupBy("module", "set_name").agg(F.collect_list("gene").alias("genes"))
    hit = hit.select("module", "set_name", F.size("genes").cast("long").alias("overlap"), F.array_join(F.sort_array("genes"), ";").alias("genes")).where(F.col("overlap") >= least)
    hit = hit.join(sizes.withColumnRenamed("module", "m"), F.col("module").eqNullSafe(F.col("m"))).join(n_set.withColumnRenamed("set_name", "s"), F.col("set_name").eqNullSafe(F.col("s"))).select("module", "set_name", "n_module", "n_set", "overlap", "genes").crossJoin(F.broadcast(total))
    tested = stored(hit.withColumn("p_value", hypergeometric_tail("overlap", "n_set", "n_module", "n_background")))
    return bh_adjusted(tested).where(F.col("p_adjusted") < fdr)


def top_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """The best hits of each module; ties by p-value, then name."""
    order = Window.partitionBy("module").orderBy(F.round("p_adjusted", 12), F.round("p_value", 12), "set_name")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def with_library(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """The library of each hit's set, unknown without one, and its description if the sets have any."""
    about = sets.groupBy("set_name", "library").agg(*([F.max("description").alias("description")] if "description" in sets.columns else [F.lit(1).alias("one")]))
    return hits.join(about.drop("one"), "set_name", "left").withColumn("library", F.coalesce("library", F.lit("unknown")))


def hit_manifest(hits: DataFrame, books: DataFrame) -> DataFrame:
    """Hits, modules with hits and sets hit of each library, 0 for those without."""
    n = hits.groupBy("library").agg(F.count("*").alias("n_hits"), F.countDistinct("module").alias("n_modules"), F.countDistinct("set_name").alias("n_sets_hit"))
    return books.join(n, "library", "left").fillna(0, ["n_hits", "n_modules", "n_sets_hit"])


def genes_in_terms(modules: DataFrame, sets: DataFrame) -> DataFrame:
    """The genes of each module that each set has."""
    return modules.select("module", "gene").distinct().join(sets.select("set_name", "gene").distinct(), "gene").groupBy("module", "set_name").agg(F.array_join(F.array_sort(F.collect_list(F.col("gene").cast("string"))), ";").alias("genes"))


def tidy_map(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct trimmed (src, tgt) without blanks."""
    t = pairs.select(F.trim(F.col(source).cast("string")).alias("src"), F.trim(F.col(target).cast("string")).alias("tgt"))
    return t.where("src <> '' and tgt <> ''").distinct()


def mapped_modules(modules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Modules in the target species, many-to-many."""
    return modules.join(mapping, modules["gene"] == mapping["src"]).select("module", F.col("tgt").alias("gene")).distinct()


def mapping_summary(modules: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per module its genes, those with a target, and distinct targets."""
    m = modules.select("module", "gene").distinct().join(mapping, F.col("gene") == F.col("src"), "left")
    return m.groupBy("module").agg(F.countDistinct("gene").alias("n_source"), F.countDistinct("src").alias("n_mapped"), F.countDistinct("tgt").alias("n_target"))


def collapsed(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key, distinct non-empty values of each column sorted and joined by `;`."""
    some = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))))), ";").alias(c)
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(*map(some, columns))


def with_metadata(modules: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Modules with collapsed metadata of their genes, empty where there is none."""
    return modules.join(collapsed(table, key, columns).withColumnRenamed(key, "gene"), "gene", "left").fillna("", columns)


def first_symbols(table: DataFrame, key: str, symbol: str, order: str) -> DataFrame:
    """The first non-empty symbol of each key in a given order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order, symbol))
    return table.where(F.col(symbol).isNotNull() & ~F.upper(F.trim(F.col(symbol))).isin("", "NA")).withColumn("nth", nth).where("nth = 1").select(key, symbol)


def labelled(metadata: DataFrame, rules: DataFrame, key: str = "project", column: str = "label", default: str = "unknown") -> DataFrame:
    """the last matching rule of (rule_no, key, label) for each row, else the default."""
    last = rules.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.col("rule_no").desc()))).where("nth = 1").select(key, F.col("label").alias(column))
    return metadata.join(last, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def relabelled(metadata: DataFrame, rules: list[tuple[str, str, dict[str, str]]], defaults: dict[str, str]) -> DataFrame:
    """label columns by ordered rules (column, pattern, labels): of the rules whose pattern the column holds, the last sets a label.

    Rules are settings, tens of them: they become one expression for each label, without a join. Null columns match none.
    """
    out = {}
    for label, default in defaults.items():
        value = F.lit(default)
        for column, pattern, labels in rules:  # later rules wrap earlier ones
            if label in labels:
                value = F.when(F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False)), F.lit(labels[label])).otherwise(value)
        out[label] = value
    return metadata.select("*", *(v.alias(k) for k, v in out.items()))


def parents(modules: DataFrame, table: DataFrame) -> DataFrame:
    """Each module's parent, itself without one; table(parent_module, child_module)."""
    return modules.join(table.select(F.col("child_module").alias("module"), "parent_module"), "module", "left").withColumn("parent_module", F.coalesce("parent_module", "module"))
