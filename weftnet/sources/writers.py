"""Sinks: matrices, edge tables, sparse matrices, graphs, summaries and reports."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of the graphs of modules that a task has on average.
GRAPH_LINES = 500_000


def tsv(df: DataFrame, path: str, one_file: bool = False, by: str | None = None) -> None:
    """A tab-separated table, optionally a folder per value of a column."""
    w = (df.coalesce(1) if one_file else df).write.mode("overwrite").option("sep", "\t").option("header", True)
    (w.partitionBy(by) if by else w).csv(path)


def wide(x: DataFrame, path: str, value: str = "x") -> None:
    """K1: genes by samples; the samples are the columns, so their number bounds the table's width."""
    tsv(x.groupBy("gene").pivot("run").agg(F.first(value)).orderBy("gene"), path)


def matrix_market(edges: DataFrame, genes: DataFrame, path: str, value: str | None = None) -> None:
    """K3: header, size line and 1-based (i, j, value) of both triangles; genes(gene, ord) count from 1.

    The parts are ranges of the sorted lines, with the header in the first: joined in order of name they are one file.
    """
    a, b = (genes.select(F.col("gene").alias(f"gene_{k}"), F.col("ord").alias(o)) for k, o in (("a", "i"), ("b", "j")))
    e = edges.join(a, "gene_a").join(b, "gene_b").select("i", "j", (F.col(value) if value else F.lit(1)).alias("v"))
    both = e.union(e.select(F.col("j"), F.col("i"), "v"))
    size = both.agg(F.count("*").alias("nnz")).crossJoin(genes.agg(F.count("*").alias("n")))
    head = size.select(F.lit(0).alias("o"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.concat_ws(" ", "n", "n", "nnz").alias("value"))
    top = head.select(F.lit(-1).alias("o"), "i", "j", F.lit("%%MatrixMarket matrix coordinate real general").alias("value"))
    body = both.select(F.lit(1).alias("o"), F.col("i").cast("long"), F.col("j").cast("long"), F.concat_ws(" ", "i", "j", "v").alias("value"))
    top.union(head).union(body).orderBy("o", "j", "i").select("value").write.mode("overwrite").text(path)


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(edges: DataFrame, path: str, nodes: DataFrame | None = None, weight: str | None = None, name: str = "network") -> None:
    """GraphML of an undirected network; nodes(gene) adds those without edges.

    The parts are ranges of the sorted lines, from head to tail: joined in order of name they are one document.
    """
    ends = edges.select(F.explode(F.array("gene_a", "gene_b")).alias("gene"))
    ends = (ends if nodes is None else ends.union(nodes.select("gene"))).distinct()
    spark = edges.sparkSession
    key = '<key id="w" for="edge" attr.name="weight" attr.type="double"/>' if weight else ""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{key}<graph id={quoteattr(name)} edgedefault="undirected">'
    line = lambda order, text: spark.createDataFrame([(order, "", text)], "o int, k string, value string")
    node = ends.select(F.lit(1).alias("o"), F.col("gene").cast("string").alias("k"), F.concat(F.lit('<node id="'), _escape(F.col("gene").cast("string")), F.lit('"/>')).alias("value"))
    data = F.concat(F.lit('"><data key="w">'), F.col(weight).cast("string"), F.lit("</data></edge>")) if weight else F.lit('"/>')
    edge = edges.select(F.lit(2).alias("o"), F.concat_ws("\t", "gene_a", "gene_b").alias("k"), F.concat(F.lit('<edge source="'), _escape(F.col("gene_a").cast("string")), F.lit('" target="'), _escape(F.col("gene_b").cast("string")), data).alias("value"))
    line(0, head).union(node).union(edge).union(line(3, "</graph></graphml>")).orderBy("o", "k").select("value").write.mode("overwrite").text(path)


def module_graphs(edges: DataFrame, modules: DataFrame, path: str) -> None:
    """The GraphML of each module's induced network, a folder per module.

    Lines are dealt in ranges, so that a large module is several tasks' work: its parts, joined in order of name, are one document.
    """
    ends = [modules.select("module", F.col("gene").alias(f"gene_{k}")) for k in "ab"]
    inside = edges.select("gene_a", "gene_b").join(ends[0], "gene_a").join(ends[1], ["module", "gene_b"])
    ids = modules.select("module").distinct()
    name = lambda c: _escape(F.col(c).cast("string"))
    head = F.concat(F.lit('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph id="M'), F.col("module").cast("string"), F.lit('" edgedefault="undirected">'))
    rows = ids.select("module", F.lit(0).alias("o"), F.lit("").alias("k"), head.alias("value"))
    rows = rows.union(modules.select("module", F.lit(1), F.col("gene").cast("string"), F.concat(F.lit('<node id="'), name("gene"), F.lit('"/>'))))
    rows = rows.union(inside.select("module", F.lit(2), F.concat_ws("\t", "gene_a", "gene_b"), F.concat(F.lit('<edge source="'), name("gene_a"), F.lit('" target="'), name("gene_b"), F.lit('"/>'))))
    rows = rows.union(ids.select("module", F.lit(3), F.lit(""), F.lit("</graph></graphml>")))
    tasks = (edges.count() + modules.count()) // GRAPH_LINES + 1
    rows.repartitionByRange(tasks, "module", "o", "k").sortWithinPartitions("module", "o", "k").select("module", "value").write.mode("overwrite").partitionBy("module").text(path)


def master(edges: DataFrame, genes: DataFrame, path: str) -> None:
    """The sorted edge list, the weighted one, and adjacency, weights and study counts as sparse matrices."""
    tsv(edges.orderBy(F.desc("n_studies"), F.desc("edge_weight"), "gene_a", "gene_b"), f"{path}/master_edges")
    tsv(edges.select("gene_a", "gene_b", "edge_weight").orderBy(F.desc("edge_weight"), "gene_a", "gene_b"), f"{path}/master_weighted_edges")
    for name, value in (("adjacency", None), ("weights", "edge_weight"), ("n_studies", "n_studies")):
        matrix_market(edges, genes, f"{path}/master_{name}_mtx", value)


def node_tables(modules: DataFrame, path: str, about: DataFrame | None = None, key: str = "gene") -> None:
    """Module table, node table, and both with metadata about genes where there is any."""
    module_table(modules, f"{path}/master_modules")
    tsv(modules.select("gene", "module").orderBy("gene", "module"), f"{path}/master_node_modules")
    if about is not None:
        from weftnet.operators.enrich import with_metadata

        columns = [c for c in about.columns if c != key]
        tsv(with_metadata(modules, about, key, columns).orderBy("module", "gene"), f"{path}/master_modules_annotated")


def likelihood(edges: DataFrame, modules: DataFrame, genes: DataFrame, path: str, weight: str = "clr") -> None:
    """Edges, weighted edges, sparse matrix, GraphML and modules of the whole-matrix network."""
    tsv(edges.select("gene_a", "gene_b").orderBy("gene_a", "gene_b"), f"{path}/likelihood_edges")
    tsv(edges.select("gene_a", "gene_b", F.col(weight).alias("edge_weight")).orderBy(F.desc("edge_weight"), "gene_a", "gene_b"), f"{path}/likelihood_weighted_edges")
    matrix_market(edges, genes, f"{path}/likelihood_mtx", weight)
    graphml(edges, f"{path}/likelihood_graphml", weight=weight)
    module_table(modules, f"{path}/likelihood_modules")


def comparison(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Lines of text that compare two networks."""
    from weftnet.operators.consensus import compare

    line = lambda text, c: F.concat(F.lit(text + ": "), F.col(c).cast("string"))
    lines = [line("edges in both", "n_both"), line(f"edges in {names[0]} alone", "n_only_a"), line(f"edges in {names[1]} alone", "n_only_b"), F.concat(F.lit("Jaccard index: "), F.format_number("jaccard", 4))]
    return compare(a, b).select(F.posexplode(F.array(*lines)).alias("o", "line")).orderBy("o")


def first_generation(modules: DataFrame, submodules: DataFrame, ids: DataFrame, path: str, hits: DataFrame | None = None) -> None:
    """Module sizes, submodules (name, gene), the map of gene names, and the enrichment of each submodule."""
    tsv(modules.groupBy("module").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "module"), f"{path}/module_sizes")
    tsv(submodules.select("name", "gene").orderBy("name", "gene"), f"{path}/submodules")
    tsv(ids.orderBy(*ids.columns), f"{path}/gene_ids")
    if hits is not None:
        tsv(hits.orderBy("p_adjusted", "set_name"), f"{path}/submodule_enrichment", by="module")


def module_table(modules: DataFrame, path: str) -> None:
    """Gene and Module (M and the id)."""
    tsv(modules.select(F.col("gene").alias("Gene"), F.concat(F.lit("M"), F.col("module").cast("string")).alias("Module")).orderBy("Module", "Gene"), path)


def enrichment(hits: DataFrame, path: str) -> None:
    """A folder per library with its hits, the columns that the tables have, and the test of each library."""
    from weftnet.operators.enrich import slug

    spark = hits.sparkSession
    named = hits.withColumn("slug", slug(F.col("library")))
    tsv(named, path, by="slug")
    spark.createDataFrame([(c,) for c in hits.columns], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_columns_used")
    method = named.groupBy("library", "slug").agg(F.count("*").alias("n_hits")).withColumns({"test": F.lit("hypergeometric, upper tail"), "adjustment": F.lit("Benjamini-Hochberg over all libraries")})
    tsv(method.orderBy("library"), f"{path}_methods_used", one_file=True)


def cache(df: DataFrame, path: str, fingerprint: str) -> None:
    """A table with the settings it was made under."""
    df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def training(records: DataFrame, path: str) -> DataFrame:
    """K7: the scores of neural estimates; batch summaries, loss curves and raw records (JSON) are written beside them.

    `records` are written first, so the training runs once.
    """
    from weftnet.operators import pairs

    records.write.mode("overwrite").parquet(f"{path}/records")
    records = records.sparkSession.read.schema(records.schema).parquet(f"{path}/records")
    batches = pairs.batches_of(records)
    tsv(batches.drop("losses").orderBy("batch"), f"{path}/batch_summary", by="study")
    tsv(pairs.loss_curve(records).orderBy("epoch"), f"{path}/loss_curve", by="study")
    batches.write.mode("overwrite").partitionBy("study").json(f"{path}/raw_diagnostics")
    return pairs.neural_scores(records)


def null_report(summary: DataFrame, bars: DataFrame, width: int = 50) -> DataFrame:
    """K5: lines of a null distribution's report with a histogram of text bars."""
    top = bars.groupBy("study").agg(F.max("n").alias("top"))
    bar = bars.join(top, "study").select("study", (F.col("bin") + 10).alias("o"), F.concat(F.format_string("%2d %8d ", "bin", "n"), F.repeat(F.lit("#"), F.round(F.col("n") / F.col("top") * width).cast("int"))).alias("line"))
    names = ("n", "mean", "std", "min", "max", "threshold", "p95", "p99", "p999")
    facts = summary.select("study", F.posexplode(F.array(*(F.concat(F.lit(n + "\t"), F.col(n).cast("string")) for n in names))).alias("o", "line"))
    return facts.union(bar).orderBy("study", "o")


def report(info: dict[str, object], timings: dict[str, float]) -> str:
    """Facts, and timings by falling share."""
    total = sum(timings.values()) or 1.0
    lines = [f"{k}: {json.dumps(v, default=str)}" for k, v in info.items()]
    return "\n".join([*lines, *(f"{k}\t{v:.2f} s\t{100 * v / total:.1f} %" for k, v in sorted(timings.items(), key=lambda x: -x[1]))])
