"""Queries over whole tables against SQL over a part: the SQL gets the same rows with keys that make them that part."""

import os

import duckdb
import pytest

from tests.test_oracles import FOLDER, plain
from weftnet import queries
from weftnet.operators import graph
from weftnet.oracles import PARTS
from weftnet.queries import PART_ORACLES, QUERIES
from weftnet.sources import writers

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Makes a folder of the smallest tables, some of them by SQL."""

    def make(**changed):
        d = tmp_path_factory.mktemp("tables")
        for f in os.listdir(FOLDER):
            name = f.removesuffix(".parquet")
            duckdb.sql(f"copy ({changed.get(name, 'select * from t').replace('from t', f"from '{FOLDER}/{f}'")}) to '{d}/{f}' (format parquet)")
        return str(d)

    return make


def rows(cols, found, shift=None):
    shift = shift or {}
    return sorted(tuple(plain(r[c] - shift.get(c, 0) if c in shift else r[c]) for c in cols) for r in found)


def by_sql(sql, d):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    return sorted(names), [dict(zip(names, x, strict=True)) for x in r.fetchall()]


def test_components_of_all_orders(spark, folder):
    """SQL that is too slow on larger tables has the same components on the smallest."""
    cols, want = by_sql(PART_ORACLES["components"], FOLDER)
    got = QUERIES["components"](spark, FOLDER).collect()
    assert want and rows(cols, got) == rows(cols, want)


def test_neural_information_of_all_candidates(spark, folder):
    d = folder(embeddings="select label, vec_id, embedding[:12] as embedding from t where label < 2")
    got = {(r["study"], r["gene_a"], r["gene_b"]) for r in QUERIES["neural_mi"](spark, d).collect()}
    sql = "select a.study, a.gene as gene_a, b.gene as gene_b from x a join x b on a.study = b.study and a.run = b.run and a.gene < b.gene group by all having abs(corr(a.x, b.x)) > 0.1"
    x = "select label as study, vec_id as run, 'G' || lpad((i - 1)::varchar, 2, '0') as gene, embedding[i]::double as x from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)"
    want = by_sql(f"with x as ({x}) {sql}", d)[1]
    assert len(want) > 10 and got == {(r["study"], r["gene_a"], r["gene_b"]) for r in want}


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """700 suppliers of five nations, one of them without."""
    path = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1, 701).selectExpr("id s_suppkey", "cast(case when id = 350 then null when id <= 400 then 7 else id % 4 end as int) s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return path


def test_near_suppliers_in_blocks(spark, suppliers, monkeypatch):
    """The links by SQL, from blocks that meet in several tasks."""
    monkeypatch.setattr(queries, "NEAR_BLOCK", 64)
    monkeypatch.setattr(queries, "NEAR_PAIRS", 20_000)
    near = queries._near_suppliers(spark, suppliers)
    assert near.rdd.getNumPartitions() > 4
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{suppliers}/supplier.parquet/*.parquet')")
    want = sorted(con.execute(PARTS["near_edges"]).fetchall())
    assert sorted((r["a"], r["b"]) for r in near.collect()) == want
    # components from few links
    stars = queries._near_stars(spark, suppliers)
    assert set((r["a"], r["b"]) for r in stars.collect()) <= set(want) and stars.count() < 10 * 700 < len(want)
    assert sorted(graph.components(stars).collect()) == sorted(graph.components(near).collect())


def test_module_graphs_in_ranges(spark, tmp_path, monkeypatch):
    """F8: a module's lines are several parts, and one document when joined in order of name."""
    monkeypatch.setattr(writers, "GRAPH_LINES", 20)
    modules = spark.range(40).selectExpr("0 module", "id gene")
    edges = modules.selectExpr("gene gene_a", "gene + 1 gene_b").where("gene_b < 40")
    writers.module_graphs(edges, modules, f"{tmp_path}/g")
    parts = sorted((tmp_path / "g" / "module=0").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 2 and len(lines) == 81 and lines[0].startswith("<graphml") and lines[-1] == "</graph></graphml>"
    assert lines[1:41] == [f'<node id="{g}"/>' for g in sorted(map(str, range(40)))]
