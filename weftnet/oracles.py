"""DuckDB SQL of the registered queries, composed of named parts."""

from __future__ import annotations

import re

PERMS, PAIR_PERMS, SEED, P = 200, 20, 42, 0.05

#: Named parts; a query takes those it mentions, and what these mention, in this order.
PARTS = {
    "expr": "SELECT label AS study, 'G' || lpad((i - 1)::VARCHAR, 2, '0') AS gene, vec_id AS run, embedding[i]::DOUBLE AS x FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "counts": "SELECT l_partkey AS gene, l_suppkey AS run, sum(l_quantity) AS count FROM lineitem GROUP BY 1, 2",
    "meta": "SELECT s_suppkey AS run, n_name AS project FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "sets": "SELECT 'brands' AS library, p_brand AS set_name, p_partkey AS gene FROM part UNION ALL SELECT 'types', p_type, p_partkey FROM part UNION ALL SELECT 'sizes', 'size ' || p_size, p_partkey FROM part",
    "mods": "SELECT DISTINCT l_suppkey AS module, l_partkey AS gene FROM lineitem",
    "libs": "SELECT run, sum(count) AS lib_size FROM counts GROUP BY run",
    "rle_genes": "SELECT gene, avg(ln(count)) AS log_mean FROM counts WHERE count > 0 GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT run) FROM dense)",
    "dense": "SELECT gene % 40 AS gene, run % 25 AS run, sum(count) AS count FROM counts GROUP BY 1, 2",
    "dense_libs": "SELECT run, sum(count) AS lib_size FROM dense GROUP BY run",
    "dense_genes": "SELECT gene, avg(ln(count)) AS log_mean FROM dense WHERE count > 0 GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT run) FROM dense)",
    "rle_raw": "SELECT run, lib_size, median(exp(ln(count) - log_mean)) / any_value(lib_size) AS raw FROM dense JOIN dense_genes USING (gene) JOIN dense_libs USING (run) WHERE count > 0 GROUP BY run, lib_size",
    "rle": "SELECT run, lib_size, raw / exp(avg(ln(raw)) OVER ()) AS factor FROM rle_raw",
    "tmm_rank": "SELECT run, count, row_number() OVER (PARTITION BY run ORDER BY count DESC, gene) AS rk FROM dense WHERE count > 0",
    "tmm_place": "SELECT floor(p) AS p, p - floor(p) AS part FROM (SELECT 1 + (count(DISTINCT gene) - 1) * 0.25 AS p FROM dense WHERE count > 0)",
    "tmm_quart": "SELECT l.run, any_value(lib_size) AS n, (coalesce(max(count) FILTER (rk = p), 0) * (1 - any_value(part)) + coalesce(max(count) FILTER (rk = p + 1), 0) * any_value(part)) / any_value(lib_size) AS q FROM dense_libs l LEFT JOIN tmm_rank r ON r.run = l.run, tmm_place GROUP BY l.run",
    "tmm_ref": "SELECT run AS ref, n AS ref_n FROM tmm_quart ORDER BY abs(q - (SELECT avg(q) FROM tmm_quart)), run LIMIT 1",
    "tmm_both": "SELECT d.run, round(log2((d.count / lib_size) / (b.count / ref_n)), 10) AS m, round((log2(d.count / lib_size) + log2(b.count / ref_n)) / 2, 10) AS a, (lib_size - d.count) / lib_size / d.count + (ref_n - b.count) / ref_n / b.count AS v FROM tmm_ref JOIN dense b ON b.run = ref JOIN dense d ON d.gene = b.gene JOIN dense_libs l ON l.run = d.run WHERE d.count > 0 AND b.count > 0",
    "tmm_kept": "SELECT run, m, v FROM (SELECT *, rank() OVER (PARTITION BY run ORDER BY m) + (count(*) OVER (PARTITION BY run, m) - 1) / 2 AS rm, rank() OVER (PARTITION BY run ORDER BY a) + (count(*) OVER (PARTITION BY run, a) - 1) / 2 AS ra, count(*) OVER (PARTITION BY run) AS k FROM tmm_both) WHERE rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3) AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05)",
    "tmm_raw": "SELECT l.run, 2 ** coalesce(w, 0) AS raw FROM dense_libs l LEFT JOIN (SELECT run, sum(m / v) / sum(1 / v) AS w FROM tmm_kept GROUP BY 1) k ON k.run = l.run",
    "tmm": "SELECT run, raw / exp(avg(ln(raw)) OVER ()) AS factor FROM tmm_raw",
    "stats": "SELECT study, gene, avg(x) AS mean, stddev_pop(x) AS sd FROM expr GROUP BY 1, 2",
    "edges_q": "SELECT study, gene, list_distinct(list_filter(q, lambda e: e > lo AND e < hi)) AS edges FROM (SELECT study, gene, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS q, min(x) AS lo, max(x) AS hi FROM expr GROUP BY 1, 2)",
    "bins": "SELECT study, gene, run, len(list_filter(edges, lambda e: e <= x)) AS bin FROM expr JOIN edges_q USING (study, gene)",
    "joint": "SELECT a.study, a.gene AS gene_a, b.gene AS gene_b, a.bin AS bi, b.bin AS bj, count(*) AS c FROM bins a JOIN bins b ON a.study = b.study AND a.run = b.run AND a.gene < b.gene GROUP BY ALL",
    "joint_n": "SELECT *, sum(c) OVER g AS n, sum(c) OVER (PARTITION BY study, gene_a, gene_b, bi) AS ci, sum(c) OVER (PARTITION BY study, gene_a, gene_b, bj) AS cj FROM joint WINDOW g AS (PARTITION BY study, gene_a, gene_b)",
    "mi": "SELECT study, gene_a, gene_b, sum(c / n * ln(c * n / (ci * cj))) AS mi, sum(c / n * ln(c * n / (ci * cj))) + (count(DISTINCT bi) + count(DISTINCT bj) - count(*) - 1) / (2 * any_value(n)) AS mi_mm FROM joint_n GROUP BY 1, 2, 3",
    "pear": "SELECT a.study, a.gene AS gene_a, b.gene AS gene_b, corr(a.x, b.x) AS r FROM expr a JOIN expr b ON a.study = b.study AND a.run = b.run AND a.gene < b.gene GROUP BY ALL",
    "ranks": "SELECT study, gene, run, rank() OVER (PARTITION BY study, gene ORDER BY x) + (count(*) OVER (PARTITION BY study, gene, x) - 1) / 2 AS x FROM expr",
    "spear": "SELECT a.study, a.gene AS gene_a, b.gene AS gene_b, corr(a.x, b.x) AS r FROM ranks a JOIN ranks b ON a.study = b.study AND a.run = b.run AND a.gene < b.gene GROUP BY ALL",
    "mi_both": "SELECT study, gene_a AS gene, gene_b AS other, mi FROM mi UNION ALL SELECT study, gene_b, gene_a, mi FROM mi",
    "mi_stat": "SELECT study, gene, avg(mi) AS mean, CASE WHEN stddev_pop(mi) > 0 THEN stddev_pop(mi) ELSE 1 END AS sd FROM mi_both GROUP BY 1, 2",
    "clr": "SELECT mi.study, gene_a, gene_b, mi, sqrt(((mi - a.mean) / a.sd) ** 2 + ((mi - b.mean) / b.sd) ** 2) / sqrt(2) AS clr FROM mi JOIN mi_stat a ON a.study = mi.study AND a.gene = gene_a JOIN mi_stat b ON b.study = mi.study AND b.gene = gene_b",
    "gsize": "SELECT study, count(DISTINCT gene) AS g FROM expr GROUP BY 1",
    "trials": f"SELECT study, perm, i, (i + 1 + p % (g - 1)) % g AS j FROM (SELECT study, perm, g, ('0x' || substr(md5('{SEED}|' || study || '|' || perm || '|i'), 1, 8))::BIGINT % g AS i, ('0x' || substr(md5('{SEED}|' || study || '|' || perm || '|j'), 1, 8))::BIGINT AS p FROM gsize, (SELECT unnest(range(0, {PERMS})) AS perm))",
    "self_trials": f"SELECT study, perm, ('0x' || substr(md5('{SEED}|' || study || '|' || perm || '|i'), 1, 8))::BIGINT % g AS i, ('0x' || substr(md5('{SEED}|' || study || '|' || perm || '|j'), 1, 8))::BIGINT % g AS j FROM gsize, (SELECT unnest(range(0, {PERMS})) AS perm)",
    "vals": "SELECT study, run, bin, dense_rank() OVER (PARTITION BY study ORDER BY gene) - 1 AS ord, dense_rank() OVER (PARTITION BY study ORDER BY run) AS place FROM bins",
    "runs": "SELECT DISTINCT study, run FROM bins",
    "mixed": f"SELECT study, perm, run, row_number() OVER (PARTITION BY study, perm ORDER BY md5('{SEED}|' || study || '|' || perm || '|' || run), run) AS place FROM runs, (SELECT unnest(range(0, {PERMS})) AS perm)",
    "first_of": "SELECT t.study, t.perm, t.j, a.place, a.bin AS bi FROM trials t JOIN vals a ON a.study = t.study AND a.ord = t.i",
    "run_of": "SELECT f.study, f.perm, f.j, f.bi, m.run FROM first_of f JOIN mixed m ON m.study = f.study AND m.perm = f.perm AND m.place = f.place",
    "cells": "SELECT r.study, r.perm, r.bi, b.bin AS bj, count(*) AS c FROM run_of r JOIN vals b ON b.study = r.study AND b.ord = r.j AND b.run = r.run GROUP BY ALL",
    "cells_n": "SELECT *, sum(c) OVER (PARTITION BY study, perm) AS n, sum(c) OVER (PARTITION BY study, perm, bi) AS ci, sum(c) OVER (PARTITION BY study, perm, bj) AS cj FROM cells",
    "null_mi": "SELECT study, perm, sum(c / n * ln(c * n / (ci * cj))) AS mi FROM cells_n GROUP BY 1, 2",
    "self_first": "SELECT t.study, t.perm, t.j, a.place, a.bin AS bi FROM self_trials t JOIN vals a ON a.study = t.study AND a.ord = t.i",
    "self_cells": "SELECT f.study, f.perm, f.bi, b.bin AS bj, count(*) AS c FROM self_first f JOIN mixed m ON m.study = f.study AND m.perm = f.perm AND m.place = f.place JOIN vals b ON b.study = f.study AND b.ord = f.j AND b.run = m.run GROUP BY ALL",
    "self_null": "SELECT study, perm, sum(c / n * ln(c * n / (ci * cj))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY study, perm) AS n, sum(c) OVER (PARTITION BY study, perm, bi) AS ci, sum(c) OVER (PARTITION BY study, perm, bj) AS cj FROM self_cells) GROUP BY 1, 2",
    "sig_all": f"SELECT mi.study, gene_a, gene_b, mi.mi, (SELECT count(*) FROM null_mi u WHERE u.study = mi.study AND round(u.mi, 9) >= round(mi.mi, 9)) / {PERMS} AS p_value FROM mi",
    "sig": f"SELECT * FROM sig_all WHERE p_value < {P}",
    "cons": "SELECT gene_a, gene_b, count(DISTINCT study) AS n_studies, avg(mi) AS mean_mi, avg(-log10(p_value + 1e-12)) AS mean_nlp FROM sig GROUP BY 1, 2 HAVING count(DISTINCT study) >= 2",
    "adj": "SELECT gene_a AS v, gene_b AS u FROM cons UNION SELECT gene_b, gene_a FROM cons",
    "deg": "SELECT v, count(*) AS degree FROM adj GROUP BY 1",
    "tri": "SELECT v, count(*) AS triangles FROM (SELECT unnest([x.gene_a, x.gene_b, y.gene_b]) AS v FROM cons x JOIN cons y ON x.gene_b = y.gene_a JOIN cons z ON z.gene_a = x.gene_a AND z.gene_b = y.gene_b) GROUP BY 1",
    "cons_reach": "SELECT v, v AS c FROM adj UNION SELECT adj.u, cons_reach.c FROM cons_reach JOIN adj ON adj.v = cons_reach.v WHERE cons_reach.c < adj.u",
    "cons_comp": "SELECT v, min(c) AS component FROM cons_reach GROUP BY v",
    "near_edges": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE (a.s_suppkey * 7 + b.s_suppkey * 3) % (2 + a.s_nationkey % 4) > 0 OR a.s_nationkey % 4 = 3 UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)",
    "near_adj": "SELECT a AS v, b AS u FROM near_edges UNION SELECT b, a FROM near_edges",
    "top_parts": "SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2",
    "bg": "SELECT DISTINCT gene FROM mods",
    "mod_n": "SELECT module, gene, count(*) OVER (PARTITION BY module) AS n_module FROM mods",
    "set_n": "SELECT set_name, gene, count(*) OVER (PARTITION BY set_name) AS n_set FROM (SELECT DISTINCT set_name, gene FROM sets JOIN bg USING (gene))",
    "hits": "SELECT module, set_name, n_module, n_set, count(*) AS overlap, string_agg(gene::VARCHAR, ';' ORDER BY gene::VARCHAR) AS genes, (SELECT count(*) FROM bg) AS n_bg FROM mod_n JOIN set_n USING (gene) WHERE n_module >= 2 GROUP BY ALL HAVING count(*) >= 2",
    "tested": "SELECT *, least(1, (SELECT sum(exp(lgamma(n_set + 1) - lgamma(j + 1) - lgamma(n_set - j + 1) + lgamma(n_bg - n_set + 1) - lgamma(n_module - j + 1) - lgamma(n_bg - n_set - n_module + j + 1) - lgamma(n_bg + 1) + lgamma(n_module + 1) + lgamma(n_bg - n_module + 1))) FROM (SELECT unnest(range(overlap, least(n_set, n_module) + 1)) AS j) WHERE n_bg - n_set - n_module + j >= 0)) AS p_value FROM hits",
    "ranked_p": "SELECT *, row_number() OVER (ORDER BY p_value, module, set_name) AS rk, count(*) OVER () AS m FROM tested",
    "annotated": "SELECT *, least(1, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM ranked_p",
}
#: Rounds of h-indices in SQL; core levels of the registered graphs are settled by then.
ROUNDS = 24


def core_sql(adj: str, out: str) -> dict[str, str]:
    """Named parts: core levels as h-indices of neighbours' levels, round by round."""
    parts = {f"{out}_0": f"SELECT v, count(*) AS core FROM {adj} GROUP BY 1"}
    for k in range(1, ROUNDS + 1):
        parts[f"{out}_{k}"] = f"SELECT v, max(least(c, rk)) AS core FROM (SELECT e.v, l.core AS c, row_number() OVER (PARTITION BY e.v ORDER BY l.core DESC) AS rk FROM {adj} e JOIN {out}_{k - 1} l ON l.v = e.u) GROUP BY 1"
    return parts | {out: f"SELECT * FROM {out}_{ROUNDS}"}


PARTS |= core_sql("adj", "cons_core") | core_sql("near_adj", "near_core")
PARTS |= {
    "run_pairs": "SELECT a.study, a.run AS a, b.run AS b, greatest(0, least(2, 1 - corr(a.x, b.x))) AS d FROM expr a JOIN expr b ON a.study = b.study AND a.gene = b.gene AND a.run < b.run GROUP BY 1, 2, 3",
    # average linkage: the nearest two become cluster -it - 1; distances to it are means weighted by size
    "merging": "SELECT study, 0 AS it, a::BIGINT AS a, b::BIGINT AS b, d, 1::BIGINT AS na, 1::BIGINT AS nb FROM run_pairs UNION ALL SELECT study, it, lo, hi, sum(d * w) / sum(w), any_value(CASE WHEN lo = -it THEN nboth WHEN lo = x THEN na ELSE nb END), any_value(CASE WHEN hi = -it THEN nboth WHEN hi = x THEN na ELSE nb END) FROM (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi FROM (SELECT study, it + 1 AS it, d, m.na + m.nb AS nboth, CASE WHEN a IN (m.a, m.b) THEN -it - 1 ELSE a END AS x, CASE WHEN b IN (m.a, m.b) THEN -it - 1 ELSE b END AS y, na, nb, CASE WHEN a IN (m.a, m.b) THEN na WHEN b IN (m.a, m.b) THEN nb ELSE 1 END AS w FROM (SELECT *, first_value({'a': a, 'b': b, 'na': na, 'nb': nb}) OVER (PARTITION BY study ORDER BY d, a, b) AS m FROM merging) WHERE NOT (a IN (m.a, m.b) AND b IN (m.a, m.b)))) GROUP BY study, it, lo, hi",
    "near_reach": "SELECT v, v AS c FROM near_adj UNION SELECT near_adj.u, near_reach.c FROM near_reach JOIN near_adj ON near_adj.v = near_reach.v WHERE near_reach.c < near_adj.u",
    "near_deg": "SELECT v, count(*) AS degree FROM near_adj GROUP BY 1",
    "near_tri": "SELECT x.v, count(*) AS triangles FROM near_adj x JOIN near_adj y ON y.v = x.v AND x.u < y.u JOIN near_adj z ON z.v = x.u AND z.u = y.u GROUP BY 1",
    "near_weight": "SELECT v, core * (degree + coalesce(triangles, 0)) / (degree * (degree + 1) / 2) AS weight FROM near_core JOIN near_deg USING (v) LEFT JOIN near_tri USING (v)",
    "near_kept": "SELECT v, weight FROM near_weight WHERE weight >= 0.2 * (SELECT max(weight) FROM near_weight)",
    "kept_adj": "SELECT e.v, e.u FROM near_adj e JOIN near_kept x ON x.v = e.v JOIN near_kept y ON y.v = e.u",
    "kept_reach": "SELECT v, v AS c FROM kept_adj UNION SELECT kept_adj.u, kept_reach.c FROM kept_reach JOIN kept_adj ON kept_adj.v = kept_reach.v WHERE kept_reach.c < kept_adj.u",
    "kept_comp": "SELECT v, min(c) AS component FROM kept_reach GROUP BY v",
    "kept_good": "SELECT component, max(weight) AS top FROM kept_comp JOIN near_kept USING (v) GROUP BY 1 HAVING count(*) >= 3 AND (SELECT count(*) / 2 FROM kept_adj e JOIN kept_comp k ON k.v = e.v WHERE k.component = kept_comp.component) / (count(*) * (count(*) - 1) / 2) >= 0.3",
    "kept_ids": "SELECT component, row_number() OVER (ORDER BY round(top, 9) DESC, component) - 1 AS module FROM kept_good",
}


def axis_sql(matrix: str, out: str) -> dict[str, str]:
    """Named parts: the first eigenvector of a symmetric matrix (a list of rows), by 30 squarings scaled to trace 1."""
    diagonal = "list_transform(range(1, len(m) + 1), lambda i: m[i][i])"
    return {
        f"{out}_power": f"SELECT 0 AS k, m FROM {matrix} UNION ALL SELECT k + 1, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) FROM (SELECT k, m, list_sum({diagonal}) AS t FROM (SELECT k, list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s))) AS m FROM {out}_power WHERE k < 30))",
        out: f"SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM (SELECT m[list_position(d, list_max(d))] AS r FROM (SELECT m, {diagonal} AS d FROM {out}_power WHERE k = 30))",
    }


PARTS |= {
    "sig_adj": "SELECT study, gene_a AS v, gene_b AS u FROM sig UNION SELECT study, gene_b, gene_a FROM sig",
    "sig_reach": "SELECT study, v, v AS c FROM sig_adj UNION SELECT sig_adj.study, sig_adj.u, sig_reach.c FROM sig_reach JOIN sig_adj ON sig_adj.study = sig_reach.study AND sig_adj.v = sig_reach.v WHERE sig_reach.c < sig_adj.u",
    "sig_comp": "SELECT study, component, count(*) AS size FROM (SELECT study, v, min(c) AS component FROM sig_reach GROUP BY 1, 2) GROUP BY 1, 2",
    "zs": "SELECT gene, run, (x - avg(x) OVER (PARTITION BY gene)) / stddev_samp(x) OVER (PARTITION BY gene) AS z FROM expr",
    "gram": "SELECT a.gene AS g, b.gene AS h, sum(a.z * b.z) AS v FROM zs a JOIN zs b ON a.run = b.run GROUP BY 1, 2",
    "gram_rows": "SELECT list(r ORDER BY g) AS m FROM (SELECT g, list(v ORDER BY h) AS r FROM gram GROUP BY g)",
    **axis_sql("gram_rows", "axis_one"),
    "gram_less": "SELECT list_transform(range(1, len(m) + 1), lambda i: list_transform(range(1, len(m) + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM (SELECT m, v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS l FROM gram_rows, axis_one)",
    **axis_sql("gram_less", "axis_two"),
    "on_axes": "SELECT run, sum(z * one.v[i]) AS a, sum(z * two.v[i]) AS b FROM (SELECT run, z, dense_rank() OVER (ORDER BY gene) AS i FROM zs), axis_one one, axis_two two GROUP BY run",
    "coordinates": "SELECT run, round(a * sign(first_value(a) OVER (ORDER BY round(abs(a), 9) DESC, run DESC)), 6) + 0.0 AS pc1, round(b * sign(first_value(b) OVER (ORDER BY round(abs(b), 9) DESC, run DESC)), 6) + 0.0 AS pc2 FROM on_axes",
}
ORDER = list(PARTS)


def with_parts(select: str) -> str:
    """The query with the parts that it needs."""
    need: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in ORDER:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(PARTS[name])
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for other in ORDER:
            if other != name and re.search(rf"\b(FROM|JOIN|,)\s+{other}\b", PARTS[name]):
                add(other)
        done.append(name)

    for name in ORDER:
        if name in need:
            add(name)
    heads = ", ".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in done)
    return f"WITH RECURSIVE {heads} {select}" if done else select
