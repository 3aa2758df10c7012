"""Graphs whose links are packed by blocks of vertices, against plain twins."""

import numpy as np
import pytest

from weftnet.operators import community, graph


@pytest.mark.parametrize("limits", [(512, 1_000_000, 2048, 8192), (8, 40, 5, 7)])
def test_triangles_without_wedges(spark, monkeypatch, limits):
    """blocks of vertices meet lists of neighbours, in few or many parts; no join makes wedges."""
    for name, value in zip(("VERTICES", "LINKS", "LISTS", "COLUMNS"), limits, strict=True):
        monkeypatch.setattr(graph, f"BLOCK_{name}", value)
    rng = np.random.default_rng(0)
    rows = [(g, f"v{a:02d}", f"v{b:02d}") for g in (0, 1) for a, b in rng.integers(0, 60, (500, 2))] + [(2, "hub", f"v{b:02d}") for b in range(60)]
    found = graph.triangles(spark.createDataFrame(rows, "graph int, a string, b string"))
    want = {}
    for g in (0, 1):
        m = np.zeros((60, 60))
        for h, a, b in rows:
            if h == g and a != b:
                m[int(a[1:]), int(b[1:])] = m[int(b[1:]), int(a[1:])] = 1
        want |= {(g, f"v{k:02d}"): int(n) for k, n in enumerate(np.diag(m @ m @ m) / 2) if n}
    assert {(r["graph"], r["v"]): r["triangles"] for r in found.collect()} == want
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["louvain", "leiden"])
def test_moves_in_blocks(spark, monkeypatch, method):
    """links in small blocks and sums in small pieces give the communities of one block; weights and names of any kind."""
    rng = np.random.default_rng(1)
    rows = [(g, f"v{a:02d}", f"v{b:02d}", float(rng.integers(1, 4))) for g in ("x", "y") for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.8 if a // 8 == b // 8 else 0.05)]
    edges = spark.createDataFrame(rows, "graph string, a string, b string, w double")
    found = lambda: sorted(map(tuple, community.communities(edges, method, least_size=1, weight="w", task_edges=0).collect()))
    want = found()
    parts = {}
    for g, m, v in want:
        parts.setdefault((g, m), set()).add(int(v[1:]) // 8)
    assert len(parts) >= 6 and all(len(x) == 1 for x in parts.values())
    for name, value in (("VERTICES", 4), ("LINKS", 30)):
        monkeypatch.setattr(graph, f"BLOCK_{name}", value)
    monkeypatch.setattr(community, "BLOCK_SUMS", 50)
    assert found() == want


def test_links_within_communities_join_as_they_did():
    """a long path within a community stays one piece, the other community apart."""
    n = 500
    order = np.random.default_rng(2).permutation(n)
    block = {"names": np.arange(n), "c": np.where(np.arange(n) < 5, 1, 0), "at": order[:-1], "to": order[1:]}
    joined = community._joined(block)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in joined.itertuples(index=False):
        root[find(b)] = find(a)
    same = block["c"][order]
    runs = 1 + int((same[1:] != same[:-1]).sum())
    assert len({find(x) for x in range(n)}) == runs and len(joined) == n - runs
    assert all((find(a) == find(b)) for a, b in zip(order[:-1], order[1:], strict=True) if block["c"][a] == block["c"][b])
