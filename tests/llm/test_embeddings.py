import numpy as np
import pytest

from weftnet.llm import embed_dedup as ed


def brute(rows, threshold):
    ok = []
    for vec_id, v, label in rows:
        y = None if v is None or label is None or vec_id is None or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        ok.append(y if y is not None and len(y) and np.isfinite(y).all() and (y != 0).any() else None)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(60):
            v = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 4))):
                rows.append((k, (v + rng.normal(size=16) * 0.15).tolist(), label))
                k += 1
    tight, loose = rng.normal(size=16), rng.normal(size=16)
    for j in range(400):
        rows.append((k + 2 * j, (tight + rng.normal(size=16) * 0.05).tolist(), 1))
        rows.append((k + 2 * j + 1, (loose + rng.normal(size=16) * 0.22).tolist(), 0))
    rows += [(5000, [0.0] * 16, 1), (5001, None, 1), (5002, [1.0] * 16, None), (5003, [1.0, None] * 8, 1), (5004, [float("nan")] * 16, 1), (5005, [], 1), (5006, [1.0] * 3, 1), (5007, [2.0] * 3, 1), (5008, [1e30] * 16, 0)]
    rows += [rows[3], rows[3], (6000, rows[5][1], rows[5][2]), (None, rows[3][1], 0)]
    return rows


def test_against_brute_force(spark, vectors):
    df = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<float>, label int, weight int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in ed.near_duplicates(df).collect()), key=str)
    assert got == brute(vectors, 0.93)
    assert ed.near_duplicates(df.limit(0)).collect() == []


def test_passes_grow_slowly():
    assert ed.passes_for(1000) < ed.passes_for(10**6) < 5 * ed.passes_for(1000)


def test_clustered_label(spark):
    """Vectors around one direction share their leading bits; planted pairs among them are found all the same."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64) / 8
    base = centre + rng.normal(size=(3000, 64)) / 8 * 0.5
    base /= np.linalg.norm(base, axis=1)[:, None]
    off = rng.normal(size=(400, 64))
    off -= (off * base[:400]).sum(1)[:, None] * base[:400]
    off /= np.linalg.norm(off, axis=1)[:, None]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.vstack([base, 0.935 * base[:400] + np.sqrt(1 - 0.935**2) * off]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in ed.near_duplicates(df).collect()}
    assert all(got[k]["n_links"] >= 1 and got[k]["component_id"] == got[3000 + k]["component_id"] for k in range(400))


def test_whole_ranges_equal_brute_force(spark):
    """Blocks of dense ranges, and of labels compared whole, unite what brute force unites."""
    from weftnet.llm.common import components, persist

    rng = np.random.default_rng(9)
    x = rng.normal(size=12) + rng.normal(size=(500, 12)) * 0.45
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {r[0]: r[2] for r in brute([(k, v.tolist(), 0) for k, v in enumerate(x)], 0.97)}
    classes = persist(spark.createDataFrame([(k, 0, v.tobytes()) for k, v in enumerate(x)], "cid long, label long, vec binary"))
    for passes in (40, 200):
        got = {r["node"]: r["component"] for r in components(ed.link_dense(classes, passes, 1, 0.97, 8, 100)).collect()}
        assert {k: got.get(k, k) for k in want} == want


def test_dense_labels_lose_no_links(spark):
    """Labels of mean cosine 0, 0.8, 0.86 and 0.9 with planted pairs just above the threshold, against brute force."""
    rng = np.random.default_rng(11)
    rows, dim = [], 64
    for label, mean in enumerate((0.0, 0.8, 0.86, 0.9)):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        x = np.sqrt(mean) * centre + np.sqrt(1 - mean) * rng.normal(size=(1200, dim)) / np.sqrt(dim)
        x /= np.linalg.norm(x, axis=1)[:, None]
        off = rng.normal(size=(100, dim))
        off -= (off * x[:100]).sum(1)[:, None] * x[:100]
        off /= np.linalg.norm(off, axis=1)[:, None]
        x = np.vstack([x, 0.935 * x[:100] + np.sqrt(1 - 0.935**2) * off])
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicates(df).collect()}
    for label in range(4):
        ids = np.array([r[0] for r in rows if r[2] == label])
        x = np.array([r[1] for r in rows if r[2] == label])
        x /= np.linalg.norm(x, axis=1)[:, None]
        ok = x @ x.T >= 0.93
        np.fill_diagonal(ok, False)
        names = ids.copy()
        while True:
            low = np.minimum(names, np.where(ok, names[None], ids.max()).min(1))
            if (low == names).all():
                break
            names = low
        links = ok.sum(1)
        assert links.sum() >= 200
        assert [got[i] for i in ids] == list(zip(links.tolist(), names.tolist(), strict=True))
