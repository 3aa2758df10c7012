"""The jobs over growing input: two runs and more, on copies."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from jobs import common, study_networks, term_counts
from weftnet.plans import resume

ROOT = Path(__file__).resolve().parents[1]
TEXTS = [
    (0, "The cat and the dog and the cat", "en", "a"),
    (1, "the dog, THE cat; and 12 more", "en", "b"),
    (2, "the cat and the the ünï dog dog", "en", "c d/e"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, "ein Hund und ein Hund und", "de", "a"),
    (6, "ein Hund und ein ein und und und", "de", "b"),
    (7, "no language the cat", None, "a"),
]
MORE = [(8, "the cat the cat and and dog dog dog", "en", "d"), (None, "the and", "en", "a"), (8, "the cat the cat and and dog dog dog", "en", "d")]
SMALL = term_counts.Settings(least_samples=2, above=0, least_library=2)


def save(spark, rows, path, schema="doc_id long, text string, lang string, source string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def parts(path):
    return {p.parent.name: p.name for p in Path(path).rglob("*.parquet")}


def test_terms_of_growing_input(spark, tmp_path):
    docs, out, check = (str(tmp_path / x) for x in ("docs", "out", "check"))
    save(spark, TEXTS, docs)
    first = rows_of(term_counts.run(spark, docs, out, check, SMALL))
    assert first and first == rows_of(term_counts.matrix(term_counts.term_counts(spark.read.parquet(docs)), SMALL))
    before = parts(f"{out}/matrix")
    assert set(before) == {"study=en", "study=de"}
    assert rows_of(term_counts.run(spark, docs, out, check, SMALL)) == first
    assert parts(f"{out}/matrix") == before and len(list(Path(f"{out}/counts").glob("batch=*"))) == 1
    save(spark, MORE, docs)
    second = rows_of(term_counts.run(spark, docs, out, check, SMALL))
    assert second != first and second == rows_of(term_counts.matrix(term_counts.term_counts(spark.read.parquet(docs)), SMALL))
    after = parts(f"{out}/matrix")
    assert after["study=de"] == before["study=de"] and after["study=en"] != before["study=en"]  # the untouched study stays
    assert {p.name for p in Path(f"{out}/counts").glob("batch=*")} == {"batch=0", "batch=1"}
    # other settings: everything again, from the counts alone
    other = term_counts.Settings(least_samples=3, above=0, least_library=2)
    assert rows_of(term_counts.run(spark, docs, out, check, other).where("study = 'en'")) == rows_of(term_counts.matrix(term_counts.term_counts(spark.read.parquet(docs)), other).where("study = 'en'"))


def test_terms_after_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    """Counts are there, the matrix isn't: the next run makes it."""
    docs, out, check = (str(tmp_path / x) for x in ("docs", "out", "check"))
    save(spark, TEXTS, docs)
    with monkeypatch.context() as m:
        m.setattr(term_counts, "matrix", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            term_counts.run(spark, docs, out, check, SMALL)
    assert rows_of(term_counts.run(spark, docs, out, check, SMALL)) == rows_of(term_counts.matrix(term_counts.term_counts(spark.read.parquet(docs)), SMALL))


def test_terms_of_nothing(spark, tmp_path):
    docs, out, check = (str(tmp_path / x) for x in ("docs", "out", "check"))
    save(spark, [], docs)
    assert term_counts.run(spark, docs, out, check, SMALL).collect() == []
    save(spark, TEXTS[3:5], docs)
    assert term_counts.run(spark, docs, out, check, SMALL).collect() == []


VECTORS = "vec_id long, label int, embedding array<float>"


def vectors(label, seed, n=30, first=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[:, 1] = x[:, 0] + rng.normal(size=n) * 0.1
    x[:, 5] = x[:, 4] * 2
    return [(1000 * label + first + k, label, v.tolist()) for k, v in enumerate(np.float32(x))]


def networks(spark, path, out, **more):
    return study_networks.run(spark, str(path), str(out), study_networks.Settings(permutations=40, p_threshold=0.05, least_studies=2, **more))


def test_networks_of_growing_input(spark, tmp_path, monkeypatch):
    seen = []
    whole = resume.scored
    monkeypatch.setattr(resume, "scored", lambda x, s: seen.append(sorted(r[0] for r in x.select("study").distinct().collect())) or whole(x, s))
    one, two, out = tmp_path / "one", tmp_path / "two", tmp_path / "out"
    odd = [(None, 1, [1.0] * 8), (5, None, [1.0] * 8), (6, 1, None), (7, 9, [0.5] * 8)]
    save(spark, vectors(1, 1) + vectors(2, 2) + odd, one, VECTORS)
    first = rows_of(networks(spark, one, out))
    assert any("study=None" in r for r in first) and any("study='1'" in r for r in first)
    assert rows_of(networks(spark, one, out)) == first and seen == [["1", "2"]]
    # study 2 changes, study 3 is new, study 1 stays
    save(spark, vectors(1, 1) + vectors(2, 7) + vectors(3, 3) + odd, two, VECTORS)
    second = rows_of(networks(spark, two, out))
    assert seen == [["1", "2"], ["2", "3"]]
    assert second == rows_of(networks(spark, two, tmp_path / "fresh")) and seen.pop() == ["1", "2", "3"]
    # back to the first input: nothing is scored, what left it is gone
    assert rows_of(networks(spark, one, out)) == first and len(seen) == 2
    # another setting is another version
    assert rows_of(networks(spark, one, out, seed=5)) and seen.pop() == ["1", "2"]


def test_networks_after_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    """Edges without a commit don't count, and are written again."""
    one, out = tmp_path / "one", tmp_path / "out"
    save(spark, vectors(1, 1) + vectors(2, 2), one, VECTORS)
    with monkeypatch.context() as m:
        m.setattr(resume.graph, "topology", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            networks(spark, one, out)
    assert list((out / "edges").rglob("*.parquet")) and not (out / "commits").exists()
    assert rows_of(networks(spark, one, out)) == rows_of(networks(spark, one, tmp_path / "fresh"))
    save(spark, [], tmp_path / "none", VECTORS)
    assert networks(spark, tmp_path / "none", tmp_path / "empty").collect() == []


def test_settings(spark, tmp_path):
    assert common.settings(spark, term_counts.Settings, str(ROOT / "jobs/term_counts.json")) == term_counts.Settings()
    assert common.settings(spark, study_networks.Settings, str(ROOT / "jobs/study_networks.json")).least_studies == 2
    (tmp_path / "bad.json").write_text('{"no_such": 1}')
    with pytest.raises(ValueError, match="no_such"):
        common.settings(spark, term_counts.Settings, str(tmp_path / "bad.json"))


def test_command_line(spark, tmp_path):
    save(spark, TEXTS, tmp_path / "docs")
    args = ["--documents", str(tmp_path / "docs"), "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "check"), "--config", str(ROOT / "jobs/term_counts.json")]
    done = subprocess.run([sys.executable, str(ROOT / "jobs/term_counts.py"), *args], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=dict(os.environ))
    assert done.returncode == 0, done.stderr
    assert "read 8 new documents" in done.stderr and "wrote the matrices" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out/counts")).where("gene = 'cat'").count() > 0
