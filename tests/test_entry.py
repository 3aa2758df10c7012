"""The entry file with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("weftnet/llm",), ("weftnet/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ()])
def test_entry_without(tmp_path, gone):
    """Every import of the rest works, and no corpus query is registered, where the folders are deleted."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copytree(ROOT / "weftnet", tmp_path / "weftnet", ignore=shutil.ignore_patterns("__pycache__"))
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)})
    assert out.returncode == 0, out.stderr
    total, corpus, pipeline = out.stdout.split()
    here = (ROOT / "weftnet/llm/queries.py").exists() and "weftnet/llm" not in gone
    assert int(total) > 60 and (int(corpus) >= 10) == here and (here or int(corpus) == 0)
    assert pipeline == str(here and (ROOT / "corpus_pipeline.py").exists() and "corpus_pipeline.py" not in gone)
