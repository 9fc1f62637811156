"""The rest works without the subpackage of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copytree(HERE / "pagewright", tmp_path / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (HERE / "corpus_pipeline.py").exists()):
        shutil.copy(HERE / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = (line.split() for line in done.stdout.strip().splitlines()[-2:])
    assert "hybrid_search" in queries and set(sql) <= set(queries) and not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_nothing_else_imports_them():
    for p in (HERE / "pagewright").rglob("*.py"):
        if "llm" not in p.relative_to(HERE).parts:
            assert "pagewright.llm" not in p.read_text() and "from ..llm" not in p.read_text() and "from .llm" not in p.read_text()
