"""The driver's entry with and without the text subpackage, in copies of the repository."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder):
    import json

    env = {**os.environ, "PYTHONPATH": str(folder)}
    return json.loads(subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout)


@pytest.fixture
def copy(tmp_path):
    for name in ("tarnlight", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leave_folder", [True, False])
def test_queries_without_the_text_subpackage(copy, pipeline, leave_folder):
    shutil.rmtree(copy / "tarnlight" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if leave_folder:
        (copy / "tarnlight" / "llm" / "__pycache__").mkdir(parents=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    names, sql = listed(copy)
    from tarnlight import profile_queries

    assert names == sorted(profile_queries.QUERIES) and sql == sorted(profile_queries.ORACLE_SQL)


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "tarnlight").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tarnlight").parts:
            assert not re.search(r"(?:import|from)\b.*\bllm\b", path.read_text()), path
