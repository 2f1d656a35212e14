"""The entry file without the parts that it only adds."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("without", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_imports_without_the_corpus_operators(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", *without))
    assert not (copy / "trialstats" / "llm").exists() and not (copy / "tests" / "llm").exists()
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[2:] == ["[]"] and int(out.stdout.split()[0]) > 100
