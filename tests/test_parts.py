"""The library without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'token_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=300)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=300)
