"""The page audits stand without the training-data operators, and the driver's contract holds."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent


def test_everything_else_imports_without_the_llm_folders(tmp_path):
    shutil.copytree(HOME, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']; print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout.strip().splitlines()[-1]) > 100


def test_nothing_outside_imports_the_llm_folder():
    for f in HOME.glob("siteloom/**/*.py"):
        if "llm" not in f.relative_to(HOME).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_entry(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["page_id", "title"]
    q = entry.queries()
    if any(k.startswith("op") for k in q):
        assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q if re.match(r"op\d+_", k)) == list(range(1, 14))
