"""The entry points without the training-data folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_training_data_folder(tmp_path):
    for name in ("kinchart", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        ignore = shutil.ignore_patterns("llm", "__pycache__")
        shutil.copytree(source, tmp_path / name, ignore=ignore) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    (tmp_path / "kinchart" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave behind
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
