"""The entry without the optional part: only an empty folder of it is left over."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.abspath(os.path.join(os.path.dirname(__file__), ".."))


def test_entry_with_a_left_over_folder(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "concordat"), tmp_path / "concordat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "concordat" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith(('op', 'pipeline')) for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    n, optional, subset = out.stdout.split()
    assert int(n) > 180 and optional == "0" and subset == "True"
