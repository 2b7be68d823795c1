"""The entry module with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


def shown(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True)


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for name in ("attesta", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "attesta" / "llm", ignore_errors=True)
    out = shown(tmp_path)
    assert out.returncode == 0, out.stderr
    n, ops, pipeline, known = out.stdout.split()
    assert int(n) > 80 and (ops, pipeline, known) == ("0", "False", "True")


def test_a_broken_subpackage_is_no_missing_one(tmp_path):
    for name in ("attesta", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    llm = tmp_path / "attesta" / "llm"
    llm.mkdir(exist_ok=True)
    (llm / "__init__.py").touch()
    (llm / "registry.py").write_text("import a_module_that_is_not_there\n")
    assert shown(tmp_path).returncode != 0
