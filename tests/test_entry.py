"""The entry module with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(*q)"


def listed(folder) -> list[str]:
    done = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy(tmp_path, *without: str):
    target = tmp_path / "copy"
    shutil.copytree(ROOT, target, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", "tests") or os.path.relpath(os.path.join(folder, n), ROOT) in without])
    return target


@pytest.mark.parametrize("without", [("plumbline/llm", "corpus_pipeline.py"), ("plumbline/llm",)])
def test_the_other_queries_stay_without_the_optional_parts(tmp_path, without):
    names = listed(copy(tmp_path, *without))
    assert len(names) > 140 and "agg1" in names and "jn1" in names
    assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_other_import_errors_are_not_swallowed(tmp_path):
    target = copy(tmp_path)
    (target / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    done = subprocess.run([sys.executable, "-c", LIST], cwd=target, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_anywhere" in done.stderr
