"""The entry point with and without the text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def names(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(set(e.oracle_sql()) - set(e.queries())))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout.split("\n")
    return out[-3].split(), out[-2].split()


def test_every_oracle_has_a_query():
    found, extra = names(ROOT)
    assert len(found) > 100 and not extra


def test_the_rest_works_without_the_text_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "caseloom"), tmp_path / "caseloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found, extra = names(str(tmp_path))
    assert "a6_accounts_in_cases" in found and not extra and not [n for n in found if n.startswith("op") or n == "pipeline"]
