"""The entry without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TELL = "import __spark_entry__ as e; from roadgrid.plans.queries import QUERIES as q; assert set(e.queries()) == set(q) == set(e.oracle_sql())"


def without(tmp_path, *names):
    """A copy of the repository without these files and folders."""
    skip = {os.path.join(ROOT, n) for n in names}
    leave = lambda d, found: [n for n in found if n in (".git", "__pycache__", ".pytest_cache") or os.path.join(d, n) in skip]
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=leave)


def imports(root, code):
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry_without_the_subpackage(tmp_path):
    imports(without(tmp_path, "roadgrid/llm", "tests/llm"), TELL)


def test_entry_without_the_subpackage_and_the_pipeline(tmp_path):
    imports(without(tmp_path, "roadgrid/llm", "tests/llm", "corpus_pipeline.py"), TELL)
