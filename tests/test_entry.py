"""The entry module works without the training-data subpackage, and shows errors of other kinds."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

from gridloom.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=120)


def copy(to, *without):
    shutil.copytree(ROOT / "gridloom", to / "gridloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to)
    for name in without:
        path = to / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)


def test_without_the_subpackage(tmp_path):
    copy(tmp_path, "gridloom/llm", "corpus_pipeline.py")
    done = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), [q for q in e.queries() if q.startswith('op')])")
    assert done.returncode == 0 and done.stdout.split()[0] == str(len(QUERIES)) and "True []" in done.stdout, done.stderr


def test_missing_library_and_other_errors(tmp_path):
    """A library that isn't there costs the subpackage's queries alone; an error of another kind shows."""
    copy(tmp_path)
    if not (tmp_path / "gridloom/llm").exists():
        return
    (tmp_path / "gridloom/llm/queries.py").write_text("import no_such_module")
    done = run(tmp_path, "import __spark_entry__ as e; print(len(e.queries()))")
    assert done.returncode == 0 and done.stdout.split()[0] in (str(len(QUERIES)), str(len(QUERIES) + 1)), done.stderr
    (tmp_path / "gridloom/llm/queries.py").write_text("raise ValueError('broken')")
    done = run(tmp_path, "import __spark_entry__")
    assert done.returncode and "broken" in done.stderr
