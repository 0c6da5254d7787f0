"""The driver's entry points, with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("case", ["no folder", "empty folder", "missing library"])
def test_other_queries_work_where_the_training_part_cannot_be_imported(tmp_path, case):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", ".pytest_cache"))
    if case != "missing library":
        shutil.rmtree(copy / "strata" / "llm", ignore_errors=True)
    if case == "no folder":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    if case == "empty folder":
        (copy / "strata" / "llm").mkdir()
    block = "sys.modules['zstandard'] = None; " if case == "missing library" else ""
    script = f"import sys; {block}import __spark_entry__ as e; print(len([q for q in e.queries() if not q.startswith('op') and q != 'pipeline']), len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    from strata import catalog

    assert out == [str(len(catalog.queries()))] * 2 + [str(len(catalog.oracle_sql()))]
