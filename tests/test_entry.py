"""The entry works with and without the subpackage for training corpora."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
RUN = """
import sys
from tabloom.session import local_session
import __spark_entry__ as e
print(e.queries()["group_summary"](local_session(2), sys.argv[1]).count() > 0)
"""


@pytest.mark.parametrize("keep", [(), ("corpus_pipeline.py",)])
def test_entry_without_training_data(tmp_path, keep):
    from tabloom.registry import QUERIES

    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(
        "llm", ".git", "__pycache__", ".pytest_cache", *({"corpus_pipeline.py"} - set(keep))))

    def ran(code, *given):
        done = subprocess.run([sys.executable, "-c", code, *given], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        return done.stdout.split()

    found = ran(COUNT)
    assert int(found[0]) == len(QUERIES) and found[2:] == ["False", "False"]
    # What is left of a deleted package is no package.
    (tmp_path / "copy/tabloom/llm/__pycache__").mkdir(parents=True)
    assert ran(COUNT) == found
    if not keep:
        assert ran(RUN, "/root/testdata/sf0.001")[-1] == "True"
