"""The entry point without the text operators, and with them broken."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def told(missing, more=""):
    code = f"import sys; sys.modules[{missing!r}] = None; {more}import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "cellfold.llm"])
def test_without(missing):
    from cellfold import checks

    done = told(missing)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(x)) for x in checks.load()]


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers"])
def test_without_a_package_of_theirs(missing):
    """The other queries stay, and it is said why the text operators don't."""
    from cellfold import checks

    done = told(missing)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(x)) for x in checks.load()]
    # Where they are there at all.
    assert "left out" in done.stderr or not (ROOT / "cellfold" / "llm").exists()


def test_other_errors_show():
    done = told("cellfold.runtime")
    assert done.returncode and "cellfold.runtime" in done.stderr
