"""The rest of the library stands without the optional llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LLM = ("cueloom/llm", "tests/llm")


def copied(to: Path, without: tuple[str, ...]) -> Path:
    """The library's files in a new folder, without some of them."""
    for path in ROOT.rglob("*.py"):
        name = path.relative_to(ROOT).as_posix()
        if not any(name == w or name.startswith(f"{w}/") for w in without):
            (to / name).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(path, to / name)
    return to


@pytest.mark.parametrize("without", [LLM, (*LLM, "corpus_pipeline.py")])
def test_entry_without_llm(tmp_path, without):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=copied(tmp_path, without), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "flagship_reuse_by_source" in names and not [n for n in names if n == "pipeline" or n.startswith("op")]


def test_nothing_else_imports_llm():
    for path in (ROOT / "cueloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
