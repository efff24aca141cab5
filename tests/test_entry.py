"""The entry points without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def names(repo: Path) -> set[str]:
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    return set(subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, check=True).stdout.split())


def test_entry_lives_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    core = names(copy)
    assert "bounce_candidates" in core and not any(n.startswith("op") or n == "pipeline" for n in core - {"overlay_plan"})
    if (REPO / "corpus_pipeline.py").exists():  # the pipeline alone is of no use
        shutil.copy(REPO / "corpus_pipeline.py", copy)
        assert names(copy) == core


def test_nothing_else_imports_them():
    for path in (REPO / "rallyframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "rallyframe.llm" not in path.read_text(), path
