"""The entry module, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def names(folder) -> list[str]:
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_llm_folders(tmp_path):
    """A copy without both folders, with and without the pipeline's file, keeps every other query and its SQL."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "bare", ignore=skip)
    shutil.copytree(ROOT, tmp_path / "barer", ignore=lambda d, n: skip(d, n) | ({"corpus_pipeline.py"} & set(n)))
    whole, bare = names(ROOT), names(tmp_path / "bare")
    assert whole[2:] == ["True", "True"] or not (ROOT / "confab/llm").is_dir()
    assert bare[2:] == ["False", "False"] and int(bare[0]) > 130 and int(bare[1]) > 100
    assert names(tmp_path / "barer") == bare
