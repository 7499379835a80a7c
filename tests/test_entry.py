"""The entry module works without the text operators and their tests."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "vitalweave", tmp_path / "vitalweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "vitalweave" / "llm" / "__pycache__").mkdir(parents=True)
    asks = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, set(s) <= set(q))"
    for with_pipeline in (False, True):
        if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        said = subprocess.run([sys.executable, "-c", asks], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(said[0]) > 100 and said[1:] == ["False", "True"]
