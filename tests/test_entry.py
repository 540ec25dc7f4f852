"""The entry module with the text operators and without them."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q)"


def run(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(folder)}, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_entry_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    few, pipeline = run(copy)
    assert int(few) > 30 and pipeline == "False"


def test_entry_as_it_is():
    assert int(run(HERE)[0]) > 30
