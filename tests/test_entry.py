import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_corpus_operators(tmp_path):
    code = "import __spark_entry__ as e; assert 'notebook_degrees' in e.queries(); assert not any(q.startswith('op') for q in e.queries())"
    gone = tmp_path / "copy"
    gone.mkdir()
    for name in ("__spark_entry__.py", "tesserae"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(gone)], check=True)
    if (gone / "tesserae" / "llm").exists():
        (gone / "tesserae" / "llm").rename(tmp_path / "llm")
    subprocess.run([sys.executable, "-c", code], cwd=gone, check=True, env=os.environ | {"PYTHONPATH": ""})
