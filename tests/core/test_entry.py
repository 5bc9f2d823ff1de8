import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[2]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_parts(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    shutil.rmtree(tmp_path / "millrace/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()), len(e.queries()) > 30)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert said.stdout.split() == ["False", "True"]
