"""The driver's contract: names match, SQL of every oracle agrees on the smallest fixture, the rest stands without the optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "terravane").mkdir()
    for p in (root / "terravane").iterdir():
        if p.name != "llm":
            (tmp_path / "terravane" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert len(q) > 200"
    (tmp_path / "run.py").write_text(code)
    real = (tmp_path / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(real)
    subprocess.run([sys.executable, "run.py"], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no fixture tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
