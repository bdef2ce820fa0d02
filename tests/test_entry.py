"""Every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from storyloom.plans import registry
from tools.compare import canon


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name in registry.oracles():
        want = duck.sql(registry.oracles()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got).equals(canon(want))


def test_entry_without_the_training_data_folders(tmp_path):
    """In a copy without both folders the rest still registers its queries."""
    root = Path(__file__).resolve().parent.parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 50 and 'pipeline' not in q; print(len(q))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "copy")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
