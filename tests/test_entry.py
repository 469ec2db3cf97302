"""Driver contract smoke test."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.abspath(E.__file__))


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert "turnover_rate" in df.columns and df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    """The other queries stand alone, whether or not the pipeline's file is left."""
    shutil.copytree(os.path.join(ROOT, "staffwise"), tmp_path / "staffwise",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if with_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    code = ("import __spark_entry__ as e; from staffwise.plans import catalog; "
            "assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLE); "
            "print(len(e.queries()))")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": ""}, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) >= 100
