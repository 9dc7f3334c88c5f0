"""The driver contract, with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_text_operators(tmp_path, pipeline):
    """What is left when vecloom/llm and tests/llm are gone, whether or not corpus_pipeline.py is still there."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 80


def test_intermediate_tables_of_a_job(spark):
    from vecloom.sources.scratch import made, settled

    before = settled(spark.range(3).toDF("x"), "before")
    with made(spark):
        inside = settled(spark.range(3).toDF("x"), "inside")
        assert inside.count() == 3
    assert before.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|FILE_NOT_EXIST|NOT_FOUND"):
        spark.read.parquet(inside.inputFiles()[0]).count()
