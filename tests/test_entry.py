"""The driver's entry points, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print('NAMES', *sorted(e.queries())); print('SQL', *sorted(e.oracle_sql()))"


def listed(where):
    done = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=where, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    lines = dict(x.split(" ", 1) for x in done.stdout.splitlines() if x.startswith(("NAMES", "SQL")))
    return lines["NAMES"].split(), lines["SQL"].split()


@pytest.mark.parametrize("gone", [("convene/llm", "tests/llm"), ("convene/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_corpus_operators(tmp_path, gone):
    from convene.plans.queries import ORACLES, QUERIES

    where = tmp_path / "repo"
    shutil.copytree(ROOT, where, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for name in gone:
        if os.path.isdir(where / name):
            shutil.rmtree(where / name)
        elif os.path.exists(where / name):
            os.remove(where / name)
    names, sql = listed(where)
    assert names == sorted(QUERIES) and sql == sorted(ORACLES)


def test_all_of_them():
    from convene.plans.queries import QUERIES

    names, sql = listed(ROOT)
    assert set(QUERIES) <= set(names) and set(sql) <= set(names)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r.rank for r in rows] == list(range(1, 11))
