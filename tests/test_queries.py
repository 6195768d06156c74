"""Each registered engine query against its SQL twin."""

import pytest
from sqlcheck import check_against_sql

from reelframe.queries import oracle_sql, queries

QUERIES, ORACLE = queries(), oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check_against_sql(spark, duck, name, QUERIES[name], ORACLE[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_the_engine_stands_alone(tmp_path):
    """Without the training-data part the entry points still import; a fault within that part isn't passed over."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True)
    got = run()
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLE))], got.stderr
    (copy / "reelframe/llm").mkdir()
    (copy / "reelframe/llm/__init__.py").write_text("")
    (copy / "reelframe/llm/queries.py").write_text("import no_such_module\n")
    (copy / "corpus_pipeline.py").write_text("")
    assert run().returncode != 0
