"""Every query of the driver contract that has oracle SQL, side by side with DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__
from indicata.plans import oracle
from indicata.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    sql = oracle.ORACLE[name]
    assert sorted(r[0] for r in duck.sql(f"describe {sql}").fetchall()) == columns
    want = sorted(tuple(map(_norm, r)) for r in duck.sql(f"select {', '.join(columns)} from ({sql})").fetchall())
    assert got == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_only_the_deleted_folder_may_be_absent():
    """A package that the corpus operators need and that is missing is an error, not an empty list of queries."""
    import subprocess
    import sys

    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], cwd=__spark_entry__.__file__.rsplit("/", 1)[0], capture_output=True, text=True)
    assert run("indicata.llm").stdout.strip() == str(len(core.QUERIES))
    assert run("numpy").returncode != 0 or len(__spark_entry__.queries()) == len(core.QUERIES)
