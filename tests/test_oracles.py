"""Every query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from gradus.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    v = getattr(v, "item", lambda: v)()
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_entry_is_the_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 31


def test_without_the_llm_files(monkeypatch):
    """The registry lives without the llm subpackage and the pipeline."""

    def gone(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name="gradus.llm")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)
