"""Every registered query with SQL gives DuckDB's rows; graph and metric operators keep their known values."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from granary.plans import catalogue
from granary.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame: pd.DataFrame) -> list:
    def one(v):
        return None if pd.isna(v) else v if isinstance(v, str | bool) else round(float(v), 6)

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_written_decisions_to_the_last_digit(spark, tmp_path):
    """Scores beside ties of ten and of nine decimals, some of them only by the C library's exp; repeated, missing and odd ids and vectors."""
    inf = float("inf")
    first = [0.17456549406051636, -0.10867497324943542, 0.19264847040176392, 0.6256093382835388, -7.095000000845175e-07, 0.0002596865233499557, 3.876404047012329, 1e30, -1e30, inf, -inf, -inf + inf, None]
    rows = [(k, [x, 1.0]) for k, x in enumerate(first)] + [(3, [0.5]), (3, [0.5]), (None, [0.25]), (90, []), (91, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalogue.QUERIES["written_decisions"](spark, str(tmp_path)).select("vec_id", "probability", "written", "decision").collect()
    want = own.execute(catalogue.ORACLE_SQL["written_decisions"]).fetchall()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
