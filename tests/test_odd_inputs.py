"""Queries on tables with odd keys, held against their SQL."""

import duckdb
import pytest

from memloom.plans.catalogue import QUERIES, SQL
from tests.test_catalogue import rows


def same_as_sql(spark, folder, name, tables):
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        want = c.execute(SQL[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


@pytest.fixture
def events(tmp_path):
    """Events of which number 0 opens a lifetime; some numbers are below 0, one is null."""
    with duckdb.connect() as c:
        c.execute(f"""COPY (SELECT CASE WHEN i < 999 THEN i - 300 END AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CAST(i % 150 AS BIGINT) AS user_id, CASE WHEN i % 7 = 3 THEN 'error' ELSE 'view' END AS event_type,
          CAST(i AS DOUBLE) AS value, '{{"k": ' || (i % 3) || '}}' AS props FROM range(1000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    return tmp_path


def test_evidence_that_is_no_memory_has_no_history(spark, events):
    same_as_sql(spark, events, "evidence_history", ["events"])
