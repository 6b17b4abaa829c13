import duckdb
import pytest

from tests.oracle import compare, connect
from tidefold.plans import job_queries, queries  # noqa: F401  both fill the same tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF)


def test_store_every_batch_where_days_add_up_to_nothing(spark, tmp_path):
    rows = [
        (1, "2024-01-01", 0), (1, "2024-01-02", 5),
        (2, "2024-01-01", 5), (2, "2024-01-01", -5), (2, "2024-01-03", 3),  # nothing on the first day, though there are values
        (3, "2024-01-01", 5), (3, "2024-01-02", -5),  # a total of zero that stays
        (4, "2024-01-02", 0),
        (5, "2024-01-01", None), (5, "2024-01-02", 2), (5, "2024-01-03", None),
        (None, "2024-01-01", 7),
        (6, "2024-01-04", 8), (7, "2023-12-31", 9),  # outside the three days
        (8, "2023-12-31", 9), (8, "2024-01-01", 0), (8, "2024-01-03", 4),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', ?, '{}')", [(n, day, key, value) for n, (key, day, value) in enumerate(rows)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    query, first = queries.QUERIES["store_every_batch"], 19723
    compare(spark, con, query, queries.ORACLE["store_every_batch"], tmp_path)
    got = {(r["batch_id"] - first, r["key"], r["value"]) for r in query(spark, tmp_path).collect()}
    assert got == {(1, 1, 500), (2, 1, 500), (2, 2, 300), (0, 3, 500), (1, 3, 0), (2, 3, 0), (1, 5, 200), (2, 5, 200), (2, 8, 400)}
