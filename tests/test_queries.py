"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(columns), sorted(tuple(shown(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if name in SQL:
        cursor = database.execute(SQL[name])
        columns = [c[0] for c in cursor.description]
        assert comparable(rows, df.columns) == comparable(cursor.fetchall(), columns)


LONG_USERS = ["pairwise_distance", "wfa_distance", "cigar_check", "dag_distance_dp", "po_edges", "heaviest_bundle", "topological_rank"]


@pytest.fixture(scope="module")
def long_users(spark, tmp_path_factory):
    """Events of users who fill several bundles, one of them exactly."""
    folder = str(tmp_path_factory.mktemp("long"))
    kinds = ["click", "view", "buy", "login"]
    sizes = {1: 300, 2: 256, 3: 130, 4: 129, 5: 17, 6: 1}
    rows = [
        (user * 1000 + i, i, user, kinds[(i * i + user * 7 + i // 5) % 4]) for user, size in sizes.items() for i in range(size)
    ]
    events = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string")
    events.selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id", "event_type").coalesce(1).write.parquet(f"{folder}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return folder, connection


@pytest.mark.parametrize("name", LONG_USERS)
def test_neighbours_over_bundle_borders(spark, long_users, name):
    folder, connection = long_users
    df = QUERIES[name](spark, folder)
    cursor = connection.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    rows = df.collect()
    assert comparable(rows, df.columns) == comparable(cursor.fetchall(), columns)
    if name == "pairwise_distance":
        assert len(rows) == sum(-(-n // 16) - 1 for n in (300, 256, 130, 129, 17, 1))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and all(r.valid for r in rows)
