import duckdb
import pytest

import __spark_entry__ as entry
from samewise import catalog_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = catalog_queries.QUERIES[name](spark, data)
    c = duck.execute(catalog_queries.ORACLE_SQL[name])
    columns = [x[0] for x in c.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(c.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog_queries.QUERIES) - set(catalog_queries.ORACLE_SQL)))
def test_rows_only(spark, data, name):
    assert catalog_queries.QUERIES[name](spark, data).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "group_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_prunes_and_pushes(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet").where("l_quantity > 45").groupBy("l_orderkey").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
