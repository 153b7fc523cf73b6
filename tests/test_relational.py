import math

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.functions import gate, scalar
from larkspur.operators import relational, statistics, versioned
from larkspur.sources.tables import TABLES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    df = catalogue.queries()[name](spark, D)
    result = duck.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert mine == sorted(repr(tuple(map(_plain, r))) for r in result.fetchall())


@pytest.mark.parametrize("sql, state", [
    ("SELECT 1; SELECT 2", "42601"), ("", "42601"), ("BEGIN", "0A000"), ("CREATE TABLE t (a INT PRIMARY KEY)", "0A000"),
])
def test_gate_rejects(sql, state):
    with pytest.raises(gate.Rejected) as e:
        gate.check(sql)
    assert e.value.sqlstate == state


def test_gate_runs_with_parameters_and_maps_errors(spark):
    row = gate.strict_sql(spark, "SELECT $1 + 1 AS a, '$1;' AS b, $2 AS c", [41, None]).first()
    assert (row.a, row.b, row.c) == (42, "$1;", None)
    with pytest.raises(gate.Rejected) as e:
        gate.strict_sql(spark, "SELECT * FROM no_such_table").collect()
    assert e.value.sqlstate == "42P01"


def test_scalars(spark):
    df = spark.createDataFrame([(" On ", 2.5), ("f", -2.5), (None, None)], "t string, x double")
    assert [tuple(r) for r in df.select(scalar.to_boolean(df.t), scalar.to_integer(df.x)).collect()] == [(True, 3), (False, -3), (None, None)]


def test_versioned_table_lifecycle(spark, tmp_path):
    schema = spark.createDataFrame([], "id int, name string").schema
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t", schema)
    assert t.snapshot().count() == 0
    t.insert(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string"))
    from pyspark.sql import functions as F

    t.update({"name": F.lit("x")}, F.col("id") == 1)
    t.delete(F.col("id") == 2)
    assert sorted(map(tuple, t.snapshot().collect()), key=str) == [(1, "x"), (3, None)]
    assert sorted(r.id for r in t.snapshot(1).collect()) == [1, 2, 3]
    with pytest.raises(versioned.ConflictError):
        t.update({"name": F.lit("y")}, F.col("id") == 1, seen=1)
    with pytest.raises(ValueError):
        t.insert(spark.createDataFrame([(1,)], "nope int"))
    g = t.collect_garbage(2, f"file://{tmp_path}/g")
    assert sorted(map(tuple, g.snapshot().collect()), key=str) == sorted(map(tuple, t.snapshot().collect()), key=str)
    assert g.log().count() == 4


def test_join_orders_cost_no_more_than_the_given_one():
    g = statistics.JoinGraph({"l": 6_000_000, "o": 1_500_000, "c": 150_000, "n": 25}, [("l", "ok", "o", "ok"), ("o", "ck", "c", "ck"), ("c", "nk", "n", "nk")])
    best = statistics.best_order(g)
    assert statistics.plan_cost(g, best) <= statistics.plan_cost(g, list(g.rows)) and not g.cyclic()
    g.edges.append(("l", "nk", "n", "nk"))
    assert g.cyclic()


def test_streaming_counts(spark, tmp_path):
    from larkspur.streaming.events import event_stream, tumbling_counts

    spark.read.parquet(f"{D}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = tumbling_counts(event_stream(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumbled").agg({"n": "sum"}).first()[0] == 1000


def _pairs(rows):
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_paired_join_spreads_pairs_of_few_keys_over_tasks(spark, most_bytes):
    left = spark.createDataFrame([(None if i % 10 == 9 else i % 10 // 4, i // 2) for i in range(600)], "k int, x long").coalesce(1)
    right = spark.createDataFrame([(None if i % 7 == 6 else i % 7 // 3, i // 2) for i in range(70)], "k int, y long").coalesce(1)
    want = _pairs(left.join(right, "k"))
    for a, b in ((left, right), (right, left)):
        out = relational.paired_join(a, b, ["k"], most_pairs=len(want) // 20, least_pairs=1, most_bytes=most_bytes)
        assert out.columns == ["k", *(c for c in a.columns + b.columns if c != "k")]
        assert _pairs(out.select("k", "x", "y")) == want
        made = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(made) >= 8 and max(r["count"] for r in made) <= len(want) // 3


def test_paired_join_of_little_or_nothing(spark):
    left, right = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k int, x string"), spark.createDataFrame([(1, 5), (1, 6), (None, 7), (3, 8)], "k int, y int")
    assert _pairs(relational.paired_join(left, right, ["k"])) == [(1, "a", 5), (1, "a", 5), (1, "a", 6), (1, "a", 6)]
    assert _pairs(relational.paired_join(left.limit(0), right, ["k"])) == _pairs(relational.paired_join(left, right.where("k > 2"), ["k"])) == []


@pytest.mark.parametrize("name", ["join_using", "join_self"])
def test_joins_on_few_keys_run_in_many_tasks(spark, tmp_path, duck, name):
    """Tables of one file each; their pairs were made by the task of the file."""
    for t, key, nation, rows in (("customer", "c_custkey", "c_nationkey", 9_000), ("supplier", "s_suppkey", "s_nationkey", 9_000)):
        spark.range(rows).select(F.col("id").alias(key), (F.col("id") % 23).cast("int").alias(nation)).toPandas().to_parquet(tmp_path / f"{t}.parquet")
    out = catalogue.queries()[name](spark, str(tmp_path))
    made = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    sql = catalogue.oracle_sql()[name]
    for t in ("customer", "supplier"):
        sql = sql.replace(f"FROM {t} a, {t} b", f"FROM '{tmp_path}/{t}.parquet' a, '{tmp_path}/{t}.parquet' b").replace(f"FROM {t})", f"FROM '{tmp_path}/{t}.parquet')")
    columns = ", ".join(out.columns)
    want = duck.execute(f"SELECT count(*), {', '.join(f'CAST(sum({c} * (1 + {i})) AS BIGINT)' for i, c in enumerate(out.columns))}, CAST(sum({out.columns[-1]} * {out.columns[-2]}) AS BIGINT) FROM (SELECT {columns} FROM ({sql}) q) r").fetchone()
    got = out.selectExpr("count(*)", *[f"sum({c} * (1 + {i}))" for i, c in enumerate(out.columns)], f"sum({out.columns[-1]} * {out.columns[-2]})").first()
    assert tuple(got) == want and len(made) >= 3
