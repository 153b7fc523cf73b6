import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import gate
from larkspur.functions.gate import Rejected
from larkspur.operators import advice, database, statistics, versioned
from larkspur.sources import text
from larkspur.streaming import changes


@pytest.fixture()
def db(spark, tmp_path):
    out = database.Database(spark, f"file://{tmp_path}/db")
    out.execute("CREATE TABLE t (k INT, name TEXT, x DOUBLE, d DATE, b BOOLEAN)")
    assert out.execute("INSERT INTO t VALUES (1, 'a', 1.5, '2024-01-02', true), (2, 'it''s; WHERE', -2, '2024-02-29', false), (3, NULL, NULL, NULL, NULL)") == 3
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _state(f):
    with pytest.raises(Rejected) as e:
        got = f()
        if isinstance(got, DataFrame):
            gate.collected(got)
    return e.value.sqlstate


def test_statements(db):
    assert _rows(db.execute("SELECT k, name, d FROM T WHERE x < 0")) == [(2, "it's; WHERE", datetime.date(2024, 2, 29))]
    assert db.execute("INSERT INTO t (name, k, x) VALUES ('z', -4, true)") == 1
    assert _rows(db.execute("SELECT k, name, x, d, b FROM t WHERE k < 0")) == [(-4, "z", 1.0, None, None)]
    assert db.execute("UPDATE t SET name = 'new', x = 7 WHERE k >= 2") == 2
    assert db.execute("UPDATE t SET b = false WHERE name = 'nobody'") == 0
    assert db.execute("DELETE FROM t WHERE name = 'new' AND k <> 3") == 1
    assert _rows(db.execute("SELECT k, name, x FROM t")) == [(-4, "z", 1.0), (1, "a", 1.5), (3, "new", 7.0)]
    assert db.execute("DELETE FROM t") == 3 and db.execute("SELECT * FROM t").count() == 0
    db.execute("CREATE TABLE IF NOT EXISTS t (other INT)")
    assert db.table("t").schema.names == ["k", "name", "x", "d", "b"]
    assert _state(lambda: db.execute("CREATE TABLE t (k INT)")) == "42P07"
    db.execute("DROP TABLE t")
    db.execute("DROP TABLE IF EXISTS t")
    assert _state(lambda: db.execute("DROP TABLE t")) == "42P01" and _state(lambda: db.execute("SELECT * FROM nowhere")) == "42P01"


@pytest.mark.parametrize("sql, state", [
    ("DELETE FROM t WHERE k IN (SELECT k FROM t)", "0A000"), ("UPDATE t SET x = 1 WHERE EXISTS (SELECT 1 FROM t)", "0A000"), ("DELETE FROM t WHERE nope = 1", "42703"),
    ("UPDATE t SET nope = 1", "42703"), ("UPDATE t SET x = max(x)", "0A000"), ("DELETE FROM t WHERE unheard(k)", "42883"), ("INSERT INTO t (k, nope) VALUES (1, 2)", "42703"),
    ("INSERT INTO t (k, x) VALUES (1)", "42601"), ("INSERT INTO t SELECT * FROM t", "0A000"), ("INSERT INTO nowhere VALUES (1)", "42P01"), ("CREATE TABLE c (a INT NOT NULL)", "0A000"),
    ("CREATE TABLE c (a INT DEFAULT 3)", "0A000"), ("INSERT INTO t (k) VALUES ('word')", "22P02"), ("INSERT INTO t (d) VALUES ('2023-02-31')", "22P02"), ("SET read_consistency = 'leader'", "0A000"),
])
def test_refused_changes_write_nothing(db, sql, state):
    before = _rows(db.execute("SELECT * FROM t"))
    assert _state(lambda: db.execute(sql)) == state
    assert _rows(db.execute("SELECT * FROM t")) == before and db.table("t").head() == 1


@pytest.mark.parametrize("sql, state", [
    ("SELECT 1/0 AS x", "22012"), ("SELECT (SELECT k FROM t) AS x", "21000"), ("SELECT nope FROM t", "42703"), ("SELECT unheard(k) FROM t", "42883"), ("SELECT 2147483647 + CAST(1 AS INT) AS x", "22003"),
    ("SELECT sum(k) OVER (PARTITION BY abs(k) ORDER BY k ROWS 2 PRECEDING) FROM t", "0A000"), ("SELECT rank() OVER w FROM t WINDOW w AS (ORDER BY k)", "0A000"), ("SELEC 1", "42601"),
    ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", "0A000"), ("SELECT CAST('x' AS INT) AS i", "22P02"),
])
def test_error_states(db, sql, state):
    assert _state(lambda: db.execute(sql)) == state


def test_prepared_statements_and_parameters(db):
    db.prepare("some", "SELECT k FROM t WHERE k >= $1 AND (name = $2 OR $2 IS NULL) AND '$1' = '$1'", ["int", "text"])
    assert _rows(db.run_prepared("some", [2, None])) == [(2,), (3,)] and _rows(db.run_prepared("some", ["1", "a"])) == [(1,)]
    db.prepare("add", "INSERT INTO t (k, name) VALUES ($1, $2)", ["int", "text"])
    assert db.run_prepared("add", [9, "it's \\ $1"]) == 1
    db.prepare("gone", "DELETE FROM t WHERE name = $1", ["text"])
    assert db.run_prepared("gone", ["it's \\ $1"]) == 1 and db.run_prepared("gone", [None]) == 0
    assert _state(lambda: db.run_prepared("some", [1])) == "08P01" and _state(lambda: db.run_prepared("other")) == "26000"
    assert _state(lambda: db.prepare("bad", "SELECT $1", ["unknown"])) == "42P18" and _state(lambda: db.execute("SELECT 1", list(range(1025)))) == "54023"
    for i in range(database.MOST_PREPARED):
        db.prepare(f"p{i}", "SELECT 1 AS a", [])
    assert _state(lambda: db.run_prepared("some", [1, "a"])) == "26000"


def test_explain_plans_and_pinned_versions(db):
    assert "Execution time" in db.execute("EXPLAIN ANALYZE SELECT k FROM t").first().plan and "Physical Plan" in db.execute("explain select 1 as a").first().plan
    assert _state(lambda: db.execute("EXPLAIN ANALYZE SELECT nope FROM t")) == "42703"
    hits = db.hits
    assert db.execute("SELECT k FROM t WHERE name = 'a'").count() == 1 and db.execute("SELECT k FROM t WHERE name = 'A'").count() == 0  # keys are exact
    assert db.hits == hits and db.execute("SELECT k FROM t WHERE name = 'a'").count() == 1 and db.hits == hits + 1
    with db.pinned():
        db.table("t").delete()
        assert db.execute("SELECT k FROM t").count() == 3
    assert db.execute("SELECT k FROM t").count() == 0
    db.execute("SET read_consistency = 'local'")


def test_transactions_see_their_own_changes_and_roll_back(db):
    with db.transaction("t"):
        db.execute("INSERT INTO t (k, name) VALUES (4, 'd')")
        db.execute("UPDATE t SET name = 'mine' WHERE k = 4 OR k = 1")
        db.execute("DELETE FROM t WHERE k = 2")
        assert _rows(db.execute("SELECT k, name FROM t")) == [(1, "mine"), (3, None), (4, "mine")]
        assert sorted(r.k for r in db.table("t").snapshot().collect()) == [1, 2, 3]
    assert db.table("t").head() == 2 and _rows(db.execute("SELECT k, name FROM t")) == [(1, "mine"), (3, None), (4, "mine")]
    with pytest.raises(ZeroDivisionError):
        with db.transaction("t"):
            db.execute("DELETE FROM t")
            raise ZeroDivisionError
    assert db.table("t").head() == 2 and db.execute("SELECT k FROM t").count() == 3


def test_first_committer_wins_and_the_losers_rows_are_never_seen(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "id int, name string").schema)
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
    one, two, three = t.begin(), t.begin(), t.begin()
    one.update({"name": F.lit("one")}, F.col("id") == 1)
    two.update({"name": F.lit("two")}, F.col("id") == 1)
    three.update({"name": F.lit("three")}, F.col("id") == 2)
    assert one.commit() == 2 and three.commit() == 3  # other rows: no conflict
    with pytest.raises(versioned.ConflictError):
        two.commit()
    assert _rows(t.snapshot()) == [(1, "one"), (2, "three")] and t.verify() == 3
    # two writers that both saw no newer version: the manifest decides
    names = [t.write(t.snapshot(with_key=True).select("pk", F.lit("U").alias("op"), F.struct("id", F.lit(w).alias("name")).alias("row")), 4) for w in ("x", "y")]
    t.publish(names[0], 3)
    with pytest.raises(versioned.ConflictError):
        t.publish(names[1], 3)
    assert {r.name for r in t.snapshot().collect()} == {"x"}


def test_history_branches_backups_and_damage(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "id int").schema)
    for i in range(3):
        t.insert(spark.createDataFrame([(i,)], "id int"))
    when = t.manifests()[2]["at"]
    assert t.version_at(when) == 2 and t.version_at(when - 1) == 1
    b = t.branch(2, f"file://{tmp_path}/b")
    b.delete(F.col("id") == 0)
    assert _rows(b.snapshot()) == [(1,)] and _rows(t.snapshot()) == [(0,), (1,), (2,)] and b.verify() == 3
    with pytest.raises(FileExistsError):
        t.branch(1, f"file://{tmp_path}/b")
    t.backup(f"file://{tmp_path}/backup", 2)
    assert _rows(versioned.restored(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/r").snapshot()) == [(0,), (1,)]
    with pytest.raises(FileExistsError):
        versioned.restored(spark, f"file://{tmp_path}/backup", f"file://{tmp_path}/r")
    spark.createDataFrame([("p", 9)], "pk string, id int").write.mode("append").parquet(f"file://{tmp_path}/backup/rows")
    with pytest.raises(versioned.DamagedError):
        versioned.verified_backup(spark, f"file://{tmp_path}/backup")
    t.log(1).select("pk", "op", "row").write.mode("append").parquet(f"{t.path}/data/{t.manifests()[2]['data']}")
    with pytest.raises(versioned.DamagedError):
        t.verify()


def test_clock():
    c = versioned.HybridClock()
    a, b = c.tick(), c.tick()
    assert a < b < c.observe(b + 5) and c.last > b + 5
    with pytest.raises(ValueError):
        c.observe(c.tick() + (10**6 << 16))


def test_change_streams_apply_in_order_and_once(spark, tmp_path):
    schema = spark.createDataFrame([], "name string").schema
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t", schema)
    inbox = f"file://{tmp_path}/in"
    log = changes.change_schema(schema)
    for part in ([("a", 1, "I", "one"), ("a", 2, "U", "two"), ("b", 3, "I", "x")], [("b", 4, "D", None), ("a", 5, "U", "three")]):
        spark.createDataFrame(part, log).coalesce(1).write.mode("append").parquet(inbox)
        changes.apply_changes(spark.readStream.schema(log).parquet(inbox), t, f"file://{tmp_path}/check").awaitTermination(120)
    assert _rows(t.snapshot(1)) == [("two",), ("x",)] and _rows(t.snapshot()) == [("three",)]
    assert changes.apply_batch(t, spark.createDataFrame([("z", 9, "I", "again")], log), 1) is None and t.head() == 2


def test_no_query_gets_a_dearer_order_than_it_was_written_in():
    graphs = [advice.query_graph(n) for n in range(1, 23)]
    assert advice.query_graph(23) is None and all(graphs)
    assert sum(statistics.plan_cost(g, statistics.best_order(g)) <= statistics.plan_cost(g, list(g.rows)) for g in graphs) == 22
    assert sum(statistics.plan_cost(g, statistics.best_order(g)) < statistics.plan_cost(g, list(g.rows)) for g in graphs) >= 8
    assert not any(g.cyclic() for g in graphs) and all(len(g.edges) == len(g.rows) - 1 for g in graphs)


def test_advice(spark):
    day = datetime.date(2024, 3, 1)
    log = spark.createDataFrame([(i, "t", c, "predicate", day) for i in range(100) for c, n in (("a", 90), ("b", 70), ("c", 5)) if i < n], "query_id int, table_name string, column_name string, kind string, day date")
    tables = spark.createDataFrame([("t", 1_000_000, 0.06, ["c", "z"])], "table_name string, table_rows long, table_gib double, laid_out array<string>")
    counts = advice.workload_counts(log)
    assert {(r.column_name, r.predicates, r.joins, r.queries) for r in counts.collect()} == {("a", 90, 0, 90), ("b", 70, 0, 90), ("c", 5, 0, 90)}
    got = {(r.action, tuple(r["columns"])) for r in advice.advised_layouts(counts, tables, day).collect()}
    assert got == {("create", ("a",)), ("create", ("b",)), ("create", ("a", "b")), ("drop", ("z",))}


def test_text(spark):
    df = spark.createDataFrame([("1", "x"), ("-7", "2.5"), ("no", None)], "a string, b string")
    schema = spark.createDataFrame([], "a int, b double, c date").schema
    assert _rows(text.decoded(df, schema)) == [(-7, 2.5, None), (1, None, None), (None, None, None)]
    assert _rows(text.text_rows(spark.createDataFrame([(1, 2.0, True), (None, None, None)], "i int, x double, b boolean"))) == [("1", "2.0000", "t"), (None, None, None)]
