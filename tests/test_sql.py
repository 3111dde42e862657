"""The dialect: accepted statements with their rows, refused ones with their errors."""

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.errors import DuplicateError, ExecutionError, MaintenanceError, SqlBindingError, SqlLexicalError, SqlLimitError, SqlSyntaxError, SqlUnknownColumnError, SqlUnknownTableError, SqlUnsupportedError, TransactionError
from tessera.sql.parser import parse


# The rows of students and enrollments, and results of statements over them, are acceptance values.
@pytest.fixture(scope="module")
def school(spark):
    e = Engine(spark)
    e.register("students", spark.createDataFrame([(1, "Ana", "CS", 22), (2, "Luis", "EE", 19), (3, "Sol", "CS", 24), (4, "Omar", "EE", 23)], "id long, name string, career string, age long"), "id")
    e.register("enrollments", spark.createDataFrame([(1, "DB2"), (1, "OS"), (3, "DB2"), (4, "OS")], "student_id long, course string"))
    e.register("numbers", spark.createDataFrame([(1, 2**53), (2, 1), (3, 1), (4, 1), (5, 1)], "id long, n long"), "id")
    e.register("odd", spark.createDataFrame([(1, float("nan"))], "id long, x double"))
    return e


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("SELECT name FROM students WHERE age > 20 ORDER BY name", [("Ana",), ("Omar",), ("Sol",)]),
        ("SELECT * FROM students WHERE id = 3", [(3, "Sol", "CS", 24)]),
        ("SELECT name FROM students WHERE age >= 22 AND age < 24 ORDER BY name DESC", [("Omar",), ("Ana",)]),
        ("SELECT career, COUNT(*) AS total FROM students GROUP BY career ORDER BY career", [("CS", 2), ("EE", 2)]),
        ("SELECT s.name, e.course FROM students AS s JOIN enrollments AS e ON s.id = e.student_id WHERE s.age > 20 ORDER BY name, course", [("Ana", "DB2"), ("Ana", "OS"), ("Omar", "OS"), ("Sol", "DB2")]),
        ("SELECT name FROM students WHERE age > 100", []),
        ("SELECT name n FROM students ORDER BY career, career DESC, id LIMIT 3", [("Ana",), ("Sol",), ("Luis",)]),
        ("SELECT COUNT(*), SUM(age) FROM students WHERE id > 9", [(0, 0)]),
        ("SELECT AVG(n) FROM numbers", [(1801439850948199.2,)]),
        ("SELECT name FROM students LIMIT 0", []),
        ("SELECT id FROM students WHERE NOT (NOT id = 2) -- note\n;", [(2,)]),
    ],
)
def test_rows(school, text, rows):
    assert school.sql(text).fetchall(100) == rows


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("SELEC name FROM students", SqlSyntaxError),
        ("SELECT nope FROM students", SqlUnknownColumnError),
        ("SELECT Name FROM students", SqlUnknownColumnError),
        ("SELECT name FROM nope", SqlUnknownTableError),
        ("SELECT name FROM students WHERE age = 1.0", SqlBindingError),
        ("SELECT name, name FROM students", SqlBindingError),
        ("SELECT career FROM students GROUP BY career", SqlBindingError),
        ("SELECT name, COUNT(*) FROM students GROUP BY career", SqlBindingError),
        ("SELECT * FROM students JOIN students ON id = id", SqlBindingError),
        ("SELECT * FROM students s JOIN enrollments e ON s.id > e.student_id", SqlBindingError),
        ("SELECT SUM(name) FROM students", SqlBindingError),
        ("SELECT DISTINCT name FROM students", SqlUnsupportedError),
        ("SELECT name FROM students WHERE name LIKE 'a'", SqlUnsupportedError),
        ("SELECT name FROM students WHERE age BETWEEN 1 AND 2", SqlUnsupportedError),
        ("SELECT name FROM students WHERE name IS NULL", SqlUnsupportedError),
        ("SELECT career, COUNT(*) FROM students GROUP BY career HAVING career = 'CS'", SqlUnsupportedError),
        ("SELECT name FROM students UNION SELECT name FROM students", SqlUnsupportedError),
        ("SELECT name FROM (SELECT name FROM students)", SqlUnsupportedError),
        ("SELECT name FROM students LEFT JOIN enrollments ON id = student_id", SqlUnsupportedError),
        ("SELECT UPPER(name) FROM students", SqlUnsupportedError),
        ("SELECT name FROM students ORDER BY 1", SqlUnsupportedError),
        ("SELECT a.id FROM students a JOIN students b ON a.id = b.id JOIN students c ON a.id = c.id", SqlUnsupportedError),
        ("SELECT name FROM students WHERE age", SqlSyntaxError),
        ("SELECT name FROM students; SELECT 1", SqlSyntaxError),
        ("SELECT name FROM students WHERE name = 'a", SqlLexicalError),
        ("SELECT name FROM students WHERE age = 1e5", SqlLexicalError),
        ("SELECT name FROM students LIMIT 1.5", SqlSyntaxError),
        ("SELECT name FROM students WHERE " + "NOT " * 200 + "age = 1", SqlLimitError),
        ("SELECT name FROM students WHERE name = '" + "x" * 70_000 + "'", SqlLexicalError),
        ("INSERT INTO students VALUES(1, 'a', 'b', 2)", MaintenanceError),
        ("INSERT INTO students VALUES(1),(2)", SqlUnsupportedError),
    ],
)
def test_errors(school, text, error):
    with pytest.raises(error):
        school.sql(text)


@pytest.mark.parametrize("text", ["SELECT MIN(age) FROM students WHERE id > 9", "SELECT AVG(age) FROM students WHERE id > 9", "SELECT id FROM odd WHERE x > 1.0", "SELECT SUM(n) FROM big"])
def test_errors_of_data(school, spark, text):
    school.register("big", spark.createDataFrame([(2**63 - 1,), (1,)], "n long"))
    with pytest.raises(Exception, match="USER_RAISED|OVERFLOW"):
        school.sql(text).fetchall(10)


def test_results_are_not_cut(school):
    with pytest.raises(Exception, match="more than 2 rows"):
        school.sql("SELECT id FROM students").fetchall(2)


def test_filters_reach_the_scan(spark):
    e = Engine(spark)
    e.register("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_orderkey")
    text = e.sql("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0").text
    assert "GreaterThan(o_totalprice,1000.0)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text and text.startswith("Projection o_orderkey")


def test_tables_change(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE TABLE alumnos(id INT PRIMARY KEY, nombre VARCHAR(6), nota FLOAT, activo BOOLEAN)")
    for row in ("1, 'Ana', 15.5, TRUE", "2, 'Luis', 11.0, FALSE", "3, 'Sol', 18.0, TRUE"):
        assert e.sql(f"INSERT INTO alumnos VALUES({row})").affected == 1
    with pytest.raises(DuplicateError):
        e.sql("INSERT INTO alumnos VALUES(1, 'x', 1.0, TRUE)")
    with pytest.raises(MaintenanceError):
        e.sql("INSERT INTO alumnos VALUES(4, 'demasiado', 1.0, TRUE)")
    with pytest.raises(SqlBindingError):
        e.sql("INSERT INTO alumnos VALUES(4, 'x', 1, TRUE)")
    assert e.sql("UPDATE alumnos SET nota = 20.0, activo = FALSE WHERE nota > 15.0").affected == 2
    assert e.sql("DELETE FROM alumnos WHERE id = 2").affected == 1
    assert Engine(spark, f"file://{tmp_path}").sql("SELECT * FROM alumnos ORDER BY id").fetchall(9) == [(1, "Ana", 20.0, False), (3, "Sol", 20.0, False)]
    with pytest.raises(DuplicateError):
        e.sql("UPDATE alumnos SET id = 7")
    e.sql("CREATE INDEX por_nota ON alumnos(nota)")
    with pytest.raises(DuplicateError):
        e.sql("CREATE UNIQUE INDEX una_nota ON alumnos(nota)")
    e.sql("DROP INDEX por_nota")
    with pytest.raises(SqlBindingError):
        e.sql("DROP INDEX __pk__alumnos")
    e.sql("DROP TABLE alumnos")
    with pytest.raises(SqlUnknownTableError):
        e.sql("SELECT * FROM alumnos")


def test_transactions(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", lock_timeout=0.2)
    e.sql("CREATE TABLE t(id INT PRIMARY KEY)")
    a, b = e.session(), e.session()
    with pytest.raises(TransactionError):
        a.sql("ROLLBACK")
    a.sql("BEGIN TRANSACTION")
    a.sql("INSERT INTO t VALUES(1)")
    assert a.sql("SELECT COUNT(*) FROM t").fetchall(1) == [(1,)]
    with pytest.raises(TransactionError):  # the table is locked
        b.sql("SELECT COUNT(*) FROM t")
    a.sql("ROLLBACK")
    assert b.sql("SELECT COUNT(*) FROM t").fetchall(1) == [(0,)]
    a.sql("BEGIN TRANSACTION")
    a.sql("INSERT INTO t VALUES(2)")
    with pytest.raises(DuplicateError):
        a.sql("INSERT INTO t VALUES(2)")
    with pytest.raises(TransactionError):  # the error has ended and undone the group
        a.sql("END TRANSACTION")
    a.sql("BEGIN TRANSACTION")
    a.sql("INSERT INTO t VALUES(3)")
    a.sql("END TRANSACTION")
    assert b.sql("SELECT * FROM t").fetchall(9) == [(3,)]


def test_many_inserts_are_merged(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE TABLE t(id INT)")
    for k in range(18):
        e.sql(f"INSERT INTO t VALUES({k})")
    assert len(e.store.catalog["tables"]["t"]["parts"]) < 17
    assert [r[0] for r in e.sql("SELECT id FROM t ORDER BY id").fetchall(99)] == [*range(18)]


def test_strings_and_numbers():
    assert parse("SELECT a FROM t WHERE b = 'it''s' AND c = -1.5").where.parts[0].right.value == "it's"


def test_explain_analyze(spark):
    e = Engine(spark)
    e.register("t", spark.range(100).selectExpr("id", "id % 7 AS g"), "id")
    found = e.sql("EXPLAIN ANALYZE SELECT g, COUNT(*) AS n FROM t WHERE id >= 30 GROUP BY g")
    assert found.affected == 7 and "rows: 7" in found.text and "Filter" in found.text and "number of output rows: 70" in found.text
    e.register("broken", spark.range(5).selectExpr("id", "CASE WHEN id = 3 THEN CAST(raise_error('no more') AS BIGINT) ELSE id END AS n"), "id")
    with pytest.raises(ExecutionError, match="no more") as failed:
        e.sql("EXPLAIN ANALYZE SELECT n FROM broken WHERE n >= 0")
    assert "Filter" in failed.value.report and "failed" in failed.value.report


def test_index_orders_rows(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    s = e.session()
    s.sql("CREATE TABLE t(id INTEGER PRIMARY KEY, k INTEGER)")
    s.load("t", spark.range(2000).selectExpr("id", "(id * 7919) % 1000 AS k").repartition(3))
    e.sql("CREATE INDEX by_k ON t(k)")
    table = e.store.catalog["tables"]["t"]
    assert table["sorted"] == "k"
    ranges = sorted((r[1], r[2]) for r in spark.read.parquet(*table["parts"]).selectExpr("input_file_name() AS f", "k").groupBy("f").agg(F.min("k"), F.max("k")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert e.sql("SELECT id FROM t WHERE k = 5").frame.count() == 2
    e.sql("DELETE FROM t WHERE k = 5")
    assert e.sql("SELECT COUNT(*) AS n FROM t").fetchall(1) == [(1998,)] and e.store.catalog["tables"]["t"]["sorted"] == "k"
    e.sql("DROP INDEX by_k")
    assert "sorted" not in e.store.catalog["tables"]["t"]


def test_two_drivers(spark, tmp_path):
    """A driver that read the catalog before another one changed it can't overwrite that change."""
    first, second = Engine(spark, f"file://{tmp_path}"), Engine(spark, f"file://{tmp_path}")
    first.sql("CREATE TABLE a(id INTEGER PRIMARY KEY)")
    with pytest.raises(TransactionError):
        second.sql("CREATE TABLE b(id INTEGER PRIMARY KEY)")
    third = Engine(spark, f"file://{tmp_path}")
    third.sql("CREATE TABLE c(id INTEGER PRIMARY KEY)")
    assert {*Engine(spark, f"file://{tmp_path}").store.catalog["tables"]} == {"a", "c"}
