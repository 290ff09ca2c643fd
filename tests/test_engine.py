import threading

import pytest
from pyspark.sql import functions as F

from tessera.budget import Budget, BudgetPolicy
from tessera.cli import run as cli
from tessera.errors import BudgetExceeded, BudgetKind, ErrorCode, QueryError
from tessera.functions.semantics import wrapping_product
from tessera.plans.compiler import ColumnMeta
from tessera.session import Busy, Engine, QueryService
from tessera.sources.catalog import Catalog, read_csv

CSV = {
    "Student": "A, B, C, D\n1, 200, 50, 33\n2, 200, 200, 44\n3, 100, 105, 44\n4, 100, 50, 11\n5, 100, 500, 22\n6, 300, 400, 11\n",
    "Course": "E, F, G\n101, 2, 3\n102, 3, 4\n104, 104, 2\n103, 1, 1\n107, 2, 8\n",
    "Enrolled": "A, E, H\n1, 101, 75\n1, 102, 82\n1, 103, 92\n2, 101, 12\n3, 102, 52\n4, 104, 27\n",
    "Staff": "name,dept,salary\nalice,eng,120\nbob,sales,90\ncarol,eng,100\ndan,sales,80\nerin,eng,110\n",
    "Employees": 'name,dept,salary\n"smith, dan",eng,10\nann,ops,20\n"a ""b"" c",eng,30\n',
    "Sales": "region,qty\neast,10\nwest,7\neast,3\n",
    "Empty": "a,b\n",
    "Big": "x\n2147483647\n2147483647\n",
    "L": "n\n1\n2\n3\n4\n5\n",
    "R": "n\n1\n2\n3\n4\n5\n",
    "Notes": 'id,note\n1,"two\nlines"\n2,one\n',
}


@pytest.fixture(scope="module")
def db(tmp_path_factory):
    top = tmp_path_factory.mktemp("db")
    (top / "data").mkdir()
    for name, text in CSV.items():
        (top / "data" / f"{name}.csv").write_text(text)
    return top


@pytest.fixture(scope="module")
def engine(spark, db):
    return Engine(spark, Catalog.from_directory(spark, str(db)))


CASES = [
    ("SELECT * FROM Student", "a,b,c,d", [(1, 200, 50, 33), (2, 200, 200, 44), (3, 100, 105, 44), (4, 100, 50, 11), (5, 100, 500, 22), (6, 300, 400, 11)]),
    ("SELECT Student.A FROM Student;", "a", [(i,) for i in range(1, 7)]),
    ("SELECT Student.D, Student.B, Student.A FROM Student WHERE Student.A < 3", "d,b,a", [(33, 200, 1), (44, 200, 2)]),
    ("SELECT * FROM Student, Enrolled WHERE Student.A = Enrolled.A", "a,b,c,d,a,e,h", [(1, 200, 50, 33, 1, 101, 75), (1, 200, 50, 33, 1, 102, 82), (1, 200, 50, 33, 1, 103, 92), (2, 200, 200, 44, 2, 101, 12), (3, 100, 105, 44, 3, 102, 52), (4, 100, 50, 11, 4, 104, 27)]),
    ("SELECT Student.A, Course.E FROM Student, Course WHERE Student.C < Course.E", "a,e", [(1, e) for e in (101, 102, 103, 104, 107)] + [(3, 107)] + [(4, e) for e in (101, 102, 103, 104, 107)]),
    ("SELECT DISTINCT Enrolled.A FROM Enrolled", "a", [(1,), (2,), (3,), (4,)]),
    ("SELECT Enrolled.E, SUM(Enrolled.H * Enrolled.H) FROM Enrolled GROUP BY Enrolled.E", "e,sum(0)", [(101, 5769), (102, 9428), (103, 8464), (104, 729)]),
    ("SELECT SUM(1) FROM Student GROUP BY Student.B", "sum(0)", [(3,), (2,), (1,)]),
    ("SELECT Student.B, Student.C FROM Student, Enrolled WHERE Student.A = Enrolled.A GROUP BY Student.B, Student.C", "b,c", [(100, 50), (200, 50), (100, 105), (200, 200)]),
    ("SELECT SUM(1), SUM(Student.A) FROM Student, Enrolled", "sum(0),sum(student.a)", [(36, 126)]),
    ("SELECT Student.A, Course.E, Enrolled.H FROM Student, Enrolled, Course WHERE Student.A = Enrolled.A AND Enrolled.E = Course.E AND Student.C > 100 AND Course.G > 2", "a,e,h", [(2, 101, 12), (3, 102, 52)]),
    ("SELECT Student.A FROM Student WHERE 1 = 1", "a", [(i,) for i in range(1, 7)]),
    ("SELECT Student.B, SUM(Student.C) FROM Student WHERE Student.D > 20 GROUP BY Student.B", "b,sum(student.c)", [(100, 605), (200, 250)]),
    ("SELECT COUNT(*), Student.B, MIN(Student.C), MAX(Student.C), AVG(Student.C) FROM Student GROUP BY Student.B", "b,count(*),min(student.c),max(student.c),avg(student.c)", [(100, 3, 50, 500, 218), (200, 2, 50, 200, 125), (300, 1, 400, 400, 400)]),
    ("SELECT Staff.dept, MIN(Staff.name), MAX(Staff.salary), COUNT(*) FROM Staff GROUP BY Staff.dept", "dept,min(staff.name),max(staff.salary),count(*)", [("sales", "bob", 90, 2), ("eng", "alice", 120, 3)]),
    ("SELECT AVG(Sales.qty), COUNT() FROM Sales", "avg(sales.qty),count(*)", [(6, 3)]),
    ("SELECT COUNT(*) FROM Empty", "count(*)", []),
    ("SELECT Empty.a, COUNT(*) FROM Empty GROUP BY Empty.a", "a,count(*)", []),
    ("SELECT Employees.salary FROM Employees WHERE Employees.name = 'smith, dan'", "salary", [(10,)]),
    ('SELECT "Employees"."salary" FROM Employees WHERE Employees.name > \'b\'', "salary", [(10,)]),
    ("SELECT Staff.name FROM Staff, Employees WHERE Staff.dept = Employees.dept AND Employees.salary = 30 AND Staff.name < 'b'", "name", [("alice",)]),
    ("SELECT Student.A, Student.A FROM Student WHERE Student.A * Student.A > 30", "a,a", [(6, 6)]),
    ("SELECT Student.A FROM Student WHERE Student.A > -3 AND Student.A <> 2 AND Student.A <= 3", "a", [(1,), (3,)]),
    ("SELECT Notes.note FROM Notes WHERE Notes.id = 1", "note", [("two\nlines",)]),
]


@pytest.mark.parametrize("sql,header,rows", CASES, ids=[c[0][:60] for c in CASES])
def test_results(engine, sql, header, rows):
    got = engine.execute(sql)
    assert ",".join(c.name for c in got.columns) == header
    assert sorted(got.rows) == sorted(rows)


@pytest.mark.parametrize("algorithm", ["merge", "shuffle_hash", "broadcast"])
def test_join_algorithms_agree(spark, engine, algorithm):
    sql = "SELECT Student.A, Enrolled.E FROM Student, Enrolled WHERE Student.A = Enrolled.A AND Enrolled.H > Student.C"
    assert sorted(Engine(spark, engine.catalog, algorithm).execute(sql).rows) == sorted(engine.execute(sql).rows)


def test_order_and_limit(engine):
    got = engine.execute("SELECT * FROM Enrolled ORDER BY Enrolled.H LIMIT 5")
    assert [r[2] for r in got.rows] == [12, 27, 52, 75, 82] and got.truncated and got.hint
    assert [r[0] for r in engine.execute("SELECT Student.B, Student.A FROM Student ORDER BY Student.B, Student.A").rows] == [100, 100, 100, 200, 200, 300]
    assert not engine.execute("SELECT * FROM Enrolled LIMIT 6").truncated
    assert engine.execute("SELECT * FROM Enrolled LIMIT 0").truncated
    assert not engine.execute("SELECT * FROM Empty LIMIT 0").truncated


ERRORS = [
    ("SELECT Student.nam FROM Student", "UNKNOWN_COLUMN", "Available"),
    ("SELECT A FROM Student", "UNSUPPORTED_SQL", "qualified"),
    ("SELECT * FROM Student, Course WHERE Student.nam = Course.E", "UNKNOWN_COLUMN", "Column 'Student.nam' not found"),
    ("SELECT * FROM Student ORDER BY Student.nam", "UNKNOWN_COLUMN", "nam"),
    ("SELECT Student.A FROM Student ORDER BY Student.B", "UNKNOWN_COLUMN", "ORDER BY"),
    ("SELECT * FROM Studnt", "UNKNOWN_TABLE", "Available tables"),
    ("SELECT * FROM student", "UNKNOWN_TABLE", "Student"),
    ("SELECT * FROM Student, Course WHERE Studnt.A = Course.E", "UNKNOWN_TABLE", "Studnt"),
    ("SELECT * FROM Student WHERE Course.E = 1", "UNKNOWN_TABLE", "Course"),
    ("SELEKT * FROM Student", "PARSE_ERROR", "SQL syntax error"),
    ("", "PARSE_ERROR", "empty"),
    ("SELECT * FROM Student; SELECT * FROM Course", "PARSE_ERROR", "syntax"),
    ("DELETE FROM Student", "UNSUPPORTED_SQL", "SELECT"),
    ("CREATE TABLE t (a INT)", "UNSUPPORTED_SQL", "SELECT"),
    ("INSERT INTO Student VALUES (1)", "UNSUPPORTED_SQL", "SELECT"),
    ("SELECT * FROM Student WHERE Student.A = 1 OR Student.A = 2", "UNSUPPORTED_SQL", "OR"),
    ("SELECT * FROM Student WHERE NOT Student.A < 1", "UNSUPPORTED_SQL", "NOT"),
    ("SELECT * FROM Student WHERE Student.A IN (1, 2)", "UNSUPPORTED_SQL", "IN"),
    ("SELECT * FROM Student WHERE Student.A + 1 = 2", "UNSUPPORTED_SQL", "Add"),
    ("SELECT Student.A * 2 FROM Student", "UNSUPPORTED_SQL", "column references"),
    ("SELECT UPPER(Staff.name) FROM Staff", "UNSUPPORTED_SQL", "UPPER"),
    ("SELECT * FROM Student ORDER BY Student.A * 2", "UNSUPPORTED_SQL", "ORDER BY"),
    ("SELECT * FROM Student ORDER BY Student.A DESC", "UNSUPPORTED_SQL", "DESC"),
    ("SELECT Student.A AS x FROM Student", "UNSUPPORTED_SQL", "alias"),
    ("SELECT s.A FROM Student s", "UNSUPPORTED_SQL", "alias"),
    ("SELECT * FROM Student JOIN Course ON Student.A = Course.E", "UNSUPPORTED_SQL", "JOIN"),
    ("SELECT * FROM Student LEFT JOIN Course ON Student.A = Course.E", "UNSUPPORTED_SQL", "JOIN"),
    ("SELECT * FROM Student, Student", "UNSUPPORTED_SQL", "twice"),
    ("SELECT Student.A FROM Student UNION SELECT Course.E FROM Course", "UNSUPPORTED_SQL", ""),
    ("SELECT * FROM (SELECT * FROM Student)", "UNSUPPORTED_SQL", ""),
    ("WITH t AS (SELECT 1) SELECT * FROM t", "UNSUPPORTED_SQL", "WITH"),
    ("SELECT 1", "UNSUPPORTED_SQL", ""),
    ("SELECT *, COUNT(*) FROM Student", "UNSUPPORTED_SQL", "*"),
    ("SELECT Student.A, COUNT(*) FROM Student", "UNSUPPORTED_SQL", "GROUP BY"),
    ("SELECT Student.A, COUNT(*) FROM Student GROUP BY Student.B", "UNSUPPORTED_SQL", "GROUP BY"),
    ("SELECT Student.B, COUNT(*) FROM Student GROUP BY Student.B HAVING COUNT(*) > 1", "UNSUPPORTED_SQL", "HAVING"),
    ("SELECT COUNT(DISTINCT Student.B) FROM Student", "UNSUPPORTED_SQL", "DISTINCT"),
    ("SELECT SUM(*) FROM Student", "UNSUPPORTED_SQL", "SUM"),
    ("SELECT * FROM Student LIMIT ALL", "UNSUPPORTED_SQL", "LIMIT"),
    ("SELECT * FROM Student LIMIT 1 OFFSET 1", "UNSUPPORTED_SQL", "OFFSET"),
    ("SELECT * FROM Student LIMIT -1", "UNSUPPORTED_SQL", "LIMIT"),
    ("SELECT * FROM Student WHERE Student.A = 'abc'", "TYPE_MISMATCH", "INT"),
    ("SELECT * FROM Student WHERE 1 = '1'", "TYPE_MISMATCH", "INT"),
    ("SELECT * FROM Student, Staff WHERE Student.A = Staff.name", "TYPE_MISMATCH", "STRING"),
    ("SELECT SUM(Staff.name) FROM Staff", "TYPE_MISMATCH", "numeric"),
    ("SELECT SUM(Big.x) FROM Big", "DATA_ERROR", "out of range"),
    ("SELECT * FROM Big WHERE Big.x * 2 > 1", "DATA_ERROR", "out of range"),
    ("SELECT * FROM Student WHERE Student.A < 3000000000", "UNSUPPORTED_SQL", "32-bit"),
]


@pytest.mark.parametrize("sql,code,part", ERRORS, ids=[e[0][:60] or "empty" for e in ERRORS])
def test_errors(engine, sql, code, part):
    with pytest.raises(QueryError) as e:
        engine.execute(sql)
    assert e.value.code.value == code and part.lower() in str(e.value).lower()


def test_column_metadata(engine):
    got = engine.execute("SELECT Staff.name, Staff.salary FROM Staff").columns
    assert got == (ColumnMeta("name", "staff.name", "STRING"), ColumnMeta("salary", "staff.salary", "INT"))
    assert engine.execute("SELECT * FROM Sales").columns[0].qualified_name is None
    assert engine.execute("SELECT * FROM Sales, Empty").columns[0].qualified_name == "sales.region"


def test_explain(engine):
    text = engine.explain("SELECT Student.B, SUM(Student.C) FROM Student, Enrolled WHERE Student.A = Enrolled.A AND Student.D > 30 GROUP BY Student.B")
    text, _, catalyst = text.partition("\n=== Plan (Catalyst) ===\n")
    assert "Aggregate" in catalyst and "Join Inner" in catalyst
    assert text == """=== Plan (as written) ===
Aggregate[group by: Student.B; calls: SUM(Student.c)]
  Project[Enrolled.A, Student.A, Student.B, Student.C, Student.D]
    Select[Student.D > 30]
      HashJoin[Student.A = Enrolled.A]
        Scan[Student]
        Scan[Enrolled]

=== Plan (optimized) ===
Aggregate[group by: Student.B; calls: SUM(Student.c)]
  Project[Enrolled.A, Student.A, Student.B, Student.C, Student.D]
    HashJoin[Student.A = Enrolled.A]
      Select[Student.D > 30]
        Scan[Student]
      Project[Enrolled.A]
        Scan[Enrolled]
"""
    assert "Join[cross]" in engine.explain("SELECT * FROM L, R")
    assert "Join[L.n < R.n]" in engine.explain("SELECT * FROM L, R WHERE L.n < R.n")


@pytest.mark.parametrize("name,text,code", [("twice", "A,A\n1,2\n", "duplicate"), ("none", "", "header"), ("long", "A,B\n1,2,3\n", "fields"), ("short", "A,B,C\n1,2\n", "fields")])
def test_bad_csv(spark, tmp_path, name, text, code):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(QueryError) as e:
        read_csv(spark, name, str(tmp_path / "t.csv"))
    assert e.value.code is ErrorCode.DATA_ERROR and code in str(e.value)


def test_type_inference(spark, tmp_path):
    (tmp_path / "t.csv").write_text("A,B,C,D,E\n1,5,+7, 3 ,2147483648\nabc,,007,-4,1\n")
    t = read_csv(spark, "t", str(tmp_path / "t.csv"))
    assert t.types == ("STRING", "STRING", "INT", "INT", "STRING") and t.row_count == 2
    assert [tuple(r) for r in t.frame.collect()] == [("1", "5", 7, 3, "2147483648"), ("abc", "", 7, -4, "1")]


def test_registration_is_atomic(spark, db):
    c = Catalog(spark)
    path, got = str(db / "data" / "Sales.csv"), []
    threads = [threading.Thread(target=lambda: got.append(c.register_csv("S", path))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [False, False, False, True]


def test_file_changed_after_load(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    c = Catalog(spark)
    c.register_csv("t", str(tmp_path / "t.csv"))
    (tmp_path / "t.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(QueryError) as e:
        Engine(spark, c).execute("SELECT * FROM t")
    assert e.value.code is ErrorCode.DATA_ERROR


def test_tuple_budget(engine):
    with pytest.raises(BudgetExceeded) as e:
        engine.execute("SELECT COUNT(*) FROM L, R", Budget(max_tuples=5))  # before any job
    assert e.value.kind is BudgetKind.TUPLES
    with pytest.raises(BudgetExceeded):
        engine.execute("SELECT COUNT(*) FROM L, R", Budget(max_tuples=20))  # 5 + 5 + 25 + 1 rows
    assert engine.execute("SELECT COUNT(*) FROM L, R", Budget(max_tuples=36)).rows == [(25,)]
    assert len(engine.execute("SELECT * FROM L LIMIT 2", Budget(max_tuples=3)).rows) == 2


def test_time_budget(spark, engine):
    with pytest.raises(BudgetExceeded) as e:
        engine.execute("SELECT * FROM L", Budget(timeout_ms=0))
    assert e.value.kind is BudgetKind.TIME
    c = Catalog(spark)
    c.register_frame("A", spark.range(1_000_000).select(F.col("id").cast("int").alias("x")))
    c.register_frame("B", spark.range(1_000_000).select(F.col("id").cast("int").alias("y")))
    with pytest.raises(BudgetExceeded):
        Engine(spark, c).execute("SELECT COUNT(*) FROM A, B WHERE A.x < B.y", Budget(timeout_ms=1500))
    assert engine.execute("SELECT COUNT(*) FROM L").rows == [(5,)]


def test_policy():
    p = BudgetPolicy()
    assert p.clamp(None, None) == Budget(100_000, 5_000)
    assert p.clamp(10**9, 10**9) == Budget(1_000_000, 30_000)
    for bad in ((0, None), (None, -1)):
        with pytest.raises(ValueError):
            p.clamp(*bad)


def test_service_audits_everything(engine):
    seen = []
    s = QueryService(engine, BudgetPolicy(default_timeout_ms=30_000), permits=1, audit=seen.append)
    assert s.execute("SELECT COUNT(*) FROM L").result.rows == [(5,)]
    assert "Scan[L]" in s.execute("EXPLAIN SELECT * FROM L").explain
    with pytest.raises(QueryError):
        s.execute("SELECT * FROM nope")
    with pytest.raises(ValueError):
        s.execute("SELECT * FROM L", max_tuples=-1)
    s._permits.acquire()
    with pytest.raises(Busy):
        s.execute("SELECT * FROM L")
    s._permits.release()
    assert [(e.outcome, e.error_code) for e in seen] == [("SUCCESS", None), ("EXPLAIN", None), ("ERROR", "UNKNOWN_TABLE"), ("ERROR", "BAD_REQUEST"), ("ERROR", "CONCURRENCY_LIMIT")]


def test_parquet_types_and_nulls(spark):
    c = Catalog(spark)
    c.register_frame("T", spark.createDataFrame([(1, 10, 1.5, "a"), (2, None, 2.5, None), (-3, -7, None, "c")], "k int, B bigint, d double, s string"))
    e = Engine(spark, c)
    assert e.execute("SELECT SUM(T.b), AVG(T.b), COUNT(T.b), COUNT(*), AVG(T.d) FROM T").rows == [(3, 1, 2, 3, 2.0)]
    assert e.execute("SELECT AVG(T.k * T.b) FROM T WHERE T.k < T.d").rows == [(10,)]
    assert e.execute("SELECT AVG(T.b) FROM T WHERE T.k < 0").rows == [(-7,)]
    assert e.execute("SELECT AVG(T.k) FROM T WHERE T.k <> 1").rows == [(0,)]


def test_wrapping_product(spark):
    df = spark.createDataFrame([(2147483647, 2)], "a int, b int")
    assert df.select(wrapping_product(df.a, df.b)).first()[0] == -2


def test_cli(spark, db, tmp_path):
    q, out = tmp_path / "q.sql", tmp_path / "sub" / "out.csv"
    q.write_text("SELECT Employees.name, Employees.salary FROM Employees WHERE Employees.salary < 25 ORDER BY Employees.salary;")
    assert cli([str(db), str(q), str(out)], spark) == 0
    assert out.read_text() == 'name,salary\n"smith, dan",10\nann,20\n'
    q.write_text("EXPLAIN SELECT * FROM L")
    assert cli([str(db), str(q), str(out)], spark) == 0 and out.read_text().startswith("=== Plan (as written) ===")
    out.unlink()
    q.write_text("SELECT * FROM L ORDER BY L.zz")
    assert cli([str(db), str(q), str(out)], spark) == 1 and not out.exists()
    q.write_text("SELECT COUNT(*) FROM L, R")
    assert cli([str(db), str(q), str(out), "--max-tuples=3"], spark) == 1 and not out.exists()
    assert cli([str(db), str(tmp_path / "none.sql"), str(out)], spark) == 1
    assert cli([str(db), str(q), str(out), "--max-tuples=-1"], spark) == 1


def test_distributed_csv_sink(spark, engine, tmp_path):
    engine.write_csv_dir("SELECT * FROM Student, Enrolled WHERE Student.A = Enrolled.A", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 6


def test_concurrent_queries(engine):
    got, sql = [], "SELECT COUNT(*) FROM L, R WHERE L.n < R.n"
    threads = [threading.Thread(target=lambda: got.append(engine.execute(sql).rows)) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got == [[(10,)]] * 4


def test_plans_push_down_and_prune(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as int) a", "cast(id as int) b", "cast(id as string) c").write.parquet(str(tmp_path / "T.parquet"))
    e = Engine(spark, Catalog.from_parquet(spark, str(tmp_path), ("T",)))
    plan = e.frame("SELECT T.a FROM T WHERE T.b > 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(b), GreaterThan(b,5)]" in plan and "ReadSchema: struct<a:int,b:int>" in plan


def test_parser_in_threads(spark, engine):
    """Quoted names parse in any thread, and no setting of the session changes."""
    import threading

    key, found = "spark.sql.ansi.doubleQuotedIdentifiers", []
    before = spark.conf.get(key)

    def work():
        for _ in range(20):
            found.append(engine.parse('SELECT "Student"."a" FROM Student').columns[0].name)

    threads = [threading.Thread(target=work) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == ["a"] * 160 and spark.conf.get(key) == before


def test_budget_stops_tasks_and_fetches(spark):
    """A cross product of 10**10 rows ends at once, and no more rows than allowed and one reach the driver."""
    import time

    c = Catalog(spark)
    c.register_frame("A", spark.range(100_000).selectExpr("cast(id as int) x"))
    c.register_frame("B", spark.range(100_000).selectExpr("cast(id as int) y"))
    e, began = Engine(spark, c), time.time()
    for sql in ("SELECT * FROM A, B", "SELECT COUNT(*) FROM A, B", "SELECT A.x FROM A ORDER BY A.x"):
        with pytest.raises(BudgetExceeded) as failed:
            e.execute(sql, Budget(max_tuples=1000))
        assert failed.value.kind is BudgetKind.TUPLES and "tuple budget" in str(failed.value)
    assert time.time() - began < 60
    assert len(e.execute("SELECT A.x FROM A LIMIT 7", Budget(max_tuples=1000)).rows) == 7


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x, ""y"" {i}"\n' for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        c = Catalog(spark)
        c.register_csv("Big", str(path))
        assert c.get("Big").frame.rdd.getNumPartitions() > 3 and c.get("Big").row_count == 20_000
        assert Engine(spark, c).execute("SELECT Big.b FROM Big WHERE Big.a = 19999").rows == [('x, "y" 19999',)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
