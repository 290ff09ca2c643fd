"""Queries over a small university database, with their rows: one for each kind of filter, join, grouping and rewrite."""

import pytest

from tessera.session import Engine
from tessera.sources.catalog import Catalog

# The tables, queries and rows that the dialect is measured by.
TABLES = {
    "Course": "E, F, G, H\n101, 201, 3, 1\n102, 202, 3, 2\n103, 203, 3, 3\n104, 204, 4, 3\n105, 205, 4, 1\n106, 206, 4, 2\n",
    "Department": "L, M, N\n1, 301, 401\n2, 302, 402\n3, 303, 403\n",
    "Enrolled": "I, J, K\n1, 101, 85\n1, 102, 92\n2, 101, 91\n2, 103, 84\n3, 102, 78\n4, 104, 65\n",
    "Faculty": "O, P, Q\n1, 501, 1\n2, 502, 1\n3, 503, 2\n4, 504, 2\n5, 505, 3\n6, 506, 3\n",
    "Student": "A, B, C, D\n1, 25, 85, 30\n2, 30, 22, 40\n3, 35, 19, 20\n4, 40, 21, 40\n5, 45, 65, 30\n6, 50, 32, 10\n",
}
#: name: (query, header, rows)
CASES = {
    "combine_selects": ("SELECT Student.A, Student.B FROM Student WHERE Student.D > 30 AND Student.C < 50;", "a,b", [(2, 30), (4, 40)]),
    "combined_optimizations": ("SELECT Student.A, Student.B, Student.C, Student.D FROM Student WHERE 1 = 1 AND Student.D > 20;", "a,b,c,d", [(1, 25, 85, 30), (2, 30, 22, 40), (4, 40, 21, 40), (5, 45, 65, 30)]),
    "complex_join_condition": ("SELECT Student.A, Student.B, Course.F, Enrolled.K FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E AND Student.D = 40 AND Course.H = 3;", "a,b,f,k", [(2, 30, 203, 84), (4, 40, 204, 65)]),
    "distinct_order_by": ("SELECT DISTINCT Student.D FROM Student ORDER BY Student.D;", "d", [(10,), (20,), (30,), (40,)]),
    "group_by_sum_order_by": ("SELECT Student.D, SUM(Student.C) FROM Student GROUP BY Student.D ORDER BY Student.D;", "d,sum(student.c)", [(10, 32), (20, 19), (30, 150), (40, 43)]),
    "group_by_with_join": ("SELECT Course.H, SUM(Enrolled.K) FROM Course, Enrolled WHERE Course.E = Enrolled.J GROUP BY Course.H;", "h,sum(enrolled.k)", [(1, 176), (2, 170), (3, 149)]),
    "group_by_with_sum": ("SELECT Student.D, SUM(Student.C) FROM Student GROUP BY Student.D;", "d,sum(student.c)", [(20, 19), (40, 43), (10, 32), (30, 150)]),
    "join_with_complex_where": ("SELECT Student.A, Student.B, Course.F, Enrolled.K FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E AND Enrolled.K > 80;", "a,b,f,k", [(1, 25, 201, 85), (1, 25, 202, 92), (2, 30, 201, 91), (2, 30, 203, 84)]),
    "multi_join_optimizations": ("SELECT Student.A, Course.E, Enrolled.K FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E AND Student.D > 30 AND Course.G > 3;", "a,e,k", [(4, 104, 65)]),
    "optimize_distinct": ("SELECT DISTINCT Student.A, Student.B, Student.C, Student.D FROM Student;", "a,b,c,d", [(1, 25, 85, 30), (2, 30, 22, 40), (3, 35, 19, 20), (4, 40, 21, 40), (5, 45, 65, 30), (6, 50, 32, 10)]),
    "optimize_group_by": ("SELECT Student.D, SUM(Student.C) FROM Student WHERE 1 = 1 GROUP BY Student.D;", "d,sum(student.c)", [(20, 19), (40, 43), (10, 32), (30, 150)]),
    "optimize_order_by": ("SELECT Student.A, Student.D FROM Student WHERE 1 = 1 ORDER BY Student.D;", "a,d", [(6, 10), (3, 20), (1, 30), (5, 30), (2, 40), (4, 40)]),
    "preserve_join_order": ("SELECT Student.A, Enrolled.J, Course.E FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E;", "a,j,e", [(1, 101, 101), (1, 102, 102), (2, 101, 101), (2, 103, 103), (3, 102, 102), (4, 104, 104)]),
    "projection_pushdown": ("SELECT Student.A, Enrolled.K FROM Student, Enrolled WHERE Student.A = Enrolled.I;", "a,k", [(1, 85), (1, 92), (2, 91), (2, 84), (3, 78), (4, 65)]),
    "projection_pushdown_with_group_by": ("SELECT Student.D, SUM(Enrolled.K) FROM Student, Enrolled WHERE Student.A = Enrolled.I GROUP BY Student.D;", "d,sum(enrolled.k)", [(20, 78), (40, 240), (30, 177)]),
    "projection_pushdown_with_order_by": ("SELECT Student.A, Student.D, Enrolled.K FROM Student, Enrolled WHERE Student.A = Enrolled.I ORDER BY Student.D;", "a,d,k", [(3, 20, 78), (1, 30, 85), (1, 30, 92), (2, 40, 91), (2, 40, 84), (4, 40, 65)]),
    "projection_pushdown_with_selection": ("SELECT Student.A, Student.C, Enrolled.K FROM Student, Enrolled WHERE Student.A = Enrolled.I AND Student.D > 20 AND Enrolled.K > 80;", "a,c,k", [(1, 85, 85), (1, 85, 92), (2, 22, 91), (2, 22, 84)]),
    "projection_pushdown_with_three_way_join": ("SELECT Student.A, Course.F FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E AND Student.D > 30;", "a,f", [(2, 201), (2, 203), (4, 204)]),
    "push_preserves_selection": ("SELECT Student.A FROM Student WHERE Student.D > 30 AND Student.C < 30;", "a", [(2,), (4,)]),
    "push_with_expression_aggregation": ("SELECT Student.D, SUM(Student.C*Enrolled.K) FROM Student, Enrolled WHERE Student.A = Enrolled.I GROUP BY Student.D;", "d,sum(0)", [(20, 1482), (40, 5215), (30, 15045)]),
    "push_with_select_star": ("SELECT * FROM Student, Enrolled WHERE Student.A = Enrolled.I AND Student.D > 30;", "a,b,c,d,i,j,k", [(2, 30, 22, 40, 2, 101, 91), (2, 30, 22, 40, 2, 103, 84), (4, 40, 21, 40, 4, 104, 65)]),
    "select_distinct": ("SELECT DISTINCT Student.D FROM Student;", "d", [(30,), (40,), (20,), (10,)]),
    "select_pushdown_after_join": ("SELECT Student.A, Student.B, Course.F, Enrolled.K FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E AND Student.D = 40 AND Enrolled.K > 80;", "a,b,f,k", [(2, 30, 201, 91), (2, 30, 203, 84)]),
    "select_with_complex_where": ("SELECT Student.A, Student.C FROM Student WHERE Student.D >= 30 AND Student.C < 50;", "a,c", [(2, 22), (4, 21)]),
    "select_with_multiple_order_by": ("SELECT Student.A, Student.D, Student.C FROM Student ORDER BY Student.D, Student.C;", "a,d,c", [(6, 10, 32), (3, 20, 19), (5, 30, 65), (1, 30, 85), (4, 40, 21), (2, 40, 22)]),
    "select_with_order_by": ("SELECT Student.A, Student.D FROM Student ORDER BY Student.D;", "a,d", [(6, 10), (3, 20), (1, 30), (5, 30), (2, 40), (4, 40)]),
    "select_with_where": ("SELECT Student.A, Student.B, Student.D FROM Student WHERE Student.D > 30;", "a,b,d", [(2, 30, 40), (4, 40, 40)]),
    "selection_projection_reordering": ("SELECT Student.A, Student.B FROM Student WHERE Student.A > 3;", "a,b", [(4, 40), (5, 45), (6, 50)]),
    "selection_pushdown": ("SELECT Student.A, Student.B, Enrolled.J, Enrolled.K FROM Student, Enrolled WHERE Student.A = Enrolled.I AND Student.D > 30 AND Enrolled.K > 80;", "a,b,j,k", [(2, 30, 101, 91), (2, 30, 103, 84)]),
    "selection_to_inner_join": ("SELECT Student.A, Course.E FROM Student, Course WHERE Student.A = Course.E AND Course.G > 3;", "a,e", []),
    "selection_to_outer_join": ("SELECT Student.A, Course.E FROM Student, Course WHERE Student.A = Course.E AND Student.D > 30;", "a,e", []),
    "simple_join": ("SELECT Student.A, Student.B, Enrolled.J, Enrolled.K FROM Student, Enrolled WHERE Student.A = Enrolled.I;", "a,b,j,k", [(1, 25, 101, 85), (1, 25, 102, 92), (2, 30, 101, 91), (2, 30, 103, 84), (3, 35, 102, 78), (4, 40, 104, 65)]),
    "simple_select_all": ("SELECT * FROM Student;", "a,b,c,d", [(1, 25, 85, 30), (2, 30, 22, 40), (3, 35, 19, 20), (4, 40, 21, 40), (5, 45, 65, 30), (6, 50, 32, 10)]),
    "simple_select_columns": ("SELECT Student.A, Student.D FROM Student;", "a,d", [(1, 30), (2, 40), (3, 20), (4, 40), (5, 30), (6, 10)]),
    "sum_count": ("SELECT SUM(1) FROM Student;", "sum(0)", [(6,)]),
    "sum_product": ("SELECT SUM(Student.C*Student.D) FROM Student;", "sum(0)", [(6920,)]),
    "sum_without_group_by": ("SELECT SUM(Student.C) FROM Student;", "sum(student.c)", [(244,)]),
    "three_way_join": ("SELECT Student.A, Student.B, Course.F, Enrolled.K FROM Student, Enrolled, Course WHERE Student.A = Enrolled.I AND Enrolled.J = Course.E;", "a,b,f,k", [(1, 25, 201, 85), (1, 25, 202, 92), (2, 30, 201, 91), (2, 30, 203, 84), (3, 35, 202, 78), (4, 40, 204, 65)]),
    "unnecessary_project": ("SELECT Student.A, Student.B, Student.C, Student.D FROM Student;", "a,b,c,d", [(1, 25, 85, 30), (2, 30, 22, 40), (3, 35, 19, 20), (4, 40, 21, 40), (5, 45, 65, 30), (6, 50, 32, 10)]),
    "unnecessary_select": ("SELECT * FROM Student WHERE 1 = 1;", "a,b,c,d", [(1, 25, 85, 30), (2, 30, 22, 40), (3, 35, 19, 20), (4, 40, 21, 40), (5, 45, 65, 30), (6, 50, 32, 10)]),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("university")
    (top / "data").mkdir()
    for name, text in TABLES.items():
        (top / "data" / f"{name}.csv").write_text(text)
    return Engine(spark, Catalog.from_directory(spark, str(top)))


@pytest.mark.parametrize("name", CASES)
def test_rows(engine, name):
    sql, header, rows = CASES[name]
    got = engine.execute(sql)
    assert ",".join(c.name for c in got.columns) == header
    assert sorted(got.rows) == sorted(rows)


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if "ORDER BY" in c[0]])
def test_order(engine, name):
    """Rows come in the order of the keys; which of equal ones comes first is left open."""
    sql, header, rows = CASES[name]
    got = engine.execute(sql)
    keys = [c.strip(" ;").split(".")[1].lower() for c in sql.split("ORDER BY")[1].split(",")]
    at = [header.split(",").index(k) for k in keys]
    assert [[r[i] for i in at] for r in got.rows] == [[r[i] for i in at] for r in rows]
