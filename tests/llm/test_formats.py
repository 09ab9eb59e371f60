import pytest

from quillgate.llm import formats
from quillgate.llm.formats import canonical_statement as form

AUDIT = "line_no bigint, original_sql string, h string, c int"
DAYS = "usage_id bigint, by_sql array<struct<stmt: string, n: bigint>>, no int"


@pytest.mark.parametrize(
    "a, b",
    [
        ("SELECT a, b FROM t", "select\n`B` ,\t\"A\"\nfrom T ;;\n"),
        ("select count( * ) as n, x from t where y<>'A'", "SELECT X, COUNT(*) AS N FROM T WHERE Y <> 'A';"),
        ("select distinct b, a from t", "SELECT DISTINCT a,b FROM t"),
        ("select f(a, b), c from (select y, x from u) v", "select c,f(a,b) from (select x,y from u) v"),
        ("select a from t union select c, b from u", "select a from t union select b,c from u"),
        ("delete from t where a = 'x; y'", "DELETE FROM T WHERE A='x; y' ; "),
        ("", " ;\n"),
    ],
)
def test_same(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(
    "a, b",
    [
        ("select a from t where x = 'A'", "select a from t where x = 'a'"),
        ("select a from t where x = 'a  b'", "select a from t where x = 'a b'"),
        ("select a from t where x = '\"a\"'", "select a from t where x = 'a'"),
        ("select f(a, b) from t", "select f(b, a) from t"),
        ("select a, a from t", "select a from t"),
        ("select a from t order by a, b", "select a from t order by b, a"),
        ("select distinct a from t", "select a from t"),
        ("select ab from t", "select a b from t"),
        ("select a from t where x = 'it''s; from'", "select a from t where x = 'it''s;from'"),
    ],
)
def test_different(a, b):
    assert form(a) != form(b)


def test_odd_text_does_not_crash():
    for t in ("select", "select ,", "((((", "))))", "'", "''", "select 'a", "select a, (b from", "\"", "`x", "from select", "select " + ", ".join(f"c{i}" for i in range(20_000)), "(" * 50_000, "'" + "x" * 500_000):
        assert isinstance(form(t), str)


def test_copies(spark):
    audit = spark.createDataFrame([(3, "select a,b from t", "x", 1), (1, "SELECT b, a FROM t;", "x", 1), (2, "select z", "x", 1), (9, None, "x", 1), (7, "select b,a from t", "x", 1), (8, "", "x", 1), (10, ";", "x", 1)], AUDIT)
    days = spark.createDataFrame([(5, [("select q", 1), ("SELECT Q", 2), (None, 1), None, ("select a,b from t", 1)], 1), (6, [("select q", 1)], 1), (7, None, 1), (8, [], 1)], DAYS)
    rows = formats.keyed(audit, days)
    assert sorted(tuple(r) for r in formats.copies(rows).collect()) == [("by_sql", 5, 0, 1), ("original_sql", 0, 1, 3), ("original_sql", 0, 1, 7), ("original_sql", 0, 8, 10)]
    assert formats.collisions(rows).first().n_collisions == 0
    empty = formats.keyed(spark.createDataFrame([], AUDIT), spark.createDataFrame([], DAYS))
    assert formats.copies(empty).count() == 0


def test_heavy_groups_give_the_same(spark, monkeypatch):
    audit = spark.createDataFrame([(i, "select a" if i % 3 else f"select {i % 7}", "x", 1) for i in range(3000)], AUDIT)
    rows = formats.keyed(audit, spark.createDataFrame([], DAYS))
    got = sorted(tuple(r) for r in formats.copies(rows).collect())  # 2000 copies of one form, beyond the bound of 1000
    first, want = {}, []
    for i in range(3000):
        k = "a" if i % 3 else i % 7
        if first.setdefault(k, i) != i:
            want.append(("original_sql", 0, first[k], i))
    assert got == sorted(want)
