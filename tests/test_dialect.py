"""The dialect: statements, errors, and predicates against a plain evaluator."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sedimenta.plans import compile as plan
from sedimenta.plans.dialect import CreateTable, Delete, Filter, Insert, Literal, Predicate, Select, SqlError, Update, parse, tokenize
from sedimenta.plans.session import SqlSession


def test_statements():
    s = parse("select A, \"b c\" from T where a >= -5 and b <> 'it''s' order by a desc limit 3; -- end")
    assert s == Select("select", "T", ("A", "b c"), Filter("and", (Predicate("a", ">=", Literal("int", -5)), Predicate("b", "<>", Literal("text", "it's")))), "a", True, 3)
    c = parse("CREATE TABLE IF NOT EXISTS t (id BIGINT PRIMARY KEY, name VARCHAR(20) NOT NULL, x)")
    assert isinstance(c, CreateTable) and c.if_not_exists and [x.not_null for x in c.columns] == [True, True, False]
    assert isinstance(parse("INSERT INTO t (a) VALUES (1), (2.5), (NULL)"), Insert)
    assert parse("UPDATE t SET a = 1, a = 'x' WHERE b != 2") == Update("update", "t", (("a", Literal("int", 1)), ("a", Literal("text", "x"))), Filter("and", (Predicate("b", "<>", Literal("int", 2)),)))
    assert isinstance(parse("delete from t"), Delete)
    assert parse('SELECT * FROM t WHERE a = "null"').where.parts[0].literal.kind == "null"
    assert parse("SELECT * FROM t").is_mutation is False and parse("DROP TABLE t").is_mutation


@pytest.mark.parametrize(
    "sql, words, offset",
    [
        ("", "expected a statement", 0),
        ("SELECT * FROM t WHERE a = 1 AND b = 2 OR c = 3", "ambiguous", 38),
        ("SELECT é FROM t x", "end of the statement", 17),
        ("SELECT * FROM t LIMIT -1", "limit", 22),
        ("SELECT * FROM t WHERE a = 'x", "unterminated string", 26),
        ("INSERT INTO t VALUES (9223372036854775808)", "out of range", 22),
        ("SELECT 1.2.3 FROM t", "a column", 7),
        ("SELECT * FROM t; SELECT 1", "end of the statement", 17),
        ("SELECT * FROM t WHERE (a = 1)", "a column", 22),
        ("SELECT a FROM t WHERE a @ 1", "unexpected character", 24),
    ],
)
def test_errors(sql, words, offset):
    with pytest.raises(SqlError, match=words) as e:
        parse(sql)
    assert e.value.offset == offset


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except SqlError:
        pass


VALUES = {
    "int": [None, -3, 0, 1, 7, 2**63 - 1],
    "float": [None, -2.5, 0.0, 1.0, 7.25, float("nan"), float("inf")],
    "text": [None, "", "1", "apple", "é", "zz"],
    "mixed": [None, ("int", 1, None, None), ("float", None, 1.5, None), ("text", None, None, "apple")],
}
TYPES = {"int": T.LongType(), "float": T.DoubleType(), "text": T.StringType(), "mixed": plan.MIXED}


def holds(v, op, lit):
    """Plain meaning of a predicate over one value."""
    if isinstance(v, tuple):
        v = next((x for x in v[1:] if x is not None), None)
    if lit.kind == "null":
        return {"=": v is None, "<>": v is not None}.get(op, False)
    if v is None or isinstance(v, str) != (lit.kind == "text"):
        return False
    a, b = v, lit.value
    if isinstance(a, float) != isinstance(b, float):
        a, b = float(a), float(b)
    if a != a:
        return False
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def test_predicates_equal_the_plain_evaluator(spark):
    literals = [Literal("null"), Literal("int", 1), Literal("int", 2**63 - 1), Literal("float", 1.5), Literal("float", 7.25), Literal("text", "apple"), Literal("text", "")]
    for kind, values in VALUES.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("n", T.LongType()), T.StructField("Col", TYPES[kind])]))
        asked = [(op, lit) for op in ("=", "<>", "<", "<=", ">", ">=") for lit in literals]
        cols = [plan.predicate(df, Predicate("cOL", op, lit)).alias(f"p{i}") for i, (op, lit) in enumerate(asked)]
        for row, v in zip(df.orderBy("n").select(*cols).collect(), values):
            assert list(row) == [holds(v, op, lit) for op, lit in asked], (kind, v)


def test_stored_tables(spark, tmp_path):
    s = SqlSession(spark, str(tmp_path))
    q = s.query
    assert q("CREATE TABLE t (a INTEGER, b TEXT NOT NULL, c)").detail == "table t created with 3 column(s)"
    assert "skipped" in q("CREATE TABLE IF NOT EXISTS T (x)").detail
    assert q("INSERT INTO t (B, a) VALUES ('one', 1), ('two', -2), ('n', NULL)").affected == 3
    q("INSERT INTO t VALUES (2.5, 'f', 7), ('x', 'g', NULL)")
    assert q("SELECT a FROM t ORDER BY a").rows() == [[-2], [1], [2.5], ["x"], [None]]
    assert q("SELECT a FROM t ORDER BY a DESC").rows() == [[2.5], [1], [-2], ["x"], [None]]
    assert q("SELECT b FROM t LIMIT 2").rows() == [["one"], ["two"]]
    assert q("SELECT b, b FROM t WHERE a > 0").rows() == [["one", "one"], ["f", "f"]]
    before = s.table("t")
    assert q("UPDATE t SET c = 'new' WHERE a <> NULL").affected == 4
    assert q("DELETE FROM t WHERE b = 1").affected == 0
    assert q("DELETE FROM t WHERE a < 0").affected == 1
    assert before.count() == 5 and q("SELECT * FROM t").row_count == 4  # an older reader keeps its version
    assert q("SELECT c FROM t WHERE b = 'f'").to_json() == '{"type": "rows", "columns": ["c"], "rows": [["new"]]}'
    for bad, words in [("INSERT INTO t (b) VALUES (NULL)", "NOT NULL"), ("INSERT INTO t (a) VALUES (1)", "NOT NULL"), ("INSERT INTO t VALUES (1)", "expected"), ("SELECT z FROM t", "no such column"), ("UPDATE t SET b = NULL", "NOT NULL"), ("SELECT * FROM t WHERE zz = 1", "no such column"), ("CREATE TABLE t (a)", "exists")]:
        with pytest.raises(SqlError, match=words):
            q(bad)
    assert q("DROP TABLE t").detail == "table t dropped, 4 row(s) removed"
    with pytest.raises(SqlError, match="no such table"):
        q("SELECT * FROM t")
    q("CREATE TABLE t (a)")
    assert q("SELECT * FROM t").rows() == []
    assert q("SELECT * FROM t").render() == "a\n(0 row(s))"


def test_plan_pushes_filters_and_takes_the_top(spark, capsys):
    from sedimenta.plans import catalogue

    catalogue.flagship(spark, "/root/testdata/sf0.001").explain("formatted")
    out = capsys.readouterr().out
    assert "TakeOrderedAndProject" in out and "GreaterThanOrEqual(o_totalprice,100000.0)" in out
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in out


def test_results_round_trip_as_json(spark):
    from sedimenta.plans.session import SqlResult

    text = '{"type": "rows", "columns": ["a", "b"], "rows": [[1, "x"], [2.5, null], ["t", "é\\n"]]}'
    back = SqlResult.from_json(spark, text)
    assert back.rows() == [[1, "x"], [2.5, None], ["t", "é\n"]] and back.to_json() == text
    assert back.as_maps()[0] == {"a": 1, "b": "x"} and back.scalar() == 1
    assert SqlResult.from_json(spark, '{"type": "affected", "count": 3}').affected == 3


def test_comments():
    assert [t.value for t in tokenize("a /* b * / \n c */ d -- e\n/***/ f")] == ["a", "d", "f", None]
    with pytest.raises(SqlError) as e:
        tokenize("é /* open *")
    assert e.value.offset == 3 and "comment" in str(e.value)


def test_only_parts_that_are_met_are_written_anew(spark, tmp_path, monkeypatch):
    from sedimenta.plans import session as module

    s = SqlSession(spark, str(tmp_path))
    s.query("CREATE TABLE t (a, _part)")
    for i in range(4):
        s.query(f"INSERT INTO t VALUES ({i}, 'x'), ({10 + i}, 'y')")
    parts = lambda: [p["path"] for p in s._state("t")[2]["parts"]]
    before = parts()
    assert s.query("UPDATE t SET _part = 5 WHERE a = 11").affected == 1 and set(parts()) & set(before) == set(before) - {before[1]}
    assert s.query("DELETE FROM t WHERE a = 99").affected == 0 and len(parts()) == 4
    assert s.query("DELETE FROM t WHERE _part = 5").affected == 1
    rows = [[i + k, v] for i in range(4) for k, v in ((0, "x"), (10, "y")) if i + k != 11]
    assert s.query("SELECT * FROM t").rows() == rows
    monkeypatch.setattr(module, "MAX_PARTS", 4)
    s.query("INSERT INTO t VALUES (1.5, NULL)")
    assert len(parts()) == 1 and s.query("SELECT * FROM t").rows() == [*rows, [1.5, None]]
