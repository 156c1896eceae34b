"""Statements over a DataFrame: names and kinds are resolved here, Catalyst does the rest.

A column's kind follows its Spark type: whole numbers are int, floats are float, strings are
text. A column of mixed kinds is a struct (k, i, d, s) with the kind's name in k. Spark must
never coerce for a comparison: text against a number is false, not a cast.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.plans.dialect import Filter, Literal, Predicate, Select, SqlError

ROW_ID = "_row_id"
MIXED = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
    ]
)

_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.StringType):
        return "text"
    if kind == MIXED:
        return "mixed"
    return "other"


def resolve(df: DataFrame, name: str) -> str:
    """The schema's spelling of a column that is named without regard to ASCII case."""
    for c in df.columns:
        if c != ROW_ID and c.lower() == name.lower():
            return c
    raise SqlError(f"no such column: {name}")


def _numeric(op: str, c: Column, lit: Literal, exact: bool) -> Column:
    """A comparison with a number: whole numbers exactly, else as doubles; NaN compares with nothing.

    Spark takes NaN as the largest number, so only some comparisons need a guard.
    """
    if exact and lit.kind == "int":
        return _OPS[op](c, F.lit(lit.value).cast("long"))
    d = c.cast("double")
    found = _OPS[op](d, F.lit(float(lit.value)))
    return found & ~F.isnan(d) if op in ("<>", ">", ">=") else found


def predicate(df: DataFrame, p: Predicate) -> Column:
    """Never null: a comparison that doesn't hold is false."""
    return F.coalesce(comparison(df, p), F.lit(False))


def comparison(df: DataFrame, p: Predicate) -> Column:
    """True where the predicate holds, else false or null; in this form it reaches the scan."""
    name = resolve(df, p.column)
    c, kind, lit = F.col(f"`{name}`"), kind_of(df.schema[name].dataType), p.literal
    if lit.kind == "null":
        if p.op == "=":
            return c.isNull()
        return c.isNotNull() if p.op == "<>" else F.lit(False)
    number = lit.kind in ("int", "float")
    if kind == "mixed":
        if not number:
            found = (c["k"] == "text") & _OPS[p.op](c["s"], F.lit(lit.value))
        elif lit.kind == "int":
            found = ((c["k"] == "int") & _numeric(p.op, c["i"], lit, True)) | ((c["k"] == "float") & _numeric(p.op, c["d"], lit, False))
        else:
            found = _numeric(p.op, F.coalesce(c["d"], c["i"].cast("double")), lit, False)
    elif kind in ("int", "float") and number:
        found = _numeric(p.op, c, lit, kind == "int")
    elif kind == "text" and not number:
        found = _OPS[p.op](c, F.lit(lit.value))
    else:
        return F.lit(False)
    return found


def condition(df: DataFrame, where: Filter | None, total: bool = True) -> Column | None:
    """The condition of a WHERE; ``total`` if it is negated or shown and so may not be null."""
    if where is None:
        return None
    parts = [(predicate if total else comparison)(df, p) for p in where.parts]
    return reduce(operator.and_ if where.joiner == "and" else operator.or_, parts)


def _keys(df: DataFrame, name: str, descending: bool) -> list[Column]:
    """Sort keys of one column: numbers before text before null, in both directions."""
    c, kind = F.col(f"`{name}`"), kind_of(df.schema[name].dataType)
    down = lambda x: x.desc_nulls_last() if descending else x.asc_nulls_last()
    if kind == "mixed":
        rank = F.when(c["k"].isin("int", "float"), 0).when(c["k"] == "text", 1)
        return [rank.asc_nulls_last(), down(F.coalesce(c["d"], c["i"].cast("double"))), down(c["s"])]
    return [down(c)]


def select(df: DataFrame, s: Select) -> DataFrame:
    """The plan of a SELECT. With a row id, ties and an unordered LIMIT follow insertion order."""
    columns = [resolve(df, c) for c in s.columns] or [c for c in df.columns if c != ROW_ID]
    where = condition(df, s.where, total=False)
    order = resolve(df, s.order_by) if s.order_by else None
    out = df if where is None else df.filter(where)
    ties = [F.col(ROW_ID).asc()] if ROW_ID in df.columns else []
    keys = (_keys(df, order, s.descending) if order else []) + ties
    if keys:
        out = out.orderBy(*keys)
    if s.limit is not None:
        out = out.limit(s.limit)
    return out.select(*[F.col(f"`{c}`") for c in columns])
