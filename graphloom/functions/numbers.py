"""Arithmetic and aggregates of typed literals, by the promotion of XSD numbers.

A term is the struct (kind, value, dt, lang). Integers and what derives from them, decimals, floats
and doubles are numbers; two of them meet in the wider of their types (integers divided make a
decimal). Integers and decimals are exact: DIGITS digits, SCALE of them behind the point (products
and quotients keep at least six there); what needs more, and what is no number or has no valid
lexical form, is an error, which is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms as T

DIGITS, SCALE = 37, 12
EXACT = f"decimal({DIGITS},{SCALE})"
#: Types that derive from integer.
INTEGERS = (
    "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
)
INTEGER, DECIMAL, FLOAT, DOUBLE = range(4)
NAMES = ("integer", "decimal", "float", "double")


def rank(term: Column) -> Column:
    """0 to 3 for an integer, decimal, float or double with a valid lexical form; else null."""
    dt, x = term["dt"], F.trim(term["value"])
    whole = dt.isin(*[T.XSD + n for n in INTEGERS]) & x.rlike(f"^(?:{T.XSD_INTEGER})$")
    point = (dt == T.XSD + "decimal") & x.rlike(f"^(?:{T.XSD_DECIMAL})$")
    wide = x.rlike(f"^(?:{T.XSD_DOUBLE}|[+-]?INF|NaN)$")
    kind = F.when(whole, INTEGER).when(point, DECIMAL).when((dt == T.XSD + "float") & wide, FLOAT).when((dt == T.XSD + "double") & wide, DOUBLE)
    return F.when(term["kind"] == "literal", kind)


def _double(term: Column) -> Column:
    x = F.trim(term["value"])
    value = F.when(x.rlike("^[+]?INF$"), F.lit(float("inf"))).when(x == "-INF", F.lit(float("-inf"))).when(x == "NaN", F.lit(float("nan"))).otherwise(x.try_cast("double"))
    return F.when(term["dt"] == T.XSD + "float", value.cast("float").cast("double")).otherwise(value)


def _exact(term: Column) -> Column:
    return F.trim(term["value"]).try_cast(EXACT)


def literal(value: Column, kind: Column) -> Column:
    """A typed literal of a lexical form and a rank; null where either is."""
    none = F.lit(None).cast("string")
    dt = F.concat(F.lit(T.XSD), F.get(F.array(*[F.lit(n) for n in NAMES]), kind))
    return F.when(value.isNotNull() & kind.isNotNull(), F.struct(F.lit("literal").alias("kind"), value.alias("value"), dt.alias("dt"), none.alias("lang")))


def _of_exact(x: Column) -> Column:
    """The shortest lexical form of an exact number."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _of_double(x: Column) -> Column:
    shown = F.when(F.isnan(x), "NaN").when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise(x.cast("string"))
    return F.when(x.isNotNull(), shown)


def _wide(x: Column, kind: Column) -> Column:
    return _of_double(F.when(kind == FLOAT, x.cast("float").cast("double")).otherwise(x))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _read(term: Column) -> Column:
    return F.struct(rank(term).alias("rank"), _exact(term).alias("exact"), _double(term).alias("wide"))


def _both(a: Column, b: Column, exact, wide, least: int = INTEGER) -> Column:
    def met(x: Column) -> Column:
        kind = F.greatest(x["a"]["rank"], x["b"]["rank"], F.lit(least))
        value = F.when(kind <= DECIMAL, _of_exact(exact(x["a"]["exact"], x["b"]["exact"]).try_cast(EXACT))).otherwise(_wide(wide(x["a"]["wide"], x["b"]["wide"]), kind))
        return F.when(x["a"]["rank"].isNotNull() & x["b"]["rank"].isNotNull(), F.struct(value.alias("value"), kind.alias("kind")))

    return _once(_once(F.struct(_read(a).alias("a"), _read(b).alias("b")), met), lambda x: literal(x["value"], x["kind"]))


def add(a: Column, b: Column) -> Column:
    return _both(a, b, F.try_add, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return _both(a, b, F.try_subtract, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return _both(a, b, F.try_multiply, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Exact numbers give a decimal, an error by zero; doubles divide as IEEE has it."""

    def ieee(x: Column, y: Column) -> Column:
        by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * float("inf"))
        return F.when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))

    return _both(a, b, F.try_divide, ieee, DECIMAL)


def less(a: Column, b: Column) -> Column:
    """a < b by value; null where one is no number."""

    def met(x: Column) -> Column:
        exact = F.greatest(x["a"]["rank"], x["b"]["rank"]) <= DECIMAL
        p, q = x["a"]["wide"], x["b"]["wide"]
        told = F.when(exact, x["a"]["exact"] < x["b"]["exact"]).otherwise(~F.isnan(p) & ~F.isnan(q) & (p < q))
        return F.when(x["a"]["rank"].isNotNull() & x["b"]["rank"].isNotNull(), told)

    return _once(F.struct(_read(a).alias("a"), _read(b).alias("b")), met)


def _order(term: Column) -> Column:
    return F.struct(_double(term), _exact(term), term["value"])


def total(term: Column) -> Column:
    """SUM: the terms' sum in their widest type; an error if a term is bound and no number; 0 of nothing."""
    kind = F.coalesce(F.max(rank(term)), F.lit(INTEGER))
    wrong = F.count(F.when(term.isNotNull() & rank(term).isNull(), 1)) > 0
    value = F.when(kind <= DECIMAL, _of_exact(F.coalesce(F.try_sum(_exact(term)), F.lit(0)).try_cast(EXACT))).otherwise(_wide(F.sum(_double(term)), kind))
    return F.when(~wrong, literal(value, kind))


def mean(term: Column) -> Column:
    """AVG: at least a decimal; 0 of nothing."""
    n, kind = F.count(term), F.greatest(F.max(rank(term)), F.lit(DECIMAL))
    wrong = F.count(F.when(term.isNotNull() & rank(term).isNull(), 1)) > 0
    exact = F.try_divide(F.try_sum(_exact(term)), n.cast("decimal(18,0)")).try_cast(EXACT)
    value = F.when(kind <= DECIMAL, _of_exact(exact)).otherwise(_wide(F.sum(_double(term)) / F.when(n > 0, n), kind))
    return F.when(n == 0, literal(F.lit("0"), F.lit(INTEGER))).when(~wrong, literal(value, kind))


def least(term: Column) -> Column:
    """MIN of the terms that are numbers, as the term it is."""
    return F.min_by(term, F.when(rank(term).isNotNull(), _order(term)))


def most(term: Column) -> Column:
    return F.max_by(term, F.when(rank(term).isNotNull(), _order(term)))
