"""Typed arithmetic against Python's own exact and floating numbers."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numbers as N
from graphloom.functions import terms as T

KINDS = ("integer", "decimal", "float", "double")
TERMS = [("integer", "3"), ("integer", "-7"), ("int", "12"), ("decimal", "2.50"), ("decimal", ".125"), ("double", "1.5e1"), ("double", "INF"), ("float", "0.5"), ("integer", "0"), ("double", "0"), ("integer", "1.5"), ("string", "4"), ("decimal", "1e2"), ("double", "NaN"), ("integer", "12345678901234567890")]


def value(dt, x):
    """(rank, number) or None, as the promotion of XSD numbers has it."""
    try:
        if dt in N.INTEGERS:
            return 0, Decimal(int(x))
        if dt == "decimal" and "e" not in x:
            return 1, Decimal(x)
        if dt in ("float", "double"):
            return KINDS.index(dt), float(x.replace("INF", "inf"))
    except ValueError:
        pass
    return None


def read(term):
    if term is None:
        return None
    dt = term["dt"][len(T.XSD) :]
    return dt, (Decimal(term["value"]) if dt in ("integer", "decimal") else float(term["value"].replace("INF", "inf")))


def close(got, want):
    if got is None or want is None:
        return got is want
    (a, x), (b, y) = got, want
    return a == b and (abs(x - y) < Decimal("1e-6") if isinstance(y, Decimal) else (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y, rel=1e-6))


def test_pairs(spark):
    rows = [(i, j, ("literal", x, T.XSD + a, None), ("literal", y, T.XSD + b, None)) for i, (a, x) in enumerate(TERMS) for j, (b, y) in enumerate(TERMS)]
    term = "struct<kind:string,value:string,dt:string,lang:string>"
    pairs = spark.createDataFrame(rows, f"i int, j int, a {term}, b {term}")
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("i", "j", N.add(a, b).alias("add"), N.subtract(a, b).alias("sub"), N.multiply(a, b).alias("mul"), N.divide(a, b).alias("div"), N.less(a, b).alias("less")).collect():
        x, y = value(*TERMS[r.i]), value(*TERMS[r.j])
        if x is None or y is None:
            assert (r.add, r["sub"], r.mul, r.div, r.less) == (None,) * 5
            continue
        k = max(x[0], y[0])
        p, q = (x[1], y[1]) if k < 2 else (float(x[1]), float(y[1]))
        assert close(read(r.add), (KINDS[k], p + q)) and close(read(r["sub"]), (KINDS[k], p - q)) and r.less == (p < q), (TERMS[r.i], TERMS[r.j])
        if abs(p) < 1e15 and abs(q) < 1e15:
            assert close(read(r.mul), (KINDS[k], p * q)), (TERMS[r.i], TERMS[r.j])
        if k < 2:
            want = ("decimal", p / q) if q else None
        else:
            want = (KINDS[k], p / q if q else math.nan if p == 0 or math.isnan(p) else math.copysign(math.inf, p))
        if abs(p) < 1e15:
            assert close(read(r.div), want), (TERMS[r.i], TERMS[r.j])


def test_aggregates(spark):
    groups = {"exact": [("integer", "1"), ("decimal", "0.1"), ("decimal", "0.2")], "whole": [("integer", "2"), ("int", "5")], "wide": [("integer", "1"), ("double", "2.5e0")], "wrong": [("integer", "1"), ("string", "x")], "none": [], "nines": [("decimal", "0.1")] * 10}
    rows = [(g, ("literal", x, T.XSD + dt, None)) for g, terms in groups.items() for dt, x in terms] + [("none", None)]
    d = spark.createDataFrame(rows, "g string, v struct<kind:string,value:string,dt:string,lang:string>")
    got = {r.g: r for r in d.groupBy("g").agg(N.total(F.col("v")).alias("total"), N.mean(F.col("v")).alias("mean"), N.least(F.col("v")).alias("lo"), N.most(F.col("v")).alias("hi")).collect()}
    shown = {g: (r.total and (r.total["value"], r.total["dt"][len(T.XSD) :]), r["mean"] and (r["mean"]["value"], r["mean"]["dt"][len(T.XSD) :])) for g, r in got.items()}
    assert shown["exact"][0] == ("1.3", "decimal") and shown["whole"] == (("7", "integer"), ("3.5", "decimal")) and shown["wide"] == (("3.5", "double"), ("1.75", "double"))
    assert shown["wrong"] == (None, None) and shown["none"] == (("0", "integer"), ("0", "integer")) and shown["nines"][0] == ("1", "decimal")
    assert got["wrong"].lo["value"] == "1" and got["wide"].hi["value"] == "2.5e0" and got["exact"].lo["value"] == "0.1" and got["none"].lo is None
