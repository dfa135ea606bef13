"""Queries of the algebra over solutions with unbound variables and typed numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import numbers as N
from graphloom.functions import terms as T
from graphloom.operators import algebra as A
from graphloom.plans.catalog import query, read
from graphloom.sources import mapping
from graphloom.sources.mapping import EX


def _triples(spark, sf_dir) -> DataFrame:
    return mapping.to_quads(spark, sf_dir).drop("g")


def _orders(t: DataFrame, order: str, where_status, where_priority=None) -> DataFrame:
    """Orders with their customer; status ?v and priority ?w are bound where the tests hold."""
    out = A.optional(A.pattern(t, f"?{order}", EX + "placedBy", "?c"), A.pattern(t, f"?{order}", EX + "status", "?v"), where=lambda v: where_status(v("v")["value"]))
    if where_priority is None:
        return out
    return A.optional(out, A.pattern(t, f"?{order}", EX + "priority", "?w"), where=lambda v: where_priority(v("w")["value"]))


_SIDES = (
    f"WITH a AS (SELECT '{EX}order' || o_orderkey AS o, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS v, CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS w FROM orders),"
    f" b AS (SELECT '{EX}order' || o_orderkey AS q, o_custkey AS c, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS v, CASE WHEN o_orderpriority > '1-V' THEN o_orderpriority END AS w FROM orders"
    " WHERE o_orderkey % 4 = 0)"
)
_SAME = "(a.v = b.v OR a.v IS NULL OR b.v IS NULL) AND (a.w = b.w OR a.w IS NULL OR b.w IS NULL)"


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = _triples(spark, sf_dir)
    a = _orders(t, "o", lambda v: v == "F", lambda w: w < "3")
    b = _orders(t, "q", lambda v: v != "P", lambda w: w > "1-V")
    every_fourth = F.substring(F.col("q")["value"], len(EX + "order") + 1, 20).try_cast("long") % 4 == 0
    return a, b.filter(every_fourth)


@query(f"{_SIDES} SELECT o, q, '{EX}customer' || a.c AS c, coalesce(a.v, b.v) AS v, coalesce(a.w, b.w) AS w FROM a JOIN b ON a.c = b.c AND {_SAME}")
def join_unbound(spark, sf_dir):
    """Two variables that may be unbound on either side, beside one that is always bound."""
    return A.projected(A.join(*_sides(spark, sf_dir)), "o", "q", "c", "v", "w")


@query(f"{_SIDES} SELECT o, q, '{EX}customer' || a.c AS c, coalesce(a.v, b.v) AS v, coalesce(a.w, b.w) AS w FROM a LEFT JOIN b ON a.c = b.c AND {_SAME} AND o < q")
def optional_unbound(spark, sf_dir):
    """OPTIONAL with its own filter, where both sides leave variables unbound."""
    a, b = _sides(spark, sf_dir)
    return A.projected(A.optional(a, b, where=lambda v: v("o")["value"] < v("q")["value"]), "o", "q", "c", "v", "w")


_KINDS = f"{_SIDES}, k AS (SELECT DISTINCT v, w FROM b WHERE c % 25 = 7 AND (v IS NULL OR w IS NULL OR w > '4'))"


def _kinds(b: DataFrame) -> DataFrame:
    """What some customers' orders have as status and priority: no variable is always bound."""
    of = F.substring(F.col("c")["value"], len(EX + "customer") + 1, 20).try_cast("long") % 25 == 7
    return b.filter(of & (F.col("v").isNull() | F.col("w").isNull() | (F.col("w")["value"] > "4"))).select("v", "w").distinct()


@query(
    f"{_KINDS} SELECT o, v, w FROM a WHERE NOT EXISTS (SELECT 1 FROM k AS b WHERE {_SAME} AND ((a.v IS NOT NULL AND b.v IS NOT NULL) OR (a.w IS NOT NULL AND b.w IS NOT NULL)))"
)
def minus_unbound(spark, sf_dir):
    """MINUS takes away by compatible solutions that have a variable bound in common."""
    a, b = _sides(spark, sf_dir)
    return A.projected(A.minus(a.select("o", "v", "w"), _kinds(b)), "o", "v", "w")


@query(f"{_KINDS} SELECT o, v, w FROM a WHERE NOT EXISTS (SELECT 1 FROM k AS b WHERE {_SAME} AND b.v IS NOT NULL AND b.w IS NOT NULL)")
def not_exists_unbound(spark, sf_dir):
    """NOT EXISTS takes away by any compatible solution, with or without a variable in common."""
    a, b = _sides(spark, sf_dir)
    return A.projected(A.not_exists(a.select("o", "v", "w"), _kinds(b).filter("v is not null and w is not null")), "o", "v", "w")


# Typed numbers: integers, decimals and doubles in one column.
_NUMBERS = (
    "WITH n AS (SELECT o_custkey AS g, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'decimal' ELSE CASE WHEN o_custkey % 5 = 0 THEN 'double' ELSE 'decimal' END END AS t,"
    " CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::DECIMAL(38,12) ELSE round(o_totalprice, 2)::DECIMAL(18,2)::DECIMAL(38,12) END AS v FROM orders)"
)


def _shortest(x: str) -> str:
    return rf"regexp_replace(regexp_replace(({x})::VARCHAR, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


def _numbers(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    price = F.round("o_totalprice", 2).cast("decimal(18,2)")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "integer").when((F.col("o_orderkey") % 3 == 2) & (F.col("o_custkey") % 5 == 0), "double").otherwise("decimal")
    text = F.when(kind == "integer", F.col("o_orderkey").cast("string")).when(kind == "double", F.concat(price.cast("string"), F.lit("E0"))).otherwise(price.cast("string"))
    term = F.struct(F.lit("literal").alias("kind"), text.alias("value"), F.concat(F.lit(T.XSD), kind).alias("dt"), F.lit(None).cast("string").alias("lang"))
    return o.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), term.alias("v"))


def _plain(c: str):
    """A typed literal as type and value; doubles with nine digits, since their sums depend on the order."""
    dt = F.element_at(F.split(F.col(c)["dt"], "#"), -1)
    return [dt.alias(f"{c}_type"), F.when(dt == "double", F.format_string("%.9e", F.col(c)["value"].cast("double"))).otherwise(F.col(c)["value"]).alias(c)]


_WIDEST = "CASE WHEN bool_or(t = 'double') THEN 'double' WHEN bool_or(t = 'decimal') THEN 'decimal' ELSE 'integer' END"


@query(
    f"{_NUMBERS}, a AS (SELECT g, {_WIDEST} AS total_type, sum(v) AS s, count(*) AS n, arg_min({_shortest('v')}, (v, t)) AS lo, arg_max({_shortest('v')}, (v, t)) AS hi FROM n GROUP BY g)"
    f" SELECT g, total_type, CASE WHEN total_type = 'double' THEN printf('%.9e', s::DOUBLE) ELSE {_shortest('s')} END AS total, lo, hi FROM a"
)
def typed_sums(spark, sf_dir):
    """SUM, MIN and MAX over mixed numbers: exact while no double is among them, in the widest type."""
    out = _numbers(spark, sf_dir).groupBy("g").agg(N.total(F.col("v")).alias("total"), N.least(F.col("v")).alias("lo"), N.most(F.col("v")).alias("hi"))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c)["value"], "E0$", ""), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "").alias(c)
    return out.select("g", *_plain("total"), bare("lo"), bare("hi"))


@query(
    f"{_NUMBERS}, p AS (SELECT x.k, greatest(x.t, y.t) AS t, x.v AS a, y.v AS b, x.t AS tx, y.t AS ty FROM n x JOIN n y ON y.k = x.k + 1), w AS (SELECT k, a, b, CASE WHEN 'double' IN (tx, ty) THEN 'double' WHEN 'decimal' IN (tx, ty) THEN 'decimal' ELSE 'integer' END AS t FROM p)"
    f" SELECT k, t AS plus_type, CASE WHEN t = 'double' THEN printf('%.9e', a::DOUBLE + b::DOUBLE) ELSE {_shortest('a + b')} END AS plus, CASE WHEN t = 'double' THEN 'double' ELSE 'decimal' END AS part_type,"
    f" CASE WHEN t = 'double' THEN printf('%.9e', a::DOUBLE / b::DOUBLE) ELSE {_shortest('((round(a * 100)::HUGEINT * 2000000 + round(b * 100)::HUGEINT) // (2 * round(b * 100)::HUGEINT))::DECIMAL(30,0) * 0.000001::DECIMAL(7,6)')} END AS part, a < b AS less FROM w"
)
def typed_arithmetic(spark, sf_dir):
    """+, / and < of neighbours of mixed types."""
    n = _numbers(spark, sf_dir)
    both = n.select("k", F.col("v").alias("a")).join(n.select((F.col("k") - 1).alias("k"), F.col("v").alias("b")), "k")
    out = both.select("k", N.add(F.col("a"), F.col("b")).alias("plus"), N.divide(F.col("a"), F.col("b")).alias("part"), N.less(F.col("a"), F.col("b")).alias("less"))
    return out.select("k", *_plain("plus"), *_plain("part"), "less")
