"""Relational tables as quads: a branch for each predicate of a table, no shuffle.

TBox: classes for parts, part types, customers, market segments, orders, nations and regions.
ABox: one individual for each row, typed, labelled and linked. Identifiers come from keys, so a
second mapping gives the same quads.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T

EX = "http://example.org/kg#"
TBOX, ABOX = "http://example.org/kg", "http://example.org/kg/abox"
QUAD = ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
#: Rows that a task tells apart by a table in its memory.
TASK_ROWS = 500_000
INTEGER, DECIMAL = T.XSD + "integer", T.XSD + "decimal"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in parts of about TASK_ROWS, counted first.

    Where the number of parts is left open, as many are put together as weigh little in the shuffle,
    and rows of repeating texts weigh a tenth there of what a task holds of them.
    """
    return rows.repartition(max(math.ceil(rows.count() / TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), *keys)


def iri(name: str, key: Column | None = None) -> Column:
    return F.lit(EX + name) if key is None else F.concat(F.lit(EX + name), key.cast("string"))


def to_iri(p: str, o: Column) -> Column:
    """One (predicate, object) pair whose object is an IRI."""
    return F.struct(F.lit(p).alias("p"), F.lit("iri").alias("o_kind"), o.alias("o"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def to_literal(p: str, o: Column, dt: str | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), F.lit("literal").alias("o_kind"), o.cast("string").alias("o"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))


def describe(table: DataFrame, subject: Column, graph: str, *pairs: Column) -> DataFrame:
    """Quads of one row: its subject with each (predicate, object) pair whose object is not null.

    Each pair is a branch of its own with a constant predicate, graph and kinds, so a pattern drops
    the branches that cannot match while it is planned and reads two columns of those that can.
    """
    def one(x: Column) -> DataFrame:
        parts = [x.getField(n).alias(n) for n in ("p", "o_kind", "o", "o_dt", "o_lang")]
        return table.select(F.lit(graph).alias("g"), F.lit("iri").alias("s_kind"), subject.alias("s"), *parts).filter("s is not null and o is not null")

    return reduce(DataFrame.union, map(one, pairs))


def type_iri(name: str, value: Column) -> Column:
    """A class made from a column's value."""
    return F.concat(F.lit(EX + name), T.class_local_name(value))


def to_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All quads of region, nation, customer, supplier, part and orders."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    c, type_, label = F.col, T.TYPE, T.LABEL
    parts = [
        describe(read("region"), iri("region", c("r_regionkey")), ABOX, to_iri(type_, iri("Region")), to_literal(label, c("r_name"))),
        describe(read("nation"), iri("nation", c("n_nationkey")), ABOX, to_iri(type_, iri("Nation")), to_literal(label, c("n_name")), to_iri(EX + "inRegion", iri("region", c("n_regionkey")))),
        describe(
            read("customer"), iri("customer", c("c_custkey")), ABOX, to_iri(type_, iri("Customer")), to_iri(type_, type_iri("Segment", c("c_mktsegment"))), to_literal(label, c("c_name")),
            to_iri(EX + "inNation", iri("nation", c("c_nationkey"))), to_literal(EX + "balance", c("c_acctbal"), DECIMAL),
        ),
        describe(read("supplier"), iri("supplier", c("s_suppkey")), ABOX, to_iri(type_, iri("Supplier")), to_literal(label, c("s_name")), to_iri(EX + "inNation", iri("nation", c("s_nationkey")))),
        describe(
            read("part"), iri("part", c("p_partkey")), ABOX, to_iri(type_, iri("Part")), to_iri(type_, type_iri("Type", c("p_type"))), to_literal(label, c("p_name")),
            to_literal(EX + "size", c("p_size"), INTEGER), to_literal(EX + "brand", c("p_brand")),
        ),
        describe(
            read("orders"), iri("order", c("o_orderkey")), ABOX, to_iri(type_, iri("Order")), to_iri(EX + "placedBy", iri("customer", c("o_custkey"))), to_literal(EX + "status", c("o_orderstatus")),
            to_literal(EX + "priority", c("o_orderpriority")),
        ),
    ]
    return reduce(DataFrame.union, parts)


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent) long: a binary tree over part keys, with some edges back to make cycles."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    down = part.filter("k > 1").select(F.col("k").alias("child"), F.floor(F.col("k") / 2).cast("long").alias("parent"))
    back = part.filter("k % 37 = 0").select(F.floor(F.col("k") / 4).cast("long").alias("child"), F.col("k").alias("parent")).filter("child > 0")
    return down.unionByName(back).distinct()


def to_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema layer over the parts: each part is a class below its type and its brand, with a
    property of its own; some brands are disjoint with types, some of those equivalent as well."""
    part, c = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col
    cls, type_, brand, has = iri("part", c("p_partkey")), type_iri("Type", c("p_type")), type_iri("Brand", c("p_brand")), iri("has", c("p_partkey"))
    name = F.concat(F.when(c("p_size") < 25, "ships ").otherwise("the "), c("p_name"))
    is_class, some = to_iri(T.TYPE, F.lit(T.CLASS)), lambda p, test, o: to_iri(p, F.when(test, o))
    parts = [
        describe(part, cls, TBOX, is_class, to_literal(T.LABEL, c("p_name")), to_iri(T.SUBCLASS, type_), to_iri(T.SUBCLASS, brand)),
        describe(part, type_, TBOX, is_class, to_literal(T.LABEL, c("p_type")), to_iri(T.SUBCLASS, iri("Item")), some(T.DISJOINT, c("p_size") == 11, cls)),
        describe(part, brand, TBOX, is_class, to_literal(T.LABEL, c("p_brand")), to_iri(T.SUBCLASS, iri("Make")), some(T.DISJOINT, c("p_size") == 7, type_), some(T.EQUIVALENT, (c("p_size") == 7) & (c("p_retailprice") > 950), type_)),
        describe(part, has, TBOX, to_iri(T.TYPE, F.lit(T.OBJECT_PROPERTY)), to_literal(T.LABEL, name), to_iri(T.DOMAIN, type_), to_iri(T.DOMAIN, brand), to_iri(T.RANGE, cls), some(T.RANGE, c("p_size") > 40, type_)),
    ]
    # Quads of keyed nodes are told apart in parts of about TASK_ROWS; of types and brands few are left before they meet.
    keyed, named = parts[0].unionByName(parts[3]), parts[1].unionByName(parts[2])
    n = max(math.ceil(10 * part.count() / TASK_ROWS), spark.sparkContext.defaultParallelism)
    return keyed.repartition(n, "s").distinct().unionByName(named.distinct())


def to_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance layer over the schema: each line item is typed by its part's class and has a fact
    of the property of another part, with the line before it as value."""
    c, whole = F.col, F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*[F.when(whole, c(k)).alias(k) for k in ("l_orderkey", "l_linenumber")], "l_partkey", "l_suppkey")
    parts = max(math.ceil(line.count() / TASK_ROWS), spark.sparkContext.defaultParallelism)
    # Keys, a fraction of the quads' bytes, say which quads repeat; a task meets about TASK_ROWS of them.
    once = lambda key: line.select("l_orderkey", "l_linenumber", key).repartition(parts, "l_orderkey", "l_linenumber").distinct()
    subject = F.concat(F.lit(EX + "line"), c("l_orderkey"), F.lit("_"), c("l_linenumber"))
    last = F.concat(F.lit(EX + "line"), c("l_orderkey"), F.lit("_"), c("l_linenumber") - 1)
    facts = once("l_suppkey").select(subject.alias("s"), F.concat(F.lit(EX + "has"), c("l_suppkey")).alias("p"), last.alias("o"))
    nothing = F.lit(None).cast("string")
    links = facts.select(F.lit(ABOX).alias("g"), F.lit("iri").alias("s_kind"), "s", "p", F.lit("iri").alias("o_kind"), "o", nothing.alias("o_dt"), nothing.alias("o_lang"))
    return describe(once("l_partkey"), subject, ABOX, to_iri(T.TYPE, iri("part", c("l_partkey")))).unionByName(links)
