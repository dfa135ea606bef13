"""Edits of individuals and concepts as a log that is applied to a layer all at once.

A log row is (seq, op, s, p, o_kind, o, o_dt, o_lang): ``add`` or ``remove`` a statement, ``delete`` all
that a node asserts so far, ``clear`` what it asserts so far of one predicate. A statement is there
afterwards if the last row that names it adds it (the layer's own statements are added first) and
no later row deletes its subject or clears its predicate. So a log of any length is three
aggregations and two joins, whatever the order its rows come in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T

COLUMNS = ["seq", "op", "s", "p", "o_kind", "o", "o_dt", "o_lang"]
_STATEMENT = ["s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]


def row(rows: DataFrame, op: str, s: str, p: Column | None = None, o: Column | None = None, o_kind: str = "iri", o_dt: Column | None = None, o_lang: Column | None = None) -> DataFrame:
    """One log row for each of ``rows``, which has the column seq; rows without an object say nothing."""
    none = F.lit(None).cast("string")
    given = lambda c: none if c is None else c.cast("string")
    out = rows.select("seq", F.lit(op).alias("op"), F.col(s).alias("s"), given(p).alias("p"), F.lit(o_kind if o is not None else None).cast("string").alias("o_kind"), given(o).alias("o"), given(o_dt).alias("o_dt"), given(o_lang).alias("o_lang"))
    return out.filter("o is not null") if o is not None else out


def created(rows: DataFrame) -> DataFrame:
    """(seq, iri, cls, label) -> log: named individuals with their class, and their label unless it is empty."""
    label = F.when(F.col("label") != "", F.col("label"))
    parts = [row(rows, "add", "iri", F.lit(T.TYPE), F.lit(T.NAMED_INDIVIDUAL)), row(rows, "add", "iri", F.lit(T.TYPE), F.col("cls")), row(rows, "add", "iri", F.lit(T.LABEL), label, "literal")]
    return reduce(DataFrame.unionByName, parts)


def replaced(rows: DataFrame, values: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """(seq, iri, columns) -> log: what a node asserts of each predicate of ``values`` becomes the
    column's value (nothing where it is null). ``kinds``: literal or iri by predicate; literal if not given.
    A row of the log at seq + 1 must not be another edit's.
    """
    later = rows.withColumn("seq", F.col("seq") + 1)
    parts = [x for p, c in values.items() for x in (row(rows, "clear", "iri", F.lit(p)), row(later, "add", "iri", F.lit(p), F.col(c), (kinds or {}).get(p, "literal")))]
    return reduce(DataFrame.unionByName, parts)


def applied(layer: DataFrame, log: DataFrame, graph_iri: str) -> DataFrame:
    """The layer's quads after a log. Rows of equal seq that name one statement: a removal wins."""
    own = layer.select(F.lit(None).cast("long").alias("seq"), F.lit(True).alias("there"), *_STATEMENT)
    named = log.filter(F.col("op").isin("add", "remove")).select(F.col("seq").cast("long").alias("seq"), (F.col("op") == "add").alias("there"), F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("iri").alias("s_kind"), *_STATEMENT[1:])
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 62))), ~F.col("there"))
    last = own.unionByName(named).groupBy(*_STATEMENT).agg(F.max(order).alias("k"), F.max_by("there", order).alias("there")).filter("there").select(*_STATEMENT, F.col("k").getField("col1").alias("at"))
    gone = log.filter("op = 'delete'").groupBy(F.col("s").alias("_s")).agg(F.max("seq").alias("_gone"))
    cleared = log.filter("op = 'clear'").groupBy(F.col("s").alias("_cs"), F.col("p").alias("_cp")).agg(F.max("seq").alias("_cleared"))
    met = last.join(gone, F.col("s") == F.col("_s"), "left").join(cleared, (F.col("s") == F.col("_cs")) & (F.col("p") == F.col("_cp")), "left")
    kept = met.filter((F.col("_gone").isNull() | (F.col("at") > F.col("_gone"))) & (F.col("_cleared").isNull() | (F.col("at") > F.col("_cleared"))))
    return kept.select(F.lit(graph_iri).alias("g"), *_STATEMENT)


def without_concepts(layer: DataFrame, concepts: DataFrame, related: str) -> DataFrame:
    """A vocabulary without ``concepts`` (iri): what they assert goes, and links of ``related`` to them."""
    gone = concepts.select(F.col("iri").alias("_i")).distinct()
    left = layer.join(gone, F.col("s") == F.col("_i"), "left_anti")
    links = left.filter((F.col("p") == related) & (F.col("o_kind") == "iri")).join(gone, F.col("o") == F.col("_i"), "left_anti")
    return left.filter(~((F.col("p") == related) & (F.col("o_kind") == "iri"))).unionByName(links)


def without_schemes(layer: DataFrame, schemes: DataFrame, in_scheme: str) -> DataFrame:
    """A vocabulary without ``schemes`` (iri) and all that their concepts assert."""
    gone = schemes.select(F.col("iri").alias("_i")).distinct()
    inside = layer.filter(F.col("p") == in_scheme).join(gone, F.col("o") == F.col("_i"), "left_semi").select(F.col("s").alias("_i"))
    return layer.join(inside.unionByName(gone).distinct(), F.col("s") == F.col("_i"), "left_anti")
