"""Conflict rules over a schema layer; each rule is a plan that gives rows of one shape.

(signature, ctype, severity, entities): entities are sorted IRIs. A view of the schema comes
first: one scan of the layer, split by predicate.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import graph
from graphloom.plans.shared import cut

#: A new conflict's similarity from which two labels are candidates.
STRING_THRESHOLD, VECTOR_THRESHOLD = 0.86, 0.75
#: Stems that say nothing about a property.
EMPTY_STEMS = ("be", "is", "are", "was", "were", "has", "have", "had", "with")


@dataclass
class Schema:
    """The pieces of a layer that the rules read."""

    classes: DataFrame  # (iri, label)
    properties: DataFrame  # (iri, label, kind)
    subclass: DataFrame  # (child, parent)
    disjoint: DataFrame  # (a, b)
    equivalent: DataFrame  # (a, b)
    domains: DataFrame  # (iri, value)
    ranges: DataFrame  # (iri, value)


def schema_of(quads: DataFrame) -> Schema:
    """Reads a layer. First label of a node in order wins; a node without label takes its local name."""
    pair = lambda p, a, b: quads.filter((F.col("p") == p) & F.col("o_kind").isin("iri", "bnode")).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
    labels = quads.filter((F.col("p") == T.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("l_iri")).agg(F.min("o").alias("label"))

    def named(kind: Column) -> DataFrame:
        nodes = quads.filter((F.col("p") == T.TYPE) & kind & (F.col("s_kind") == "iri")).select(F.col("s").alias("iri"), F.col("o").alias("kind")).distinct()
        joined = nodes.join(labels, nodes["iri"] == labels["l_iri"], "left")
        return joined.select("iri", F.coalesce("label", T.local_name(F.col("iri"))).alias("label"), "kind")

    properties = named(F.col("o").isin(T.OBJECT_PROPERTY, T.DATA_PROPERTY))
    return Schema(
        named(F.col("o") == T.CLASS).drop("kind"),
        properties.select("iri", "label", F.when(F.col("kind") == T.OBJECT_PROPERTY, "object").otherwise("data").alias("kind")),
        pair(T.SUBCLASS, "child", "parent"), pair(T.DISJOINT, "a", "b"), pair(T.EQUIVALENT, "a", "b"), pair(T.DOMAIN, "iri", "value"), pair(T.RANGE, "iri", "value"),
    )


def _row(ctype: str, severity: str, entities: Column, *signature: Column) -> list[Column]:
    return [F.concat_ws("|", F.lit(ctype), *signature).alias("signature"), F.lit(ctype).alias("ctype"), F.lit(severity).alias("severity"), F.array_sort(entities).alias("entities")]


def subclass_cycles(schema: Schema) -> DataFrame:
    """One conflict for each cycle that holds a declared class."""
    found = graph.cycles(schema.subclass)
    declared = found.join(schema.classes, found["node"] == schema.classes["iri"], "left_semi").select("root").distinct()
    members = found.join(declared, "root", "left_semi").groupBy("root").agg(F.collect_list("node").alias("m"))
    return members.select(*_row("cycle", "error", F.col("m"), graph.ordered_members(F.col("m"))))


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def disjoint_subclasses(schema: Schema, up: DataFrame) -> DataFrame:
    """Two disjoint classes of which one is an ancestor of the other; of both directions one conflict."""
    pairs = schema.disjoint.filter("a <> b")
    hit = up.join(pairs, ((up["node"] == pairs["a"]) & (up["anc"] == pairs["b"]))).select("a", "b").unionByName(
        up.join(pairs, ((up["node"] == pairs["b"]) & (up["anc"] == pairs["a"]))).select("a", "b")
    )
    low, high = _ordered(F.col("a"), F.col("b"))
    return hit.select(low.alias("a"), high.alias("b")).distinct().select(*_row("disjoint_subclass", "error", F.array("a", "b"), F.col("a"), F.col("b")))


def disjoint_common(schema: Schema, up: DataFrame) -> DataFrame:
    """A class below two disjoint classes, itself none of them."""
    low, high = _ordered(F.col("a"), F.col("b"))
    pairs = schema.disjoint.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("anc")).unionByName(pairs.select(F.col("b").alias("anc"))).distinct()
    sets = up.join(ends, "anc", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("anc")).alias("has"))
    both = graph.pairs_held(sets, pairs).filter("node <> a and node <> b")
    return both.distinct().select(*_row("disjoint_common", "error", F.array("node", "a", "b"), F.col("node"), F.col("a"), F.col("b")))


def equivalent_disjoint(schema: Schema) -> DataFrame:
    """A pair asserted equivalent and, in the same order, disjoint."""
    both = schema.equivalent.join(schema.disjoint, ["a", "b"], "left_semi")
    return both.distinct().select(*_row("equiv_disjoint", "error", F.array("a", "b"), graph.ordered_members(F.array("a", "b"))))


def multiple_values(values: DataFrame, up: DataFrame, ctype: str) -> DataFrame:
    """Properties with two or more domains (ranges) after dropping those that are ancestors of another."""
    own = values.distinct()
    other = own.select(F.col("iri").alias("o_iri"), F.col("value").alias("o_value"))
    wide = own.join(other, F.col("iri") == F.col("o_iri")).filter("value <> o_value").join(up, (F.col("o_value") == up["node"]) & (F.col("value") == up["anc"]), "left_semi").select("iri", "value").distinct()
    left = own.join(wide, ["iri", "value"], "left_anti").groupBy("iri").agg(F.collect_list("value").alias("m")).filter(F.size("m") >= 2)
    return left.select(*_row(ctype, "warning", F.concat(F.array("iri"), F.col("m")), F.col("iri")))


def predicate_specialization(schema: Schema) -> DataFrame:
    """Object properties whose labels are a common stem followed by their range's label."""
    labels = schema.classes.select(F.col("iri").alias("value"), T.norm_label(F.col("label")).alias("suffix"))
    props = schema.properties.filter("kind = 'object'").select("iri", T.norm_label(F.col("label")).alias("norm"))
    pairs = props.join(schema.ranges, "iri").join(labels, "value")
    latin = F.when(F.endswith("norm", F.concat(F.lit(" "), F.col("suffix"))), F.substring("norm", F.lit(1), F.length("norm") - F.length("suffix") - 1))
    letters = F.concat("norm", "suffix").rlike("[A-Za-z]")
    cjk = F.when(~letters & F.endswith("norm", F.col("suffix")) & (F.length("norm") - F.length("suffix") >= 2), F.substring("norm", F.lit(1), F.length("norm") - F.length("suffix")))
    stems = pairs.withColumn("stem", F.coalesce(latin, cjk)).filter("suffix <> '' and stem is not null and stem <> ''").filter(~F.col("stem").isin(*EMPTY_STEMS))
    best = stems.groupBy("iri").agg(F.min_by("stem", F.struct(F.length("stem"), F.col("stem"))).alias("stem"))  # the longest suffix leaves the shortest stem
    family = best.groupBy("stem").agg(F.collect_list("iri").alias("m")).filter(F.size("m") >= 2)
    row = _row("predicate_specialization", "warning", F.col("m"))
    return family.select(F.concat_ws("|", F.lit("predspec"), "stem", graph.ordered_members(F.col("m"))).alias("signature"), *row[1:])


def detect(quads: DataFrame) -> DataFrame:
    """All structural conflicts of a layer, errors before warnings when sorted by ``rank``."""
    schema = schema_of(quads)
    up = cut(graph.ancestors(schema.subclass))
    rules = [
        subclass_cycles(schema), disjoint_subclasses(schema, up), disjoint_common(schema, up), equivalent_disjoint(schema),
        multiple_values(schema.domains, up, "domain_multi"), multiple_values(schema.ranges, up, "range_multi"), predicate_specialization(schema),
    ]
    return reduce(DataFrame.unionByName, rules).withColumn("rank", F.when(F.col("severity") == "error", 0).otherwise(1))


def synced(known: DataFrame, found: DataFrame) -> DataFrame:
    """(signature, status) and (signature, ...) -> signature, status, change.

    New conflicts open; dismissed ones stay dismissed; open ones that are gone clear; cleared ones
    that are back open again. One full outer join.
    """
    old, new = known.select("signature", F.col("status").alias("old")), found.select("signature", F.lit(True).alias("there")).distinct()
    both = old.join(new, "signature", "full_outer")
    there = F.col("there").isNotNull()
    status = F.when(~there, F.when(F.col("old") == "open", "cleared").otherwise(F.col("old"))).otherwise(F.when(F.col("old") == "dismissed", "dismissed").otherwise("open"))
    change = (
        F.when(F.col("old").isNull(), "new").when(there & (F.col("old") == "cleared"), "reopened").when(~there & (F.col("old") == "open"), "auto_cleared").otherwise("kept")
    )
    return both.select("signature", status.alias("status"), change.alias("change"))


def evidence(conflicts: DataFrame, provenance: DataFrame) -> DataFrame:
    """(signature, entities), (axiom_key, chunk_id, ...) -> (signature, axiom_key, chunk_id, rank).

    Keys hold their IRIs between bars, so the containment join is an equi-join on the IRIs: rank 0
    where the key holds all of a conflict's entities, 1 where it holds some.
    """
    named = conflicts.select("signature", "entities", F.explode("entities").alias("entity"))
    parts = provenance.select("axiom_key", "chunk_id", F.explode(F.array_distinct(F.split("axiom_key", r"\|"))).alias("entity"))
    hits = named.join(parts, "entity").groupBy("signature", "axiom_key", "chunk_id").agg(F.countDistinct("entity").alias("n"), F.first(F.size(F.array_distinct("entities"))).alias("of"))
    return hits.select("signature", "axiom_key", "chunk_id", F.when(F.col("n") == F.col("of"), 0).otherwise(1).alias("rank"))


def routed(advice: DataFrame, floor: float = 0.85) -> DataFrame:
    """(signature, resolution, confidence) -> adds route: 'apply' from ``floor`` on, else 'recommend'."""
    sure = F.coalesce(T.clamp_confidence(F.col("confidence")) >= floor, F.lit(False))
    first = F.row_number().over(Window.partitionBy("signature").orderBy(F.col("confidence").desc_nulls_last(), "resolution"))
    return advice.withColumn("route", F.when(sure, "apply").otherwise("recommend")).withColumn("_n", first).filter("_n = 1").drop("_n")
