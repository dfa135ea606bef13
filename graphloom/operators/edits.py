"""Edits of a graph layer as rewrites of its quads; each gives the layer after the edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import graph
from graphloom.operators.store import insert
from graphloom.sources.mapping import QUAD


def quad(graph_iri: str, s: Column, p: str, o: Column, literal: bool = False, dt: str | None = None) -> list[Column]:
    """Columns of one quad with an IRI subject."""
    return [
        F.lit(graph_iri).alias("g"), F.lit("iri").alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), F.lit("literal" if literal else "iri").alias("o_kind"), o.alias("o"),
        F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    ]


def add_classes(quads: DataFrame, graph_iri: str, base: str, labels: DataFrame) -> DataFrame:
    """(label) as classes whose IRIs come from their labels; what is there stays."""
    iri = F.concat(F.lit(base), T.class_local_name(F.col("label")))
    new = labels.filter(T.norm_label(F.col("label")) != "")
    return insert(quads, new.select(*quad(graph_iri, iri, T.TYPE, F.lit(T.CLASS))).unionByName(new.select(*quad(graph_iri, iri, T.LABEL, F.col("label"), True))))


def add_axioms(quads: DataFrame, graph_iri: str, predicate: str, pairs: DataFrame) -> DataFrame:
    """(a, b) as axioms; an axiom of a node with itself is ignored."""
    return insert(quads, pairs.filter("a <> b").select(*quad(graph_iri, F.col("a"), predicate, F.col("b"))))


def delete_axioms(quads: DataFrame, predicate: str, pairs: DataFrame) -> DataFrame:
    """Without the axioms (a, b); disjointness and equivalence go both ways round."""
    gone = pairs.select("a", "b")
    if predicate in (T.DISJOINT, T.EQUIVALENT):
        gone = gone.unionByName(gone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hit = (F.col("p") == predicate) & (F.col("s") == F.col("a")) & (F.col("o") == F.col("b"))
    return quads.join(gone.distinct(), hit, "left_anti")


def delete_nodes(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the quads that have one of ``nodes`` (iri) as subject or object."""
    n = nodes.select("iri").distinct()
    return quads.join(n, quads["s"] == n["iri"], "left_anti").join(n, (quads["o_kind"] != "literal") & (quads["o"] == n["iri"]), "left_anti")


def cascade_classes(abox: DataFrame, nodes: DataFrame) -> DataFrame:
    """An instance layer after its classes ``nodes`` (iri) are deleted.

    An individual loses the type; one that has no other type left goes with all it asserts. What
    others assert about it stays.
    """
    gone = nodes.select("iri").distinct()
    typed = abox.filter((F.col("p") == T.TYPE) & (F.col("o") != T.NAMED_INDIVIDUAL)).select("s", "o").distinct()
    marked = typed.join(gone.withColumn("_hit", F.lit(1)), F.col("o") == F.col("iri"), "left")
    dead = marked.groupBy("s").agg(F.count("_hit").alias("hit"), F.count(F.lit(1)).alias("n")).filter("hit > 0 and hit = n").select(F.col("s").alias("d"))
    kept = abox.join(dead, abox["s"] == dead["d"], "left_anti")
    return kept.join(gone, (F.col("p") == T.TYPE) & (F.col("o") == F.col("iri")), "left_anti")


def drop_properties(quads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without the properties ``nodes`` (iri): their own quads and every use as predicate."""
    n = nodes.select("iri").distinct()
    return delete_nodes(quads, n).join(n, F.col("p") == F.col("iri"), "left_anti")


def _renamed(quads: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """IRIs in ``columns`` replaced by names' (src -> tgt); literals stay."""
    out = quads
    for c in columns:
        side = names.select(F.col("src").alias("_src"), F.col("tgt").alias("_tgt"))
        on = F.col(c) == F.col("_src") if c != "o" else (F.col("o") == F.col("_src")) & (F.col("o_kind") == "iri")
        out = out.join(side, on, "left").withColumn(c, F.coalesce("_tgt", c)).drop("_src", "_tgt")
    return out.select(QUAD)


def merge_classes(quads: DataFrame, names: DataFrame) -> DataFrame:
    """Classes renamed by (src, tgt), one row for each src: sources lose type and label, axioms and
    individuals move to the target, links of the target to itself go."""
    src = names.select(F.col("src").alias("_x"))
    kept = quads.join(src, F.col("p").isin(T.TYPE, T.LABEL, T.COMMENT) & (F.col("s") == F.col("_x")), "left_anti")
    moved = _renamed(kept, names, "s", "o")
    own = F.col("p").isin(T.SUBCLASS, T.DISJOINT, T.EQUIVALENT) & (F.col("s") == F.col("o"))
    return moved.filter(~own).distinct()


def merge_properties(quads: DataFrame, names: DataFrame) -> DataFrame:
    """Properties renamed by (src, tgt) as predicates and in their slots; sources lose type and label."""
    src = names.select(F.col("src").alias("_x"))
    kept = quads.join(src, F.col("p").isin(T.TYPE, T.LABEL, T.COMMENT) & (F.col("s") == F.col("_x")), "left_anti")
    moved = _renamed(kept, names, "s", "p", "o")
    return moved.filter(~((F.col("p") == T.RDFS + "subPropertyOf") & (F.col("s") == F.col("o")))).distinct()


def subordinate_properties(quads: DataFrame, graph_iri: str, names: DataFrame) -> DataFrame:
    """Properties (src, tgt) as sub-properties; the target's slots take in those of its sources."""
    below = names.filter("src <> tgt").select(*quad(graph_iri, F.col("src"), T.RDFS + "subPropertyOf", F.col("tgt")))
    slots = quads.filter(F.col("p").isin(T.DOMAIN, T.RANGE)).join(names, F.col("s") == F.col("src")).withColumn("s", F.col("tgt")).select(QUAD)
    return insert(insert(quads, below), slots)


def set_union(quads: DataFrame, graph_iri: str, prop: str, slot: str, members: list[str]) -> DataFrame:
    """The slot's value becomes the union of two members or more, written as a linked list."""
    names = sorted(set(members))
    if len(names) < 2:
        raise ValueError("a union has two members or more")
    spark = quads.sparkSession
    head = F.substring(F.sha2(F.lit("|".join([prop, slot, *names])), 256), 1, 12)
    rows = spark.createDataFrame([(i, m, i + 1 < len(names)) for i, m in enumerate(names)], "pos int, member string, more boolean")
    cell, after = F.concat(F.lit("l"), head, F.lit("_"), F.col("pos")), F.concat(F.lit("l"), head, F.lit("_"), F.col("pos") + 1)
    row = lambda s_kind, s, p, o_kind, o: F.struct(F.lit(s_kind).alias("s_kind"), s.alias("s"), F.lit(p).alias("p"), o_kind.alias("o_kind"), o.alias("o"))
    union = F.concat(F.lit("u"), head)
    first = F.col("pos") == 0
    each = F.array(
        row("bnode", cell, T.RDF + "first", F.lit("iri"), F.col("member")),
        row("bnode", cell, T.RDF + "rest", F.when(F.col("more"), "bnode").otherwise("iri"), F.when(F.col("more"), after).otherwise(F.lit(T.RDF + "nil"))),
        F.when(first, row("iri", F.lit(prop), slot, F.lit("bnode"), union)),
        F.when(first, row("bnode", union, T.TYPE, F.lit("iri"), F.lit(T.CLASS))),
        F.when(first, row("bnode", union, T.OWL + "unionOf", F.lit("bnode"), cell)),
    )
    new = rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(F.lit(graph_iri).alias("g"), "x.*", F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return insert(collect_garbage(quads.filter(~((F.col("s") == prop) & (F.col("p") == slot)))), new)


def collect_garbage(quads: DataFrame) -> DataFrame:
    """Without the blank nodes that no IRI leads to."""
    links = quads.filter(F.col("o_kind") == "bnode").select(F.col("s_kind"), F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    roots = links.filter("s_kind = 'iri'").select(F.col("b").alias("node"))
    live = graph.reachable(links.filter("s_kind = 'bnode'").select("a", "b"), roots)
    return quads.filter("s_kind <> 'bnode'").unionByName(quads.filter("s_kind = 'bnode'").join(live, F.col("s") == F.col("node"), "left_semi"))


def individual_iri(base: str, label: Column, cls: Column) -> Column:
    """A new individual's IRI: the same for the same label and class, whatever task makes it."""
    return F.concat(F.lit(base + "ind-"), F.substring(F.sha2(F.concat_ws("|", T.norm_label(label), cls), 256), 1, 12))


def split_import(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imported quads as (schema, instances): schema nodes are those that are typed or used as such."""
    schema_types = (T.CLASS, T.RDFS + "Class", T.OBJECT_PROPERTY, T.DATA_PROPERTY, T.OWL + "AnnotationProperty", T.RDF + "Property", T.OWL + "Ontology")
    typed = quads.filter((F.col("p") == T.TYPE) & F.col("o").isin(*schema_types)).select(F.col("s").alias("n"))
    used = quads.filter(F.col("p").isin(T.SUBCLASS, T.RDFS + "subPropertyOf", T.DOMAIN, T.RANGE, T.DISJOINT, T.EQUIVALENT, T.OWL + "unionOf", T.RDF + "first", T.RDF + "rest")).select(F.col("s").alias("n"))
    nodes = typed.unionByName(used).distinct()
    return quads.join(nodes, F.col("s") == F.col("n"), "left_semi"), quads.join(nodes, F.col("s") == F.col("n"), "left_anti")


def relocate(quads: DataFrame, old: str, new: str) -> DataFrame:
    """IRIs that begin with ``old`` begin with ``new`` instead; literals stay as they are."""
    move = lambda c: F.when(F.startswith(c, F.lit(old)), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c)))).otherwise(F.col(c))
    return quads.select(
        move("g").alias("g"), "s_kind", F.when(F.col("s_kind") == "iri", move("s")).otherwise(F.col("s")).alias("s"), move("p").alias("p"), "o_kind",
        F.when(F.col("o_kind") == "iri", move("o")).otherwise(F.col("o")).alias("o"), move("o_dt").alias("o_dt"), "o_lang",
    )


def stale_mappings(mapped: DataFrame, quads: DataFrame) -> DataFrame:
    """(iri, mapped) whose mapped entity is no subject of the graphs."""
    there = quads.select(F.col("s").alias("_s")).distinct()
    return mapped.filter("mapped is not null").join(there, F.col("mapped") == F.col("_s"), "left_anti")


def import_counts(before: DataFrame, imported: DataFrame, replace: bool = False) -> DataFrame:
    """(added, removed): net change of a layer (s_kind ... o_lang) by a merge or replacement."""
    old, new = before.select(QUAD[1:]).distinct(), imported.select(QUAD[1:]).distinct()
    added = new.subtract(old).select(F.lit("added").alias("op"))
    removed = old.subtract(new).select(F.lit("removed").alias("op"))
    both = added.unionByName(removed) if replace else added
    return both.agg(F.count_if(F.col("op") == "added").alias("added"), F.count_if(F.col("op") == "removed").alias("removed"))
