"""Checks of instance data against the schema, and SHACL shapes, as plans that give violation rows.

Rows: (id, type, severity, individual, detail): ``id`` is 16 hex digits of the violation's parts.
The world is open: a missing type is no violation, a conflicting one is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import graph
from graphloom.plans.shared import shuffled, written

MAX_DIRECT_TYPES = 12
MAX_VIOLATIONS = 500
#: Rows that a task tells apart by a table in its memory.
TASK_ROWS = 1_000_000
#: Pairs of disjoint classes, counted, that are sent to every task; more are dealt.
FEW_PAIRS = 100_000
_NO_CLASS = (T.NAMED_INDIVIDUAL, T.CLASS, T.OBJECT_PROPERTY, T.DATA_PROPERTY)


def _violation(kind: str, severity: str, detail: Column, *parts: Column) -> list[Column]:
    return [T.short_id(F.lit(kind), *parts).alias("id"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), parts[0].alias("individual"), detail.alias("detail")]


def direct_types(abox: DataFrame) -> DataFrame:
    """(ind, cls): asserted classes of individuals."""
    return abox.filter((F.col("p") == T.TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(*_NO_CLASS)).select(F.col("s").alias("ind"), F.col("o").alias("cls")).distinct()


def type_closure(types: DataFrame, up: DataFrame) -> DataFrame:
    """(ind, cls) with all superclasses; a class without superclass stands for itself.

    Only what comes twice is dropped, so the rows are counted first and dealt, by class to be joined
    and by individual to be told apart, in parts of about TASK_ROWS, which bounds what a task holds.
    """
    types = written(types)
    over = up.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    n = types.join(over, types["cls"] == over["node"], "left").agg(F.sum(F.coalesce("n", F.lit(0)) + 1)).first()[0] or 0
    parts = max(math.ceil(n / TASK_ROWS), types.sparkSession.sparkContext.defaultParallelism)
    dealt = types.repartition(parts, "cls")
    every = dealt.join(up, dealt["cls"] == up["node"]).select("ind", F.col("anc").alias("cls")).unionByName(types)
    return every.repartition(parts, "ind").distinct()


def placeholders(abox: DataFrame, types: DataFrame) -> DataFrame:
    """Individuals whose label names nothing (their local name counts where there is no label)."""
    labels = abox.filter(F.col("p") == T.LABEL).groupBy(F.col("s").alias("l_ind")).agg(F.min("o").alias("label"))
    named = types.select("ind").distinct().join(shuffled(labels), F.col("ind") == F.col("l_ind"), "left").select("ind", F.coalesce("label", T.local_name(F.col("ind"))).alias("label"))
    return named.filter(T.non_identifying(F.col("label"))).select(*_violation("placeholder", "error", F.col("label"), F.col("ind")))


def too_many_types(types: DataFrame, most: int = MAX_DIRECT_TYPES) -> DataFrame:
    many = types.groupBy("ind").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return many.select(*_violation("type_count", "error", F.col("n").cast("string"), F.col("ind")))


def _pairs(disjoint: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return disjoint.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct()


def disjoint_classes(disjoint: DataFrame) -> DataFrame:
    """(cls): classes that are disjoint with another."""
    pairs = _pairs(disjoint)
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def class_sets(types: DataFrame, up: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ind, has): those classes of an individual that are ``wanted`` (cls), inherited ones included,
    sorted; no row where there is none. Only ancestors that are wanted are looked up."""
    sets, kinds = class_kinds(types, up, wanted)
    return sets.join(shuffled(kinds), "kind").select("ind", "has")


def class_kinds(types: DataFrame, up: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class_sets`` as (ind, kind) and (kind, has): an individual is dealt with the key of what its
    classes give it, and a set that many have is put together once."""
    over = up.select("node", "anc").unionByName(wanted.select(F.col("cls").alias("node"), F.col("cls").alias("anc")))
    own = over.join(shuffled(wanted.select(F.col("cls").alias("anc"))), "anc", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("anc")).alias("own"))
    own = written(own.select("node", "own", graph.set_key(F.col("own")).alias("key")))
    mixed = types.join(shuffled(own.select("node", "key")), types["cls"] == own["node"]).groupBy("ind").agg(F.array_sort(F.collect_set("key")).alias("mix"))
    sets = written(mixed.select("ind", "mix", graph.set_key(F.col("mix")).alias("kind")))
    each = sets.select("kind", "mix").distinct().select("kind", F.explode("mix").alias("key"))
    met = each.join(shuffled(own.select("key", "own").distinct()), "key").groupBy("kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("has"))
    return sets.select("ind", "kind"), written(met)


def disjoint_types(sets: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Individuals in two disjoint classes; ``sets``: (ind, has) of all classes that are in a pair."""
    return _disjoint_rows(graph.pairs_held(sets.select(F.col("ind").alias("node"), "has"), _pairs(disjoint)).withColumnRenamed("node", "ind"))


def _disjoint_rows(hit: DataFrame) -> DataFrame:
    return hit.select(*_violation("disjoint", "error", F.concat_ws("|", "a", "b"), F.col("ind"), F.col("a"), F.col("b")))


def slot_members(tbox: DataFrame, slot: str) -> DataFrame:
    """(prop, cls): classes of a domain or range; members of a union where it is one."""
    values = tbox.filter((F.col("p") == slot) & F.col("o_kind").isin("iri", "bnode")).select(F.col("s").alias("prop"), F.col("o").alias("value"), "o_kind")
    unions = tbox.filter(F.col("p") == T.OWL + "unionOf").select(F.col("s").alias("u"), F.col("o").alias("head"))
    heads = values.join(shuffled(unions), values["value"] == unions["u"]).select("prop", "head")
    members = graph.list_members(tbox, heads.select("head").distinct(), T.RDF + "first", T.RDF + "rest", T.RDF + "nil")
    return values.filter("o_kind = 'iri'").select("prop", F.col("value").alias("cls")).unionByName(heads.join(shuffled(members), "head").select("prop", F.col("member").alias("cls"))).distinct()


def slot_conflicts(links: DataFrame, members: DataFrame, sets: DataFrame, disjoint: DataFrame, up: DataFrame, kind: str) -> DataFrame:
    """(prop, ind, fact): facts whose individual conflicts with every member class of the slot.

    An individual conflicts with a class if one of its classes is disjoint with it or with one of
    its superclasses. ``sets``: (ind, has) of all classes that are in a disjoint pair. What a slot
    asks for is one value too (of each member class the classes that it or a superclass is and that
    are in a pair), so equal slots and equal sets are judged once, however many facts have them.
    """
    keyed = sets.select("ind", "has", graph.set_key(F.col("has")).alias("kind"))
    return _slot_conflicts(links, members, keyed.select("ind", "kind"), keyed.select("kind", "has").distinct(), disjoint, up, kind)


def _slot_conflicts(links: DataFrame, members: DataFrame, sets: DataFrame, kinds: DataFrame, disjoint: DataFrame, up: DataFrame, kind: str) -> DataFrame:
    """``slot_conflicts`` for (ind, kind) and (kind, has): facts carry keys of slots and sets, and each
    slot and set that a fact brings together are looked up once to be judged."""
    both = written(disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    members = written(members)
    asked = members.select("cls").distinct()
    wide = asked.join(shuffled(up), asked["cls"] == up["node"]).select("cls", F.col("anc").alias("over")).unionByName(asked.select("cls", F.col("cls").alias("over")))
    over = wide.join(shuffled(both.select(F.col("a").alias("over")).distinct()), "over", "left_semi").groupBy("cls").agg(F.array_sort(F.collect_set("over")).alias("over"))
    slots = members.join(shuffled(over), "cls").groupBy("prop").agg(F.array_sort(F.collect_set("over")).alias("slot"), F.count(F.lit(1)).alias("n"))
    need = members.groupBy(F.col("prop").alias("n_prop")).agg(F.count(F.lit(1)).alias("of"))
    slots = slots.join(shuffled(need), (F.col("prop") == F.col("n_prop")) & (F.col("n") == F.col("of")))
    slots = written(slots.select(F.col("prop").alias("s_prop"), "slot", graph.set_key(F.col("slot")).alias("ask")))
    known = sets.select(F.col("ind").alias("t_ind"), "kind")
    asks = links.join(shuffled(slots.select("s_prop", "ask")), F.col("prop") == F.col("s_prop"))
    met = written(asks.join(shuffled(known), F.col("ind") == F.col("t_ind")).select("prop", "ind", "fact", "ask", "kind"))
    pairs = met.select("ask", "kind").distinct().join(shuffled(slots.select("ask", "slot").distinct()), "ask").join(shuffled(kinds), "kind")
    each = pairs.select("ask", "kind", "has", F.size("slot").alias("of"), F.posexplode("slot").alias("i", "over"))
    each = each.select("ask", "kind", "of", "i", "has", F.explode("over").alias("a")).select("ask", "kind", "of", "i", "a", F.explode("has").alias("b"))
    foes = F.broadcast(both) if both.count() <= FEW_PAIRS else shuffled(both)
    bad = written(each.join(foes, ["a", "b"]).groupBy("ask", "kind", "of").agg(F.countDistinct("i").alias("n")).filter("n = of").select("ask", "kind"))
    hit = met.join(shuffled(bad), ["ask", "kind"], "left_semi").select("prop", "ind", "fact").distinct()
    return hit.select(*_violation(kind, "warning", F.col("fact"), F.col("ind"), F.col("prop"), F.col("fact")))


def wrong_datatypes(abox: DataFrame, tbox: DataFrame) -> DataFrame:
    """Data values that are not in the lexical space of their property's XSD range."""
    ranges = tbox.filter((F.col("p") == T.RANGE) & F.startswith("o", F.lit(T.XSD))).select(F.col("s").alias("prop"), F.col("o").alias("dt")).distinct()
    values = abox.filter(F.col("o_kind") == "literal").join(ranges, F.col("p") == F.col("prop"))
    return values.filter(~T.xsd_valid(F.col("o"), F.col("dt"))).select(*_violation("datatype", "warning", F.col("o"), F.col("s"), F.col("p"), F.col("o"))).distinct()


def validate(tbox: DataFrame, abox: DataFrame) -> DataFrame:
    """All violations of an instance layer.

    Both layers are written once, with what the rules read of them. All that grows with them is
    dealt to tasks, so the driver holds plans only.
    """
    tbox, abox = written(tbox.select("s", "p", "o_kind", "o")), written(abox.select("s", "p", "o_kind", "o"))
    pair = lambda p: tbox.filter(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
    up = graph.ancestors(pair(T.SUBCLASS).select(F.col("a").alias("child"), F.col("b").alias("parent")))
    types, disjoint = written(direct_types(abox)), written(pair(T.DISJOINT))
    sets, kinds = class_kinds(types, up, disjoint_classes(disjoint))
    held = graph.kinds_held(kinds, _pairs(disjoint))
    links = abox.filter(F.col("p") != T.TYPE)
    fact = F.concat_ws("|", "s", "p", "o")
    out = links.select(F.col("p").alias("prop"), F.col("s").alias("ind"), fact.alias("fact"))
    into = links.filter("o_kind = 'iri'").select(F.col("p").alias("prop"), F.col("o").alias("ind"), fact.alias("fact"))
    return reduce(
        DataFrame.unionByName,
        [
            placeholders(abox, types), too_many_types(types), _disjoint_rows(sets.join(shuffled(held), "kind")),
            _slot_conflicts(out, slot_members(tbox, T.DOMAIN), sets, kinds, disjoint, up, "domain"),
            _slot_conflicts(into, slot_members(tbox, T.RANGE).filter(~F.startswith("cls", F.lit(T.XSD))), sets, kinds, disjoint, up, "range"),
            wrong_datatypes(abox, tbox),
        ],
    )


def report(violations: DataFrame, most: int = MAX_VIOLATIONS) -> tuple[DataFrame, bool]:
    """The first ``most`` violations, errors first, and whether there are more."""
    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    top = violations.orderBy(rank, "id").limit(most + 1)
    return top.limit(most), top.count() > most


def apply_fix(abox: DataFrame, kind: str, individual: str, predicate: str | None = None, value: str | None = None) -> DataFrame:
    """An instance layer after a fix: delete_individual, remove_type, or remove_assertion."""
    mine = F.col("s") == individual
    if kind == "delete_individual":
        return abox.filter(~mine)
    if kind == "remove_type":
        return abox.filter(~(mine & (F.col("p") == T.TYPE) & (F.col("o") == value)))
    if kind == "remove_assertion":
        return abox.filter(~(mine & (F.col("p") == predicate) & (F.col("o") == value)))
    raise ValueError(f"no such fix: {kind}")


def relax_range(tbox: DataFrame, prop: str) -> DataFrame:
    """A schema layer without the property's ranges."""
    return tbox.filter(~((F.col("s") == prop) & (F.col("p") == T.RANGE)))


def read_shapes(shapes: DataFrame) -> DataFrame:
    """(shape, target, path, min_count, node_kind, datatype, class_): one row for each property shape."""
    one = lambda p, name: shapes.filter(F.col("p") == T.SH + p).select(F.col("s").alias(f"{name}_s"), F.col("o").alias(name))
    out = one("targetClass", "target").select(F.col("target_s").alias("shape"), "target")
    props = one("property", "node")
    out = out.join(props, out["shape"] == props["node_s"]).select("shape", "target", "node")
    for p, name in (("path", "path"), ("minCount", "min_count"), ("nodeKind", "node_kind"), ("datatype", "datatype"), ("class", "class_")):
        side = one(p, name)
        out = out.join(side, out["node"] == side[f"{name}_s"], "inner" if p == "path" else "left").drop(f"{name}_s")
    return out.select("shape", "target", "path", F.col("min_count").try_cast("int").alias("min_count"), "node_kind", "datatype", "class_")


def shacl(shapes: DataFrame, data: DataFrame) -> DataFrame:
    """(shape, focus, path, constraint, value): what the data breaks of the shapes.

    Targets are the direct instances of a class; ``class`` asks for a direct type.
    """
    shapes = written(shapes)  # few as a rule, and a table's size is known: what no shape names is left out before it travels
    classes = shapes.select(F.col("target").alias("t_o")).unionByName(shapes.filter("class_ is not null").select(F.col("class_").alias("t_o"))).distinct()
    types = data.filter(F.col("p") == T.TYPE).select(F.col("s").alias("t_s"), F.col("o").alias("t_o")).join(classes, "t_o", "left_semi").distinct()
    focus = shapes.join(types, F.col("target") == F.col("t_o")).withColumnRenamed("t_s", "focus").drop("t_o")
    paths = shapes.select(F.col("path").alias("v_p")).distinct()
    values = data.select(F.col("s").alias("v_s"), F.col("p").alias("v_p"), "o_kind", "o", "o_dt", "o_lang").join(paths, "v_p", "left_semi").distinct()
    met = written(focus.join(values, (F.col("focus") == F.col("v_s")) & (F.col("path") == F.col("v_p")), "left"))
    row = lambda d, constraint, value: d.select("shape", "focus", "path", F.lit(constraint).alias("constraint"), value.alias("value"))
    key = ["shape", "focus", "path", "min_count"]
    few = met.filter("min_count is not null").groupBy(*key).agg(F.count("o").alias("n")).filter("n < min_count")
    there = met.filter("o is not null")
    bad_kind = there.filter(
        ((F.col("node_kind") == T.SH + "IRI") & (F.col("o_kind") != "iri")) | ((F.col("node_kind") == T.SH + "Literal") & (F.col("o_kind") != "literal"))
    )
    plain = F.when(F.col("o_lang").isNotNull(), F.lit(T.RDF + "langString")).otherwise(F.coalesce("o_dt", F.lit(T.XSD + "string")))
    bad_type = there.filter(F.col("datatype").isNotNull() & ((F.col("o_kind") != "literal") | (plain != F.col("datatype"))))
    other = types.select(F.col("t_s").alias("c_s"), F.col("t_o").alias("c_o"))
    bad_class = there.filter("class_ is not null").join(other, (F.col("o") == F.col("c_s")) & (F.col("class_") == F.col("c_o")), "left_anti")
    return reduce(
        DataFrame.unionByName,
        [row(few, "minCount", F.col("n").cast("string")), row(bad_kind, "nodeKind", F.col("o")), row(bad_type, "datatype", F.col("o")), row(bad_class, "class", F.col("o"))],
    ).distinct()
