"""Views, statistics and listings of a graph: scan, group, join labels, filter, sort, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators.validation import direct_types
from graphloom.plans.shared import cut

#: Where a default scheme comes from, in order.
SCHEME_ORIGIN = "extraction"


def labels(quads: DataFrame) -> DataFrame:
    """(iri, label): the smallest label of each node."""
    return quads.filter((F.col("p") == T.LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))


def with_label(rows: DataFrame, column: str, names: DataFrame, into: str) -> DataFrame:
    """Adds the label of an IRI column, or its local name."""
    side = names.select(F.col("iri").alias("_iri"), F.col("label").alias("_label"))
    return rows.join(side, F.col(column) == F.col("_iri"), "left").withColumn(into, F.coalesce("_label", T.local_name(F.col(column)))).drop("_iri", "_label")


def class_counts(quads: DataFrame) -> DataFrame:
    """(cls, n): individuals of each class."""
    return direct_types(quads).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def class_list(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """(iri, label) with counts, most individuals first; a class without any counts 0."""
    out = classes.join(counts, F.col("iri") == F.col("cls"), "left").select("iri", "label", F.coalesce("n", F.lit(0)).alias("n"))
    return out.orderBy(F.col("n").desc(), "label", "iri")


def ontology_stats(tbox: DataFrame) -> DataFrame:
    """classes, properties, axioms (subclass + disjoint + equivalent) in one scan."""
    typed = lambda *kinds: F.count_distinct(F.when((F.col("p") == T.TYPE) & F.col("o").isin(*kinds), F.col("s")))
    axiom = F.col("p").isin(T.SUBCLASS, T.DISJOINT, T.EQUIVALENT) & (F.col("o_kind") == "iri")
    return tbox.agg(typed(T.CLASS).alias("classes"), typed(T.OBJECT_PROPERTY, T.DATA_PROPERTY).alias("properties"), F.count_if(axiom).alias("axioms"))


def property_view(tbox: DataFrame, names: DataFrame) -> DataFrame:
    """(iri, kind, label, domains, ranges): sorted members of each slot."""
    kind = F.when(F.col("o") == T.OBJECT_PROPERTY, "object").otherwise("data")
    props = tbox.filter((F.col("p") == T.TYPE) & F.col("o").isin(T.OBJECT_PROPERTY, T.DATA_PROPERTY)).groupBy(F.col("s").alias("iri")).agg(F.max(kind).alias("kind"))
    slots = tbox.filter(F.col("p").isin(T.DOMAIN, T.RANGE)).groupBy(F.col("s").alias("_s")).agg(
        F.sort_array(F.collect_set(F.when(F.col("p") == T.DOMAIN, F.col("o")))).alias("domains"), F.sort_array(F.collect_set(F.when(F.col("p") == T.RANGE, F.col("o")))).alias("ranges")
    )
    out = with_label(props, "iri", names, "label").join(slots, F.col("iri") == F.col("_s"), "left").drop("_s")
    return out.select("iri", "kind", "label", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"), F.coalesce("ranges", F.array().cast("array<string>")).alias("ranges"))


def individuals(quads: DataFrame, names: DataFrame, cls: str | None = None, needle: str | None = None) -> DataFrame:
    """(iri, label): individuals of a class whose label or IRI holds the needle, in any case."""
    found = direct_types(quads)
    if cls is not None:
        found = found.filter(F.col("cls") == cls)
    out = with_label(found.select(F.col("ind").alias("iri")).distinct(), "iri", names, "label")
    needle = (needle or "").strip().lower()
    return out.filter(F.contains(F.lower("label"), F.lit(needle)) | F.contains(F.lower("iri"), F.lit(needle))) if needle else out


def page(rows: DataFrame, *order: Column | str, skip: int = 0, take: int = 50, most: int = 200) -> DataFrame:
    """One page in an order that should end in a unique column; ``take`` lies between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, skip)).limit(max(1, min(take, most)))


def facts(quads: DataFrame, names: DataFrame) -> DataFrame:
    """(s, s_label, p, p_label, value, value_label, is_link): assertions with labels on all IRIs."""
    rows = quads.filter(F.col("p") != T.TYPE).select("s", "p", F.col("o").alias("value"), (F.col("o_kind") != "literal").alias("is_link"))
    out = with_label(with_label(rows, "s", names, "s_label"), "p", names, "p_label")
    link = F.when(F.col("is_link"), F.col("value"))
    out = with_label(out.withColumn("_link", link), "_link", names, "_found")
    return out.select("s", "s_label", "p", "p_label", "value", F.when(F.col("is_link"), F.col("_found")).otherwise(F.col("value")).alias("value_label"), "is_link")


def concepts(quads: DataFrame) -> DataFrame:
    """(iri, scheme, pref, pref_lang, alts, hidden, broader, related, mapped, status, origin, created, modified) of SKOS concepts."""
    at = lambda p: F.col("p") == p
    one = lambda p: F.min(F.when(at(p), F.col("o")))
    many = lambda p: F.sort_array(F.collect_set(F.when(at(p), F.col("o"))))
    S, D = T.SKOS, "http://purl.org/dc/terms/"
    is_concept = F.max(F.when(at(T.TYPE) & (F.col("o") == S + "Concept"), 1))
    out = quads.groupBy(F.col("s").alias("iri")).agg(
        is_concept.alias("_c"), one(S + "inScheme").alias("scheme"), F.min(F.when(at(S + "prefLabel"), F.struct("o", "o_lang"))).alias("_p"), many(S + "altLabel").alias("alts"), many(S + "hiddenLabel").alias("hidden"),
        many(S + "broader").alias("broader"), many(S + "related").alias("related"), one(S + "exactMatch").alias("mapped"), one(D + "status").alias("status"), one(D + "source").alias("origin"), one(D + "created").alias("created"), one(D + "modified").alias("modified"),
    )
    return out.filter("_c = 1").select("iri", "scheme", F.col("_p.o").alias("pref"), F.col("_p.o_lang").alias("pref_lang"), "alts", "hidden", "broader", "related", "mapped", "status", "origin", "created", "modified")


def concept_stats(rows: DataFrame) -> DataFrame:
    """schemes, concepts, labels, mapped, unmapped of ``concepts`` rows."""
    n_labels = F.when(F.col("pref").isNotNull(), 1).otherwise(0) + F.size("alts") + F.size("hidden")
    return rows.agg(
        F.countDistinct("scheme").alias("schemes"), F.count(F.lit(1)).alias("concepts"), F.coalesce(F.sum(n_labels), F.lit(0)).cast("long").alias("labels"), F.count("mapped").alias("mapped"), F.count_if(F.col("mapped").isNull()).alias("unmapped")
    )


def filter_concepts(rows: DataFrame, scheme: str | None = None, status: str | None = None, mapping: str | None = None, origin: str | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """Concepts by scheme, status, mapping ('mapped' or 'standalone'), origin, day and text.

    The day is the first ten characters of modified, else created; a concept without one passes.
    """
    for column, wanted in (("scheme", scheme), ("status", status), ("origin", origin)):
        if wanted:
            rows = rows.filter(F.col(column) == wanted)
    if mapping:
        rows = rows.filter(F.col("mapped").isNotNull() if mapping == "mapped" else F.col("mapped").isNull())
    day = F.substring(F.coalesce("modified", "created", F.lit("")), 1, 10)
    if since:
        rows = rows.filter((day == "") | (day >= since))
    if until:
        rows = rows.filter((day == "") | (day <= until))
    if text and text.strip():
        all_labels = F.concat(F.array("pref"), "alts", "hidden")
        rows = rows.filter(F.exists(all_labels, lambda x: F.contains(F.lower(x), F.lit(text.strip().lower()))))
    return rows.orderBy(F.upper("pref"), "iri")


def related_labels(rows: DataFrame, column: str) -> DataFrame:
    """(iri, labels): the labels of a list of related concepts, in the list's order."""
    each = rows.select("iri", F.posexplode(column).alias("pos", "other"))
    names = rows.select(F.col("iri").alias("other"), F.col("pref").alias("name"))
    met = each.join(names, "other", "left").groupBy("iri").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", T.local_name(F.col("other"))).alias("name")))).alias("x"))
    return met.select("iri", F.transform("x", lambda y: y["name"]).alias("labels"))


def resolve(rows: DataFrame, needle: str, lang: str | None = None, k: int = 10) -> DataFrame:
    """(iri, label, score): concepts that a term names, best first, each by its best label.

    Equal labels score 1.0, 0.98 and 0.95 by kind (preferred, alternative, hidden), contained ones
    0.72. Labels without a language pass any language.
    """
    wanted = F.lower(F.trim(F.lit(needle)))
    kinds = F.concat(
        F.array(F.struct(F.col("pref").alias("label"), F.col("pref_lang").alias("lang"), F.lit(1.0).alias("exact"))),
        F.transform("alts", lambda x: F.struct(x.alias("label"), F.lit(None).cast("string").alias("lang"), F.lit(0.98).alias("exact"))),
        F.transform("hidden", lambda x: F.struct(x.alias("label"), F.lit(None).cast("string").alias("lang"), F.lit(0.95).alias("exact"))),
    )
    each = rows.select("iri", F.explode(kinds).alias("l")).filter("l.label is not null")
    if lang:
        each = each.filter(F.col("l.lang").isNull() | (F.lower("l.lang") == lang.lower()))
    norm = F.lower(F.trim("l.label"))
    scored = each.withColumn("score", F.when(norm == wanted, F.col("l.exact")).when(F.contains(norm, wanted), F.lit(0.72))).filter("score is not null")
    best = F.row_number().over(Window.partitionBy("iri").orderBy(F.col("score").desc(), F.col("l.label")))
    return scored.withColumn("_n", best).filter("_n = 1").select("iri", F.col("l.label").alias("label"), "score").orderBy(F.col("score").desc(), "label", "iri").limit(k)


def concepts_per_scheme(vocabulary: DataFrame, in_scheme: str) -> DataFrame:
    """(scheme, n): how many different concepts each scheme has."""
    return vocabulary.filter(F.col("p") == in_scheme).select("s", F.col("o").alias("scheme")).distinct().groupBy("scheme").agg(F.count(F.lit(1)).alias("n"))


def default_scheme(schemes: DataFrame, rows: DataFrame, fixed: str) -> DataFrame:
    """(scheme): the fixed one if there, else the only one, else the extraction scheme with most
    concepts, else the one with most mapped, then most concepts. ``schemes``: (scheme, origin)."""
    n = rows.groupBy(F.col("scheme").alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.count("mapped").alias("m"))
    all_ = schemes.join(n, F.col("scheme") == F.col("_s"), "left").select("scheme", "origin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    mine = F.coalesce(F.col("origin") == SCHEME_ORIGIN, F.lit(False))
    key = F.struct((F.col("scheme") == fixed), mine, F.when(mine, F.col("n")).otherwise(F.col("m")), F.col("n"))
    return all_.select("scheme", key.alias("k")).orderBy(F.col("k").desc(), "scheme").limit(1).select("scheme")


def isolated_classes(classes: DataFrame, subclass: DataFrame, members: DataFrame) -> DataFrame:
    """(iri) of classes without parent, child or place in a domain or range; ``members``: (cls)."""
    used = subclass.select(F.col("child").alias("u")).unionByName(subclass.select(F.col("parent").alias("u"))).unionByName(members.select(F.col("cls").alias("u"))).distinct()
    return classes.join(used, classes["iri"] == used["u"], "left_anti").select("iri")


def spaced_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows spread evenly over an order: places round(i (N - 1) / (n - 1)), halves to even."""
    total = rows.count()
    if total <= n:
        return rows
    places = [total // 2] if n == 1 else sorted({round(i * (total - 1) / (n - 1)) for i in range(n)})
    dealt = cut(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count().orderBy("_part").collect()  # one row for each partition
    before, at = 0, F.lit(0)
    for r in sizes:
        at = F.when(F.col("_part") == r["_part"], F.lit(before)).otherwise(at)
        before += r["count"]
    ranked = dealt.withColumn("_at", at + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    return ranked.filter(F.col("_at").isin(places)).drop("_at", "_part")
