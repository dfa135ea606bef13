"""The vocabulary layer: concept rules, proposals, resolution, and keeping it in step with the schema.

Concepts are three flat tables: concepts (iri, scheme, mapped, status, origin), labels
(iri, kind, value, lang) with kind 'pref', 'alt' or 'hidden', and relations (iri, kind, other) with
kind 'broader' or 'related'. What is done entity by entity in order elsewhere is a rank over that
order here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import graph

# Fixed values.
STATUSES, ORIGINS = ("active", "deprecated"), ("manual", "extraction", "agent")


def broken_rules(concepts: DataFrame, labels: DataFrame, relations: DataFrame, schemes: DataFrame) -> DataFrame:
    """(iri, rule, detail): what concepts break. No rows: all may be stored."""
    row = lambda d, rule, detail: d.select("iri", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    known = schemes.select(F.col("scheme").alias("_s"))
    keyed = labels.withColumn("norm", X.normalize_label("value")).withColumn("tag", F.lower(F.coalesce("lang", F.lit("")))).filter("norm <> ''")
    pref = keyed.filter("kind = 'pref'")
    many = pref.groupBy("iri", "tag").agg(F.countDistinct("norm").alias("n")).filter("n > 1")
    twice = keyed.groupBy("iri", "norm", "tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = keyed.join(concepts.select(F.col("iri").alias("_i"), "scheme"), F.col("iri") == F.col("_i"))
    shared = placed.groupBy("scheme", "norm", "tag").agg(F.min("iri").alias("first"), F.max("iri").alias("last")).filter("first <> last")
    reused = placed.join(shared, ["scheme", "norm", "tag"], "left_semi").select("iri", "norm").distinct()
    ends = relations.join(concepts.select(F.col("iri").alias("_i"), F.col("scheme").alias("s1")), F.col("iri") == F.col("_i"))
    ends = ends.join(concepts.select(F.col("iri").alias("_o"), F.col("scheme").alias("s2")), F.col("other") == F.col("_o"), "left")
    loops = graph.cycles(relations.filter("kind = 'broader' and iri <> other").select(F.col("iri").alias("child"), F.col("other").alias("parent")))
    return reduce(
        DataFrame.unionByName,
        [
            row(concepts.join(known, F.col("scheme") == F.col("_s"), "left_anti"), "scheme not found", F.col("scheme")),
            row(concepts.join(pref.select(F.col("iri").alias("_p")).distinct(), F.col("iri") == F.col("_p"), "left_anti"), "no preferred label", F.lit(None)),
            row(many, "preferred label twice in a language", F.col("tag")), row(twice, "label twice in a concept", F.col("norm")), row(reused, "label of another concept", F.col("norm")),
            row(ends.filter("s2 is null or s1 <> s2"), "relation leaves the scheme", F.col("other")), row(relations.filter("iri = other"), "relation to itself", F.col("other")),
            row(loops.select(F.col("node").alias("iri"), "root"), "broader cycle", F.col("root")),
            row(concepts.filter(~F.coalesce(F.col("status"), F.lit("active")).isin(*STATUSES)), "status", F.col("status")), row(concepts.filter(~F.coalesce(F.col("origin"), F.lit("manual")).isin(*ORIGINS)), "origin", F.col("origin")),
            row(concepts.filter("mapped is not null").filter(~F.col("mapped").rlike("^(?:https?://|urn:)")), "mapping is no absolute IRI", F.col("mapped")),
        ],
    )


def drop_stale(concepts: DataFrame, entities: DataFrame) -> DataFrame:
    """Concepts whose mapped entity is not among ``entities`` (iri) lose the mapping and stay."""
    known = entities.select(F.col("iri").alias("_e")).distinct()
    return concepts.join(known, F.col("mapped") == F.col("_e"), "left").withColumn("mapped", F.col("_e")).drop("_e")


def sync_entities(entities: DataFrame, concepts: DataFrame, labels: DataFrame, scheme: str, vocabulary: str) -> DataFrame:
    """(iri, label, rank) -> (iri, label, concept, action, lang) for entities that no concept maps.

    In the order of ``rank``: 'conflict' where a mapped concept, or an entity before, owns the
    label; 'adopt' where a concept without mapping has it as preferred label; else 'add'.
    """
    mapped = concepts.filter("mapped is not null")
    open_ = entities.withColumn("norm", T.norm_label(F.col("label"))).filter("norm <> ''").join(mapped.select(F.col("mapped").alias("_m")).distinct(), F.col("iri") == F.col("_m"), "left_anti")
    owned = labels.join(mapped.select(F.col("iri").alias("_c")), F.col("iri") == F.col("_c"), "left_semi").select(T.norm_label(F.col("value")).alias("_owned")).distinct()
    free = concepts.filter("mapped is null").select(F.col("iri").alias("_f"))
    pref = labels.filter("kind = 'pref'").join(free, F.col("iri") == F.col("_f"), "left_semi").groupBy(F.col("value").alias("_value")).agg(F.min("iri").alias("_adopt"))
    place = F.row_number().over(Window.partitionBy("norm").orderBy("rank", "iri"))
    out = open_.withColumn("_n", place).join(owned, F.col("norm") == F.col("_owned"), "left").join(pref, F.col("label") == F.col("_value"), "left")
    action = F.when(F.col("_owned").isNotNull() | (F.col("_n") > 1), "conflict").when(F.col("_adopt").isNotNull(), "adopt").otherwise("add")
    concept = F.when(action == "adopt", F.col("_adopt")).when(action == "add", F.concat(F.lit(f"{vocabulary}#concept-"), T.local_name(F.col("iri"))))
    return out.select("iri", "label", concept.alias("concept"), action.alias("action"), T.guess_language(F.col("label")).alias("lang"))


def missing_aliases(entities: DataFrame, concepts: DataFrame, labels: DataFrame, scheme: str) -> DataFrame:
    """(concept, label, lang): an entity's label for its concept where no concept of the scheme has it."""
    of = concepts.filter("mapped is not null").select(F.col("iri").alias("concept"), "mapped")
    named = entities.join(of, entities["iri"] == of["mapped"]).select("concept", "label", T.guess_language(F.col("label")).alias("lang"))
    mine = concepts.filter(F.col("scheme") == scheme).select(F.col("iri").alias("_c"))
    used = labels.join(mine, F.col("iri") == F.col("_c"), "left_semi").select(T.norm_label(F.col("value")).alias("_n"), F.lower("lang").alias("_l")).distinct()
    new = named.join(used, (T.norm_label(F.col("label")) == F.col("_n")) & (F.lower("lang") == F.col("_l")), "left_anti")
    first = F.row_number().over(Window.partitionBy(T.norm_label(F.col("label")), F.lower("lang")).orderBy("concept"))
    return new.withColumn("_i", first).filter("_i = 1").drop("_i")


def missing_broader(subclass: DataFrame, concepts: DataFrame, relations: DataFrame) -> DataFrame:
    """(iri, other): concepts of a class and its superclass in one scheme that lack the broader link."""
    first = concepts.filter("mapped is not null").groupBy("mapped").agg(F.min(F.struct("iri", "scheme")).alias("c"))
    low = first.select(F.col("mapped").alias("child"), F.col("c.iri").alias("iri"), F.col("c.scheme").alias("s1"))
    high = first.select(F.col("mapped").alias("parent"), F.col("c.iri").alias("other"), F.col("c.scheme").alias("s2"))
    links = subclass.join(low, "child").join(high, "parent").filter("s1 = s2 and iri <> other").select("iri", "other").distinct()
    return links.join(relations.filter("kind = 'broader'").select("iri", "other").distinct(), ["iri", "other"], "left_anti")


def proposal_signature(action: Column, payload: Column, target: Column) -> Column:
    """SHA-256 of the proposal as JSON with sorted keys; ``payload`` is JSON with sorted keys."""
    quoted = lambda c: F.coalesce(F.to_json(F.struct(c.alias("x"))), F.lit('{"x":null}'))
    bare = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(quoted(c), r'^\{"x":|\}$', ""))
    return F.sha2(F.concat(F.lit('{"action":'), bare(action), F.lit(',"payload":'), payload, F.lit(',"target_iri":'), bare(target), F.lit("}")), 256)


def new_proposals(proposals: DataFrame, known: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, signature, term, evidence, ...): those whose quote and term their chunk holds and
    whose signature is new; of equal signatures the first."""
    src = chunks.select(F.col("chunk_id").alias("_c"), F.lower("text").alias("_t"))
    held = proposals.join(src, F.col("chunk_id") == F.col("_c")).filter(F.contains("_t", F.lower("evidence")) & F.contains("_t", F.lower("term"))).drop("_c", "_t")
    fresh = held.join(known.select("signature").distinct(), "signature", "left_anti")
    return fresh.withColumn("_i", F.row_number().over(Window.partitionBy("signature").orderBy("chunk_id", "term"))).filter("_i = 1").drop("_i")


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows (id, status, ...) with the last decision (id, status, seq) of each pending one."""
    last = decisions.groupBy(F.col("id").alias("_id")).agg(F.max_by("status", "seq").alias("_new"))
    pending = F.col("status") == "pending"
    return queue.join(last, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(pending & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("status"))).drop("_id", "_new")


def replacements(pairs: DataFrame) -> DataFrame:
    """(source, replacement): those whose words are the last words of the source."""
    return pairs.filter(T.safe_subclass(F.col("source"), F.col("replacement")))


def common_superclasses(members: DataFrame, up: DataFrame) -> DataFrame:
    """(group, cls), (node, anc) -> (group, anc): ancestors that all classes of a group have."""
    n = members.distinct().groupBy("group").agg(F.count(F.lit(1)).alias("of"))
    met = members.distinct().join(up, F.col("cls") == F.col("node")).groupBy("group", "anc").agg(F.count(F.lit(1)).alias("n"))
    return met.join(n, "group").filter("n = of").select("group", "anc")
