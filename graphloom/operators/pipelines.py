"""Multi-step flows over decision tables: verification, recovery of classes and hierarchy, merging.

Every step is a pure function of tables, so a flow is one plan and a repeated run agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import evidence as E
from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import edits, extraction, graph, similarity, terminology

LINK_FLOOR = 0.85


def verify(classes: DataFrame, chunks: DataFrame, critic: DataFrame, adjudicator: DataFrame | None = None, denotations: DataFrame | None = None) -> DataFrame:
    """Classes that the critic keeps, or else the adjudicator; then denotations (source,
    replacement) rename those whose replacement is the tail of the label. A table that is absent
    changes nothing."""
    kept = extraction.verified_roles(classes, critic, chunks)
    if adjudicator is not None:
        rest = classes.join(kept.select(F.col("chunk_id").alias("_c"), F.col("label").alias("_l")), (F.col("chunk_id") == F.col("_c")) & (F.col("label") == F.col("_l")), "left_anti")
        kept = kept.unionByName(extraction.verified_roles(rest, adjudicator, chunks))
    if denotations is None:
        return kept
    safe = terminology.replacements(denotations).groupBy("source").agg(F.min("replacement").alias("replacement"))
    return kept.join(safe, F.col("label") == F.col("source"), "left").withColumn("label", F.coalesce("replacement", "label")).drop("source", "replacement")


def recovery_candidates(labels: DataFrame, chunks: DataFrame, occurrences: int = 8, each: int = 2) -> DataFrame:
    """(label, chunk_id, start, stop): windows around an even sample of ``each`` places in each of an
    even sample of ``occurrences`` of all chunks that hold a label."""
    found = extraction.evenly_sampled(extraction.grounding_chunks(labels, chunks, None), "label", "chunk_id", occurrences)
    texts = found.join(chunks.select("chunk_id", "text"), "chunk_id")
    spans = texts.select("label", "chunk_id", F.explode(X.sampled_windows(F.col("label"), F.col("text"), F.lit(each))).alias("w"))
    return spans.select("label", "chunk_id", "w.start", "w.stop")


def accepted_links(decisions: DataFrame, chunks: DataFrame, floor: float = LINK_FLOOR) -> DataFrame:
    """(chunk_id, sub, super, confidence, evidence) -> (sub, super): sure links whose quote the chunk
    holds; of one subclass's parents the surest."""
    held = decisions.join(chunks.select(F.col("chunk_id").alias("_c"), "text"), F.col("chunk_id") == F.col("_c"))
    held = held.filter((T.clamp_confidence(F.col("confidence")) >= floor) & (T.norm_label(F.col("sub")) != T.norm_label(F.col("super"))))
    held = held.filter(E.evidence_is_grounded(F.col("evidence"), F.col("text")))
    best = F.row_number().over(Window.partitionBy(T.norm_label(F.col("sub"))).orderBy(F.col("confidence").cast("double").desc(), "super"))
    return held.withColumn("_n", best).filter("_n = 1").select("sub", "super")


def attach(isolated: DataFrame, votes: DataFrame, most: int = 5) -> DataFrame:
    """(iri, label), (sub, super) -> (sub, super): parents for isolated classes, only lexically safe
    ones, none that more than ``most`` classes name."""
    mine = votes.join(isolated.select(T.norm_label(F.col("label")).alias("_n")).distinct(), T.norm_label(F.col("sub")) == F.col("_n"), "left_semi")
    named = extraction.popular_parents(mine.select(F.col("sub").alias("a"), F.col("super").alias("b")), most)
    return named.filter(T.safe_subclass(F.col("a"), F.col("b"))).select(F.col("a").alias("sub"), F.col("b").alias("super")).distinct()


def duplicates_to_merge(entities: DataFrame, vectors: DataFrame | None, decisions: DataFrame | None, least: float = similarity.JACCARD) -> DataFrame:
    """(iri, label), (iri, embedding) -> (src, tgt): every entity of a group of duplicates but the
    first, and the first. Vectors only add their score to string candidates; a judge decides."""
    found = similarity.string_candidates(entities, least)
    if vectors is not None:
        side = lambda x: vectors.select(F.col("iri").alias(f"iri_{x}"), F.col("embedding").alias(f"e_{x}"))
        found = found.join(side("a"), "iri_a", "left").join(side("b"), "iri_b", "left").withColumn("cosine", T.cosine(F.col("e_a"), F.col("e_b"))).drop("e_a", "e_b")
    kept = similarity.judged(found, decisions)
    groups = graph.components(kept.select(F.col("iri_a").alias("a"), F.col("iri_b").alias("b")))
    return groups.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("tgt"))


def merge_duplicates(quads: DataFrame, names: DataFrame) -> DataFrame:
    """Individuals renamed by (src, tgt): all they assert and what is asserted of them moves; links
    of an individual to itself that only the merge made go."""
    own = quads.filter((F.col("s") == F.col("o")) & (F.col("o_kind") == "iri")).select(F.col("s").alias("_s"), F.col("p").alias("_p"))
    moved = edits._renamed(quads, names, "s", "o").distinct()
    loop = (F.col("s") == F.col("o")) & (F.col("o_kind") == "iri")
    kept = moved.filter(loop).join(own, (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")), "left_semi")
    return moved.filter(~loop).unionByName(kept)
