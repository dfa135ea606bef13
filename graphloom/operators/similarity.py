"""Duplicate candidates: label similarity, vector similarity, and what disqualifies a pair.

Label pairs come from a prefix-filtered token join: words are ordered by how rare they are, and
two labels that are similar enough share one of the first few of their rarest words, so common
words never become join keys. Equal labels are merged before the join. Vector links come from
blocks: equal vectors are merged, the rest are range-dealt by their angle to a pivot and a range is
cut into cells of bounded size; only cells whose ranges can hold a link meet, each two in a task
of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import graph
from graphloom.plans.shared import written

JACCARD, COSINE = 0.86, 0.75
#: Most vectors of a cell, and those from which on there are more than CELLS of them; ranges by angle; rows that are scored together.
BLOCK, LEAST_BLOCK, CELLS, MAX_BLOCKS, SLICE = 16384, 1024, 32, 2048, 512


def label_classes(entities: DataFrame) -> DataFrame:
    """(iri, label) -> (norm, iri, first): normalized label and the smallest IRI that has it."""
    named = entities.select("iri", T.norm_label(F.col("label")).alias("norm")).filter("norm <> ''").distinct()
    first = named.groupBy("norm").agg(F.min("iri").alias("first"))
    return named.join(first, "norm")


def label_pairs(norms: DataFrame, least: float = JACCARD) -> DataFrame:
    """Distinct (norm) -> (a, b, score) of pairs a < b whose similarity is at least ``least``."""
    words = norms.select("norm", F.array_distinct(F.split("norm", " ")).alias("words"))
    each = words.select("norm", F.size("words").alias("n"), F.explode("words").alias("word"))
    rare = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("norm").orderBy("df", "word"))
    prefix = each.join(rare, "word").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("word", "norm", "n")
    other = prefix.select("word", F.col("norm").alias("norm2"), F.col("n").alias("n2"))
    met = prefix.join(other, "word").filter((F.col("norm") < F.col("norm2")) & (F.least("n", "n2") >= F.greatest("n", "n2") * least))
    pairs = met.select(F.col("norm").alias("a"), F.col("norm2").alias("b")).distinct()
    return pairs.withColumn("score", T.jaccard(F.col("a"), F.col("b"))).filter(F.col("score") >= least)


def string_candidates(entities: DataFrame, least: float = JACCARD) -> DataFrame:
    """(iri, label) -> (iri_a, iri_b, score): each entity with its label class's first, and the
    firsts of similar classes; together they connect all similar pairs."""
    classes = label_classes(entities)
    same = classes.filter("iri <> first").select(F.col("first").alias("iri_a"), F.col("iri").alias("iri_b"), F.lit(1.0).alias("score"))
    of = classes.select("norm", "first").distinct()
    pairs = label_pairs(of.select("norm"), least).join(of.select(F.col("norm").alias("a"), F.col("first").alias("fa")), "a").join(of.select(F.col("norm").alias("b"), F.col("first").alias("fb")), "b")
    return same.unionByName(pairs.select(F.least("fa", "fb").alias("iri_a"), F.greatest("fa", "fb").alias("iri_b"), "score"))


def _units(batch: pa.RecordBatch) -> np.ndarray:
    v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]


def vector_links(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """(id, embedding) -> (a, b, score): pairs a < b of cosine at least ``least``. Exact.

    Angles obey the triangle inequality, so vectors whose angles to a pivot differ by more than
    the angle of ``least`` cannot be linked: cells of at most about BLOCK vectors in the order of that
    angle meet only the cells near them. A vector is sent to each cell that it meets, about CELLS of
    them until these are full. Copies of a vector count once there; their pairs are
    made afterwards, in parts of about BLOCK copies.
    """
    known = vectors.filter("id is not null and embedding is not null and size(embedding) > 0")
    classes = known.groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # The id of a class is of its first vector's id and its value: an id may come with several vectors.
    classes = classes.withColumn("cls", F.concat_ws(":", F.when(F.col("copies") > 1, "n").otherwise("1"), F.md5(F.to_json(F.struct("embedding"))), F.col("id").cast("string")))
    parts = F.ceil(F.col("copies") / BLOCK).cast("int").alias("parts")
    named = known.select(F.col("id").alias("member"), "embedding").join(classes.select("embedding", "cls", "copies", parts), "embedding")
    members = named.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    unique = classes.select(F.col("cls").alias("id"), "embedding")
    split = classes.select("cls", parts)

    def spread(links: DataFrame, of: str, into: str) -> DataFrame:
        """``links`` for each member of the class in column ``of``."""
        dealt = links.join(split.withColumnRenamed("cls", of), of).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return dealt.join(members.select(F.col("cls").alias(of), "part", F.col("member").alias(into)), [of, "part"]).drop("part", of)

    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    own = members.filter("copies > 1").withColumn("score", F.pow(norm / F.greatest(norm, F.lit(1e-12)), 2))
    same = own.filter(F.col("score") >= least)
    copies = spread(same.select("cls", F.col("member").alias("a"), "score"), "cls", "b").filter("a < b").select("a", "b", "score")
    links, id_type = _class_links(unique, least), known.schema["id"].dataType
    # A class of one vector ends in its id; only the links of other classes are joined with members.
    alone = lambda c: F.substring(c, F.lit(36), F.length(c)).cast(id_type)
    told = lambda d: d.filter("m <> n").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"), "score")
    if classes.filter("copies > 1").isEmpty():
        return told(links.select(alone(F.col("a")).alias("m"), alone(F.col("b")).alias("n"), "score"))
    links, single = written(links), F.startswith("a", F.lit("1")) & F.startswith("b", F.lit("1"))
    many = spread(spread(links.filter(~single), "a", "m"), "b", "n").select("m", "n", "score")
    return told(links.filter(single).select(alone(F.col("a")).alias("m"), alone(F.col("b")).alias("n"), "score").unionByName(many)).unionByName(copies)


def _class_links(known: DataFrame, least: float) -> DataFrame:
    """The links of distinct vectors with string ids."""
    first = known.orderBy("id").limit(1).collect()
    if not first:
        return known.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
    pivot = F.array(*[F.lit(float(x)) for x in first[0]["embedding"]])
    angle = F.acos(F.least(F.greatest(T.cosine(F.col("embedding"), pivot), F.lit(-1.0)), F.lit(1.0)))
    placed = known.select("id", "embedding", angle.alias("angle"))
    n = placed.count()
    size = min(BLOCK, max(LEAST_BLOCK, math.ceil(n / CELLS)))
    parts = min(MAX_BLOCKS, n // size)
    cuts = sorted(set(placed.stat.approxQuantile("angle", [i / parts for i in range(1, parts)], 0.0001))) if parts > 1 else []
    reach = math.acos(min(1.0, least)) + 1e-9
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    block_of = lambda angle: F.size(F.filter(bounds, lambda c: c <= angle))
    # A range holds as many cells as its rows need, so cells stay small however many rows there are.
    held = {r["block"]: r["n"] for r in placed.groupBy(block_of(F.col("angle")).alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = [max(1, math.ceil(held.get(i, 0) / size)) for i in range(len(cuts) + 1)]
    starts = F.array(*[F.lit(sum(cells[:i])) for i in range(len(cells) + 1)])
    start = lambda block: F.get(starts, block)
    mine = block_of(F.col("angle"))
    cell = start(mine) + F.pmod(F.xxhash64("id"), start(mine + 1) - start(mine)).cast("int")
    dealt = placed.withColumn("block", cell).withColumn("other", F.explode(F.sequence(start(block_of(F.col("angle") - reach)), start(block_of(F.col("angle") + reach) + 1) - 1)))
    met = dealt.select("id", "embedding", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def pair(key: tuple, batch: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        rows = batch.select(["id", "embedding"]).combine_chunks().to_batches()
        ids, unit = np.concatenate([r.column(0).to_numpy(zero_copy_only=False) for r in rows]), np.concatenate([_units(r) for r in rows])
        side = np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.column("block").chunks])
        left, right = (side == i, side == j) if i != j else (np.ones(len(ids), bool),) * 2
        a_ids, a_unit, b_ids, b_unit = ids[left], unit[left], ids[right], unit[right]
        found = []
        for at in range(0, len(a_ids), SLICE):
            score = a_unit[at : at + SLICE] @ b_unit.T
            x, y = np.nonzero(score >= least)
            a, b = a_ids[at + x], b_ids[y]
            keep = (a != b) if i != j else (a < b)
            found.append(pa.table({"a": pa.array(a[keep], pa.string()), "b": pa.array(b[keep], pa.string()), "score": score[x, y][keep]}))
        return pa.concat_tables(found or [pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "score": np.empty(0)})])

    return met.groupBy("i", "j").applyInArrow(pair, "a string, b string, score double").select("a", "b", "score")


#: Tasks that cells are dealt to at most.
MAX_TASKS = 8192
#: Rows of a cell of ``vector_top_k`` at most, and from which on there are more; bytes of a cell's vectors; scores that a task holds.
TOP_ROWS, TOP_LEAST, TOP_BYTES, TOP_SCORES = 16384, 1024, 1 << 25, 1 << 22


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = TOP_ROWS) -> DataFrame:
    """(id, embedding), (id, embedding) -> (query_id, rank, id, score): exact nearest by cosine.

    Every query is scored against every vector, so work is quadratic where all vectors are queries.
    Both are dealt to cells of bounded size, and each two cells meet in a task of their own that
    keeps the best k for a query; what the tasks keep merges by rank. No vector passes the driver.
    """
    whole = lambda d: d.filter("id is not null and embedding is not null and size(embedding) > 0").select("id", "embedding")
    known, asked = whole(vectors), whole(queries)
    count = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    (n, size), (m, _) = count(known), count(asked)
    side = math.ceil(math.sqrt(vectors.sparkSession.sparkContext.defaultParallelism))
    most = max(1, min(TOP_ROWS, TOP_BYTES // (8 * size)))
    cells = lambda rows, most: max(1, math.ceil(rows / most), min(side, math.ceil(rows / TOP_LEAST)))
    across, down = cells(n, most), cells(m, min(most, block_rows))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    own = lambda of: F.pmod(F.xxhash64("id", "embedding"), F.lit(of)).cast("int")
    dealt = asked.select("id", "embedding", F.lit(True).alias("asked"), own(down).alias("i"), each(across).alias("j"))
    dealt = dealt.unionByName(known.select("id", "embedding", F.lit(False).alias("asked"), each(down).alias("i"), own(across).alias("j")))

    def best(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["id", "embedding"]).combine_chunks().to_batches()
        ids, unit = np.concatenate([r.column(0).to_numpy(zero_copy_only=False) for r in rows]), np.concatenate([_units(r) for r in rows])
        asked = np.concatenate([c.to_numpy(zero_copy_only=False) for c in table.column("asked").chunks])
        q_ids, q_unit, v_ids, v_unit = ids[asked], unit[asked], ids[~asked], unit[~asked]
        found = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": np.empty(0)})]
        step = max(1, TOP_SCORES // max(1, len(v_ids)))
        for at in range(0, len(q_ids) if len(v_ids) else 0, step):
            score = q_unit[at : at + step] @ v_unit.T
            # Rounding moves a score by half of 1e-9, so none that could be among the best is below this.
            least = np.partition(score, len(v_ids) - min(k, len(v_ids)), axis=1)[:, len(v_ids) - min(k, len(v_ids))] - 2e-9
            x, y = np.nonzero(score >= least[:, None])
            s = np.round(score[x, y], 9)
            order = np.lexsort((v_ids[y], -s, x))
            x, y, s = x[order], y[order], s[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < k
            found.append(pa.table({"query_id": q_ids[at + x[keep]], "id": v_ids[y[keep]], "score": s[keep]}))
        return pa.concat_tables(found)

    # Counted parts, since a task's work is not in proportion to its bytes.
    met = dealt.repartition(min(across * down, MAX_TASKS), "i", "j").groupBy("i", "j").applyInArrow(best, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def eligible(pairs: DataFrame, labels: DataFrame, subclass: DataFrame, disjoint: DataFrame, equivalent: DataFrame) -> DataFrame:
    """(iri_a, iri_b, ...) without pairs that are related by subclass links, asserted disjoint or
    equivalent (either way round), or told apart by composition of their labels."""
    comp = graph.components(subclass.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    of = lambda end: comp.select(F.col("node").alias(f"n_{end}"), F.col("root").alias(f"root_{end}"))
    name = lambda end: labels.groupBy(F.col("iri").alias(f"l_{end}")).agg(F.min(T.norm_label(F.col("label"))).alias(f"norm_{end}"))
    out = pairs
    for end in ("a", "b"):
        out = out.join(of(end), F.col(f"iri_{end}") == F.col(f"n_{end}"), "left").join(name(end), F.col(f"iri_{end}") == F.col(f"l_{end}"), "left")
    out = out.filter(~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False)))
    out = out.filter(~F.coalesce(T.compositional_distinct(F.col("norm_a"), F.col("norm_b")), F.lit(False))).select(*pairs.columns)
    for told in (disjoint, equivalent):
        both = told.select("a", "b").unionByName(told.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        out = out.join(both, (F.col("iri_a") == both["a"]) & (F.col("iri_b") == both["b"]), "left_anti")
    return out


def united(strings: DataFrame, vectors: DataFrame) -> DataFrame:
    """(iri_a, iri_b, score) twice -> (iri_a, iri_b, score, method): a vector's score overrides a string's."""
    s, v = strings.select("iri_a", "iri_b", F.col("score").alias("s_score")), vectors.select("iri_a", "iri_b", F.col("score").alias("v_score"))
    both = s.join(v, ["iri_a", "iri_b"], "full_outer")
    return both.select("iri_a", "iri_b", F.coalesce("v_score", "s_score").alias("score"), F.when(F.col("v_score").isNotNull(), "embedding").otherwise("string").alias("method"))


def judged(candidates: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Candidates that a judge kept. No judge keeps all; a judge that kept none keeps none."""
    if decisions is None:
        return candidates
    kept = decisions.filter("keep").select("iri_a", "iri_b").distinct()
    return candidates.join(kept, ["iri_a", "iri_b"], "left_semi")


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, iri) -> (norm, iri) of aliases that name exactly one entity."""
    named = aliases.select(T.norm_label(F.col("alias")).alias("norm"), "iri").filter("norm <> ''")
    return named.groupBy("norm").agg(F.min("iri").alias("iri"), F.max("iri").alias("_last")).filter("iri = _last").drop("_last")


def overlap(a: Column, b: Column) -> Column:
    """Do two label lists share a label, as normalized?"""
    return F.arrays_overlap(F.transform(a, T.norm_label), F.transform(b, T.norm_label))
