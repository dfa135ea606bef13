"""Graph-pattern algebra as DataFrames: patterns, joins, optional, minus, paths, groups, order.

Queries are built with Python calls; Catalyst plans them. A solution is a DataFrame with one
struct column for each variable: (kind, value, dt, lang), null where the variable is unbound.
A column that cannot be null is always bound, and joins on such columns only are plain equi-joins.
Numbers, dates and strings are taken out of a term by the functions below, which give null where
SPARQL has a type error, so a filter drops the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import graph
from graphloom.plans.shared import shuffled, written

TERM = "struct<kind:string,value:string,dt:string,lang:string>"
MAX_ROWS = 10_000
DEFAULT_ROWS = 1_000


def iri(value: str) -> tuple[str, str, str | None, str | None]:
    return ("iri", value, None, None)


def lit(value: str, dt: str | None = None, lang: str | None = None) -> tuple[str, str, str | None, str | None]:
    return ("literal", value, dt, lang)


def _term(x: str) -> Column:
    return F.struct(F.col(f"{x}_kind").alias("kind"), F.col(x).alias("value"), F.col(f"{x}_dt").alias("dt"), F.col(f"{x}_lang").alias("lang"))


def pattern(triples: DataFrame, s, p, o) -> DataFrame:
    """Solutions of one triple pattern. Parts are ``"?name"``, an IRI string, or a term tuple.

    Constants become filters that reach the scan; a variable used twice becomes an equality.
    """
    none = F.lit(None).cast("string")
    columns = {
        "s": F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("value"), none.alias("dt"), none.alias("lang")),
        "p": F.struct(F.lit("iri").alias("kind"), F.col("p").alias("value"), none.alias("dt"), none.alias("lang")),
        "o": _term("o"),
    }
    bound: dict[str, Column] = {}
    for at, part in (("s", s), ("p", p), ("o", o)):
        if isinstance(part, str) and part.startswith("?"):
            name = part[1:]
            if name in bound:
                triples = triples.filter(bound[name].eqNullSafe(columns[at]))
            else:
                bound[name] = columns[at]
            continue
        kind, value, dt, lang = iri(part) if isinstance(part, str) else part
        triples = triples.filter(F.col(at) == value)
        if at != "p":
            triples = triples.filter(F.col(f"{at}_kind") == kind)
        if at == "o" and kind == "literal":
            same = F.coalesce(F.col("o_dt"), F.lit(T.XSD + "string")) == (dt or T.XSD + "string")
            triples = triples.filter(F.col("o_lang") == lang if lang else F.col("o_lang").isNull() & same)
    return triples.select(*[c.alias(n) for n, c in bound.items()]) if bound else triples.select(F.lit(True).alias("_met")).limit(1)


#: Copies of the right side where solutions share no bound variable, so that a product is no single task's.
SALTS = 16


def _loose(a: DataFrame, b: DataFrame, named: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(shared variables that are always bound, those that may be unbound on either side)."""
    shared = [c for c in a.columns if c in b.columns]
    maybe = [c for c in shared if c in named or a.schema[c].nullable or b.schema[c].nullable]
    return [c for c in shared if c not in maybe], maybe


def _masked(side: DataFrame, maybe: list[str], own: str, other: str, prefix: str) -> DataFrame:
    """A row of ``side`` for each set of variables that its partner may have bound.

    Adds ``own`` and ``other`` (bit sets of bound variables), and for each variable its value where
    both have it, else null: rows of the two sides are compatible where all of these are the same.
    """
    mask = F.lit(0)
    for i, c in enumerate(maybe):
        mask = mask + F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
    out = side.withColumn(own, mask).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit((1 << len(maybe)) - 1))))
    both = F.col(own).bitwiseAND(F.col(other))
    return out.withColumns({f"{prefix}{i}": F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)) for i, c in enumerate(maybe)})


def _pairs(a: DataFrame, b: DataFrame, sure: list[str], maybe: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their masks (variables of ``b`` as ``_r_name``), and the equalities that join them."""
    right = b.select(*[F.col(c).alias(f"_r_{c}") for c in b.columns])
    on = F.lit(True)
    for c in sure:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    if not maybe:
        return a, right, on
    left, right = _masked(a, maybe, "_am", "_bm", "_ak"), _masked(right, [f"_r_{c}" for c in maybe], "_r_bm", "_r_am", "_bk")
    on = on & (F.col("_am") == F.col("_r_am")) & (F.col("_bm") == F.col("_r_bm"))
    for i in range(len(maybe)):
        on = on & F.col(f"_ak{i}").eqNullSafe(F.col(f"_bk{i}"))
    return left, right, on


def _same(names: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return on


def _merged(a: DataFrame, b: DataFrame, named: tuple[str, ...], where, keep: bool = False) -> DataFrame:
    """Compatible pairs of solutions as one solution each; with ``keep`` also the left one, as ``_a_name``."""
    sure, maybe = _loose(a, b, named)
    left, right, on = _pairs(a, b, sure, maybe)
    if maybe and not sure:  # rows that have no variable in common meet in a product, which is spread
        apart = lambda x, y: F.col(x).bitwiseAND(F.col(y)) == 0
        left = left.withColumn("_salt", F.when(apart("_am", "_bm"), F.pmod(F.xxhash64(*a.columns), F.lit(SALTS))).otherwise(0))
        right = right.withColumn("_r_salt", F.explode(F.when(apart("_r_am", "_r_bm"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = on & (F.col("_salt") == F.col("_r_salt"))
    of = lambda c: F.coalesce(c, f"_r_{c}") if c in maybe else F.col(c) if c in a.columns else F.col(f"_r_{c}")
    if where is not None:
        on = on & where(of)
    extra = [F.col(c).alias(f"_a_{c}") for c in a.columns] if keep else []
    return left.join(right, on).select(*[of(c).alias(c) for c in a.columns], *[of(c).alias(c) for c in b.columns if c not in a.columns], *extra)


def join(a: DataFrame, b: DataFrame, *maybe_unbound: str) -> DataFrame:
    """Compatible solutions of both: they agree where both have a variable bound.

    Variables that may be unbound are known by their columns' nullability; others can be named.
    They are split by what is bound: one equi-join over pairs of such sets, never a product with a
    filter.
    """
    return _merged(a, b, maybe_unbound, None)


def optional(a: DataFrame, b: DataFrame, *maybe_unbound: str, where=None) -> DataFrame:
    """All of ``a``, with ``b`` where it is compatible; ``where(var)`` is the filter inside OPTIONAL."""
    sure, maybe = _loose(a, b, maybe_unbound)
    if not maybe:
        left, right, on = _pairs(a, b, sure, maybe)
        on = on if where is None else on & where(lambda n: F.col(n) if n in a.columns else F.col(f"_r_{n}"))
        return left.join(right, on, "left").select(*a.columns, *[F.col(f"_r_{c}").alias(c) for c in b.columns if c not in a.columns])
    met = _merged(a, b, maybe_unbound, where, keep=True)
    # whether a solution met one depends on its values only, so what is left is told by them
    known = [c for c in a.columns if where is not None or c in sure or c in maybe]
    seen = met.select(*[F.col(f"_a_{c}").alias(f"_m_{c}") for c in known]).distinct()
    alone = a.join(seen, _same(known, "_m_"), "left_anti")
    return met.drop(*[f"_a_{c}" for c in a.columns]).unionByName(alone, allowMissingColumns=True)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for b in parts[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def _met(a: DataFrame, b: DataFrame, how: str, overlap: bool) -> DataFrame:
    """``a`` with (left_semi) or without (left_anti) the solutions that ``b`` has a compatible one for.

    With ``overlap`` only one with a variable bound on both sides counts.
    """
    sure, maybe = _loose(a, b, ())
    shared = [*sure, *maybe]
    left, right, on = _pairs(a.select(*shared), b.select(*shared), sure, maybe)
    if not maybe:
        return a.join(right, on, how)
    if overlap and not sure:
        left, right = left.filter(F.col("_am").bitwiseAND(F.col("_bm")) > 0), right.filter(F.col("_r_am").bitwiseAND(F.col("_r_bm")) > 0)
    keys = [f"_r_{c}" for c in sure] + ["_r_am", "_r_bm", *[f"_bk{i}" for i in range(len(maybe))]]
    met = left.join(right.select(*keys).distinct(), on, "left_semi").select(*[F.col(c).alias(f"_m_{c}") for c in shared]).distinct()
    return a.join(met, _same(shared, "_m_"), how)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Without the solutions that are compatible with one of ``b`` and have a variable bound in common with it."""
    return _met(a, b, "left_anti", True) if set(a.columns) & set(b.columns) else a


def exists(a: DataFrame, b: DataFrame) -> DataFrame:
    """The solutions that a solution of ``b`` is compatible with."""
    return _met(a, b, "left_semi", False)


def not_exists(a: DataFrame, b: DataFrame) -> DataFrame:
    return _met(a, b, "left_anti", False)


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Inline solutions; None is UNDEF."""
    cells = [tuple(None if x is None else (iri(x) if isinstance(x, str) else x) for x in r) for r in rows]
    full = [" NOT NULL" if all(r[i] is not None for r in cells) else "" for i in range(len(names))]
    return spark.createDataFrame(cells, ", ".join(f"{n} {TERM}{f}" for n, f in zip(names, full, strict=True)))


def path_plus(triples: DataFrame, predicate: str, s: str = "s", o: str = "o", zero: bool = False) -> DataFrame:
    """Pairs joined by one or more steps (``zero``: or none) of a predicate: a distinct fixpoint.

    Terms are numbered, so the rounds of ``graph.ancestors`` carry numbers only, and each pair's
    terms are looked up once, at the end.
    """
    step = written(pattern(triples, "?a", predicate, "?b").distinct())
    ends = step.select(F.col("a").alias("term")).unionByName(step.select(F.col("b").alias("term"))).distinct()
    names = written(ends.select("term", F.monotonically_increasing_id().alias("n")))
    number_of = lambda d, end, n: d.join(shuffled(names.select(F.col("term").alias("_term"), F.col("n").alias(n))), F.col(end) == F.col("_term")).drop("_term", end)
    pairs = graph.ancestors(number_of(number_of(step, "a", "child"), "b", "parent"))
    fields = ("kind", "value", "dt", "lang")
    told = lambda p: names.select(F.col("n").alias(p), *[F.col("term")[f].alias(f"{p}_{f}") for f in fields])
    term = lambda p: F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields])
    known = pairs.join(shuffled(told("_b")), F.col("anc") == F.col("_b")).join(shuffled(told("_a")), F.col("node") == F.col("_a")).select(term("_a").alias("a"), term("_b").alias("b"))
    if zero:
        every = union(pattern(triples, "?x", "?p", "?y").select("x"), pattern(triples, "?y", "?p", "?x").select("x")).distinct()
        known = known.unionByName(every.select(F.col("x").alias("a"), F.col("x").alias("b"))).distinct()
    return known.select(F.col("a").alias(s), F.col("b").alias(o))


def path_seq(a: DataFrame, b: DataFrame, mid: str) -> DataFrame:
    """Two steps that meet in ``mid``, which leaves the solution."""
    return join(a, b).drop(mid)


# Terms to values. Null is SPARQL's error.
def text(v: str) -> Column:
    """STR(): the IRI or the lexical form."""
    return F.when(F.col(v)["kind"] != "bnode", F.col(v)["value"])


def number(v: str) -> Column:
    numeric = F.regexp_extract(F.col(v)["dt"], "[^#]*$", 0).isin("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger")
    return F.when((F.col(v)["kind"] == "literal") & numeric, F.col(v)["value"].try_cast("double"))


def moment(v: str) -> Column:
    return F.when(F.col(v)["dt"].isin(T.XSD + "dateTime", T.XSD + "date"), F.col(v)["value"].try_cast("timestamp"))


def lang(v: str) -> Column:
    return F.when(F.col(v)["kind"] == "literal", F.coalesce(F.col(v)["lang"], F.lit("")))


def datatype(v: str) -> Column:
    return F.when(F.col(v)["kind"] == "literal", F.when(F.col(v)["lang"].isNotNull(), F.lit(T.RDF + "langString")).otherwise(F.coalesce(F.col(v)["dt"], F.lit(T.XSD + "string"))))


def is_kind(v: str, kind: str) -> Column:
    return F.col(v)["kind"] == kind


def bound(v: str) -> Column:
    return F.col(v).isNotNull()


def same_term(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)


def lang_matches(v: str, wanted: str) -> Column:
    tag = F.lower(lang(v))
    return tag != "" if wanted == "*" else (tag == wanted.lower()) | F.startswith(tag, F.lit(wanted.lower() + "-"))


def regex(v: str, expression: str, flags: str = "") -> Column:
    return text(v).rlike((f"(?{flags})" if flags else "") + expression)


def as_literal(value: Column, dt: str | None = None) -> Column:
    """A value bound as a literal term; null stays unbound."""
    none = F.lit(None).cast("string")
    return F.when(value.isNotNull(), F.struct(F.lit("literal").alias("kind"), value.cast("string").alias("value"), F.lit(dt).cast("string").alias("dt"), none.alias("lang")))


def sort_keys(v: str, descending: bool = False) -> list[Column]:
    """Order of terms: unbound, blank, IRI, literal; numbers by value, then by text."""
    rank = F.when(F.col(v).isNull(), 0).when(F.col(v)["kind"] == "bnode", 1).when(F.col(v)["kind"] == "iri", 2).otherwise(3)
    keys = [rank, number(v), moment(v), F.col(v)["value"], F.col(v)["lang"]]
    return [k.desc_nulls_last() for k in keys] if descending else [k.asc_nulls_first() for k in keys]


def bounded(solutions: DataFrame, limit: int | None = None, offset: int = 0, cap: int = DEFAULT_ROWS) -> DataFrame:
    """At most min(limit, cap) solutions; the cap itself lies between 1 and MAX_ROWS."""
    cap = max(1, min(cap, MAX_ROWS))
    return solutions.offset(offset).limit(min(cap, cap if limit is None else limit))


def projected(solutions: DataFrame, *names: str) -> DataFrame:
    """Solutions as plain columns: IRI, ``_:label`` or lexical value."""
    return solutions.select(*[T.to_wire(F.col(n)["kind"], F.col(n)["value"]).alias(n) for n in (names or solutions.columns)])


def ask(solutions: DataFrame) -> DataFrame:
    """One row: is there a solution?"""
    return solutions.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("boolean"))


# Aggregates over the solutions of a group.
def group_concat(v: str, separator: str = " ", distinct: bool = False) -> Column:
    """The texts of a variable's terms in order, joined; unbound ones count for nothing."""
    collect = F.collect_set if distinct else F.collect_list
    return F.array_join(F.array_sort(collect(text(v))), separator)


def sample(v: str) -> Column:
    """One text of a variable's terms: the smallest, so that reruns agree."""
    return F.min(text(v))
