"""Queries on curation: edit logs, vocabularies, cycles in the data, merging of duplicates from end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import conflicts, edit_log, merkle, pipelines, similarity, terminology, views
from graphloom.plans.catalog import query, read
from graphloom.plans.shared import fresh_dir
from graphloom.sources import mapping
from graphloom.sources.mapping import ABOX, EX

FLAG, SKOS = EX + "flag", "http://www.w3.org/2004/02/skos/core#"


def _customers(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return mapping.describe(c, mapping.iri("customer", F.col("c_custkey")), ABOX, mapping.to_iri(T.TYPE, mapping.iri("Customer")), mapping.to_literal(T.LABEL, F.col("c_name")), mapping.to_literal(FLAG, F.when(F.col("c_acctbal") > 5000, F.lit("F"))))


_LOG = f"""
WITH own AS (
  SELECT '{EX}customer' || c_custkey AS s, '{T.TYPE}' AS p, '{EX}Customer' AS o FROM customer UNION ALL SELECT '{EX}customer' || c_custkey, '{T.LABEL}', c_name FROM customer
  UNION ALL SELECT '{EX}customer' || c_custkey, '{FLAG}', 'F' FROM customer WHERE c_acctbal > 5000),
edits AS (SELECT o_orderkey * 2 AS seq, '{EX}customer' || o_custkey AS s, o_orderstatus AS st, o_orderpriority[1:1] AS pr FROM orders),
named AS (
  SELECT -1 AS seq, TRUE AS there, * FROM own
  UNION ALL SELECT seq, pr = '1', s, '{FLAG}', st FROM edits WHERE pr IN ('1', '2')
  UNION ALL SELECT seq, TRUE, s, '{T.TYPE}', unnest(['{T.NAMED_INDIVIDUAL}', '{EX}Again']) FROM edits WHERE pr = '5' UNION ALL SELECT seq, TRUE, s, '{T.LABEL}', 'again ' || st FROM edits WHERE pr = '5'
  UNION ALL SELECT seq + 1, TRUE, s, '{EX}note', st FROM edits WHERE pr = '4'),
wiped AS (
  SELECT s, NULL AS p, seq FROM edits WHERE pr = '3' AND st = 'F' UNION ALL SELECT s, '{EX}note', seq FROM edits WHERE pr = '4' UNION ALL SELECT s, '{FLAG}', seq FROM edits WHERE pr = '3' AND st = 'O'),
last AS (SELECT s, p, o, max(seq) AS seq, arg_max(there, seq) AS there FROM named GROUP BY ALL)
SELECT s, p, o FROM last l WHERE there AND NOT EXISTS (SELECT 1 FROM wiped w WHERE w.s = l.s AND (w.p IS NULL OR w.p = l.p) AND w.seq > l.seq)
"""


@query(_LOG)
def edited_individuals(spark, sf_dir):
    """Orders as a log of edits of customers: flags added and removed, notes replaced, customers deleted and made again."""
    orders = read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("seq"), mapping.iri("customer", F.col("o_custkey")).alias("iri"), F.col("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("pr"))
    of = lambda test: orders.filter(test)
    again = of("pr = '5'").select("seq", "iri", F.lit(EX + "Again").alias("cls"), F.concat(F.lit("again "), "st").alias("label"))
    log = [
        edit_log.row(of("pr = '1'"), "add", "iri", F.lit(FLAG), F.col("st"), "literal"), edit_log.row(of("pr = '2'"), "remove", "iri", F.lit(FLAG), F.col("st"), "literal"), edit_log.row(of("pr = '3' and st = 'F'"), "delete", "iri"),
        edit_log.row(of("pr = '3' and st = 'O'"), "clear", "iri", F.lit(FLAG)), edit_log.replaced(of("pr = '4'"), {EX + "note": "st"}), edit_log.created(again),
    ]
    return edit_log.applied(_customers(spark, sf_dir), reduce(DataFrame.unionByName, log), ABOX).select("s", "p", "o")


# Vocabularies.
_VOCABULARY = f"""
WITH c AS (SELECT '{EX}concept' || p_partkey AS s, p_partkey AS k, p_brand, p_size FROM part), v AS (
  SELECT s, 'inScheme' AS p, '{EX}scheme' || p_brand AS o FROM c UNION ALL SELECT s, 'related', '{EX}concept' || (k * 7 % (SELECT max(p_partkey) FROM part) + 1) FROM c UNION ALL SELECT s, 'broader', '{EX}concept' || (k // 2) FROM c WHERE k > 1
  UNION ALL SELECT DISTINCT '{EX}scheme' || p_brand, 'title', p_brand FROM c)
"""


def _vocabulary(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("s", mapping.iri("concept", F.col("p_partkey")))
    most = p.select(F.max("p_partkey")).first()[0]  # one number
    scheme = F.concat(F.lit(EX + "scheme"), "p_brand")
    concepts = mapping.describe(p, F.col("s"), ABOX, mapping.to_iri(SKOS + "inScheme", scheme), mapping.to_iri(SKOS + "related", mapping.iri("concept", F.col("p_partkey") * 7 % most + 1)), mapping.to_iri(SKOS + "broader", F.when(F.col("p_partkey") > 1, mapping.iri("concept", F.floor(F.col("p_partkey") / 2)))))
    return concepts.unionByName(mapping.describe(p.select("p_brand").distinct(), scheme, ABOX, mapping.to_literal("title", F.col("p_brand"))))


@query(
    f"{_VOCABULARY}, gone AS (SELECT s FROM c WHERE p_size % 4 = 1), left_ AS (SELECT * FROM v WHERE s NOT IN (SELECT s FROM gone) AND NOT (p = 'related' AND o IN (SELECT s FROM gone))),"
    f" out_ AS (SELECT s FROM left_ WHERE p = 'inScheme' AND o = '{EX}schemeBrand#13' UNION SELECT '{EX}schemeBrand#13') SELECT s, p, o FROM left_ WHERE s NOT IN (SELECT s FROM out_)"
)
def deleted_concepts(spark, sf_dir):
    """A vocabulary after concepts and then a scheme with its concepts were deleted."""
    v = _vocabulary(spark, sf_dir)
    gone = read(spark, sf_dir, "part").filter("p_size % 4 = 1").select(mapping.iri("concept", F.col("p_partkey")).alias("iri"))
    left = edit_log.without_concepts(v, gone, SKOS + "related")
    schemes = spark.createDataFrame([(EX + "schemeBrand#13",)], "iri string")
    return edit_log.without_schemes(left, schemes, SKOS + "inScheme").select("s", F.element_at(F.split("p", "#"), -1).alias("p"), "o")


_BROADER = (
    "WITH RECURSIVE r AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 5 = 2 AND p_partkey > 2 UNION SELECT p_partkey // 4, p_partkey FROM part WHERE p_partkey % 23 = 0 AND p_partkey > 3),"
    " u(a, b) AS (SELECT a, b FROM r UNION SELECT u.a, r.b FROM u JOIN r ON u.b = r.a), s AS (SELECT x.a, x.b FROM u x JOIN u y ON x.a = y.b AND x.b = y.a)"
)


def _broader(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    half, quarter = F.floor(k / 2).cast("long"), F.floor(k / 4).cast("long")
    link = lambda test, a, b: p.filter(test).select(a.alias("a"), b.alias("b"))
    return link("p_partkey > 1", k, half).unionByName(link("p_partkey % 5 = 2 and p_partkey > 2", half, k)).unionByName(link("p_partkey % 23 = 0 and p_partkey > 3", quarter, k)).distinct()


@query(f"{_BROADER} SELECT lpad(a::VARCHAR, 9, '0') AS iri, lpad(min(b)::VARCHAR, 9, '0') AS root FROM s GROUP BY a")
def broader_cycles(spark, sf_dir):
    """Concepts whose broader links lead back to them."""
    name = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    links = _broader(spark, sf_dir).select(name("a").alias("iri"), F.lit("broader").alias("kind"), name("b").alias("other"))
    nothing = spark.createDataFrame([], "iri string, scheme string, mapped string, status string, origin string")
    labels = spark.createDataFrame([], "iri string, kind string, value string, lang string")
    broken = terminology.broken_rules(nothing, labels, links, spark.createDataFrame([], "scheme string"))
    return broken.filter("rule = 'broader cycle'").select("iri", F.col("detail").alias("root"))


@query(f"{_BROADER}, m AS (SELECT a, min(b) AS root FROM s GROUP BY a), d AS (SELECT DISTINCT root FROM m JOIN part ON p_partkey = a AND p_size > 10) SELECT root, count(*) AS n, md5('cycle|' || string_agg(lpad(a::VARCHAR, 9, '0'), '|' ORDER BY a)) AS signature FROM m JOIN d USING (root) GROUP BY root")
def subclass_cycle_conflicts(spark, sf_dir):
    """Cycles of classes as conflicts, where a member is declared."""
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    links = _broader(spark, sf_dir).select(name(F.col("a")).alias("child"), name(F.col("b")).alias("parent"))
    classes = read(spark, sf_dir, "part").filter("p_size > 10").select(name(F.col("p_partkey")).alias("iri"), F.col("p_name").alias("label"))
    found = conflicts.subclass_cycles(conflicts.Schema(classes, None, links, None, None, None, None))
    return found.select(F.array_min("entities").cast("long").alias("root"), F.size("entities").cast("long").alias("n"), F.md5(F.col("signature").cast("binary")).alias("signature"))


@query(
    f"{_VOCABULARY} SELECT o AS scheme, count(*) AS n FROM v WHERE p = 'inScheme' GROUP BY o"
)
def concepts_per_scheme(spark, sf_dir):
    return views.concepts_per_scheme(_vocabulary(spark, sf_dir), SKOS + "inScheme").select("scheme", "n")


# Duplicates: gathered by label, judged, grouped, renamed, with what refers to them.
_DUPLICATES = f"""
WITH RECURSIVE p AS (SELECT '{EX}part' || p_partkey AS iri, p_partkey AS k, p_name, p_brand, p_size FROM part),
firsts AS (SELECT p_name, min(iri) AS iri, arg_min(k, iri) AS k FROM p GROUP BY p_name), pairs AS (SELECT x.iri AS a, y.iri AS b FROM firsts x JOIN p y ON x.p_name = y.p_name AND x.iri < y.iri WHERE (x.k + y.k) % 4 <> 0),
u AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), c(node, other) AS (SELECT a, b FROM u UNION SELECT c.node, u.b FROM c JOIN u ON c.other = u.a),
roots AS (SELECT node, least(min(other), node) AS root FROM c GROUP BY node),
q AS (SELECT iri AS s, 'label' AS p, p_name AS o FROM p UNION ALL SELECT iri, 'brand', p_brand FROM p UNION ALL SELECT '{EX}line' || l_orderkey || '_' || l_linenumber, 'of', '{EX}part' || l_partkey FROM lineitem)
SELECT DISTINCT coalesce(x.root, s) AS s, p, CASE WHEN p = 'of' THEN coalesce(y.root, o) ELSE o END AS o FROM q LEFT JOIN roots x ON x.node = s LEFT JOIN roots y ON y.node = o AND p = 'of'
"""


@query(_DUPLICATES)
def merged_duplicates_flow(spark, sf_dir):
    """Parts of one name, but for pairs that the judge rejects, become one; line items follow."""
    p, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    iri = mapping.iri("part", F.col("p_partkey"))
    quads = mapping.describe(p, iri, ABOX, mapping.to_literal("label", F.col("p_name")), mapping.to_literal("brand", F.col("p_brand")))
    quads = quads.unionByName(mapping.describe(line, F.concat(F.lit(EX + "line"), "l_orderkey", F.lit("_"), "l_linenumber"), ABOX, mapping.to_iri("of", mapping.iri("part", F.col("l_partkey")))))
    entities = p.select(iri.alias("iri"), F.col("p_name").alias("label"))
    key = lambda c: F.substring(c, len(EX + "part") + 1, 20).cast("long")
    decisions = similarity.string_candidates(entities, 1.0).select("iri_a", "iri_b", ((key("iri_a") + key("iri_b")) % 4 != 0).alias("keep"))
    names = pipelines.duplicates_to_merge(entities, None, decisions, 1.0)
    return pipelines.merge_duplicates(quads, names).select("s", "p", "o")


# Versions as trees: names of customers before and after some were changed, some went and some came.
_VERSIONS = (
    f"WITH a AS (SELECT '<{EX}customer' || c_custkey || '> <{T.LABEL}> \"' || c_name || '\" <{ABOX}> .' AS line FROM customer), b AS (SELECT '<{EX}customer' || c_custkey || '> <{T.LABEL}> \"' || c_name || CASE WHEN c_custkey % 40 = 3 THEN ' new' ELSE '' END || '\" <{ABOX}> .' AS line"
    f" FROM customer WHERE c_custkey % 97 <> 5 UNION ALL SELECT '<{EX}customer' || (c_custkey + 1000000000) || '> <{T.LABEL}> \"' || c_name || '\" <{ABOX}> .' FROM customer WHERE c_custkey % 150 = 7),"
    " d AS (SELECT 'added' AS op, line FROM b WHERE line NOT IN (SELECT line FROM a) UNION ALL SELECT 'removed', line FROM a WHERE line NOT IN (SELECT line FROM b))"
)


@query(f"{_VERSIONS} SELECT op, line, (SELECT count(DISTINCT sha256(line)[1:2]) FROM d) AS ranges_read, (SELECT count(DISTINCT sha256(line)[1:2]) FROM (FROM a UNION FROM b)) AS ranges FROM d")
def version_diff(spark, sf_dir):
    """Lines that differ between two versions, and how many of the ranges were read for them."""
    c, key = read(spark, sf_dir, "customer"), F.col("c_custkey")
    layer = lambda rows, k, name: mapping.describe(rows, mapping.iri("customer", k), ABOX, mapping.to_literal(T.LABEL, name))
    changed = F.when(key % 40 == 3, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name"))
    after = layer(c.filter("c_custkey % 97 <> 5"), key, changed).unionByName(layer(c.filter("c_custkey % 150 = 7"), key + 1_000_000_000, F.col("c_name")))
    at = fresh_dir(spark, "versions")
    merkle.write_version(layer(c, key, F.col("c_name")), f"{at}/a")
    merkle.write_version(after, f"{at}/b")
    lines, n, every = merkle.diff(spark, f"{at}/a", f"{at}/b")
    return lines.withColumn("ranges_read", F.lit(n).cast("long")).withColumn("ranges", F.lit(every).cast("long"))
