"""Queries on hierarchies that change or are shown: closures kept up under edits, display forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans.catalog import query, read
from graphloom.sources import mapping

_LINKS = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 4, p_partkey FROM part WHERE p_partkey % 37 = 0 AND p_partkey // 4 > 0"
_EDITED = (
    f"WITH RECURSIVE e AS ({_LINKS}), gone AS (SELECT child, parent FROM e WHERE child % 11 = 3), plus AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 11 <> 3 AND p_partkey >= 3),"
    " kept AS (SELECT * FROM e WHERE child % 11 <> 3), final AS (SELECT * FROM kept UNION SELECT * FROM plus),"
    " c0(node, anc) AS (SELECT child, parent FROM e UNION SELECT c0.node, e.parent FROM c0 JOIN e ON c0.anc = e.child),"
    " c1(node, anc) AS (SELECT child, parent FROM kept UNION SELECT c1.node, kept.parent FROM c1 JOIN kept ON c1.anc = kept.child),"
    " c2(node, anc) AS (SELECT child, parent FROM final UNION SELECT c2.node, final.parent FROM c2 JOIN final ON c2.anc = final.child),"
    " g AS (SELECT * FROM gone EXCEPT SELECT * FROM plus), x AS (SELECT node, child, parent FROM c0 JOIN g ON anc = child UNION SELECT child, child, parent FROM g),"
    " lost AS (SELECT x.node, c0.anc FROM x JOIN c0 ON c0.node = x.parent UNION SELECT node, parent FROM x)"
)


@query(
    f"{_EDITED} SELECT node, anc, CASE WHEN EXISTS (SELECT 1 FROM c0 WHERE c0.node = c2.node AND c0.anc = c2.anc) AND NOT EXISTS (SELECT 1 FROM lost WHERE lost.node = c2.node AND lost.anc = c2.anc) THEN 'kept'"
    " WHEN EXISTS (SELECT 1 FROM c1 WHERE c1.node = c2.node AND c1.anc = c2.anc) THEN 'rederived' ELSE 'added' END AS change FROM c2"
    " UNION ALL SELECT node, anc, 'gone' FROM lost WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE c2.node = lost.node AND c2.anc = lost.anc)"
)
def closure_after_edits(spark, sf_dir):
    """A stored closure after every eleventh class lost its links and every thirteenth got one; what each pair went through."""
    tree = mapping.class_tree(spark, sf_dir)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))
    plus = part.filter("child % 13 = 0 and child % 11 <> 3 and child >= 3")
    return graph.maintained(graph.ancestors(tree), tree, tree.filter("child % 11 = 3"), plus)


@query(
    f"{_EDITED} SELECT change, count(*) AS n FROM (SELECT CASE WHEN c2.node IS NULL THEN 'gone' WHEN lost.node IS NOT NULL AND c1.node IS NOT NULL THEN 'rederived' WHEN lost.node IS NULL AND c0.node IS NOT NULL THEN 'kept' ELSE 'added' END AS change"
    " FROM c2 FULL JOIN lost ON c2.node = lost.node AND c2.anc = lost.anc LEFT JOIN c1 ON c1.node = c2.node AND c1.anc = c2.anc LEFT JOIN c0 ON c0.node = c2.node AND c0.anc = c2.anc) GROUP BY change"
)
def closure_touched(spark, sf_dir):
    """How many pairs the edits touch, and in which way."""
    return closure_after_edits(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# A hierarchy with several parents, cycles of two and three classes, standalone classes and parents that are no classes.
_TREE = (
    "WITH RECURSIVE cls AS (SELECT 'c' || p_partkey AS iri, p_name AS label FROM part WHERE p_partkey % 10 <> 9),"
    " links AS (SELECT 'c' || p_partkey AS child, 'c' || (p_partkey // 3) AS parent FROM part WHERE p_partkey % 10 < 7 AND p_partkey > 2"
    "  UNION SELECT 'c' || p_partkey, 'c' || (p_partkey // 5) FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 10 < 7 UNION SELECT 'c' || (p_partkey // 3), 'c' || p_partkey FROM part WHERE p_partkey % 50 = 31 UNION SELECT 'c' || p_partkey, 'c' || p_partkey FROM part WHERE p_partkey % 17 = 0),"
    " own AS (SELECT DISTINCT child, parent FROM links WHERE child <> parent AND child IN (SELECT iri FROM cls) AND parent IN (SELECT iri FROM cls)),"
    " up(node, anc) AS (SELECT child, parent FROM own UNION SELECT up.node, own.parent FROM up JOIN own ON up.anc = own.child),"
    " open AS (SELECT child, parent, label FROM own JOIN cls ON iri = parent WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.node = own.parent AND up.anc = own.child)),"
    " chosen AS (SELECT child, arg_min(parent, (label, parent)) AS parent, count(*) - 1 AS extra FROM open GROUP BY child),"
    " walk(node, place, depth) AS (SELECT iri, iri, 0 FROM cls UNION ALL SELECT node, c.parent, depth + 1 FROM walk JOIN chosen c ON walk.place = c.child),"
    " top AS (SELECT node, max(depth) AS depth, arg_max(place, depth) AS root FROM walk GROUP BY node), size AS (SELECT place AS node, count(*) AS branch FROM walk GROUP BY place)"
)


@query(
    f"{_TREE} SELECT t.node, c.parent, root, depth::INTEGER AS depth, branch, coalesce(extra, 0)::BIGINT AS extra, c.parent IS NULL AND branch = 1 AS standalone,"
    " (SELECT string_agg(place, '/' ORDER BY w.depth DESC) FROM walk w WHERE w.node = t.node) AS path FROM top t JOIN size s USING (node) LEFT JOIN chosen c ON c.child = t.node"
)
def display_forest(spark, sf_dir):
    """Primary parents, roots, depths, branches, paths and standalone classes of a hierarchy with cycles."""
    p = read(spark, sf_dir, "part")
    name, key = lambda k: F.concat(F.lit("c"), k.cast("long").cast("string")), F.col("p_partkey")
    link = lambda test, child, parent: p.filter(test).select(name(child).alias("child"), name(parent).alias("parent"))
    edges = link("p_partkey % 10 < 7 and p_partkey > 2", key, F.floor(key / 3)).unionByName(link("p_partkey % 4 = 1 and p_partkey % 10 < 7", key, F.floor(key / 5)))
    edges = edges.unionByName(link("p_partkey % 50 = 31", F.floor(key / 3), key)).unionByName(link("p_partkey % 17 = 0", key, key))
    classes = p.filter("p_partkey % 10 <> 9").select(name(key).alias("iri"), F.col("p_name").alias("label"))
    return graph.display_forest(classes, edges, paths=True).withColumn("path", F.array_join("path", "/"))


@query(
    "WITH RECURSIVE sub AS (SELECT p_type AS child, p_brand AS parent FROM part UNION SELECT p_name, p_type FROM part), named AS (SELECT child AS iri FROM sub UNION SELECT parent FROM sub), chosen AS (SELECT child, min(parent) AS parent, count(DISTINCT parent) - 1 AS extra FROM sub WHERE child <> parent GROUP BY child),"
    " walk(node, place, depth) AS (SELECT iri, iri, 0 FROM named UNION ALL SELECT node, c.parent, depth + 1 FROM walk JOIN chosen c ON walk.place = c.child), size AS (SELECT place AS node, count(*) AS branch FROM walk GROUP BY place)"
    " SELECT node, c.parent, branch, coalesce(extra, 0)::BIGINT AS extra FROM size LEFT JOIN chosen c ON c.child = node"
)
def display_tree(spark, sf_dir):
    """The forest of names below types below brands: a few roots with wide branches."""
    p = read(spark, sf_dir, "part")
    edges = p.select(F.col("p_type").alias("child"), F.col("p_brand").alias("parent")).unionByName(p.select(F.col("p_name").alias("child"), F.col("p_type").alias("parent"))).distinct()
    named = edges.select(F.col("child").alias("iri")).unionByName(edges.select(F.col("parent").alias("iri"))).distinct().withColumn("label", F.col("iri"))
    return graph.display_forest(named, edges).select("node", "parent", "branch", "extra")
