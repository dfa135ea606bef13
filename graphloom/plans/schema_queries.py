"""Queries over the schema layer that ``mapping.to_schema`` makes of the parts, and its instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import algebra as A
from graphloom.operators import conflicts, extraction, graph, similarity, terminology, validation, views
from graphloom.plans.catalog import norm_sql, pascal_sql, query, read
from graphloom.plans.shared import cut
from graphloom.sources import mapping
from graphloom.sources.mapping import ABOX, EX, TBOX

#: The same layer in SQL: parts, subclass links, their closure (two steps deep), disjoint and equivalent pairs.
LAYER = f"""
p AS (SELECT p_partkey AS k, '{EX}part' || p_partkey AS c, '{EX}Type' || {pascal_sql('p_type')} AS t, '{EX}Brand' || {pascal_sql('p_brand')} AS b, '{EX}has' || p_partkey AS h,
      CASE WHEN p_size < 25 THEN 'ships ' ELSE 'the ' END || p_name AS h_label, * FROM part),
sub AS (SELECT c AS child, t AS parent FROM p UNION SELECT c, b FROM p UNION SELECT t, '{EX}Item' FROM p UNION SELECT b, '{EX}Make' FROM p),
up AS (SELECT child AS node, parent AS anc FROM sub UNION SELECT x.child, y.parent FROM sub x JOIN sub y ON x.parent = y.child),
dis AS (SELECT b AS x, t AS y FROM p WHERE p_size = 7 UNION SELECT t, c FROM p WHERE p_size = 11),
equ AS (SELECT DISTINCT b AS x, t AS y FROM p WHERE p_size = 7 AND p_retailprice > 950),
classes AS (SELECT c AS iri, p_name AS label FROM p UNION SELECT t, min(p_type) FROM p GROUP BY t UNION SELECT b, min(p_brand) FROM p GROUP BY b),
slots AS (SELECT h AS prop, 'domain' AS slot, t AS cls FROM p UNION SELECT h, 'domain', b FROM p UNION SELECT h, 'range', c FROM p UNION SELECT h, 'range', t FROM p WHERE p_size > 40),
facts AS (SELECT DISTINCT '{EX}line' || l_orderkey || '_' || l_linenumber AS s, '{EX}has' || l_suppkey AS prop, '{EX}line' || l_orderkey || '_' || (l_linenumber - 1) AS o FROM lineitem),
types AS (SELECT DISTINCT '{EX}line' || l_orderkey || '_' || l_linenumber AS ind, '{EX}part' || l_partkey AS cls FROM lineitem),
closed AS (SELECT ind, cls FROM types UNION SELECT ind, anc FROM types JOIN up ON cls = node)
"""


def _schema(spark, sf_dir):
    return conflicts.schema_of(mapping.to_schema(spark, sf_dir))


def _up(spark, sf_dir):
    return cut(graph.ancestors(_schema(spark, sf_dir).subclass))


def _pair(quads, p):
    return quads.filter(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


@query(f"WITH {LAYER} SELECT node, anc FROM up")
def schema_ancestors(spark, sf_dir):
    return _up(spark, sf_dir).select("node", "anc")


@query(f"WITH {LAYER} SELECT DISTINCT 'disjoint_subclass|' || least(x, y) || '|' || greatest(x, y) AS signature FROM dis WHERE EXISTS (SELECT 1 FROM up WHERE (node = x AND anc = y) OR (node = y AND anc = x))")
def conflict_disjoint_subclass(spark, sf_dir):
    return conflicts.disjoint_subclasses(_schema(spark, sf_dir), _up(spark, sf_dir)).select("signature")


@query(
    f"WITH {LAYER} SELECT DISTINCT 'disjoint_common|' || u.node || '|' || least(x, y) || '|' || greatest(x, y) AS signature FROM dis JOIN up u ON u.anc = x JOIN up v ON v.anc = y AND u.node = v.node WHERE u.node <> x AND u.node <> y"
)
def conflict_disjoint_common(spark, sf_dir):
    return conflicts.disjoint_common(_schema(spark, sf_dir), _up(spark, sf_dir)).select("signature")


_NARROW = "SELECT prop, s.cls FROM slots s WHERE slot = '{slot}' AND NOT EXISTS (SELECT 1 FROM slots o JOIN up ON up.node = o.cls AND up.anc = s.cls WHERE o.prop = s.prop AND o.slot = s.slot AND o.cls <> s.cls)"


@query(f"WITH {LAYER}, n AS ({_NARROW.format(slot='domain')}) SELECT 'domain_multi|' || prop AS signature, count(*) AS n FROM n GROUP BY prop HAVING count(*) >= 2")
def conflict_domain_multi(spark, sf_dir):
    found = conflicts.multiple_values(_schema(spark, sf_dir).domains, _up(spark, sf_dir), "domain_multi")
    return found.select("signature", (F.size("entities") - 1).cast("long").alias("n"))


@query(
    f"WITH {LAYER}, w AS (SELECT h, {norm_sql('h_label')} AS norm, {norm_sql('p_name')} AS part_name, {norm_sql('p_type')} AS type_name, p_size FROM p),"
    " stems AS (SELECT h, left(norm, length(norm) - length(part_name) - 1) AS stem FROM w WHERE ends_with(norm, ' ' || part_name) UNION SELECT h, left(norm, length(norm) - length(type_name) - 1) FROM w WHERE p_size > 40 AND ends_with(norm, ' ' || type_name)),"
    " best AS (SELECT h, arg_min(stem, length(stem)) AS stem FROM stems WHERE stem NOT IN ('', 'be', 'is', 'are', 'was', 'were', 'has', 'have', 'had', 'with') GROUP BY h)"
    " SELECT 'predspec|' || stem || '|' || string_agg(h, '|' ORDER BY h) AS signature, count(*) AS n FROM best GROUP BY stem HAVING count(*) >= 2"
)
def conflict_predicate_specialization(spark, sf_dir):
    return conflicts.predicate_specialization(_schema(spark, sf_dir)).select("signature", F.size("entities").cast("long").alias("n"))


@query(
    f"WITH {LAYER}, n AS ({_NARROW.format(slot='domain')}), r AS ({_NARROW.format(slot='range')}), k AS ("
    "SELECT 'disjoint_subclass' AS ctype, count(DISTINCT (least(x, y), greatest(x, y))) AS n FROM dis WHERE EXISTS (SELECT 1 FROM up WHERE (node = x AND anc = y) OR (node = y AND anc = x))"
    " UNION ALL SELECT 'disjoint_common', count(DISTINCT (u.node, least(x, y), greatest(x, y))) FROM dis JOIN up u ON u.anc = x JOIN up v ON v.anc = y AND u.node = v.node WHERE u.node <> x AND u.node <> y"
    " UNION ALL SELECT 'equiv_disjoint', count(*) FROM equ SEMI JOIN dis USING (x, y)"
    " UNION ALL SELECT 'domain_multi', count(*) FROM (SELECT prop FROM n GROUP BY prop HAVING count(*) >= 2) UNION ALL SELECT 'range_multi', count(*) FROM (SELECT prop FROM r GROUP BY prop HAVING count(*) >= 2)"
    " UNION ALL SELECT 'predicate_specialization', 2) SELECT ctype, CASE WHEN ctype IN ('domain_multi', 'range_multi', 'predicate_specialization') THEN 1 ELSE 0 END AS rank, n FROM k WHERE n > 0"
)
def conflict_detect(spark, sf_dir):
    """All rules over the layer; two stems (ships, the) make a family each."""
    return conflicts.detect(mapping.to_schema(spark, sf_dir)).groupBy("ctype", "rank").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LAYER} SELECT ind, cls FROM closed")
def type_closure(spark, sf_dir):
    return validation.type_closure(validation.direct_types(mapping.to_items(spark, sf_dir)), _up(spark, sf_dir))


_ENEMY = "d2 AS (SELECT x, y FROM dis UNION SELECT y, x FROM dis), over_ AS (SELECT prop, slot, cls, cls AS o FROM slots UNION SELECT prop, slot, cls, anc FROM slots JOIN up ON cls = node), against AS (SELECT DISTINCT prop, slot, cls, y AS enemy FROM over_ JOIN d2 ON o = x)"


@query(
    f"WITH {LAYER}, {_ENEMY}, hit AS (SELECT f.s, f.prop, f.o, count(DISTINCT a.cls) AS n FROM facts f JOIN closed c ON c.ind = f.s JOIN against a ON a.prop = f.prop AND a.slot = 'domain' AND a.enemy = c.cls GROUP BY ALL)"
    " SELECT s AS individual, s || '|' || prop || '|' || o AS detail FROM hit WHERE n = (SELECT count(*) FROM slots WHERE slots.prop = hit.prop AND slot = 'domain')"
)
def domain_violations(spark, sf_dir):
    tbox, abox, up = mapping.to_schema(spark, sf_dir), mapping.to_items(spark, sf_dir), _up(spark, sf_dir)
    disjoint = cut(_pair(tbox, T.DISJOINT))
    sets = validation.class_sets(validation.direct_types(abox), up, validation.disjoint_classes(disjoint))
    links = abox.filter(F.col("p") != T.TYPE).select(F.col("p").alias("prop"), F.col("s").alias("ind"), F.concat_ws("|", "s", "p", "o").alias("fact"))
    return validation.slot_conflicts(links, validation.slot_members(tbox, T.DOMAIN), sets, disjoint, up, "domain").select("individual", "detail")


@query(
    f"WITH {LAYER}, {_ENEMY}, hit AS (SELECT slot, f.s, f.prop, f.o, count(DISTINCT a.cls) AS n FROM facts f JOIN closed c ON true JOIN against a ON a.prop = f.prop AND a.enemy = c.cls AND c.ind = CASE slot WHEN 'domain' THEN f.s ELSE f.o END GROUP BY ALL),"
    " bad AS (SELECT slot AS kind FROM hit WHERE n = (SELECT count(*) FROM slots WHERE slots.prop = hit.prop AND slots.slot = hit.slot)"
    " UNION ALL SELECT 'disjoint' FROM (SELECT DISTINCT a.ind, x, y FROM closed a JOIN dis ON a.cls = x JOIN closed b ON b.ind = a.ind AND b.cls = y))"
    " SELECT kind AS type, CASE kind WHEN 'disjoint' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM bad GROUP BY ALL"
)
def instance_validation(spark, sf_dir):
    return validation.validate(mapping.to_schema(spark, sf_dir), mapping.to_items(spark, sf_dir)).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {LAYER} SELECT DISTINCT a.ind AS individual, least(x, y) || '|' || greatest(x, y) AS detail FROM closed a JOIN dis ON a.cls = x JOIN closed b ON b.ind = a.ind AND b.cls = y ORDER BY left(sha256('disjoint|' || individual || '|' || detail), 16) LIMIT 500"
)
def violation_report(spark, sf_dir):
    disjoint = cut(_pair(mapping.to_schema(spark, sf_dir), T.DISJOINT))
    sets = validation.class_sets(validation.direct_types(mapping.to_items(spark, sf_dir)), _up(spark, sf_dir), validation.disjoint_classes(disjoint))
    return validation.report(validation.disjoint_types(sets, disjoint))[0].select("individual", "detail")


@query("SELECT '" + EX + "order' || o_orderkey AS individual, o_orderpriority AS detail FROM orders UNION SELECT '" + EX + "order' || o_orderkey, o_totalprice::VARCHAR FROM orders WHERE o_orderkey % 4 = 0 AND false")
def datatype_violations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    abox = mapping.describe(orders, mapping.iri("order", F.col("o_orderkey")), ABOX, mapping.to_literal(EX + "rank", F.col("o_orderpriority")), mapping.to_literal(EX + "price", F.col("o_totalprice")))
    one = spark.range(1)
    tbox = mapping.describe(one, mapping.iri("rank"), TBOX, mapping.to_iri(T.RANGE, F.lit(T.XSD + "integer"))).unionByName(mapping.describe(one, mapping.iri("price"), TBOX, mapping.to_iri(T.RANGE, F.lit(T.XSD + "decimal"))))
    return validation.wrong_datatypes(abox, tbox).select("individual", "detail")


@query(
    f"SELECT '{EX}customer' || c_custkey AS individual, CASE c_custkey % 3 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'n/a' END AS detail FROM customer WHERE c_custkey % 3 < 2"
)
def placeholder_violations(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 3 == 0, " Unknown ").when(F.col("c_custkey") % 3 == 1, "n/a").otherwise(F.col("c_name"))
    abox = mapping.describe(c, mapping.iri("customer", F.col("c_custkey")), ABOX, mapping.to_iri(T.TYPE, mapping.iri("Customer")), mapping.to_literal(T.LABEL, label))
    return validation.placeholders(abox, validation.direct_types(abox)).select("individual", "detail")


@query(
    f"SELECT '{EX}customer' || c_custkey AS focus, 'nodeKind' AS constraint, c_acctbal::VARCHAR AS value FROM customer UNION SELECT '{EX}customer' || c_custkey, 'datatype', '{EX}nation' || c_nationkey FROM customer"
    f" UNION SELECT '{EX}customer' || c_custkey, 'class', '{EX}nation' || c_nationkey FROM customer UNION SELECT '{EX}order' || o_orderkey, 'class', '{EX}customer' || o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"
)
def shacl_kinds(spark, sf_dir):
    """nodeKind, datatype and class; a nation is no region, and a balance is no IRI."""
    rows = [
        ("a", EX + "Customer", EX + "balance", None, T.SH + "IRI", None, None), ("b", EX + "Customer", EX + "inNation", None, None, T.XSD + "string", None),
        ("c", EX + "Customer", EX + "inNation", None, T.SH + "IRI", None, EX + "Region"), ("d", EX + "Order", EX + "placedBy", 1, None, None, EX + "Customer"), ("e", EX + "Customer", EX + "balance", 1, T.SH + "Literal", T.XSD + "decimal", None),
    ]
    shapes = spark.createDataFrame(rows, "shape string, target string, path string, min_count int, node_kind string, datatype string, class_ string")
    return validation.shacl(shapes, mapping.to_quads(spark, sf_dir)).select("focus", "constraint", "value").distinct()


@query("SELECT 'shape' || n_nationkey AS shape, n_name AS target, 'path' || n_regionkey AS path, n_regionkey AS min_count FROM nation")
def shacl_read(spark, sf_dir):
    n, bnode = read(spark, sf_dir, "nation"), F.concat(F.lit("b"), F.col("n_nationkey"))
    shape = F.concat(F.lit("shape"), F.col("n_nationkey"))
    quads = mapping.describe(n, shape, TBOX, mapping.to_iri(T.SH + "targetClass", F.col("n_name")), mapping.to_iri(T.SH + "property", bnode)).unionByName(
        mapping.describe(n, bnode, TBOX, mapping.to_iri(T.SH + "path", F.concat(F.lit("path"), F.col("n_regionkey"))), mapping.to_literal(T.SH + "minCount", F.col("n_regionkey"), T.XSD + "integer"))
    )
    return validation.read_shapes(quads).select("shape", "target", "path", "min_count")


# Views of the layer.
@query(f"WITH {LAYER} SELECT h AS iri, 'object' AS kind, h_label AS label, array_to_string(list_sort([t, b]), ',') AS domains, CASE WHEN p_size > 40 THEN array_to_string(list_sort([c, t]), ',') ELSE c END AS ranges FROM p")
def property_view(spark, sf_dir):
    tbox = mapping.to_schema(spark, sf_dir)
    return views.property_view(tbox, views.labels(tbox)).select("iri", "kind", "label", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"))


@query(f"WITH {LAYER}, n AS (SELECT cls, count(*) AS n FROM types GROUP BY cls) SELECT iri, label, coalesce(n, 0) AS n FROM classes LEFT JOIN n ON iri = cls")
def class_list(spark, sf_dir):
    tbox = mapping.to_schema(spark, sf_dir)
    return views.class_list(conflicts.schema_of(tbox).classes.select("iri", "label"), views.class_counts(mapping.to_items(spark, sf_dir)))


@query(
    f"WITH {LAYER}, n AS (SELECT 'subclass' AS facet, child AS a, parent AS b FROM sub UNION SELECT 'disjoint', x, y FROM dis UNION SELECT 'equivalent', x, y FROM equ)"
    " SELECT facet, a AS node, b AS other FROM n WHERE a IN (SELECT t FROM p) UNION SELECT 'of_' || facet, b, a FROM n WHERE b IN (SELECT t FROM p)"
)
def class_neighbourhood(spark, sf_dir):
    s = _schema(spark, sf_dir)
    facet = lambda d, name: d.toDF("a", "b").select(F.lit(name).alias("facet"), "a", "b")
    edges = facet(s.subclass.select("child", "parent"), "subclass").unionByName(facet(s.disjoint.select("a", "b"), "disjoint")).unionByName(facet(s.equivalent.select("a", "b"), "equivalent"))
    return graph.neighbourhood(edges, read(spark, sf_dir, "part").select(mapping.type_iri("Type", F.col("p_type")).alias("node")).distinct())


@query(f"WITH {LAYER}, g AS (SELECT p_size AS grp, c FROM p), m AS (SELECT grp, anc, count(DISTINCT c) AS n FROM g JOIN up ON c = node GROUP BY ALL) SELECT grp::VARCHAR AS grp, anc FROM m WHERE n = (SELECT count(DISTINCT c) FROM g WHERE g.grp = m.grp)")
def common_superclasses(spark, sf_dir):
    members = read(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("group"), mapping.iri("part", F.col("p_partkey")).alias("cls"))
    return terminology.common_superclasses(members, _up(spark, sf_dir)).select(F.col("group").alias("grp"), "anc")


@query(f"WITH {LAYER} SELECT count(DISTINCT iri) AS classes, (SELECT count(*) FROM p) AS properties, (SELECT count(*) FROM sub) + (SELECT count(*) FROM dis) + (SELECT count(*) FROM equ) AS axioms FROM classes")
def schema_stats(spark, sf_dir):
    return views.ontology_stats(mapping.to_schema(spark, sf_dir))


# Similar entities.
@query(f"WITH l AS (SELECT p_partkey AS k, {norm_sql('p_name')} AS norm FROM part), f AS (SELECT norm, min(k) AS first FROM l GROUP BY norm) SELECT first AS iri_a, k AS iri_b, 1.0::DOUBLE AS score FROM l JOIN f USING (norm) WHERE k <> first")
def duplicate_labels(spark, sf_dir):
    return similarity.string_candidates(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("label")), 1.0)


@query(
    f"WITH {LAYER}, pairs AS (SELECT c AS a, c || 'x' AS b FROM p UNION SELECT c, '{EX}customer' || p_size FROM p), told AS (SELECT '{EX}part' || p_partkey AS a, '{EX}customer' || p_size AS b FROM part WHERE p_size % 2 = 0)"
    " SELECT a AS iri_a, b AS iri_b FROM pairs ANTI JOIN told USING (a, b)"
)
def eligible_pairs(spark, sf_dir):
    """Brands and types hang together by the parts below them, so only pairs with strangers stay, but
    for those that are told apart."""
    s, part = _schema(spark, sf_dir), read(spark, sf_dir, "part")
    cls, customer = mapping.iri("part", F.col("p_partkey")), mapping.iri("customer", F.col("p_size"))
    to = lambda d, o: d.select(cls.alias("iri_a"), o.alias("iri_b"))
    pairs = to(part, F.concat(cls, F.lit("x"))).unionByName(to(part, customer)).unionByName(to(part, mapping.type_iri("Type", F.col("p_type"))))
    told = part.filter("p_size % 2 = 0").select(customer.alias("a"), cls.alias("b"))
    return similarity.eligible(pairs.distinct(), s.classes.select("iri", "label"), s.subclass, told, s.equivalent)


@query(
    "WITH s AS (SELECT o_custkey AS a, o_orderkey AS b, o_totalprice AS s FROM orders WHERE o_orderstatus <> 'F'), v AS (SELECT o_custkey AS a, o_orderkey AS b, o_totalprice / 2 AS v FROM orders WHERE o_orderstatus <> 'O')"
    " SELECT a AS iri_a, b AS iri_b, coalesce(v, s) AS score, CASE WHEN v IS NULL THEN 'string' ELSE 'embedding' END AS method FROM s FULL JOIN v USING (a, b)"
)
def candidate_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("iri_a"), F.col("o_orderkey").alias("iri_b"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return similarity.united(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus <> 'O'").withColumn("score", F.col("score") / 2))


@query("SELECT o_custkey AS iri_a, o_orderkey AS iri_b, o_totalprice AS score FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def judged_candidates(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("iri_a"), F.col("o_orderkey").alias("iri_b"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("keep"))
    return similarity.judged(o.drop("keep"), o.drop("score"))


@query(f"SELECT x.p_partkey AS a, (len(list_intersect([{norm_sql('x.p_name')}, {norm_sql('x.p_type')}], [{norm_sql('y.p_name')}, {norm_sql('y.p_brand')}])) > 0) AS shared FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1")
def label_overlap(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("a"), F.array("p_name", "p_type").alias("xs"))
    y = p.select((F.col("p_partkey") - 1).alias("b"), F.array("p_name", "p_brand").alias("ys"))
    return x.join(y, F.col("a") == F.col("b")).select("a", similarity.overlap(F.col("xs"), F.col("ys")).alias("shared"))


# Terminology.
def _concepts(spark, sf_dir):
    """Parts as concepts of their brand's scheme; larger ones map a customer or nobody."""
    p, c = read(spark, sf_dir, "part"), F.col
    return p.select(
        c("p_partkey").cast("string").alias("iri"), c("p_brand").alias("scheme"), c("p_name").alias("pref"), F.lit("en").alias("pref_lang"), F.array("p_type").alias("alts"), F.array().cast("array<string>").alias("hidden"),
        F.when(c("p_size") > 25, F.floor(c("p_partkey") * 3 / 4).cast("string")).alias("mapped"), F.when(c("p_size") % 5 == 0, "deprecated").otherwise("active").alias("status"), F.when(c("p_size") % 2 == 0, "agent").otherwise("manual").alias("origin"),
        F.when(c("p_size") % 3 == 0, "2024-05-01T00:00:00Z").when(c("p_size") % 3 == 1, "2023-01-01").alias("created"), F.lit(None).cast("string").alias("modified"), c("p_partkey").cast("string").alias("k"),
    )


@query(
    "SELECT p_partkey::VARCHAR AS iri, p_name AS pref FROM part WHERE p_size % 5 <> 0 AND p_size > 25 AND p_size % 2 = 0 AND p_size % 3 <> 1 AND contains(lower(p_name || '|' || p_type), 'ol')"
)
def concept_filters(spark, sf_dir):
    return views.filter_concepts(_concepts(spark, sf_dir), status="active", mapping="mapped", origin="agent", since="2024-01-01", until="2024-12-31", text=" OL ").select("iri", "pref")


@query("SELECT count(DISTINCT p_brand) AS schemes, count(*) AS concepts, count(*) * 2 AS labels, count(*) FILTER (p_size > 25) AS mapped, count(*) FILTER (NOT p_size > 25) AS unmapped FROM part")
def concept_stats(spark, sf_dir):
    return views.concept_stats(_concepts(spark, sf_dir))


@query("SELECT x.p_partkey::VARCHAR AS iri, coalesce(y.p_name, (x.p_partkey + 1)::VARCHAR) || ',' || coalesce(z.p_name, (x.p_partkey + 2)::VARCHAR) AS labels FROM part x LEFT JOIN part y ON y.p_partkey = x.p_partkey + 1 LEFT JOIN part z ON z.p_partkey = x.p_partkey + 2")
def related_labels(spark, sf_dir):
    rows = _concepts(spark, sf_dir).withColumn("related", F.array(*[(F.col("k").cast("long") + i).cast("string") for i in (1, 2)]))
    return views.related_labels(rows, "related").select("iri", F.array_join("labels", ",").alias("labels"))


@query("WITH n AS (SELECT p_brand AS s, count(*) AS n, count(*) FILTER (p_size > 25) AS m FROM part GROUP BY p_brand) SELECT s AS scheme FROM n ORDER BY m DESC, n DESC, s LIMIT 1")
def default_scheme(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    return views.default_scheme(rows.select("scheme", F.lit("manual").alias("origin")).distinct(), rows, "no such scheme")


@query("SELECT p_partkey::VARCHAR AS iri, CASE WHEN p_size > 25 AND p_partkey * 3 // 4 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN (p_partkey * 3 // 4)::VARCHAR END AS mapped FROM part")
def drop_stale_mappings(spark, sf_dir):
    known = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("iri"))
    return terminology.drop_stale(_concepts(spark, sf_dir), known).select("iri", "mapped")


def _labels(rows):
    pref = rows.select("iri", F.lit("pref").alias("kind"), F.col("pref").alias("value"), F.col("pref_lang").alias("lang"))
    return pref.unionByName(rows.select("iri", F.lit("alt").alias("kind"), F.explode("alts").alias("value"), F.lit("en").alias("lang")))


@query(
    f"WITH c AS (SELECT p_partkey AS k, {norm_sql('p_name')} AS pn, {norm_sql('p_type')} AS tn, p_name, p_size FROM part), owned AS (SELECT pn AS n FROM c WHERE p_size > 25 UNION SELECT tn FROM c WHERE p_size > 25),"
    " free AS (SELECT p_name, min(k::VARCHAR) AS adopt FROM c WHERE NOT p_size > 25 GROUP BY p_name),"
    f" e AS (SELECT DISTINCT {norm_sql('p_name')} AS n, '{EX}e' || p_partkey AS iri, p_name AS label, p_partkey AS r FROM part WHERE p_size = 3 UNION ALL SELECT {norm_sql('s_name')}, '{EX}s' || s_suppkey, s_name, s_suppkey FROM supplier),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY r, iri) AS i FROM e)"
    " SELECT iri, CASE WHEN n IN (SELECT n FROM owned) OR i > 1 THEN 'conflict' WHEN adopt IS NOT NULL THEN 'adopt' ELSE 'add' END AS action, CASE WHEN n IN (SELECT n FROM owned) OR i > 1 THEN NULL WHEN adopt IS NOT NULL THEN adopt"
    f" ELSE 'http://v#concept-' || substr(iri, {len(EX) + 1}) END AS concept FROM o LEFT JOIN free ON label = p_name"
)
def sync_entities(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    one = read(spark, sf_dir, "part").filter("p_size = 3").select(F.concat(F.lit(EX + "e"), F.col("p_partkey")).alias("iri"), F.col("p_name").alias("label"), F.col("p_partkey").alias("rank"))
    two = read(spark, sf_dir, "supplier").select(F.concat(F.lit(EX + "s"), F.col("s_suppkey")).alias("iri"), F.col("s_name").alias("label"), F.col("s_suppkey").alias("rank"))
    return terminology.sync_entities(one.unionByName(two), rows, _labels(rows), "any", "http://v").select("iri", "action", "concept")


@query(
    f"WITH m AS (SELECT p_partkey::VARCHAR AS concept, (p_partkey * 3 // 4) AS e FROM part WHERE p_size > 25), n AS (SELECT concept, c_name AS label, {norm_sql('c_name')} AS norm FROM m JOIN customer ON e = c_custkey)"
    " SELECT arg_min(concept, concept) AS concept, label FROM n GROUP BY label, norm"
)
def missing_aliases(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    entities = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("iri"), F.col("c_name").alias("label"))
    return terminology.missing_aliases(entities, rows, _labels(rows), "Brand#13").select("concept", "label")


@query(
    "WITH c AS (SELECT (p_partkey * 3 // 4) AS e, min((p_partkey::VARCHAR, p_brand)) AS m FROM part WHERE p_size > 25 GROUP BY 1), k AS (SELECT e, m[1] AS iri, m[2] AS scheme FROM c)"
    " SELECT DISTINCT x.iri, y.iri AS other FROM k x JOIN k y ON y.e BETWEEN x.e + 1 AND x.e + 9 AND x.scheme = y.scheme WHERE x.iri <> y.iri AND x.e IN (SELECT c_custkey FROM customer)"
)
def missing_broader(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    sub = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("child"), F.explode(F.transform(F.sequence(F.col("c_custkey") + 1, F.col("c_custkey") + 9), lambda x: x.cast("string"))).alias("parent"))
    none = spark.createDataFrame([], "iri string, kind string, other string")
    return terminology.missing_broader(sub, rows, none)


@query(
    "WITH c AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS iri, p_brand, p_size, p_name FROM part), r AS (SELECT iri, (k + 1)::VARCHAR AS other FROM c WHERE k % 3 = 0),"
    " n AS (SELECT p_brand, p_name, count(*) AS n FROM c GROUP BY ALL)"
    " SELECT rule, count(*) AS n FROM (SELECT iri, 'scheme not found' AS rule FROM c WHERE p_brand = 'Brand#13' UNION ALL SELECT iri, 'label of another concept' FROM c JOIN n USING (p_brand, p_name) WHERE n > 1"
    " UNION ALL SELECT r.iri, 'relation leaves the scheme' FROM r JOIN c x ON r.iri = x.iri LEFT JOIN c y ON r.other = y.iri WHERE y.iri IS NULL OR x.p_brand <> y.p_brand UNION ALL SELECT iri, 'mapping is no absolute IRI' FROM c WHERE p_size > 25) GROUP BY rule"
)
def concept_rules(spark, sf_dir):
    rows = _concepts(spark, sf_dir)
    labels = _labels(rows).filter("kind = 'pref'")
    relations = rows.filter("cast(k as long) % 3 = 0").select("iri", F.lit("broader").alias("kind"), (F.col("k").cast("long") + 1).cast("string").alias("other"))
    schemes = rows.select("scheme").distinct().filter("scheme <> 'Brand#13'")
    return terminology.broken_rules(rows, labels, relations, schemes).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND c IS NOT NULL THEN c ELSE CASE o_orderstatus WHEN 'F' THEN 'pending' ELSE 'done' END END AS status FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def decide_queue(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "pending").otherwise("done").alias("status"))
    made = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq")).agg(F.max("l_returnflag").alias("status"))
    return terminology.decide(rows, made)


@query(
    "WITH p AS (SELECT doc_id AS chunk_id, md5(coalesce(lang, '')) AS signature, lang AS term, left(text, 5) AS evidence FROM documents WHERE contains(lower(text), lower(lang)) AND text <> '')"
    " SELECT min(chunk_id) AS chunk_id, signature FROM p WHERE term <> 'fr' GROUP BY signature"
)
def new_proposals(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    rows = d.filter("text <> ''").select(F.col("doc_id").alias("chunk_id"), F.md5(F.coalesce("lang", F.lit(""))).alias("signature"), F.col("lang").alias("term"), F.substring("text", 1, 5).alias("evidence"))
    known = spark.createDataFrame([("fr",)], "x string").select(F.md5("x").alias("signature"))
    return terminology.new_proposals(rows, known, d.select(F.col("doc_id").alias("chunk_id"), "text")).select("chunk_id", "signature")


# Extraction.
@query(f"SELECT {norm_sql('p_name')} AS norm, arg_min(p_partkey, (p_size, p_partkey)) AS iri FROM part GROUP BY 1")
def label_index(spark, sf_dir):
    return extraction.label_index(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("label"), F.col("p_size").alias("seq")))


@query(f"WITH v AS (SELECT {norm_sql('p_brand')} AS n, count(DISTINCT {norm_sql('p_name')}) AS c FROM part GROUP BY 1) SELECT p_name AS a, p_brand AS b, count(*) AS n FROM part WHERE {norm_sql('p_brand')} IN (SELECT n FROM v WHERE c <= 20) GROUP BY ALL UNION ALL SELECT p_name, 'only ' || p_partkey, 1 FROM part")
def popular_parents(spark, sf_dir):
    """Brands that more than twenty labels name are too general; a parent of its own is not."""
    p = read(spark, sf_dir, "part")
    axioms = p.select(F.col("p_name").alias("a"), F.col("p_brand").alias("b")).unionByName(p.select(F.col("p_name").alias("a"), F.concat(F.lit("only "), F.col("p_partkey")).alias("b")))
    return extraction.popular_parents(axioms, 20).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


_BASE = "http://v#"


@query(
    f"WITH x AS (SELECT '{_BASE}' || {pascal_sql('p_name')} AS c, '{_BASE}' || {pascal_sql('p_type')} AS t, p_name, p_partkey, p_size FROM part),"
    f" q AS (SELECT c AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM x UNION SELECT c, '{T.LABEL}', arg_min(p_name, p_partkey) FROM x GROUP BY c UNION SELECT c, '{T.SUBCLASS}', t FROM x WHERE c <> t AND p_size >= 10 UNION SELECT c, '{T.DISJOINT}', t FROM x WHERE c <> t AND p_size < 10)"
    " SELECT s, p, o FROM q"
)
def schema_delta(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("chunk_id", F.col("p_partkey")).withColumn("pos", F.lit(0))
    delta = {
        "classes": p.select("chunk_id", "pos", F.col("p_name").alias("label")),
        "properties": spark.createDataFrame([], "chunk_id long, pos int, label string, kind string, domain string, range string"),
        "axioms": p.select(F.when(F.col("p_size") < 10, "disjoint").otherwise("subclass").alias("type"), F.col("p_name").alias("a"), F.col("p_type").alias("b")),
    }
    return extraction.schema_quads(delta, TBOX, _BASE).select("s", "p", "o")


@query(
    f"WITH m AS (SELECT o_orderkey AS chunk, 'Order ' || o_orderkey AS label, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'odd' END AS cls, 'Order ' || (o_orderkey + 1) AS target FROM orders),"
    f" n AS (SELECT *, '{_BASE}ind-' || left(sha256({norm_sql('label')} || '|' || '{EX}' || cls), 12) AS iri FROM m WHERE cls <> 'odd')"
    f" SELECT 'quad' AS kind, iri AS s, '{T.TYPE}' AS p, '{EX}' || cls AS o FROM n UNION ALL SELECT 'quad', iri, '{T.LABEL}', label FROM n UNION ALL SELECT 'quad', a.iri, '{EX}next', b.iri FROM n a JOIN n b ON a.target = b.label"
    f" UNION ALL SELECT 'pending', a.iri, '{EX}next', target FROM n a WHERE target NOT IN (SELECT label FROM n) UNION ALL SELECT 'unknown', cls, NULL, count(*)::VARCHAR FROM m WHERE cls = 'odd' GROUP BY cls"
)
def merge_individuals(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("odd")
    name = lambda k: F.concat(F.lit("Order "), k)
    base = o.select(F.col("o_orderkey").alias("chunk_id"), F.lit(0).alias("pos"), name(F.col("o_orderkey")).alias("label"), cls.alias("class"), F.lit("next").alias("property"), name(F.col("o_orderkey") + 1).alias("target"))
    found = {"individuals": base.select("chunk_id", "pos", "label", "class"), "relations": base.select("chunk_id", "pos", "label", "property", "target"), "attributes": base.limit(0).select("chunk_id", "pos", "label", "property", F.col("target").alias("value"))}
    index = lambda *names: spark.createDataFrame([(n, EX + n) for n in names], "norm string, iri string")
    out = extraction.merge_individuals(found, index("done", "open"), index("next"), index().limit(0), ABOX, _BASE)
    rows = out["quads"].select(F.lit("quad").alias("kind"), "s", "p", "o").unionByName(out["pending"].select(F.lit("pending").alias("kind"), F.col("subj").alias("s"), F.col("prop").alias("p"), F.col("target").alias("o")))
    return rows.unionByName(out["unknown"].select(F.lit("unknown").alias("kind"), F.col("class").alias("s"), F.lit(None).cast("string").alias("p"), F.col("n").cast("string").alias("o")))


# Solutions.
@query("SELECT n_name AS nation, string_agg(DISTINCT c_mktsegment, ' ' ORDER BY c_mktsegment) AS segments, min(c_name) AS some FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def group_concat_sample(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), mapping.to_quads(spark, sf_dir).drop("g")
    segments = mapping.describe(c, mapping.iri("customer", F.col("c_custkey")), ABOX, mapping.to_literal(EX + "segment", F.col("c_mktsegment"))).drop("g")
    found = A.join(A.join(A.join(A.pattern(segments, "?c", EX + "segment", "?seg"), A.pattern(n, "?c", EX + "inNation", "?x")), A.pattern(n, "?x", T.LABEL, "?nation")), A.pattern(n, "?c", T.LABEL, "?name"))
    return found.groupBy(F.col("nation.value").alias("nation")).agg(A.group_concat("seg", distinct=True).alias("segments"), A.sample("name").alias("some"))
