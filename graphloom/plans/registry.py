"""Registered queries of the knowledge-graph operators, with DuckDB SQL where SQL can say the same.

The graph comes from the test tables (``sources.mapping``); the SQL is over the tables themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import algebra as A
from graphloom.operators import conflicts, edits, graph, history, similarity, store, terminology, validation, views
from graphloom.plans import curation_queries, edit_queries, evidence_queries, hierarchy_queries, schema_queries, solution_queries, text_queries
from graphloom.plans.catalog import ORACLES, QUERIES, Query, query
from graphloom.plans.catalog import norm_sql as _norm
from graphloom.plans.catalog import pascal_sql as _pascal
from graphloom.plans.catalog import read as _read
from graphloom.sources import mapping
from graphloom.sources.mapping import ABOX, EX, TBOX

def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.to_quads(spark, sf_dir).drop("g")


_BINARY = "SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 4, p_partkey FROM part WHERE p_partkey % 37 = 0 AND p_partkey // 4 > 0"


# Scans and patterns.
@query(f"SELECT '{EX}customer' || c_custkey AS s, '{EX}nation' || c_nationkey AS o FROM customer UNION ALL SELECT '{EX}supplier' || s_suppkey, '{EX}nation' || s_nationkey FROM supplier")
def scan_pattern(spark, sf_dir):
    return store.match(mapping.to_quads(spark, sf_dir), p=EX + "inNation", graph=ABOX).select("s", "o")


@query(f"SELECT '{EX}order' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'F'")
def contains_probe(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir)
    probe = mapping.describe(_read(spark, sf_dir, "orders"), mapping.iri("order", F.col("o_orderkey")), ABOX, mapping.to_literal(EX + "status", F.lit("F")))
    return store.contains(quads, probe).select("s")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 0 AS boolean")
def ask_exists(spark, sf_dir):
    return A.ask(A.pattern(_triples(spark, sf_dir), "?o", EX + "status", A.lit("F")))


@query(
    f"SELECT '{ABOX}' AS g, (SELECT count(*) * 2 FROM region) + (SELECT count(*) * 3 FROM nation) + (SELECT count(*) * 5 FROM customer) + (SELECT count(*) * 3 FROM supplier)"
    " + (SELECT count(*) * 5 FROM part) + (SELECT count(*) * 4 FROM orders) AS n"
)
def count_by_graph(spark, sf_dir):
    return store.counts(mapping.to_quads(spark, sf_dir))


@query(f"SELECT '{EX}customer' || c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def bgp_join_2(spark, sf_dir):
    t = _triples(spark, sf_dir)
    found = A.join(A.pattern(t, "?c", T.TYPE, EX + "Customer"), A.join(A.pattern(t, "?c", EX + "inNation", "?x"), A.pattern(t, "?x", T.LABEL, "?n")))
    return A.projected(found, "c", "n")


@query("SELECT c_name AS name, n_name AS nation, c_acctbal::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def bgp_star(spark, sf_dir):
    t = _triples(spark, sf_dir)
    star = A.join(A.join(A.pattern(t, "?c", T.LABEL, "?name"), A.pattern(t, "?c", EX + "balance", "?b")), A.join(A.pattern(t, "?c", EX + "inNation", "?x"), A.pattern(t, "?x", T.LABEL, "?nation")))
    kept = star.withColumn("balance", A.number("b")).filter("balance > 5000")
    return kept.select(F.col("name.value").alias("name"), F.col("nation.value").alias("nation"), "balance")


@query(f"SELECT '{EX}customer' || c_custkey AS c, CASE WHEN o_orderkey IS NOT NULL THEN '{EX}order' || o_orderkey END AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
def optional_left(spark, sf_dir):
    t = _triples(spark, sf_dir)
    orders = A.join(A.pattern(t, "?o", EX + "placedBy", "?c"), A.pattern(t, "?o", EX + "status", "?st"))
    found = A.optional(A.pattern(t, "?c", T.TYPE, EX + "Customer"), orders, where=lambda v: v("st")["value"] == "F")
    return A.projected(found, "c", "o")


@query(f"SELECT '{EX}customer' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def minus_anti(spark, sf_dir):
    t = _triples(spark, sf_dir)
    urgent = A.join(A.pattern(t, "?o", EX + "placedBy", "?c"), A.pattern(t, "?o", EX + "priority", A.lit("1-URGENT")))
    return A.projected(A.minus(A.pattern(t, "?c", T.TYPE, EX + "Customer"), urgent))


@query(f"SELECT '{EX}customer' || c_custkey AS x FROM customer UNION ALL SELECT '{EX}supplier' || s_suppkey FROM supplier")
def union_alt(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return A.projected(A.union(A.pattern(t, "?x", T.TYPE, EX + "Customer"), A.pattern(t, "?x", T.TYPE, EX + "Supplier")))


@query(f"SELECT '{EX}customer' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark, sf_dir):
    t = _triples(spark, sf_dir)
    urgent = A.join(A.pattern(t, "?o", EX + "placedBy", "?c"), A.pattern(t, "?o", EX + "priority", A.lit("1-URGENT")))
    return A.projected(A.exists(A.pattern(t, "?c", T.TYPE, EX + "Customer"), urgent))


@query(f"SELECT '{EX}nation' || n_nationkey AS n, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey IN (1, 2)")
def values_join(spark, sf_dir):
    t = _triples(spark, sf_dir)
    given = A.values(spark, ["r"], [(EX + "region1",), (EX + "region2",)])
    return A.projected(A.join(A.join(A.pattern(t, "?n", EX + "inRegion", "?r"), given), A.pattern(t, "?r", T.LABEL, "?label")), "n", "label")


@query(f"SELECT '{EX}order' || o_orderkey AS o, '{EX}region' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_seq_inv(spark, sf_dir):
    t = _triples(spark, sf_dir)
    two = A.path_seq(A.pattern(t, "?o", EX + "placedBy", "?c"), A.pattern(t, "?c", EX + "inNation", "?n"), "c")
    return A.projected(A.path_seq(two, A.pattern(t, "?n", EX + "inRegion", "?r"), "n"), "o", "r")


@query("SELECT n_name AS nation, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) >= 3")
def group_count_having(spark, sf_dir):
    t = _triples(spark, sf_dir)
    found = A.join(A.join(A.pattern(t, "?c", EX + "balance", "?b"), A.pattern(t, "?c", EX + "inNation", "?x")), A.pattern(t, "?x", T.LABEL, "?nation"))
    grouped = found.withColumn("v", A.number("b")).groupBy(F.col("nation.value").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    return grouped.filter("n >= 3")


@query("SELECT p_size::VARCHAR AS size, p_name AS name, p_partkey::VARCHAR AS key FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 20 OFFSET 10")
def order_slice(spark, sf_dir):
    t = _triples(spark, sf_dir)
    found = A.join(A.pattern(t, "?p", EX + "size", "?size"), A.pattern(t, "?p", T.LABEL, "?name")).withColumn("key", F.substring(A.text("p"), len(EX + "part") + 1, 20).cast("long"))
    ordered = found.orderBy(*A.sort_keys("size", descending=True), *A.sort_keys("name"), "key")
    top = A.bounded(ordered, limit=20, offset=10)
    return top.select(F.col("size.value").alias("size"), F.col("name.value").alias("name"), F.col("key").cast("string").alias("key"))


@query(
    f"SELECT '{EX}part' || p_partkey AS p, strlen(p_name) AS len, upper(p_name) AS up, md5(p_name) AS hash, '{T.XSD}integer' AS dt FROM part WHERE regexp_matches(p_name, '^[a-m]') AND p_size >= 25"
)
def filter_functions(spark, sf_dir):
    t = _triples(spark, sf_dir)
    found = A.join(A.pattern(t, "?p", T.LABEL, "?n"), A.pattern(t, "?p", EX + "size", "?s")).filter(A.regex("n", "^[a-m]") & (A.number("s") >= 25))
    name = A.text("n")
    return found.select(A.text("p").alias("p"), F.length(name).cast("long").alias("len"), F.upper(name).alias("up"), F.md5(name).alias("hash"), A.datatype("s").alias("dt"))


@query(f"WITH RECURSIVE e AS ({_BINARY}), c(node, anc) AS (SELECT child, parent FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.anc = e.child) SELECT '{EX}' || node AS a, '{EX}' || anc AS b FROM c")
def path_plus_closure(spark, sf_dir):
    tree = mapping.class_tree(spark, sf_dir)
    edges = mapping.describe(tree, mapping.iri("", F.col("child")), TBOX, mapping.to_iri(T.SUBCLASS, mapping.iri("", F.col("parent")))).drop("g")
    return A.projected(A.path_plus(edges, T.SUBCLASS, "a", "b"))


# Graph operators.
@query(f"WITH RECURSIVE e AS ({_BINARY}), c(node, anc) AS (SELECT child, parent FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.anc = e.child) SELECT node, anc FROM c")
def ancestor_closure(spark, sf_dir):
    return graph.ancestors(mapping.class_tree(spark, sf_dir))


@query(
    f"WITH RECURSIVE e AS ({_BINARY}), c(node, anc) AS (SELECT child, parent FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.anc = e.child)"
    " SELECT least(min(x.anc), x.node) AS root, x.node FROM c x JOIN c y ON x.node = y.anc AND x.anc = y.node GROUP BY x.node"
)
def scc_cycles(spark, sf_dir):
    return graph.cycles(mapping.class_tree(spark, sf_dir))


_SPARSE = "SELECT c_custkey AS a, c_custkey + c_custkey % 7 AS b FROM customer"


@query(
    f"WITH RECURSIVE e AS ({_SPARSE}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(node, other) AS (SELECT a, b FROM u UNION SELECT c.node, u.b FROM c JOIN u ON c.other = u.a)"
    " SELECT node, least(min(other), node) AS root FROM c GROUP BY node"
)
def components(spark, sf_dir):
    e = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + F.col("c_custkey") % 7).alias("b"))
    return graph.components(e)


@query(f"WITH RECURSIVE e AS ({_BINARY}), c(node) AS (SELECT 5 UNION SELECT e.child FROM c JOIN e ON c.node = e.parent) SELECT node::BIGINT AS node FROM c")
def reachable_nodes(spark, sf_dir):
    down = mapping.class_tree(spark, sf_dir).select(F.col("parent").alias("a"), F.col("child").alias("b"))
    return graph.reachable(down, spark.createDataFrame([(5,)], "node long"))


# Views and listings.
@query(
    f"SELECT '{EX}Customer' AS cls, count(*) AS n FROM customer UNION ALL SELECT '{EX}Supplier', count(*) FROM supplier UNION ALL SELECT '{EX}Nation', count(*) FROM nation UNION ALL SELECT '{EX}Region', count(*) FROM region"
    f" UNION ALL SELECT '{EX}Order', count(*) FROM orders UNION ALL SELECT '{EX}Part', count(*) FROM part UNION ALL SELECT '{EX}Segment' || {_pascal('c_mktsegment')}, count(*) FROM customer GROUP BY 1"
    f" UNION ALL SELECT '{EX}Type' || {_pascal('p_type')}, count(*) FROM part GROUP BY 1"
)
def class_counts(spark, sf_dir):
    return views.class_counts(mapping.to_quads(spark, sf_dir))


@query("SELECT '" + EX + "customer' || c_custkey AS iri, c_name AS label FROM customer WHERE contains(lower(c_name), '1') OR contains('" + EX.lower() + "customer' || c_custkey, '1') ORDER BY c_name, iri LIMIT 25 OFFSET 5")
def individual_page(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir)
    return views.page(views.individuals(quads, views.labels(quads), EX + "Customer", " 1 "), "label", "iri", skip=5, take=25)


@query("SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) AS classes, 0::BIGINT AS properties, count(DISTINCT (p_type, p_brand)) AS axioms FROM part")
def ontology_stats(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(mapping.type_iri("Type", F.col("p_type")).alias("t"), mapping.type_iri("Brand", F.col("p_brand")).alias("b"))
    tbox = mapping.describe(part, F.col("b"), TBOX, mapping.to_iri(T.TYPE, F.lit(T.CLASS)), mapping.to_iri(T.SUBCLASS, F.col("t"))).unionByName(mapping.describe(part, F.col("t"), TBOX, mapping.to_iri(T.TYPE, F.lit(T.CLASS))))
    return views.ontology_stats(tbox.distinct())


@query(
    f"SELECT '{EX}order' || o_orderkey AS s, 'order' || o_orderkey AS s_label, coalesce(c_name, 'customer' || o_custkey) AS value_label FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def label_fallback_join(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir)
    placed = store.match(quads, p=EX + "placedBy")
    return views.facts(placed, views.labels(quads)).select("s", "s_label", "value_label")


# Validation and conflicts.
@query(f"SELECT '{EX}part' || p_partkey AS individual, p_size::VARCHAR AS detail FROM part WHERE p_size > 25 AND p_retailprice > 950")
def disjoint_type_violations(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    types = part.select(mapping.iri("part", F.col("p_partkey")).alias("ind"), F.when(F.col("p_size") > 25, "large").otherwise("small").alias("cls"), "p_size")
    more = part.filter("p_retailprice > 950").select(mapping.iri("part", F.col("p_partkey")).alias("ind"), F.lit("dear").alias("cls"), "p_size")
    sets = types.unionByName(more).groupBy("ind").agg(F.array_sort(F.collect_set("cls")).alias("has"))
    disjoint = spark.createDataFrame([("large", "dear")], "a string, b string")
    found = validation.disjoint_types(sets, disjoint).select("individual")
    return found.join(types, F.col("individual") == F.col("ind")).select("individual", F.col("p_size").cast("string").alias("detail"))


@query("SELECT 'customer' || o_custkey AS individual, count(DISTINCT o_orderdate)::VARCHAR AS detail FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderdate) > 12")
def type_count_violations(spark, sf_dir):
    types = _read(spark, sf_dir, "orders").select(F.concat(F.lit("customer"), F.col("o_custkey")).alias("ind"), F.col("o_orderdate").cast("string").alias("cls")).distinct()
    return validation.too_many_types(types).select("individual", "detail")


@query(
    "SELECT event_id, v AS value, regexp_matches(v, '^[+-]?[0-9]+$') AS is_integer, TRY_CAST(v AS DOUBLE) IS NOT NULL AS is_decimal"
    " FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE coalesce(json_extract_string(props, '$.k'), '') || CASE WHEN event_id % 3 = 1 THEN '.5' ELSE '' END END AS v FROM events)"
)
def xsd_lexical(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.when(F.col("event_id") % 3 == 1, ".5").otherwise("")))
    rows = _read(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return rows.select("event_id", "value", T.xsd_valid(F.col("value"), F.lit(T.XSD + "integer")).alias("is_integer"), T.xsd_valid(F.col("value"), F.lit(T.XSD + "decimal")).alias("is_decimal"))


@query(f"SELECT '{EX}customer' || c_custkey AS focus, count(o_orderkey)::VARCHAR AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 3")
def shacl_mincount(spark, sf_dir):
    orders = mapping.describe(_read(spark, sf_dir, "orders"), mapping.iri("customer", F.col("o_custkey")), ABOX, mapping.to_iri(EX + "placed", mapping.iri("order", F.col("o_orderkey"))))
    data = store.match(mapping.to_quads(spark, sf_dir), p=T.TYPE, o=EX + "Customer").unionByName(orders)
    shapes = spark.createDataFrame([("shape", EX + "Customer", EX + "placed", 3, T.SH + "IRI", None, None)], "shape string, target string, path string, min_count int, node_kind string, datatype string, class_ string")
    return validation.shacl(shapes, data).select("focus", "value")


@query("SELECT 'domain_multi|' || p_brand AS signature, count(DISTINCT p_type) AS n FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2")
def domain_multi(spark, sf_dir):
    values = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("iri"), F.col("p_type").alias("value"))
    none = spark.createDataFrame([], "node string, anc string")
    return conflicts.multiple_values(values, none, "domain_multi").select("signature", (F.size("entities") - 1).cast("long").alias("n"))


@query("SELECT 'equiv_disjoint|' || least(a, b) || '|' || greatest(a, b) AS signature FROM (SELECT DISTINCT p_type AS a, p_brand AS b FROM part WHERE p_size < 10 INTERSECT SELECT DISTINCT p_type, p_brand FROM part WHERE p_size > 40)")
def equivalent_disjoint(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    pairs = lambda test: part.filter(test).select(F.col("p_type").alias("a"), F.col("p_brand").alias("b")).distinct()
    schema = conflicts.Schema(None, None, None, pairs("p_size > 40"), pairs("p_size < 10"), None, None)
    return conflicts.equivalent_disjoint(schema).select("signature")


@query(
    "WITH old AS (SELECT 's' || o_orderkey AS signature, CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'O' THEN 'dismissed' ELSE 'cleared' END AS old FROM orders WHERE o_totalprice > 100000),"
    " new AS (SELECT 's' || o_orderkey AS signature FROM orders WHERE o_orderpriority < '3')"
    " SELECT signature, CASE WHEN n IS NULL THEN CASE WHEN old = 'open' THEN 'cleared' ELSE old END WHEN old = 'dismissed' THEN 'dismissed' ELSE 'open' END AS status,"
    " CASE WHEN old IS NULL THEN 'new' WHEN n IS NOT NULL AND old = 'cleared' THEN 'reopened' WHEN n IS NULL AND old = 'open' THEN 'auto_cleared' ELSE 'kept' END AS change"
    " FROM old FULL JOIN (SELECT signature, 1 AS n FROM new) USING (signature)"
)
def conflict_sync(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("*", F.concat(F.lit("s"), F.col("o_orderkey")).alias("signature"))
    status = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", "dismissed").otherwise("cleared")
    return conflicts.synced(orders.filter("o_totalprice > 100000").select("signature", status.alias("status")), orders.filter("o_orderpriority < '3'"))


# Scalar functions on labels and texts.
@query(
    f"SELECT doc_id, {_norm('text')} AS norm, CASE WHEN regexp_matches(text, '[\\x{{3400}}-\\x{{9FFF}}]') THEN 'zh-CN' ELSE 'en' END AS lang FROM documents"
)
def norm_label(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", T.norm_label(F.col("text")).alias("norm"), T.guess_language(F.col("text")).alias("lang"))


@query(f"SELECT DISTINCT p_name AS label, {_pascal('p_name')} AS local FROM part")
def class_local_name(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_name").alias("label"), T.class_local_name(F.col("p_name")).alias("local")).distinct()


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[^#/]*$') = '' THEN url ELSE regexp_extract(url, '[^#/]*$') END AS local FROM pages")
def local_name(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.local_name(F.col("url")).alias("local"))


@query(
    "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, coalesce(list_sum(list_transform(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+|[^\\s]'),"
    " lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9_]') THEN ceil(length(t) / 4.0)::BIGINT ELSE 1 END)), 0)) END::BIGINT AS tokens FROM documents"
)
def token_estimate(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query()
def chunk_spans(spark, sf_dir):
    return X.chunks(_read(spark, sf_dir, "documents"))


# Similarity.
_LABELS = f"SELECT DISTINCT {_norm('p_name')} AS norm FROM part"


@query(
    f"WITH l AS ({_LABELS}), w AS (SELECT norm, string_split(norm, ' ') AS ws FROM l), p AS (SELECT x.norm AS a, y.norm AS b, len(list_intersect(x.ws, y.ws)) AS i, len(list_distinct(x.ws)) AS n, len(y.ws) AS m FROM w x JOIN w y ON x.norm < y.norm)"
    " SELECT a, b, i::DOUBLE / (n + m - i) AS score FROM p WHERE i::DOUBLE / (n + m - i) >= 0.3"
)
def jaccard_pairs(spark, sf_dir):
    norms = _read(spark, sf_dir, "part").select(T.norm_label(F.col("p_name")).alias("norm")).distinct()
    return similarity.label_pairs(norms, 0.3)


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)"
    " SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.e, y.e) / (x.n * y.n), 6) AS score FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.35"
)
def cosine_pairs(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.vector_links(v, 0.35).select("a", "b", F.round("score", 6).alias("score"))


@query(
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),"
    " s AS (SELECT x.vec_id AS query_id, y.vec_id AS id, round(list_dot_product(x.e, y.e) / (x.n * y.n), 9) AS score FROM u x, u y),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"
)
def topk_cosine(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return similarity.vector_top_k(v, v, 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    f"WITH a AS (SELECT {_norm("'Order' || l_orderkey")} AS norm, l_returnflag AS iri FROM lineitem) SELECT norm, min(iri) AS iri FROM a WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT iri) = 1"
)
def unique_alias(spark, sf_dir):
    return similarity.unique_aliases(_read(spark, sf_dir, "lineitem").select(F.concat(F.lit("Order"), F.col("l_orderkey")).alias("alias"), F.col("l_returnflag").alias("iri")))


# Lines, keys, diffs.
def _mapped_lines() -> str:
    """SQL of the lines of the whole mapped graph, a SELECT for each table and pair."""
    i = lambda name, key: f"'<{EX}{name}' || {key} || '>'"
    escaped = lambda c: reduce(lambda x, e: f"replace({x}, chr({e[0]}), chr(92) || {e[1]})", ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")), c)
    text = lambda c: f"'\"' || {escaped(c)} || '\"'"
    typed = lambda c, dt: f"'\"' || {c}::VARCHAR || '\"^^<{T.XSD}{dt}>'"
    cls = lambda n: f"'<{EX}{n}>'"
    made = lambda n, c: f"'<{EX}{n}' || {_pascal(c)} || '>'"
    tables = {
        "region": (i("region", "r_regionkey"), [(T.TYPE, cls("Region")), (T.LABEL, text("r_name"))]),
        "nation": (i("nation", "n_nationkey"), [(T.TYPE, cls("Nation")), (T.LABEL, text("n_name")), (EX + "inRegion", i("region", "n_regionkey"))]),
        "customer": (
            i("customer", "c_custkey"),
            [(T.TYPE, cls("Customer")), (T.TYPE, made("Segment", "c_mktsegment")), (T.LABEL, text("c_name")), (EX + "inNation", i("nation", "c_nationkey")), (EX + "balance", typed("c_acctbal", "decimal"))],
        ),
        "supplier": (i("supplier", "s_suppkey"), [(T.TYPE, cls("Supplier")), (T.LABEL, text("s_name")), (EX + "inNation", i("nation", "s_nationkey"))]),
        "part": (
            i("part", "p_partkey"),
            [(T.TYPE, cls("Part")), (T.TYPE, made("Type", "p_type")), (T.LABEL, text("p_name")), (EX + "size", typed("p_size", "integer")), (EX + "brand", text("p_brand"))],
        ),
        "orders": (
            i("order", "o_orderkey"),
            [(T.TYPE, cls("Order")), (EX + "placedBy", i("customer", "o_custkey")), (EX + "status", text("o_orderstatus")), (EX + "priority", text("o_orderpriority"))],
        ),
    }
    each = [f"SELECT {s} || ' <{p}> ' || {o} || ' <{ABOX}> .' AS line FROM {t}" for t, (s, pairs) in tables.items() for p, o in pairs]
    return f"SELECT DISTINCT line FROM ({' UNION ALL '.join(each)}) WHERE line IS NOT NULL"


@query(_mapped_lines())
def nquads_dump_graph(spark, sf_dir):
    """The whole mapped graph as lines."""
    return store.lines(mapping.to_quads(spark, sf_dir))


@query(
    f"WITH {schema_queries.LAYER}, q AS (SELECT child AS s, '{T.SUBCLASS}' AS p, '<' || parent || '>' AS o FROM sub WHERE parent NOT IN ('{EX}Item', '{EX}Make') OR child IN (SELECT t FROM p UNION SELECT b FROM p)"
    f" UNION SELECT x, '{T.DISJOINT}', '<' || y || '>' FROM dis UNION SELECT x, '{T.EQUIVALENT}', '<' || y || '>' FROM equ UNION SELECT iri, '{T.TYPE}', '<{T.CLASS}>' FROM classes UNION SELECT c, '{T.LABEL}', chr(34) || p_name || chr(34) FROM p"
    f" UNION SELECT t, '{T.LABEL}', chr(34) || p_type || chr(34) FROM p UNION SELECT b, '{T.LABEL}', chr(34) || p_brand || chr(34) FROM p UNION SELECT h, '{T.LABEL}', chr(34) || h_label || chr(34) FROM p UNION SELECT h, '{T.TYPE}', '<{T.OBJECT_PROPERTY}>' FROM p"
    f" UNION SELECT prop, CASE slot WHEN 'domain' THEN '{T.DOMAIN}' ELSE '{T.RANGE}' END, '<' || cls || '>' FROM slots) SELECT '<' || s || '> <' || p || '> ' || o || ' <{TBOX}> .' AS line FROM q"
)
def nquads_dump_lines(spark, sf_dir):
    """The whole schema layer as lines."""
    return store.lines(mapping.to_schema(spark, sf_dir))


@query(f"SELECT '{ABOX}' AS g, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS signature FROM ({_mapped_lines()})")
def layer_signature(spark, sf_dir):
    return store.layer_signature(mapping.to_quads(spark, sf_dir))


@query()
def graph_fingerprint(spark, sf_dir):
    """The order-free fingerprint of each whole graph; layer_signature is the sorted form for layers that fit one executor."""
    return store.set_fingerprint(mapping.to_quads(spark, sf_dir))


@query(f"SELECT 'triple|' || sha256('<{EX}order' || o_orderkey || '> <{EX}placedBy> <{EX}customer' || o_custkey || '> .') AS key FROM orders")
def triple_key(spark, sf_dir):
    placed = store.match(mapping.to_quads(spark, sf_dir), p=EX + "placedBy")
    return placed.select(T.triple_key(F.col("s"), F.col("p"), T.object_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))).alias("key"))


@query("SELECT 'added' AS op, 'k' || p_partkey AS line FROM part WHERE p_size > 25 AND NOT p_retailprice > 950 UNION SELECT 'removed', 'k' || p_partkey FROM part WHERE p_retailprice > 950 AND NOT p_size > 25")
def diff_added_removed(spark, sf_dir):
    part = _read(spark, sf_dir, "part").withColumn("line", F.concat(F.lit("k"), F.col("p_partkey")))
    return store.diff_lines(part.filter("p_retailprice > 950").select("line"), part.filter("p_size > 25").select("line"))


# Edits.
@query(
    f"SELECT DISTINCT '{EX}part' || p_partkey AS s, '{EX}' || CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'merged' ELSE 'b' || p_brand END AS o FROM part"
)
def merge_classes_rewrite(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    quads = mapping.describe(part, mapping.iri("part", F.col("p_partkey")), ABOX, mapping.to_iri(T.TYPE, F.concat(F.lit(EX + "b"), F.col("p_brand"))))
    names = spark.createDataFrame([(EX + "bBrand#11", EX + "merged"), (EX + "bBrand#12", EX + "merged")], "src string, tgt string")
    return edits.merge_classes(quads, names).select("s", "o")


@query(
    f"WITH b AS ({edit_queries.BY_P}) SELECT p, n - CASE p WHEN '{T.TYPE}' THEN (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) WHEN '{T.LABEL}' THEN (SELECT count(*) FROM supplier) WHEN '{EX}inNation' THEN (SELECT count(*) FROM supplier) ELSE 0 END AS n FROM b"
)
def delete_class_cascade(spark, sf_dir):
    """Customers keep their segment type when the class Customer goes; suppliers have no other type and go with all they assert."""
    gone = spark.createDataFrame([(EX + "Customer",), (EX + "Supplier",)], "iri string")
    return edits.cascade_classes(mapping.to_quads(spark, sf_dir), gone).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS iri, o_custkey + 100 AS mapped FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)")
def stale_mappings(spark, sf_dir):
    mapped = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("iri"), (F.col("o_custkey") + 100).alias("mapped"))
    return edits.stale_mappings(mapped, _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s")))


# History and provenance.
@query(
    "WITH c AS (SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'add' ELSE 'remove' END AS op, 'line' || user_id AS line, ts FROM events), cutoff AS (SELECT ts FROM events WHERE event_id = 500),"
    " first AS (SELECT line, arg_min(op, (ts, event_id)) AS op FROM c WHERE ts >= (SELECT ts FROM cutoff) GROUP BY line), now AS (SELECT DISTINCT 'line' || user_id AS line FROM events WHERE event_type = 'view')"
    " SELECT line FROM now FULL JOIN first USING (line) WHERE CASE WHEN op IS NULL THEN true ELSE op = 'remove' END"
)
def rollback_state(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("line", F.concat(F.lit("line"), F.col("user_id")))
    changes = e.select("event_id", F.lit(None).cast("long").alias("group_id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 5 < 3, "add").otherwise("remove").alias("op"), "line")
    return history.rollback(e.filter("event_type = 'view'").select("line"), changes, 500)


_TRACED = "SELECT o_orderkey AS chunk_id, o_custkey AS key, c_custkey AS document_id, coalesce(c_name, '(deleted)') AS filename FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0"


def _traced(spark, sf_dir):
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0")
    provenance = orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("key"))
    chunks = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    return history.trace(provenance, chunks, customer.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename")))


@query(_TRACED)
def provenance_trace(spark, sf_dir):
    return _traced(spark, sf_dir).select("chunk_id", "key", "document_id", "filename")


@query(f"SELECT document_id, count(DISTINCT key) AS keys, count(DISTINCT chunk_id) AS chunks FROM ({_TRACED}) GROUP BY document_id")
def provenance_counts(spark, sf_dir):
    return history.provenance_counts(_traced(spark, sf_dir))


@query("SELECT o_custkey AS ks_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS release_id FROM orders GROUP BY o_custkey")
def current_release(spark, sf_dir):
    d = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ks_id"), F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("created_at"))
    return history.current_release(d)


@query(
    "WITH v AS (SELECT DISTINCT l_orderkey AS ks_id, l_linenumber AS version FROM lineitem WHERE l_quantity > 10), n AS (SELECT ks_id, max(version) + 1 AS next FROM v GROUP BY ks_id),"
    " c AS (SELECT ks_id, version + 1 AS version FROM v UNION SELECT ks_id, 1 FROM v) SELECT ks_id, any_value(next) AS next, min(c.version) AS lowest_free FROM c ANTI JOIN v USING (ks_id, version) JOIN n USING (ks_id) GROUP BY ks_id"
)
def next_version(spark, sf_dir):
    return history.next_version(_read(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("ks_id"), F.col("l_linenumber").alias("version")))


@query(
    "SELECT *, conflicts + violations + proposals + resolutions AS blocking FROM (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS conflicts, (SELECT count(*) FROM part WHERE p_size > 40) AS violations,"
    " (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS proposals, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS resolutions)"
)
def quality_gate(spark, sf_dir):
    rows = lambda table, status, severity: _read(spark, sf_dir, table).select(status.alias("status"), severity.alias("severity"))
    test = lambda expression, yes, no: F.when(F.expr(expression), yes).otherwise(no)
    conflicts_ = rows("orders", test("o_orderstatus = 'O'", "open", "dismissed"), test("o_orderpriority = '1-URGENT'", "error", "warning"))
    violations = rows("part", F.lit("open"), test("p_size > 40", "error", "warning"))
    pending = lambda table, expression: rows(table, test(expression, "pending", "done"), F.lit("error"))
    return history.gate(conflicts_, violations, pending("lineitem", "l_returnflag = 'R'"), pending("customer", "c_acctbal < 0"))


@query(f"SELECT count(*) AS keys, count(*) FILTER (n = 1) AS only_here FROM (SELECT key, count(DISTINCT document_id) AS n, bool_or(document_id = 7) AS here FROM ({_TRACED}) GROUP BY key) WHERE here")
def doc_contribution(spark, sf_dir):
    return history.contribution(_traced(spark, sf_dir), 7)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i IN (SELECT round_even(j * (n - 1) / 99.0, 0)::BIGINT FROM range(100) r(j))")
def spaced_sample(spark, sf_dir):
    return views.spaced_sample(_read(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("SELECT event_id AS id, event_type AS action FROM events WHERE contains(lower(event_type), 'er') ORDER BY ts DESC, event_id DESC LIMIT 200")
def history_page(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("props").alias("summary"), F.col("ts").alias("created_at"))
    return history.history_page(e, text="ER").select("id", "action")


@query("SELECT event_id AS id, event_type AS action, coalesce(c_name, '?') AS name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0 ORDER BY ts DESC, event_id DESC LIMIT 30")
def member_activity(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), "user_id", F.col("ts").alias("created_at"))
    users = _read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return history.activity(e, users).select("id", "action", "name")


@query("SELECT count(*) FILTER (op = 'a') AS added, count(*) FILTER (op = 'r') AS removed FROM (SELECT 'a' AS op FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'r' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def import_counts(spark, sf_dir):
    quads = lambda status: mapping.describe(_read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status), mapping.iri("customer", F.col("o_custkey")), ABOX, mapping.to_iri(T.TYPE, mapping.iri("Buyer")))
    return edits.import_counts(quads("O"), quads("F"), replace=True)


@query("SELECT DISTINCT p_name AS iri FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 49) AND p_name NOT IN (SELECT p_name FROM part WHERE p_retailprice > 999)")
def isolated_classes(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    classes = part.select(F.col("p_name").alias("iri")).distinct()
    return views.isolated_classes(classes, part.filter("p_size > 49").select(F.col("p_name").alias("child"), F.col("p_brand").alias("parent")), part.filter("p_retailprice > 999").select(F.col("p_name").alias("cls")))


@query(
    "WITH c AS (SELECT p_partkey AS iri, p_name AS label FROM part), s AS (SELECT iri, label, CASE WHEN lower(trim(label)) = 'plate' THEN 1.0 WHEN contains(lower(trim(label)), 'plate') THEN 0.72 END AS score FROM c)"
    " SELECT iri, label, score::DOUBLE AS score FROM s WHERE contains(lower(label), 'plate') ORDER BY score DESC, label, iri LIMIT 10"
)
def resolve_topk(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("pref"), F.lit(None).cast("string").alias("pref_lang"), none.alias("alts"), none.alias("hidden"))
    return views.resolve(rows, " Plate ")


@query("SELECT o_custkey::VARCHAR AS iri, 'label twice in a concept' AS rule, o_orderpriority || ' ' || o_orderstatus AS detail FROM orders GROUP BY ALL HAVING count(*) > 1")
def concept_label_twice(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("iri", F.col("o_custkey").cast("string"))
    rows = orders.select("iri", F.lit("s").alias("scheme"), F.lit(None).cast("string").alias("mapped"), F.lit("active").alias("status"), F.lit("agent").alias("origin")).distinct()
    labels = orders.select("iri", F.lit("alt").alias("kind"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("value"), F.lit("en").alias("lang"))
    none = spark.createDataFrame([], "iri string, kind string, other string")
    found = terminology.broken_rules(rows, labels, none, spark.createDataFrame([("s",)], "scheme string"))
    return found.filter("rule = 'label twice in a concept'").select("iri", "rule", F.upper("detail").alias("detail"))


#: Queries of these modules are registered where they are defined.
MODULES = (curation_queries, schema_queries, edit_queries, text_queries, evidence_queries, hierarchy_queries, solution_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the label of their nation."""
    return bgp_join_2(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
