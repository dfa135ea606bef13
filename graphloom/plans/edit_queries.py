"""Queries on stores, edits, files, history and label functions over the whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import conflicts, edits, graph, history, pipelines, store, terminology, views
from graphloom.plans.catalog import norm_sql, pascal_sql, query, read
from graphloom.plans.shared import fresh_dir
from graphloom.sources import blobs, mapping, rdf
from graphloom.sources.mapping import ABOX, EX, TBOX

#: SQL of the mapped graph's quads by predicate.
BY_P = (
    f"SELECT '{T.TYPE}' AS p, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) * 2 FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) * 2 FROM part) + (SELECT count(*) FROM orders) AS n"
    f" UNION ALL SELECT '{T.LABEL}', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part)"
    f" UNION ALL SELECT '{EX}inRegion', count(*) FROM nation UNION ALL SELECT '{EX}inNation', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT '{EX}balance', count(*) FROM customer"
    f" UNION ALL SELECT '{EX}size', count(*) FROM part UNION ALL SELECT '{EX}brand', count(*) FROM part UNION ALL SELECT '{EX}placedBy', count(*) FROM orders UNION ALL SELECT '{EX}status', count(*) FROM orders UNION ALL SELECT '{EX}priority', count(*) FROM orders"
)


def _by_p(quads):
    return quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _buyers(spark, sf_dir, test: str):
    """Customers of the orders that pass a test, as typed individuals."""
    return mapping.describe(read(spark, sf_dir, "orders").filter(test), mapping.iri("customer", F.col("o_custkey")), ABOX, mapping.to_iri(T.TYPE, mapping.iri("Buyer")))


# Stores.
@query(f"SELECT '{EX}customer' || c_custkey AS s, c_name AS o FROM customer UNION ALL SELECT '{EX}supplier' || s_suppkey, s_name FROM supplier UNION ALL SELECT '{EX}part' || p_partkey, p_name FROM part UNION ALL SELECT '{EX}nation' || n_nationkey, n_name FROM nation UNION ALL SELECT '{EX}region' || r_regionkey, r_name FROM region")
def scan_literals(spark, sf_dir):
    return store.match(mapping.to_quads(spark, sf_dir), p=T.LABEL, o_kind="literal").select("s", "o")


@query("SELECT 'cell' || o_custkey AS s, o_orderkey::VARCHAR AS o FROM orders WHERE o_custkey = 7")
def scan_blank_subject(spark, sf_dir):
    quads = mapping.describe(read(spark, sf_dir, "orders"), F.concat(F.lit("cell"), F.col("o_custkey")), ABOX, mapping.to_literal(T.RDF + "first", F.col("o_orderkey"))).withColumn("s_kind", F.lit("bnode"))
    return store.match(quads, s="cell7", s_kind="bnode").select("s", "o")


@query(f"SELECT DISTINCT '{EX}customer' || o_custkey AS s FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def insert_union(spark, sf_dir):
    return store.insert(_buyers(spark, sf_dir, "o_orderstatus = 'F'"), _buyers(spark, sf_dir, "o_orderpriority = '1-URGENT'")).select("s")


@query(f"SELECT '{EX}customer' || o_custkey AS s FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def remove_difference(spark, sf_dir):
    return store.remove(_buyers(spark, sf_dir, "o_orderstatus = 'F'"), _buyers(spark, sf_dir, "o_orderpriority = '1-URGENT'")).select("s")


@query(f"SELECT '{ABOX}' AS g, count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT '{TBOX}', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'")
def replace_graph(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir).unionByName(_buyers(spark, sf_dir, "o_orderstatus = 'F'").withColumn("g", F.lit(TBOX)).distinct())
    return store.counts(store.replace_graph(quads, ABOX, _buyers(spark, sf_dir, "o_orderstatus = 'O'")))


@query(f"SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_orderstatus IN ('O', 'F')")
def merged_layers(spark, sf_dir):
    quads = _buyers(spark, sf_dir, "o_orderstatus = 'F'").withColumn("g", F.lit(TBOX)).unionByName(_buyers(spark, sf_dir, "o_orderstatus = 'O'"))
    return store.merged(quads, [TBOX, ABOX]).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH b AS ({BY_P}) SELECT 1 AS version, p, n FROM b UNION ALL SELECT 3, p, n FROM b")
def snapshot_versions(spark, sf_dir):
    """The graph is committed, cleared, and the first version made current again."""
    kept = store.SnapshotStore(spark, fresh_dir(spark, "store"))
    first = kept.commit(mapping.to_quads(spark, sf_dir))
    kept.commit(kept.read().limit(0))
    last = kept.revert(first)
    return _by_p(kept.read(first)).withColumn("version", F.lit(first)).unionByName(_by_p(kept.read(2)).withColumn("version", F.lit(2))).unionByName(_by_p(kept.read(last)).withColumn("version", F.lit(last)))


_SIDE = f"SELECT DISTINCT '<{EX}customer' || o_custkey || '> <{T.TYPE}> <{EX}Buyer> <{ABOX}> .' AS line FROM orders WHERE o_orderstatus = "


@query(
    f"WITH d AS (SELECT 'added' AS op, line FROM ({_SIDE}'O' EXCEPT {_SIDE}'F') UNION ALL SELECT 'removed', line FROM ({_SIDE}'F' EXCEPT {_SIDE}'O')), r AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY line) AS i FROM d)"
    f" SELECT '{ABOX}' AS g, op, count(*) AS n, string_agg(line, chr(10) ORDER BY line) FILTER (i <= 20) AS sample FROM r GROUP BY op"
)
def release_diff(spark, sf_dir):
    return history.release_diff(_buyers(spark, sf_dir, "o_orderstatus = 'F'"), _buyers(spark, sf_dir, "o_orderstatus = 'O'")).withColumn("sample", F.array_join("sample", "\n"))


# Files.
@query(BY_P)
def nquads_round_trip(spark, sf_dir):
    at = fresh_dir(spark, "nquads")
    rdf.write_nquads(mapping.to_quads(spark, sf_dir), at)
    return _by_p(rdf.read_nquads(spark, at))


@query(BY_P)
def turtle_round_trip(spark, sf_dir):
    at = fresh_dir(spark, "turtle")
    rdf.write_turtle(mapping.to_quads(spark, sf_dir), at)
    return _by_p(_imported(spark, at, "turtle"))


@query(BY_P)
def rdfxml_round_trip(spark, sf_dir):
    at = fresh_dir(spark, "rdfxml")
    rdf.write_rdfxml(mapping.to_quads(spark, sf_dir), at)
    return _by_p(_imported(spark, at, "rdfxml"))


@query(BY_P)
def jsonld_export(spark, sf_dir):
    """Every value of the written objects, counted by predicate."""
    at = fresh_dir(spark, "jsonld")
    rdf.write_jsonld(mapping.to_quads(spark, sf_dir), at)
    whole = spark.read.text(at, wholetext=True)
    pair = "map<string,string>"
    each = whole.select(F.explode(F.from_json("value", f"array<{pair}>")).alias("x")).select(F.explode("x").alias("p", "v")).filter("p <> '@id'")
    return each.select("p", F.explode(F.from_json("v", f"array<{pair}>"))).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _imported(spark, at: str, name: str):
    return rdf.import_files(spark, at, ABOX, name)


@query(f"WITH b AS ({BY_P}) SELECT 'abox' AS layer, sum(n)::BIGINT AS lines FROM b UNION ALL SELECT 'tbox', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'")
def export_manifest(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir).unionByName(_buyers(spark, sf_dir, "o_orderstatus = 'F'").withColumn("g", F.lit(TBOX)))
    return history.export(quads, fresh_dir(spark, "export"), {"abox": ABOX, "tbox": TBOX}, 1000).groupBy("layer").agg(F.sum("lines").alias("lines"))


@query(f"SELECT (SELECT sum(n)::BIGINT FROM ({BY_P})) AS quads, (SELECT count(*) FROM orders) AS provenance")
def capture_release(spark, sf_dir):
    quads = mapping.to_quads(spark, sf_dir)
    placed = store.match(quads, p=EX + "placedBy")
    key = T.triple_key(F.col("s"), F.col("p"), T.object_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")))
    notes = placed.select(key.alias("key"), F.col("s").alias("chunk_id")).unionByName(placed.select(F.concat(F.lit("lost"), key).alias("key"), F.col("s").alias("chunk_id")))
    at = history.capture(quads, notes, fresh_dir(spark, "release"), 1)
    rows = spark.read.parquet(f"{at}/quads").select(F.lit("q").alias("k")).unionByName(spark.read.parquet(f"{at}/provenance").select(F.lit("p").alias("k")))
    return rows.agg(F.count_if(F.col("k") == "q").alias("quads"), F.count_if(F.col("k") == "p").alias("provenance"))


@query("WITH t AS (SELECT sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents WHERE text IS NOT NULL) SELECT sha256, any_value(size_bytes) AS size_bytes, count(*) AS n FROM t GROUP BY sha256")
def blob_store(spark, sf_dir):
    """Every text as a blob, read back, with how many documents have it."""
    d = read(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").cast("binary").alias("content"))
    at = fresh_dir(spark, "blobs")
    blobs.write_blobs(d, at).write.parquet(fresh_dir(spark, "blob-list"))
    found = blobs.read_blobs(spark, at).filter(F.sha2("content", 256) == F.col("sha256")).select("sha256", "size_bytes")
    return found.join(blobs.reference_counts(d.select(F.sha2("content", 256).alias("sha256"))), "sha256")


@query("SELECT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING max(coalesce(source, '')) = '' OR bool_and(lang <> 'en')")
def unreferenced_blobs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("sha256"), "source", "lang")
    return blobs.unreferenced(d.select("sha256").distinct(), d.filter("source <> '' and (lang is null or lang = 'en')"))


@query(f"SELECT 'urn:moved/' || 'customer' || c_custkey AS s, 'urn:moved/inNation' AS p, 'urn:moved/nation' || c_nationkey AS o FROM customer UNION ALL SELECT 'urn:moved/customer' || c_custkey, '{T.LABEL}', c_name FROM customer")
def relocate_iris(spark, sf_dir):
    quads = mapping.describe(read(spark, sf_dir, "customer"), mapping.iri("customer", F.col("c_custkey")), ABOX, mapping.to_iri(EX + "inNation", mapping.iri("nation", F.col("c_nationkey"))), mapping.to_literal(T.LABEL, F.col("c_name")))
    return edits.relocate(quads, EX, "urn:moved/").select("s", "p", "o")


# Edits.
def _types(spark, sf_dir):
    """Parts typed by their brand, and one axiom of each kind for each part."""
    p = read(spark, sf_dir, "part")
    brand, cls = F.concat(F.lit(EX + "b"), F.col("p_brand")), F.concat(F.lit(EX + "t"), F.col("p_type"))
    typed = mapping.describe(p, mapping.iri("part", F.col("p_partkey")), ABOX, mapping.to_iri(T.TYPE, brand))
    return typed.unionByName(mapping.describe(p, brand, TBOX, mapping.to_iri(T.DISJOINT, cls), mapping.to_iri(T.SUBCLASS, cls)).distinct())


@query(f"SELECT '{EX}' || {pascal_sql('p_name')} AS s, '{T.TYPE}' AS p, '{T.CLASS}' AS o FROM part UNION SELECT '{EX}' || {pascal_sql('p_name')}, '{T.LABEL}', p_name FROM part")
def add_classes(spark, sf_dir):
    labels = read(spark, sf_dir, "part").select(F.col("p_name").alias("label")).unionByName(spark.createDataFrame([(" ?! ",)], "label string"))
    return edits.add_classes(spark.createDataFrame([], store.SCHEMA), TBOX, EX, labels).select("s", "p", "o")


@query(f"SELECT DISTINCT '{EX}b' || p_brand AS a, '{EX}t' || p_type AS b FROM part WHERE p_brand <> p_type")
def add_axioms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.concat(F.lit(EX + "b"), F.col("p_brand")).alias("a"), F.concat(F.lit(EX + "t"), F.col("p_type")).alias("b"))
    loops = p.select("a", F.col("a").alias("b"))
    return edits.add_axioms(spark.createDataFrame([], store.SCHEMA), TBOX, T.EQUIVALENT, p.unionByName(loops)).select(F.col("s").alias("a"), F.col("o").alias("b"))


@query(
    f"WITH x AS (SELECT DISTINCT '{EX}b' || p_brand AS a, '{EX}t' || p_type AS b FROM part), gone AS (SELECT DISTINCT '{EX}b' || p_brand AS a, '{EX}t' || p_type AS b FROM part WHERE p_size < 10)"
    f" SELECT '{T.DISJOINT}' AS p, count(*) AS n FROM x ANTI JOIN gone USING (a, b) UNION ALL SELECT '{T.SUBCLASS}', count(*) FROM x UNION ALL SELECT '{T.TYPE}', count(*) FROM part"
)
def delete_axioms(spark, sf_dir):
    """Given the other way round, disjoint pairs go and subclass links stay. Of which none is left counts 0."""
    p = read(spark, sf_dir, "part").filter("p_size < 10").select(F.concat(F.lit(EX + "t"), F.col("p_type")).alias("a"), F.concat(F.lit(EX + "b"), F.col("p_brand")).alias("b"))
    left = _by_p(edits.delete_axioms(edits.delete_axioms(_types(spark, sf_dir), T.DISJOINT, p), T.SUBCLASS, p))
    kinds = spark.createDataFrame([(T.DISJOINT,), (T.SUBCLASS,), (T.TYPE,)], "p string")
    return kinds.join(left, "p", "left").select("p", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"SELECT '{EX}order' || o_orderkey AS s, '{EX}status' AS p, o_orderstatus AS o FROM orders WHERE o_orderpriority <> '1-URGENT'")
def delete_nodes(spark, sf_dir):
    quads = mapping.describe(read(spark, sf_dir, "orders"), mapping.iri("order", F.col("o_orderkey")), ABOX, mapping.to_iri(EX + "priority", F.concat(F.lit(EX), F.col("o_orderpriority"))), mapping.to_literal(EX + "status", F.col("o_orderstatus")))
    gone = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(mapping.iri("order", F.col("o_orderkey")).alias("iri"))
    others = read(spark, sf_dir, "orders").select(F.concat(F.lit(EX), F.col("o_orderpriority")).alias("iri")).distinct()
    return edits.delete_nodes(quads, gone.unionByName(others)).select("s", "p", "o")


@query(f"WITH b AS ({BY_P}) SELECT p, n FROM b WHERE p NOT IN ('{EX}size', '{EX}status')")
def drop_properties(spark, sf_dir):
    return _by_p(edits.drop_properties(mapping.to_quads(spark, sf_dir), spark.createDataFrame([(EX + "size",), (EX + "status",)], "iri string")))


@query(f"WITH b AS ({BY_P}) SELECT CASE WHEN p IN ('{EX}status', '{EX}priority') THEN '{EX}state' ELSE p END AS p, sum(n)::BIGINT AS n FROM b GROUP BY 1")
def merge_properties(spark, sf_dir):
    names = spark.createDataFrame([(EX + "status", EX + "state"), (EX + "priority", EX + "state")], "src string, tgt string")
    return _by_p(edits.merge_properties(mapping.to_quads(spark, sf_dir), names))


@query(f"SELECT DISTINCT '{EX}prop' || p_partkey AS s, '{T.DOMAIN}' AS p, '{EX}' || p_brand AS o FROM part UNION SELECT '{EX}prop' || p_partkey, '{T.RDFS}subPropertyOf', '{EX}over' || p_type FROM part UNION SELECT '{EX}over' || p_type, '{T.DOMAIN}', '{EX}' || p_brand FROM part")
def subordinate_properties(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    prop = mapping.iri("prop", F.col("p_partkey"))
    quads = mapping.describe(p, prop, TBOX, mapping.to_iri(T.DOMAIN, F.concat(F.lit(EX), F.col("p_brand"))))
    return edits.subordinate_properties(quads, TBOX, p.select(prop.alias("src"), F.concat(F.lit(EX + "over"), F.col("p_type")).alias("tgt"))).select("s", "p", "o")


@query(f"WITH m AS (SELECT DISTINCT '{EX}' || r_name AS member FROM region) SELECT (row_number() OVER (ORDER BY member) - 1)::INT AS pos, member FROM m")
def union_members(spark, sf_dir):
    """A property's domain becomes the union of all regions; the list is walked again."""
    members = [EX + r["r_name"] for r in read(spark, sf_dir, "region").collect()]
    quads = edits.set_union(mapping.to_schema(spark, sf_dir), TBOX, EX + "has1", T.DOMAIN, members)
    heads = quads.filter(F.col("p") == T.OWL + "unionOf").select(F.col("o").alias("head"))
    return graph.list_members(quads, heads, T.RDF + "first", T.RDF + "rest", T.RDF + "nil").select("pos", "member")


@query("SELECT o_orderkey AS head, n AS pos, 'm' || (o_orderkey + n) AS member FROM orders, range(6) r(n) WHERE o_orderkey % 50 = 0 AND o_orderkey + n <= (SELECT max(o_orderkey) FROM orders) AND n <= 5")
def list_walk(spark, sf_dir):
    """Lists of six cells that begin at every fiftieth order."""
    o = read(spark, sf_dir, "orders").filter("o_orderkey % 50 < 6")
    last = read(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last"))
    cell = F.concat(F.lit("c"), F.col("o_orderkey"))
    ended = (F.col("o_orderkey") % 50 == 5) | (F.col("o_orderkey") == F.lit(last.first()["last"]))
    after = F.when(ended, F.lit(T.RDF + "nil")).otherwise(F.concat(F.lit("c"), F.col("o_orderkey") + 1))
    quads = mapping.describe(o, cell, TBOX, mapping.to_iri(T.RDF + "first", F.concat(F.lit("m"), F.col("o_orderkey"))), mapping.to_iri(T.RDF + "rest", after))
    heads = o.filter("o_orderkey % 50 = 0").select(cell.alias("head"))
    found = graph.list_members(quads, heads, T.RDF + "first", T.RDF + "rest", T.RDF + "nil")
    return found.select(F.substring("head", 2, 20).cast("long").alias("head"), F.col("pos").cast("long").alias("pos"), "member")


@query("SELECT 'b' || c_custkey AS s FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def collect_garbage(spark, sf_dir):
    """Two blank nodes in a row for each customer; an IRI leads to those of every third."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    one, two = F.concat(F.lit("b"), k), F.concat(F.lit("d"), k)
    link = lambda s_kind, s, o: mapping.describe(c, s, TBOX, mapping.to_iri(EX + "to", o)).withColumn("s_kind", F.lit(s_kind)).withColumn("o_kind", F.lit("bnode"))
    quads = link("iri", mapping.iri("customer", F.when(k % 3 == 0, k)), one).unionByName(link("bnode", one, two)).unionByName(mapping.describe(c, two, TBOX, mapping.to_literal(T.LABEL, F.col("c_name"))).withColumn("s_kind", F.lit("bnode")))
    return edits.collect_garbage(quads).filter("s_kind = 'bnode'").select("s")


@query(f"SELECT 'schema' AS layer, count(DISTINCT p_partkey) * 3 AS n FROM part UNION ALL SELECT 'instances', count(DISTINCT (l_orderkey, l_linenumber, l_suppkey)) FROM lineitem WHERE l_returnflag = 'R'")
def split_import(spark, sf_dir):
    p, line = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    cls = mapping.iri("part", F.col("p_partkey"))
    quads = mapping.describe(p, cls, TBOX, mapping.to_iri(T.TYPE, F.lit(T.CLASS)), mapping.to_literal(T.LABEL, F.col("p_name")), mapping.to_iri(T.SUBCLASS, F.lit(EX + "Item")))
    facts = mapping.describe(line, F.concat(F.lit(EX + "l"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")), ABOX, mapping.to_iri(EX + "from", mapping.iri("supplier", F.col("l_suppkey")))).distinct()
    schema, instances = edits.split_import(quads.unionByName(facts))
    return schema.agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit("schema")).unionByName(instances.agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit("instances")))


@query(f"SELECT 'x' || least(a, b) AS s, 'x' || greatest(a, b) AS o FROM (SELECT c_custkey // 2 * 2 AS a, c_nationkey AS b FROM customer) WHERE a <> b AND false UNION ALL SELECT DISTINCT '{EX}customer' || (c_custkey // 2 * 2), '{EX}nation' || c_nationkey FROM customer")
def merge_duplicates(spark, sf_dir):
    """Customers with odd keys become those before them; what they assert moves."""
    c = read(spark, sf_dir, "customer")
    quads = mapping.describe(c, mapping.iri("customer", F.col("c_custkey")), ABOX, mapping.to_iri(EX + "inNation", mapping.iri("nation", F.col("c_nationkey"))))
    names = c.filter("c_custkey % 2 = 1").select(mapping.iri("customer", F.col("c_custkey")).alias("src"), mapping.iri("customer", F.col("c_custkey") - 1).alias("tgt"))
    return pipelines.merge_duplicates(quads, names).select("s", "o")


# History and queues.
@query("SELECT l_orderkey AS document_id, l_linenumber AS chunk FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderstatus = 'P'")
def replace_chunks(spark, sf_dir):
    chunks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"))
    parsed = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"), F.lit(99).alias("chunk"))
    return history.replace_chunks(chunks, parsed)


@query(
    "SELECT 'document' AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'chunk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"
    " UNION ALL SELECT 'axiom_provenance', count(*) FROM lineitem WHERE l_quantity > 25 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"
)
def delete_documents(spark, sf_dir):
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    chunk = F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id")
    tables = {"document": o.select(F.col("o_orderkey").alias("document_id")), "chunk": line.select(F.col("l_orderkey").alias("document_id"), chunk), "axiom_provenance": line.filter("l_quantity > 25").select(chunk)}
    out = history.delete_documents(tables, o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id")))
    count = lambda name: out[name].agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return count("document").unionByName(count("chunk")).unionByName(count("axiom_provenance"))


@query("SELECT c_custkey AS document_id FROM customer WHERE c_nationkey = 7 AND (c_custkey IN (3, 28, 53) OR c_mktsegment = 'BUILDING' OR (c_custkey % 2 = 0 AND c_mktsegment <> 'BUILDING'))")
def select_documents(spark, sf_dir):
    """By id, by a folder, and by a folder with those below it; paths come with spare slashes."""
    c = read(spark, sf_dir, "customer")
    folder = F.when(F.col("c_mktsegment") == "BUILDING", "/build//").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("even/"), F.col("c_mktsegment"))).otherwise("/evening")
    docs = c.select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("ks_id"), folder.alias("folder"))
    return history.select_documents(docs, 7, [3, 28, 53], ["build", "/even/"]).select("document_id")


@query("SELECT c_custkey AS document_id, c_name AS filename FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50 OFFSET 10")
def documents_page(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"), "c_acctbal")
    return views.page(c, F.col("c_acctbal").desc(), F.col("document_id").desc(), skip=10, take=50).select("document_id", "filename")


@query("SELECT event_id AS id, event_type AS surface_form FROM events WHERE event_id % 3 < 2 AND contains(event_type, 'i') ORDER BY ts, event_id LIMIT 200")
def queue_page(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("surface_form"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "open").otherwise("done").alias("status"))
    return history.queue(e, ["pending", "open"], "I", take=1000).select("id", "surface_form")


@query("SELECT count(*)::BIGINT AS a, sum(l_linenumber)::BIGINT AS b FROM lineitem")
def merge_counts(spark, sf_dir):
    return history.merge_counts(read(spark, sf_dir, "lineitem").select(F.lit(1).alias("a"), F.col("l_linenumber").alias("b"), "l_returnflag"))


@query("SELECT 's' || o_orderkey AS signature, 'c' || o_custkey || '|o' || (o_orderkey // 2) AS axiom_key, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS rank FROM orders WHERE o_orderstatus = 'P'")
def conflict_evidence(spark, sf_dir):
    """Each conflict names its order's customer, and every second one the other part of the key as well."""
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    mine, half = F.concat(F.lit("c"), F.col("o_custkey"), F.lit("k"), F.col("o_orderkey")), F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 2))
    found = o.select(F.concat(F.lit("s"), F.col("o_orderkey")).alias("signature"), F.array(mine, F.when(F.col("o_orderkey") % 2 == 0, F.concat(half, F.lit("k"), F.col("o_orderkey"))).otherwise("none")).alias("entities"))
    notes = o.select(F.concat_ws("|", mine, F.concat(half, F.lit("k"), F.col("o_orderkey"))).alias("axiom_key"), F.col("o_orderkey").alias("chunk_id"))
    return conflicts.evidence(found, notes).select("signature", F.regexp_replace("axiom_key", "k[0-9]+", "").alias("axiom_key"), "chunk_id", "rank")


@query(
    "WITH r AS (SELECT o_custkey::VARCHAR AS signature, o_orderpriority AS resolution, o_totalprice / 400000 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 400000 DESC, o_orderpriority) AS i FROM orders)"
    " SELECT signature, resolution, CASE WHEN least(c, 1) >= 0.85 THEN 'apply' ELSE 'recommend' END AS route FROM r WHERE i = 1"
)
def routed_advice(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("signature"), F.col("o_orderpriority").alias("resolution"), (F.col("o_totalprice") / 400000).alias("confidence"))
    return conflicts.routed(o).select("signature", "resolution", "route")


# Label functions.
@query(f"SELECT p_name AS label, lower(left({pascal_sql('p_name')}, 1)) || substr({pascal_sql('p_name')}, 2) AS local FROM part GROUP BY p_name")
def property_local_name(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("label"), T.property_local_name(F.col("p_name")).alias("local")).distinct()


@query(f"SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '{T.XSD}integer' WHEN 'O' THEN '{T.XSD}dateTime' END AS dt FROM orders")
def canonical_datatype(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", " <xsd:Integer> ").when(F.col("o_orderstatus") == "O", "http://www.w3.org/2001/XMLSchema#dateTime").otherwise("no such type")
    return read(spark, sf_dir, "orders").select("o_orderkey", T.canonical_datatype(name).alias("dt"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN value IS NULL THEN NULL WHEN value > 10 THEN 1.0 ELSE greatest(value / 10, 0) END::DOUBLE AS confidence FROM events")
def clamp_confidence(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, "high").otherwise((F.col("value") / 10).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", T.clamp_confidence(raw).alias("confidence"))


_WORDS = f"x AS (SELECT DISTINCT {norm_sql('p_name')} AS a FROM part), pairs AS (SELECT a, string_split(a, ' ')[-1] AS b FROM x UNION SELECT a, string_split(a, ' ')[1] FROM x)"


@query(f"WITH {_WORDS} SELECT a, b, len(string_split(a, ' ')) > 1 AND string_split(a, ' ')[-1] = b AS safe, len(string_split(a, ' ')) > 1 AND string_split(a, ' ')[-1] <> b AS mismatch, len(string_split(a, ' ')) > 1 AND string_split(a, ' ')[-1] <> b AS apart FROM pairs")
def compound_labels(spark, sf_dir):
    """Labels against their last and their first word: safe, of another head, told apart."""
    x = read(spark, sf_dir, "part").select(T.norm_label(F.col("p_name")).alias("a")).distinct()
    pairs = x.select("a", F.explode(F.array(F.element_at(F.split("a", " "), -1), F.element_at(F.split("a", " "), 1))).alias("b")).distinct()
    return pairs.select("a", "b", T.safe_subclass(F.col("a"), F.col("b")).alias("safe"), T.head_mismatch(F.col("a"), F.col("b")).alias("mismatch"), T.compositional_distinct(F.col("a"), F.col("b")).alias("apart"))


@query(f"WITH {_WORDS} SELECT a AS source, b AS replacement FROM pairs WHERE len(string_split(a, ' ')) > 1 AND string_split(a, ' ')[-1] = b")
def safe_replacements(spark, sf_dir):
    x = read(spark, sf_dir, "part").select(T.norm_label(F.col("p_name")).alias("source")).distinct()
    pairs = x.select("source", F.explode(F.array(F.element_at(F.split("source", " "), -1), F.element_at(F.split("source", " "), 1))).alias("replacement")).distinct()
    return terminology.replacements(pairs)


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS shown FROM documents")
def nquads_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.nq_escape(F.col("text")).alias("shown"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'subclass|' || p_type || '|' || p_brand WHEN 1 THEN 'disjoint|' || least(p_type, p_brand) || '|' || greatest(p_type, p_brand) ELSE 'equivalent|' || least(p_type, p_brand) || '|' || greatest(p_type, p_brand) END AS key FROM part")
def axiom_keys(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("subclass"), F.lit("disjoint"), F.lit("equivalent")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.axiom_key(kind, F.col("p_type"), F.col("p_brand")).alias("key"))


@query("SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN '_:' || n_name ELSE n_name END AS term FROM nation")
def wire_terms(spark, sf_dir):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "bnode").otherwise("literal")
    return read(spark, sf_dir, "nation").select("n_nationkey", T.to_wire(kind, F.col("n_name")).alias("term"))


@query("SELECT event_id, lower(trim(v)) IN ('', 'untitled', 'unknown', 'n/a', 'na', 'none', 'null', 'tbd', 'todo', '-') AS hollow FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' TBD ' WHEN 1 THEN event_type WHEN 2 THEN '' ELSE 'N/A' END AS v FROM events)")
def hollow_labels(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, " TBD ").when(F.col("event_id") % 4 == 1, F.col("event_type")).when(F.col("event_id") % 4 == 2, "").otherwise("N/A")
    return read(spark, sf_dir, "events").select("event_id", T.non_identifying(value).alias("hollow"))


@query("SELECT '/' || regexp_replace(trim(f, '/ '), '/+', '/', 'g') AS path, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN ' //a///b/' WHEN 1 THEN c_mktsegment ELSE '' END AS f FROM customer) GROUP BY 1")
def folder_paths(spark, sf_dir):
    folder = F.when(F.col("c_custkey") % 3 == 0, " //a///b/").when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(history.folder_path(folder).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
