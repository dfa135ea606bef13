"""Queries on files, texts, replies and decisions over the whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import extraction, history, pipelines
from graphloom.plans.catalog import query, read
from graphloom.plans.shared import fresh_dir, written
from graphloom.sources import blobs, documents, rdf


def _parts(spark, sf_dir):
    """The parts, dealt anew: a split holds too many small rows for work on texts."""
    return read(spark, sf_dir, "part").repartition("p_partkey")


def _case(column: str, *values):
    """The value at a key modulo the number of values."""
    out = F.when(F.col(column) % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(F.col(column) % len(values) == i, v)
    return out


# Names.
@query(
    "WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '#' WHEN 2 THEN url || '/' ELSE 'urn:page:' || page_id END AS iri FROM pages),"
    " l AS (SELECT *, string_split(iri, '#')[-1] AS fragment, string_split(iri, '/')[-1] AS step FROM u)"
    " SELECT page_id, string_split(replace(iri, '#', '/'), '/')[-1] AS individual, string_split(replace(replace(iri, '#', '/'), ':', '/'), '/')[-1] AS published,"
    " CASE WHEN contains(iri, '#') AND fragment <> '' THEN fragment WHEN contains(iri, '/') AND step <> '' THEN step ELSE iri END AS in_rules,"
    " CASE WHEN contains(iri, '#') THEN fragment ELSE string_split(rtrim(iri, '/'), '/')[-1] END AS in_schema FROM l"
)
def local_name_forms(spark, sf_dir):
    """The forms of local names that differ where an IRI has several marks, ends with one, or has none."""
    iri = _case("page_id", F.col("url"), F.concat("url", F.lit("#")), F.concat("url", F.lit("/")), F.concat(F.lit("urn:page:"), "page_id"))
    u = read(spark, sf_dir, "pages").select("page_id", iri.alias("iri"))
    i = F.col("iri")
    return u.select("page_id", T.local_part(i).alias("individual"), T.local_part(i, "#/:").alias("published"), T.local_in_rules(i).alias("in_rules"), T.local_in_schema(i).alias("in_schema"))


# Files.
@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'rdfxml' WHEN 1 THEN 'jsonld' WHEN 2 THEN 'ntriples' WHEN 3 THEN 'turtle' WHEN 4 THEN 'rdfxml' ELSE 'turtle' END AS form FROM events")
def file_formats(spark, sf_dir):
    """Formats by content, and by an extension that the content does not show."""
    line = F.concat(F.lit("<http://x/s> <http://x/p> \""), "event_type", F.lit("\" .\n"))
    content = _case("event_id", F.concat(F.lit("<?xml version=\"1.0\"?><a>"), "event_type", F.lit("</a>")), F.col("props"), line, F.concat(F.lit("@prefix x: <http://x/> .\nx:"), "event_type", F.lit(" x:p 1 .")), line, line)
    name = _case("event_id", *[F.lit("graph")] * 4, F.lit("graph.RDF"), F.lit("graph.ttl"))
    return read(spark, sf_dir, "events").select("event_id", rdf.format_of(name, content).alias("form"))


@query(
    "WITH f AS (SELECT text, sha256(text) AS sha256, 'files/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.csv' ELSE '.exe' END AS path FROM documents WHERE text IS NOT NULL),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS i FROM f)"
    " SELECT sha256, substr(path, 7) AS filename, lower(string_split(path, '.')[-1]) AS ext, octet_length(encode(text))::BIGINT AS size_bytes, CASE WHEN NOT ends_with(path, '.exe') THEN text END AS text FROM k WHERE i = 1"
)
def parsed_files(spark, sf_dir):
    """Each distinct text as a file, the first of equal ones; what is no document has no text."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    path = F.concat(F.lit("files/"), "doc_id", _case("doc_id", F.lit(".txt"), F.lit(".MD"), F.lit(".csv"), F.lit(".exe")))
    files = d.select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return documents.parsed(files).drop("path")


@query(
    "WITH h AS (SELECT DISTINCT sha256(url) AS h FROM pages WHERE url IS NOT NULL)"
    " SELECT sha256(string_agg(h || ' ' || h[1:2] || '/' || h[3:4] || '/' || h, chr(10) ORDER BY h)) AS hash FROM h"
)
def folder_hash(spark, sf_dir):
    """The hash of a folder of blobs, one for each address."""
    at = fresh_dir(spark, "blobs")
    blobs.write_blobs(read(spark, sf_dir, "pages").select(F.encode("url", "UTF-8").alias("content")), at).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(history.directory_hash(spark, at),)], "hash string")


# Labels and sources.
@query(
    "WITH d AS (SELECT doc_id, text, regexp_extract(text, '^\\W*(\\w+)', 1) AS label FROM documents), p AS (SELECT *, string_split(lower(text), lower(label)) AS s FROM d WHERE label <> ''),"
    " h AS (SELECT doc_id, label, length(text) AS n, i, (list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * length(label))::BIGINT AS hit FROM (SELECT *, unnest(range(1, len(s))) AS i FROM p)),"
    " w AS (SELECT doc_id, label, hit, greatest(0, hit - 320) AS a, least(n, hit + length(label) + 320) AS b FROM h),"
    " g AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY hit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),"
    " r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY hit ROWS UNBOUNDED PRECEDING) AS run FROM g)"
    " SELECT doc_id, label, min(a)::INTEGER AS start, max(b)::INTEGER AS stop FROM r GROUP BY doc_id, label, run"
)
def evidence_windows(spark, sf_dir):
    """Windows around each document's first word, wherever it comes again."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^\W*(\w+)", 1).alias("label"))
    return d.select("doc_id", "label", F.explode(X.evidence_windows("label", "text")).alias("w")).select("doc_id", "label", "w.start", "w.stop")


_HOLDS = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part UNION SELECT DISTINCT p_name FROM part), c AS (SELECT p_partkey AS chunk_id, p_name AS text FROM part), h AS (SELECT label, chunk_id, text FROM w JOIN c ON contains(' ' || text || ' ', ' ' || label || ' '))"


def _labels(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return p.select(F.explode(F.split("p_name", " ")).alias("label")).unionByName(p.select(F.col("p_name").alias("label"))).distinct()


def _chunks(spark, sf_dir):
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text"))


@query(f"WITH {_HOLDS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chunk_id) AS i FROM h) SELECT label, chunk_id FROM r WHERE i <= 4")
def grounding_chunks(spark, sf_dir):
    """The first chunks that hold each word and each name."""
    return extraction.grounding_chunks(_labels(spark, sf_dir), _chunks(spark, sf_dir))


@query(
    f"WITH {_HOLDS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chunk_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM h),"
    " k AS (SELECT * FROM r WHERE n <= 8 OR i IN (SELECT round_even(j * (n - 1) / 7.0, 0) FROM range(8) t(j)))"
    " SELECT label, chunk_id, 0 AS start, length(text)::INTEGER AS stop FROM k"
)
def recovery_windows(spark, sf_dir):
    """Evidence in an even sample of all chunks that hold a label."""
    return pipelines.recovery_candidates(_labels(spark, sf_dir), _chunks(spark, sf_dir))


# Replies and guards.
def _replies(spark, sf_dir):
    """A fenced reply for each part; every seventh is no JSON."""
    p = _parts(spark, sf_dir)
    cls = lambda c: F.struct(F.concat(F.lit(" "), c).alias("label"))
    axiom = F.struct(F.col("p_name").alias("sub"), F.col("p_type").alias("super"))
    apart = F.struct(F.col("p_type").alias("a"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("b"))
    head = F.struct(F.array(cls(F.col("p_name")), cls(F.lit(""))).alias("classes"), F.array(axiom).alias("subclass_of"), F.array(apart).alias("disjoint_with"))
    reply = F.when(F.col("p_partkey") % 7 == 0, "no object here").otherwise(F.concat(F.lit("Sure:\n```json\n"), F.to_json(head), F.lit("\n```")))
    return p.select(F.col("p_partkey").alias("chunk_id"), reply.alias("reply"))


@query(
    "WITH p AS (SELECT * FROM part WHERE p_partkey % 7 <> 0) SELECT p_partkey AS chunk_id, 'class' AS type, p_name AS a, NULL AS b FROM p"
    " UNION ALL SELECT p_partkey, 'subclass', p_name, p_type FROM p UNION ALL SELECT p_partkey, 'disjoint', p_type, p_brand FROM p WHERE p_size > 25"
)
def schema_replies(spark, sf_dir):
    """Classes and axioms of replies; rows without what they need go."""
    found = extraction.parse_schema(_replies(spark, sf_dir))
    return found["classes"].select("chunk_id", F.lit("class").alias("type"), F.col("label").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(found["axioms"].select("chunk_id", "type", "a", "b"))


@query("SELECT p_partkey AS chunk_id, p_name AS label, 'made by' AS property, p_brand AS value FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, p_name, 'sold in', p_type FROM part WHERE p_partkey % 7 <> 0")
def individual_replies(spark, sf_dir):
    """Attributes and relations of the individuals in replies."""
    p = _parts(spark, sf_dir)
    ind = F.struct(
        F.col("p_name").alias("label"), F.col("p_type").alias("class"), F.array(F.struct(F.lit(" made by ").alias("property"), F.col("p_brand").alias("value")), F.struct(F.lit("").alias("property"), F.col("p_brand").alias("value"))).alias("attributes"),
        F.array(F.struct(F.lit("sold in").alias("property"), F.col("p_type").alias("target"))).alias("relations"),
    )
    reply = F.when(F.col("p_partkey") % 7 == 0, F.lit("{")).otherwise(F.to_json(F.struct(F.array(ind).alias("individuals"))))
    found = extraction.parse_individuals(p.select(F.col("p_partkey").alias("chunk_id"), reply.alias("reply")))
    return found["attributes"].select("chunk_id", "label", "property", "value").unionByName(found["relations"].select("chunk_id", "label", "property", F.col("target").alias("value")))


def _guarded(spark, sf_dir):
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("Type: "), "p_type", F.lit("\nMade by: "), "p_brand", F.lit("\nThe "), "p_name", F.lit(" is an instance of it."))
    labels = F.array(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit("xsd:integer"), F.lit("Absent Thing"))
    classes = p.select(F.col("p_partkey").alias("chunk_id"), F.posexplode(labels).alias("pos", "label"))
    return extraction.guard_classes(classes, p.select(F.col("p_partkey").alias("chunk_id"), text.alias("text")))


@query(
    "SELECT p_partkey AS chunk_id, 'property' AS part, 'size' AS a, 'data' AS b FROM part UNION ALL SELECT p_partkey, 'class', p_type, NULL FROM part"
    " UNION ALL SELECT p_partkey, 'axiom', p_type, p_type FROM part WHERE p_partkey % 2 = 1"
)
def clean_schema(spark, sf_dir):
    """Blocked classes go with their axioms, empty properties go, a datatype as range makes a data property."""
    guarded = written(_guarded(spark, sf_dir))
    each = guarded.select("chunk_id").distinct()
    props = F.array(F.struct(F.concat(F.lit("size "), "chunk_id").alias("label"), F.lit("integer").alias("range")), F.struct(F.lit("has").alias("label"), F.lit("integer").alias("range")))
    none = F.lit(None).cast("string")
    delta = {
        "properties": each.select("chunk_id", F.posexplode(props).alias("pos", "x")).select("chunk_id", "pos", "x.label", none.alias("comment"), none.alias("domain"), "x.range", F.lit("object").alias("kind")),
        "axioms": guarded.filter("pos = 1").select("chunk_id", "pos", F.lit("subclass").alias("type"), F.col("label").alias("a"), F.when(F.col("chunk_id") % 2 == 1, F.col("label")).otherwise("Absent Thing").alias("b"), none.alias("evidence")),
    }
    clean = extraction.clean_schema(delta, guarded)
    out = clean["classes"].select("chunk_id", F.lit("class").alias("part"), F.col("label").alias("a"), none.alias("b"))
    out = out.unionByName(clean["properties"].select("chunk_id", F.lit("property").alias("part"), F.regexp_replace("label", " [0-9]+$", "").alias("a"), F.col("kind").alias("b")))
    return out.unionByName(clean["axioms"].select("chunk_id", F.lit("axiom").alias("part"), "a", "b"))


# Decisions.
def _decisions(spark, sf_dir, confidence):
    """Two decisions on each name, of which the first counts; quotes of every fifth part are not in its chunk."""
    p = _parts(spark, sf_dir)
    row = F.struct(F.lit(0).alias("seq"), confidence.cast("string").alias("confidence"), (F.col("p_partkey") % 3 != 0).alias("keep")), F.struct(F.lit(1).alias("seq"), F.lit("1").alias("confidence"), F.lit(True).alias("keep"))
    quote = F.when(F.col("p_partkey") % 5 == 0, "somewhere else").otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("chunk_id"), F.initcap("p_name").alias("label"), F.lit("type").alias("role"), quote.alias("evidence"), F.explode(F.array(*row)).alias("x")).select("chunk_id", "label", "role", "evidence", "x.*")


@query("SELECT p_partkey AS chunk_id, p_name AS label FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size / 50 >= 0.7")
def verified_roles(spark, sf_dir):
    """Classes that their first decision keeps, surely enough and with a quote that the chunk holds."""
    delta = _chunks(spark, sf_dir).withColumnRenamed("text", "label")
    return extraction.verified_roles(delta, _decisions(spark, sf_dir, F.col("p_size") / 50), _chunks(spark, sf_dir))


@query(
    "SELECT p_partkey AS chunk_id, CASE WHEN p_name < 'm' THEN string_split(p_name, ' ')[-1] ELSE p_name END AS label FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND (p_size / 50 >= 0.7 OR (51 - p_size) / 50 >= 0.7)"
)
def verified_classes(spark, sf_dir):
    """Critic, then adjudicator for the rest, then names for what is denoted."""
    delta = _chunks(spark, sf_dir).withColumnRenamed("text", "label")
    names = _parts(spark, sf_dir).select(F.col("p_name").alias("source")).distinct()
    denoted = names.filter("source < 'm'").select("source", F.element_at(F.split("source", " "), -1).alias("replacement")).unionByName(names.filter("source >= 'm'").select("source", F.element_at(F.split("source", " "), 1).alias("replacement")))
    critic, adjudicator = _decisions(spark, sf_dir, F.col("p_size") / 50), _decisions(spark, sf_dir, (51 - F.col("p_size")) / 50)
    return pipelines.verify(delta, _chunks(spark, sf_dir), critic, adjudicator, denoted)


@query(
    "WITH v AS (SELECT p_name AS sub, p_type AS super, p_size / 50 AS c, p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_size / 50 >= 0.85), r AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY c DESC, super) AS i FROM v) SELECT sub, super FROM r WHERE i = 1"
)
def accepted_links(spark, sf_dir):
    """Of each name's sure and quoted parents the surest."""
    p = _parts(spark, sf_dir)
    quote = F.when(F.col("p_partkey") % 5 == 0, "somewhere else").otherwise(F.col("p_name"))
    links = p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("sub"), F.col("p_type").alias("super"), (F.col("p_size") / 50).cast("string").alias("confidence"), quote.alias("evidence"))
    return pipelines.accepted_links(links, _chunks(spark, sf_dir))


@query(
    "WITH n AS (SELECT DISTINCT p_name AS sub FROM part), v AS (SELECT sub, string_split(sub, ' ')[-1] AS super FROM n UNION SELECT sub, string_split(sub, ' ')[1] FROM n), m AS (SELECT super, count(DISTINCT sub) AS n FROM v GROUP BY super)"
    " SELECT sub, super FROM v JOIN m USING (super) WHERE n <= 12 AND super = string_split(sub, ' ')[-1]"
)
def attached_parents(spark, sf_dir):
    """Parents for isolated classes: heads of their names, unless too many classes name them."""
    names = _parts(spark, sf_dir).select(F.col("p_name").alias("label")).distinct()
    words = F.split("label", " ")
    votes = names.select(F.col("label").alias("sub"), F.explode(F.array(F.element_at(words, -1), F.element_at(words, 1))).alias("super"))
    return pipelines.attach(names.withColumn("iri", F.col("label")), votes, 12)
