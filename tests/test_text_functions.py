"""Labels, chunks, evidence and replies."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import text as X
from graphloom.operators import extraction
from graphloom.sources import documents, rdf

CHUNKS = [
    ("First sentence. Second sentence.\n\nThird paragraph.", [(0, 0, 16, "First sentence. ", 5), (1, 6, 32, "sentence. Second sentence.", 8), (2, 16, 50, "Second sentence.\n\nThird paragraph.", 11)]),
    ("第一句。第二句。\n\n第三段。", [(0, 0, 14, "第一句。第二句。\n\n第三段。", 12)]),
    ("Pump P-101 温度为 80°C。Next sentence.", [(0, 0, 15, "Pump P-101 温度为 ", 7), (1, 5, 34, "P-101 温度为 80°C。Next sentence.", 14)]),
]


@pytest.mark.parametrize("text,want", CHUNKS)
def test_golden_chunks(text, want):
    assert [tuple(c.values()) for c in X.chunk(text, 24, 6)] == want


def test_chunks_cover_texts(spark):
    docs = spark.createDataFrame([(1, CHUNKS[0][0]), (2, None), (3, "  "), (4, "word " * 5000)], "doc_id long, text string")
    got = X.chunks(docs, 200, 20)
    assert {r.doc_id for r in got.collect()} == {1, 4}
    spans = [(r.char_start, r.char_end) for r in got.filter("doc_id = 4").orderBy("idx").collect()]
    assert spans[0][0] == 0 and spans[-1][1] == 25000 and all(b[0] <= a[1] < b[1] for a, b in zip(spans, spans[1:]))


def test_terms(spark):
    rows = [("centrifugalPump  A-1", "centrifugal pump a 1", "CentrifugalPumpA1", "centrifugalPumpA1"), ("", "", "Class", "property"), ("阀门", "阀门", "阀门", "阀门"), ("HTTPServer x", "httpserver x", "HttpserverX", "httpserverX")]
    d = spark.createDataFrame(rows, "x string, n string, c string, p string")
    got = d.select(T.norm_label(F.col("x")) == F.col("n"), T.class_local_name(F.col("x")) == F.col("c"), T.property_local_name(F.col("x")) == F.col("p")).collect()
    assert all(all(r) for r in got)
    types = spark.createDataFrame([("int", "integer"), ("xsd:Double", "decimal"), (f"<{T.XSD}dateTime>", "dateTime"), ("weird", None)], "x string, y string")
    assert all(r[0] == (None if r[1] is None else T.XSD + r[1]) for r in types.select(T.canonical_datatype(F.col("x")), "y").collect())
    pairs = spark.createDataFrame([("Centrifugal Pump", "Pump", True, False), ("Pump Station", "Pump", False, True), ("Pump", "Pump", False, False)], "a string, b string, safe boolean, bad boolean")
    assert all(r[0] == r[2] and r[1] == r[3] for r in pairs.select(T.safe_subclass(F.col("a"), F.col("b")), T.head_mismatch(F.col("a"), F.col("b")), "safe", "bad").collect())
    j = spark.createDataFrame([("a b", "a b", 1.0), ("a b c", "a b d", 0.5), ("a b", "a b b", 2 / 3)], "a string, b string, s double")
    assert all(abs(r[0] - r[1]) < 1e-12 for r in j.select(T.jaccard(F.col("a"), F.col("b")), "s").collect())
    c = spark.createDataFrame([("0.5", 0.5), ("7", 1.0), ("NaN", None), ("x", None), (None, None)], "a string, b double")
    assert all(r[0] == r[1] for r in c.select(T.clamp_confidence(F.col("a")), "b").collect())


def test_local_names(spark):
    rows = [
        ("http://x/a#b", "b", "b", "b", "b"), ("http://x/a#", "", "", "a#", ""), ("http://x/a/", "", "", "http://x/a/", "a"), ("urn:Animal", "urn:Animal", "Animal", "urn:Animal", "urn:Animal"),
        ("http://x#a/b", "b", "b", "a/b", "a/b"), ("", "", "", "", ""), (None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "x string, individual string, published string, rules string, schema string")
    x = F.col("x")
    got = d.select(T.local_part(x), T.local_part(x, "#/:"), T.local_in_rules(x), T.local_in_schema(x), "individual", "published", "rules", "schema").collect()
    assert all(tuple(r[:4]) == tuple(r[4:]) for r in got)


def test_formats(spark):
    rows = [("a.TTL", "{}", "turtle"), ("a", '{"@id": "x"}', "jsonld"), ("a.b", "<s> <p> <o> .", "ntriples"), (None, "<?xml?>", "rdfxml"), ("a", None, None), ("a", "", "turtle")]
    d = spark.createDataFrame(rows, "n string, c string, want string")
    assert all(r[0] == r[1] for r in d.select(rdf.format_of("n", "c"), "want").collect())


def test_files_of_equal_content(spark):
    rows = [("d/b.txt", 1, b"x"), ("d/a.MD", 1, b"x"), ("d/c.exe", 1, b"y"), ("d/e.docx", 1, b"z"), ("d/f.csv", 0, b"")]
    got = documents.parsed(spark.createDataFrame(rows, "path string, length long, content binary"))
    assert sorted((r.filename, r.ext, r.text) for r in got.collect()) == [("a.MD", "md", "x"), ("c.exe", "exe", None), ("e.docx", "docx", None), ("f.csv", "csv", "")]
    assert documents.parsed(spark.createDataFrame([], "path string, length long, content binary")).count() == 0


def test_window_spans():
    assert X.windows("a_b", "zz a b " + "q" * 900 + " A_B", 10) == [(0, 16), (898, 911)]


def test_replies(spark):
    reply = '```json\n{"classes": [{"label": "Pump"}, {"label": ""}, {"comment": "x"}], "object_properties": [{"label": "has size", "range": "integer", "domain": "Pump"}], "subclass_of": [{"sub": "Pump Station", "super": "Pump"}, {"sub": "Valve", "super": "Pump"}]}\n```'
    replies = spark.createDataFrame([(1, reply), (2, "not json"), (3, None)], "chunk_id long, reply string")
    delta = extraction.parse_schema(replies)
    assert [r.label for r in delta["classes"].collect()] == ["Pump"] and delta["axioms"].count() == 2
    chunks = spark.createDataFrame([(1, "A Pump moves water.")], "chunk_id long, text string")
    guarded = extraction.guard_classes(delta["classes"], chunks)
    assert guarded.first()["blocked"] is None
    clean = extraction.clean_schema(delta, guarded)
    prop = clean["properties"].first()
    assert (prop["kind"], prop["range"], prop["domain"]) == ("data", T.XSD + "integer", "Pump") and clean["axioms"].count() == 0
    quads = extraction.schema_quads(clean, "urn:g", "urn:x:")
    assert quads.filter("s = 'urn:x:Pump'").count() == 2 and quads.filter("s = 'urn:x:hasSize'").count() == 4


def test_boundary_cases(spark):
    cases = [
        ("Country", "Type: Country\nName: Argentina\nA country is a state.", True), ("Argentina", "Type: Country\nName: Argentina\nA country is a state.", False), ("xsd:string", "Type: Measurement\nUnit: xsd:string", False),
        ("Ghost", "nothing here", False), ("Blue Danube", "Blue Danube is an instance of Winery", False),
    ]
    chunks = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)], "chunk_id long, text string")
    classes = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "chunk_id long, label string")
    got = {r.label: r.blocked is None for r in extraction.guard_classes(classes, chunks).collect()}
    assert got == {c: ok for c, _, ok in cases}


def test_individuals(spark):
    reply = '{"individuals": [{"label": "P-101", "class": "Pump", "attributes": [{"property": "size", "value": "5"}], "relations": [{"property": "feeds", "target": "T-1"}, {"property": "feeds", "target": "nowhere"}]}, {"label": "T-1", "class": "Tank"}, {"label": "Q", "class": "Unknown"}]}'
    found = extraction.parse_individuals(spark.createDataFrame([(1, reply)], "chunk_id long, reply string"))
    idx = lambda *r: spark.createDataFrame([*r], "norm string, iri string")
    out = extraction.merge_individuals(found, idx(("pump", "urn:Pump"), ("tank", "urn:Tank")), idx(("size", "urn:size"), ("feeds", "urn:feeds")), idx(("t 1", "urn:old-tank")), "urn:g", "urn:x:")
    assert out["quads"].count() == 6 and out["quads"].filter("o = 'urn:old-tank'").count() == 1
    assert [r.target for r in out["pending"].collect()] == ["nowhere"] and [tuple(r) for r in out["unknown"].collect()] == [("Unknown", 1)]


def test_windows_of_all_hits(spark):
    text = ("ab" + "q" * 98) * 30
    every = [(max(0, 100 * i - 10), 100 * i + 12) for i in range(30)]
    assert X.windows("ab", text, 10) == every
    assert X.windows("ab", text, 10, 4) == [every[i] for i in (0, 10, 19, 29)]
    d = spark.createDataFrame([("ab", ("ab" + "q" * 998) * 30)], "label string, text string")
    assert [(w.start, w.stop) for w in d.select(X.evidence_windows("label", "text")).first()[0]] == [(max(0, 1000 * i - 320), min(30000, 1000 * i + 322)) for i in range(30)]
