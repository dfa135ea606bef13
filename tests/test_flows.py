import glob
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import pipelines as P
from graphloom.operators import store
from graphloom.sources import blobs, documents, rdf


def test_verify_and_links(spark):
    chunks = spark.createDataFrame([(1, "A centrifugal pump is a pump. A valve too.")], "chunk_id long, text string")
    classes = spark.createDataFrame([(1, "Centrifugal Pump"), (1, "Valve"), (1, "Ghost")], "chunk_id long, label string")
    say = lambda *r: spark.createDataFrame([*r], "chunk_id long, label string, keep boolean, role string, confidence string, evidence string, seq int")
    critic = say((1, "centrifugal pump", True, "type", "0.9", "A centrifugal pump is a pump", 1), (1, "Valve", False, "type", "0.9", "A valve too", 1), (1, "Ghost", True, "type", "0.9", "not there at all", 1))
    second = say((1, "Valve", True, "type", "0.8", "A valve too", 1))
    names = spark.createDataFrame([("Centrifugal Pump", "Pump"), ("Valve", "Other")], "source string, replacement string")
    assert [r.label for r in P.verify(classes, chunks, critic).collect()] == ["Centrifugal Pump"]
    assert sorted(r.label for r in P.verify(classes, chunks, critic, second, names).collect()) == ["Pump", "Valve"]
    links = spark.createDataFrame([(1, "Centrifugal Pump", "Pump", "0.9", "centrifugal pump is a pump"), (1, "Centrifugal Pump", "Thing", "0.86", "A valve too"), (1, "Valve", "Pump", "0.5", "A valve too")], "chunk_id long, sub string, super string, confidence string, evidence string")
    assert [tuple(r) for r in P.accepted_links(links, chunks).collect()] == [("Centrifugal Pump", "Pump")]
    assert [tuple(r)[:2] for r in P.recovery_candidates(spark.createDataFrame([("valve",), ("nowhere",)], "label string"), chunks).collect()] == [("valve", 1)]
    iso = spark.createDataFrame([("i", "Centrifugal Pump"), ("v", "Valve")], "iri string, label string")
    assert [tuple(r) for r in P.attach(iso, spark.createDataFrame([("Centrifugal Pump", "Pump"), ("Valve", "Pump")], "sub string, super string")).collect()] == [("Centrifugal Pump", "Pump")]


def test_merging(spark):
    ents = spark.createDataFrame([("a", "Big Pump"), ("b", "big pump"), ("c", "bigPump"), ("d", "Valve")], "iri string, label string")
    names = P.duplicates_to_merge(ents, None, None)
    assert sorted(tuple(r) for r in names.collect()) == [("b", "a"), ("c", "a")]
    assert P.duplicates_to_merge(ents, None, spark.createDataFrame([], "iri_a string, iri_b string, keep boolean")).count() == 0
    q = spark.createDataFrame([("g", "iri", "a", "p", "iri", "b", None, None), ("g", "iri", "b", "n", "literal", "b", None, None), ("g", "iri", "d", "p", "iri", "c", None, None), ("g", "iri", "d", "p", "iri", "d", None, None)], store.SCHEMA)
    assert sorted((r.s, r.p, r.o) for r in P.merge_duplicates(q, names).collect()) == [("a", "n", "b"), ("d", "p", "a"), ("d", "p", "d")]


def test_document_exports(spark, tmp_path):
    hard = 'a & b < "c" > é'
    q = spark.createDataFrame([("g", "iri", "urn:x:s", "urn:x:p", "literal", hard, None, "en"), ("g", "iri", "urn:x:s", "urn:x:q", "iri", "urn:x:o", None, None), ("g", "bnode", "b", "urn:x:n", "literal", "5", T.XSD + "integer", None)], store.SCHEMA)
    rdf.write_rdfxml(q.coalesce(1), str(tmp_path / "xml"))
    back = {t for f in glob.glob(f"{tmp_path}/xml/part-*") if (s := open(f, encoding="utf-8").read()).strip() for t in rdf.triples_of(s, "rdfxml", "", "z") if ET.fromstring(s) is not None}
    assert (("iri", "urn:x:s", None, None), "urn:x:p", ("literal", hard, None, "en")) in back and len(back) == 3
    rdf.write_jsonld(q, str(tmp_path / "json"))
    objects = [o for f in glob.glob(f"{tmp_path}/json/part-*") if (s := open(f, encoding="utf-8").read()).strip() for o in json.loads(s)]
    mine = next(o for o in objects if o["@id"] == "urn:x:s")
    assert mine["urn:x:p"] == [{"@value": hard, "@language": "en"}] and mine["urn:x:q"] == [{"@id": "urn:x:o"}] and len(objects) == 2


def test_blobs_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),), (None,)], "content binary")
    made = blobs.write_blobs(rows, f"file://{tmp_path}/cas")
    assert made.count() == 2 and blobs.write_blobs(rows, f"file://{tmp_path}/cas").count() == 2
    kept = blobs.read_blobs(spark, str(tmp_path / "cas"))
    assert {bytes(r.content) for r in kept.collect()} == {b"one", b"two"}
    docs = kept.filter("size_bytes = 3").limit(1).select("sha256")
    assert blobs.unreferenced(kept, docs).count() == 1 and blobs.reference_counts(docs).first()["n"] == 1

    import zipfile

    (tmp_path / "docs").mkdir()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "docs" / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Hello")}{p(" ")}<w:tbl><w:tr><w:tc>{p("x")}</w:tc><w:tc>{p("y")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "docs" / "b.csv").write_text("a,b\n1,2")
    (tmp_path / "docs" / "c.md").write_text("a,b\n1,2")
    (tmp_path / "docs" / "bad.docx").write_bytes(b"no zip")
    got = {r.filename: r.text for r in documents.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got == {"a.docx": "Hello\nx\ny\nx | y", "b.csv": "a,b\n1,2", "bad.docx": None}


def test_keys(spark):
    d = spark.createDataFrame([("disjoint", "b", "a"), ("subclass", "b", "a")], "k string, a string, b string")
    assert [r[0] for r in d.select(T.axiom_key(F.col("k"), F.col("a"), F.col("b"))).collect()] == ["disjoint|a|b", "subclass|b|a"]


def test_recovery_samples_all_occurrences(spark):
    chunks = spark.createDataFrame([(i, ("valve " + "q" * 1994) * 5) for i in range(30)], "chunk_id long, text string")
    got = P.recovery_candidates(spark.createDataFrame([("valve",)], "label string"), chunks).collect()
    assert sorted((r.chunk_id, r.start, r.stop) for r in got) == [(c, *w) for c in (0, 4, 8, 12, 17, 21, 25, 29) for w in ((0, 325), (7680, 8325))]
    assert sorted(r.chunk_id for r in P.recovery_candidates(spark.createDataFrame([("valve",)], "label string"), chunks, 1, 1).collect()) == [15]


def test_directory_hash_goes_by_relative_paths(spark, tmp_path):
    from graphloom.operators import history

    def folder(name, files):
        for path, text in files.items():
            at = tmp_path / name / path
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(text)
        return history.directory_hash(spark, f"file://{tmp_path}/{name}")

    one = folder("one", {"a/x.txt": "first", "b/x.txt": "second"})
    assert one == folder("two", {"a/x.txt": "first", "b/x.txt": "second"})
    assert one != folder("three", {"a/x.txt": "second", "b/x.txt": "first"})
