"""Knowledge-graph operators on small graphs, by hand and against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import algebra as A
from graphloom.operators import conflicts, edits, graph, history, similarity, store, validation, views
from graphloom.sources import mapping, rdf
from graphloom.sources.mapping import QUAD

G = "urn:g"


def quads(spark, rows):
    """(s, p, o) with o an IRI, or a ("text", dt, lang) literal; blank nodes begin with _:"""
    out = []
    for s, p, o in rows:
        sk, s = ("bnode", s[2:]) if s.startswith("_:") else ("iri", s)
        if isinstance(o, tuple):
            out.append((G, sk, s, p, "literal", *(o + (None, None))[:3]))
        else:
            out.append((G, sk, s, p, *(("bnode", o[2:]) if o.startswith("_:") else ("iri", o)), None, None))
    return spark.createDataFrame(out, store.SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closures_against_python(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(18)}
        frame = spark.createDataFrame([*edges], "child long, parent long")
        up = {a: {b for x, b in edges if x == a} for a in range(14)}
        for _ in range(14):
            up = {a: v | set(itertools.chain.from_iterable(up[x] for x in v)) for a, v in up.items()}
        assert rows(graph.ancestors(frame)) == sorted((a, b) for a, v in up.items() for b in v)
        loops = {a: min(b for b in v if a in up[b]) for a, v in up.items() if a in v}
        assert rows(graph.cycles(frame)) == sorted((min(r, a), a) for a, r in loops.items())
        nodes = {x for e in edges for x in e}
        root = {n: n for n in nodes}
        for _ in nodes:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert rows(graph.components(frame.select(F.col("child").alias("a"), F.col("parent").alias("b")))) == sorted(root.items())
        got = graph.reachable(frame.select(F.col("child").alias("a"), F.col("parent").alias("b")), spark.createDataFrame([(3,)], "node long"))
        assert {r[0] for r in got.collect()} == {3} | up[3]
    assert graph.ancestors(frame.limit(0)).count() == graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lists_and_garbage(spark):
    first, rest = T.RDF + "first", T.RDF + "rest"
    q = quads(spark, [("_:a", first, "urn:1"), ("_:a", rest, "_:b"), ("_:b", first, "urn:2"), ("_:b", rest, "_:c"), ("_:c", first, "urn:3"), ("_:c", rest, T.RDF + "nil"), ("_:x", first, "urn:9"), ("_:x", rest, "_:x"), ("urn:p", T.DOMAIN, "_:a")])
    heads = spark.createDataFrame([("a",), ("x",)], "head string")
    got = graph.list_members(q, heads, first, rest, T.RDF + "nil", max_hops=5)
    assert rows(got.filter("head = 'a'")) == [("a", 0, "urn:1"), ("a", 1, "urn:2"), ("a", 2, "urn:3")]
    assert got.filter("head = 'x'").count() == 5
    assert edits.collect_garbage(q).count() == 7
    made = edits.set_union(q, G, "urn:p", T.DOMAIN, ["urn:C", "urn:D"])
    assert rows(validation.slot_members(made, T.DOMAIN)) == [("urn:p", "urn:C"), ("urn:p", "urn:D")]
    with pytest.raises(ValueError):
        edits.set_union(q, G, "urn:p", T.DOMAIN, ["urn:C"])


def test_store(spark, tmp_path):
    a = quads(spark, [("urn:s", "urn:p", "urn:o"), ("urn:s", "urn:p", ("x",)), ("urn:s", "urn:p", ("x", None, "en")), ("_:b", "urn:p", ("1", T.XSD + "integer"))])
    one = quads(spark, [("urn:s", "urn:p", ("x",))])
    assert store.insert(a, one).count() == 4 and store.remove(a, one).count() == 3 and store.contains(a, one).count() == 1
    assert store.match(a, s="b", s_kind="bnode").count() == 1 and store.match(a, graph=None).count() == 0 and store.match(a, o="x", o_lang="en").count() == 1
    assert [r[0] for r in store.lines(a).orderBy("line").collect()] == ['<urn:s> <urn:p> "x" <urn:g> .', '<urn:s> <urn:p> "x"@en <urn:g> .', "<urn:s> <urn:p> <urn:o> <urn:g> .", f'_:b <urn:p> "1"^^<{T.XSD}integer> <urn:g> .']
    assert rows(store.layer_signature(a)) == rows(store.layer_signature(a.orderBy(F.rand(1))))
    assert rows(store.set_fingerprint(a)) == rows(store.set_fingerprint(a.unionByName(a)))
    assert rows(store.set_fingerprint(a)) != rows(store.set_fingerprint(store.remove(a, one)))
    s = store.SnapshotStore(spark, str(tmp_path / "kg"))
    assert s.read().count() == 0
    assert s.commit(a) == 1 and s.commit(store.remove(a, one)) == 2
    assert s.read().count() == 3 and s.read(1).count() == 4 and s.revert(1) == 3 and s.read().count() == 4
    assert store.replace_graph(a, G, one).count() == 1 and store.replace_graph(a, "urn:other", one).count() == 5
    diff = store.diff_lines(store.lines(a), store.lines(store.remove(a, one)))
    assert rows(diff) == [("removed", '<urn:s> <urn:p> "x" <urn:g> .')]


def test_line_formats_round_trip(spark, tmp_path):
    hard = 'quote " back \\ tab \t line \n ret \r é 😀 \\n'
    a = quads(spark, [("urn:s", "urn:p", (hard, None, "en-GB")), ("_:b1", "urn:p", "_:b2"), ("urn:s", "urn:p", ("5", T.XSD + "integer")), ("urn:h#x", "urn:p", "urn:h#label")])
    rdf.write_nquads(a, str(tmp_path / "nq"))
    back = rdf.read_nquads(spark, str(tmp_path / "nq"))
    assert rows(back.select([F.coalesce(c, F.lit("-")) for c in QUAD])) == rows(a.select([F.coalesce(c, F.lit("-")) for c in QUAD]))
    lines = spark.createDataFrame([("<urn:a> <urn:b> \"\\u00e9\\U0001F600\" .",), ("broken",), ("",), ("# note",), ("<urn:a> <urn:b> <urn:c> <urn:g2> . # end",)], "value string")
    got = rows(rdf.parse_lines(lines, "urn:d").select("g", "o"))
    assert got == [("urn:d", "é😀"), ("urn:g2", "urn:c")]


def test_import_formats(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix ex: <urn:x:> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\nex:Pump a owl:Class ; ex:l "a;b"@en, 5, 1.5, true .\nex:p101 a ex:Pump ; ex:has [ ex:q ( ex:i ex:j ) ] . # end\n')
    (tmp_path / "b.rdf").write_text(f'<?xml version="1.0"?><rdf:RDF xmlns:rdf="{T.RDF}" xmlns:x="urn:x:"><x:Pump rdf:about="urn:x:p2"><x:l xml:lang="de">é</x:l><x:near rdf:resource="urn:x:p1"/><x:n rdf:datatype="{T.XSD}integer">7</x:n></x:Pump></rdf:RDF>')
    (tmp_path / "c.nt").write_text("<urn:x:s> <urn:x:p> <urn:x:o> .\n<urn:x:s> <urn:x:p> <urn:x:o> .\n")
    got = rdf.import_files(spark, str(tmp_path), G)
    assert got.filter("s = 'urn:x:Pump'").count() == 5 and got.filter("s = 'urn:x:p2'").count() == 4 and got.filter("s = 'urn:x:s'").count() == 1
    assert got.filter(F.col("p") == T.RDF + "first").count() == 2
    schema, instances = edits.split_import(got)
    assert schema.filter("s = 'urn:x:Pump'").count() == 5 and instances.filter("s = 'urn:x:p101'").count() == 2
    assert rows(got.select("s", "p", "o")) == rows(rdf.import_files(spark, str(tmp_path), G).select("s", "p", "o"))
    rdf.write_turtle(got, str(tmp_path / "out"))
    assert rdf.sniff("<a> <b> <c> .") == "ntriples" and rdf.sniff("@prefix a: <b> .") == "turtle" and rdf.sniff('{"@id": 1}') == "jsonld"


def test_conflict_rules(spark):
    C, P = T.CLASS, T.OBJECT_PROPERTY
    q = quads(spark, [
        *[(f"urn:{c}", T.TYPE, C) for c in "ABCDEXY"], ("urn:A", T.SUBCLASS, "urn:B"), ("urn:B", T.SUBCLASS, "urn:A"), ("urn:C", T.SUBCLASS, "urn:D"), ("urn:C", T.DISJOINT, "urn:D"),
        ("urn:E", T.SUBCLASS, "urn:X"), ("urn:E", T.SUBCLASS, "urn:Y"), ("urn:Y", T.DISJOINT, "urn:X"), ("urn:X", T.EQUIVALENT, "urn:Y"), ("urn:Y", T.EQUIVALENT, "urn:X"),
        ("urn:p", T.TYPE, P), ("urn:p", T.DOMAIN, "urn:C"), ("urn:p", T.DOMAIN, "urn:D"), ("urn:q", T.TYPE, P), ("urn:q", T.DOMAIN, "urn:X"), ("urn:q", T.DOMAIN, "urn:Y"),
        ("urn:A", T.LABEL, ("Pump",)), ("urn:B", T.LABEL, ("Valve",)), ("urn:r1", T.TYPE, P), ("urn:r1", T.LABEL, ("controls pump",)), ("urn:r1", T.RANGE, "urn:A"), ("urn:r2", T.TYPE, P), ("urn:r2", T.LABEL, ("controlsValve",)),
        ("urn:r2", T.RANGE, "urn:B"), ("urn:r3", T.TYPE, P), ("urn:r3", T.LABEL, ("has valve",)), ("urn:r3", T.RANGE, "urn:B"),
    ])
    assert {r.signature for r in conflicts.detect(q).collect()} == {
        "cycle|urn:A|urn:B", "disjoint_subclass|urn:C|urn:D", "disjoint_common|urn:E|urn:X|urn:Y", "equiv_disjoint|urn:X|urn:Y", "domain_multi|urn:q", "predspec|controls|urn:r1|urn:r2",
    }
    assert conflicts.detect(q.limit(0)).count() == 0
    known = spark.createDataFrame([("a", "open"), ("b", "dismissed"), ("c", "open"), ("d", "cleared")], "signature string, status string")
    now = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "signature string")
    assert rows(conflicts.synced(known, now)) == [("a", "open", "kept"), ("b", "dismissed", "kept"), ("c", "cleared", "auto_cleared"), ("d", "open", "reopened"), ("e", "open", "new")]


def test_validation_and_shapes(spark):
    tbox = quads(spark, [("urn:Cat", T.SUBCLASS, "urn:Animal"), ("urn:Animal", T.DISJOINT, "urn:Thing"), ("urn:owns", T.RANGE, "urn:Animal"), ("urn:age", T.RANGE, T.XSD + "integer"), ("urn:owns", T.DOMAIN, "urn:Person")])
    abox = quads(spark, [
        ("urn:tom", T.TYPE, "urn:Cat"), ("urn:tom", T.LABEL, ("Tom",)), ("urn:box", T.TYPE, "urn:Thing"), ("urn:odd", T.TYPE, "urn:Cat"), ("urn:odd", T.TYPE, "urn:Thing"), ("urn:x", T.TYPE, "urn:Cat"), ("urn:x", T.LABEL, (" Unknown ",)),
        ("urn:ann", "urn:owns", "urn:tom"), ("urn:ann", "urn:owns", "urn:box"), ("urn:tom", "urn:age", ("four",)), ("urn:odd", "urn:age", ("4",)), *[("urn:many", T.TYPE, f"urn:T{i}") for i in range(13)],
    ])
    got = {(r.type, r.individual) for r in validation.validate(tbox, abox).collect()}
    assert got == {("placeholder", "urn:x"), ("disjoint", "urn:odd"), ("range", "urn:box"), ("datatype", "urn:tom"), ("type_count", "urn:many")}
    top, more = validation.report(validation.validate(tbox, abox), 2)
    assert top.count() == 2 and more
    shapes = quads(spark, [("urn:sh", T.SH + "targetClass", "urn:Cat"), ("urn:sh", T.SH + "property", "_:p"), ("_:p", T.SH + "path", "urn:age"), ("_:p", T.SH + "minCount", ("1", T.XSD + "integer")), ("_:p", T.SH + "datatype", T.XSD + "integer"), ("_:p", T.SH + "nodeKind", T.SH + "IRI")])
    broken = validation.shacl(validation.read_shapes(shapes), abox)
    assert rows(broken.select("focus", "constraint")) == [("urn:odd", "datatype"), ("urn:odd", "nodeKind"), ("urn:tom", "datatype"), ("urn:tom", "nodeKind"), ("urn:x", "minCount")]


def test_algebra(spark):
    q = quads(spark, [("urn:a", "urn:k", "urn:b"), ("urn:b", "urn:k", "urn:c"), ("urn:c", "urn:k", "urn:a"), ("urn:a", "urn:n", ("5", T.XSD + "integer")), ("urn:b", "urn:n", ("x",)), ("urn:a", "urn:same", "urn:a")]).drop("g")
    assert A.path_plus(q, "urn:k").count() == 9
    assert A.pattern(q, "?x", "?p", "?x").count() == 1
    num = A.pattern(q, "?s", "urn:n", "?v").filter(A.number("v") > 1)
    assert rows(A.projected(num, "s")) == [("urn:a",)]
    left = A.optional(A.pattern(q, "?s", "urn:k", "?o"), A.pattern(q, "?s", "urn:n", "?v"))
    assert rows(A.projected(left, "s", "v").fillna("-")) == [("urn:a", "5"), ("urn:b", "x"), ("urn:c", "-")]
    again = A.join(left, A.values(spark, ["v", "w"], [(A.lit("5", T.XSD + "integer"), "urn:w")]), "v")
    assert rows(A.projected(again, "s", "v")) == [("urn:a", "5"), ("urn:c", "5")]
    assert A.minus(left, A.pattern(q, "?zz", "urn:same", "?yy")).count() == 3
    assert A.ask(A.pattern(q, "urn:a", "urn:k", "urn:b")).first()[0] is True and A.ask(A.pattern(q, "urn:a", "urn:k", "urn:z")).first()[0] is False
    assert A.bounded(left, limit=5000, cap=2).count() == 2


def test_edits(spark):
    abox = quads(spark, [("urn:i", T.TYPE, "urn:A"), ("urn:i", T.TYPE, T.NAMED_INDIVIDUAL), ("urn:i", "urn:p", ("v",)), ("urn:j", T.TYPE, "urn:A"), ("urn:j", T.TYPE, "urn:B"), ("urn:j", "urn:q", "urn:i")])
    left = edits.cascade_classes(abox, spark.createDataFrame([("urn:A",)], "iri string"))
    assert rows(left.select("s", "o")) == [("urn:j", "urn:B"), ("urn:j", "urn:i")]
    names = spark.createDataFrame([("urn:A", "urn:B")], "src string, tgt string")
    tbox = quads(spark, [("urn:A", T.LABEL, ("a",)), ("urn:A", T.SUBCLASS, "urn:B"), ("urn:C", T.SUBCLASS, "urn:A")])
    assert rows(edits.merge_classes(tbox, names).select("s", "o")) == [("urn:C", "urn:B")]
    moved = edits.merge_properties(abox, spark.createDataFrame([("urn:q", "urn:p")], "src string, tgt string"))
    assert moved.filter("p = 'urn:p'").count() == 2
    gone = edits.delete_axioms(quads(spark, [("urn:B", T.DISJOINT, "urn:A"), ("urn:B", T.SUBCLASS, "urn:A")]), T.DISJOINT, spark.createDataFrame([("urn:A", "urn:B")], "a string, b string"))
    assert gone.count() == 1
    assert rows(edits.relocate(abox, "urn:", "http://n/").select("s").distinct()) == [("http://n/i",), ("http://n/j",)]


def test_similarity(spark):
    ents = spark.createDataFrame([(1, "Centrifugal Pump"), (2, "centrifugalPump"), (3, "a b c d e f g"), (4, "a b c d e f g h"), (5, "other")], "iri long, label string")
    got = rows(similarity.string_candidates(ents))
    assert [g[:2] for g in got] == [(1, 2), (3, 4)]
    rng = random.Random(3)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    frame = spark.createDataFrame(vecs, "id long, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    want = {(i, j) for (i, a), (j, b) in itertools.combinations(vecs, 2) if cos(a, b) >= 0.9}
    for block in (1024, 40):
        similarity.BLOCK = block
        found = rows(similarity.vector_links(frame, 0.9))
        assert {f[:2] for f in found} == want and len(found) == len(want)
    similarity.BLOCK = 1024
    top = similarity.vector_top_k(frame, frame.filter("id < 5"), 3).orderBy("query_id", "rank").collect()
    assert [r.id for r in top if r["rank"] == 1] == [0, 1, 2, 3, 4]
    pairs = spark.createDataFrame([("p", "q"), ("r", "s"), ("t", "u"), ("v", "w"), ("ok", "fine")], "iri_a string, iri_b string")
    labels = spark.createDataFrame([("v", "pump"), ("w", "pump station"), ("ok", "left valve"), ("fine", "valve left")], "iri string, label string")
    e = lambda *r: spark.createDataFrame([*r], "a string, b string")
    left = similarity.eligible(pairs, labels, spark.createDataFrame([("p", "z"), ("q", "z")], "child string, parent string"), e(("s", "r")), e(("t", "u")))
    assert rows(left) == [("ok", "fine")]


def test_concepts(spark):
    S = T.SKOS
    q = quads(spark, [(f"urn:c{i}", T.TYPE, S + "Concept") for i in (1, 2, 3)] + [
        ("urn:c1", S + "prefLabel", ("Pump", None, "en")), ("urn:c1", S + "altLabel", ("Centrifugal Pump", None, "en")), ("urn:c1", S + "exactMatch", "urn:Pump"), ("urn:c2", S + "prefLabel", ("Valve",)),
        ("urn:c2", "http://purl.org/dc/terms/status", ("deprecated",)), ("urn:c3", S + "prefLabel", ("Gate",)), ("urn:c3", S + "broader", "urn:c2"),
    ])
    c = views.concepts(q)
    assert c.count() == 3 and views.filter_concepts(c, mapping="mapped").count() == 1 and views.filter_concepts(c, status="deprecated").count() == 1
    assert rows(views.resolve(c, " pump ")) == [("urn:c1", "Pump", 1.0)]
    assert rows(views.resolve(c, "centrifugal")) == [("urn:c1", "Centrifugal Pump", 0.72)]
    assert rows(views.related_labels(c, "broader")) == [("urn:c3", ["Valve"])]
    assert views.concept_stats(c).first()[1:] == (3, 4, 1, 2)


def test_history(spark, tmp_path):
    t = lambda n: f"2024-01-01 00:00:0{n}"
    changes = spark.createDataFrame([(1, None, t(1), "add", "a"), (2, 7, t(2), "add", "b"), (3, None, t(3), "remove", "a"), (4, 7, t(4), "add", "c"), (5, None, t(5), "remove", "b")], "event_id long, group_id long, created_at string, op string, line string").withColumn("created_at", F.to_timestamp("created_at"))
    now = spark.createDataFrame([("c",), ("z",)], "line string")
    assert rows(history.rollback(now, changes, 4)) == [("a",), ("z",)]  # event 4 belongs to the group of event 2
    assert rows(history.rollback(now, changes, 5)) == [("b",), ("c",), ("z",)]
    q = quads(spark, [(f"urn:s{i}", "urn:p", (f"dot. {i}",)) for i in range(2500)])
    made = history.export(q, str(tmp_path / "x"), {"abox": G}, 1000)
    assert made.agg(F.sum("lines")).first()[0] == 2500 and made.agg(F.max("lines")).first()[0] <= 1000
    with pytest.raises(ValueError):
        history.export(q, str(tmp_path / "y"), {"abox": G}, 10)
    diff = history.release_diff(q, q.filter("s <> 'urn:s7'"), 5).collect()
    assert [(r.op, r.n, len(r["sample"])) for r in diff] == [("removed", 1, 1)]
    diff = history.release_diff(q.limit(0), q, 5).first()
    assert (diff.op, diff.n, len(diff["sample"])) == ("added", 2500, 5)


def test_whole_graph_dump_and_fingerprint(spark):
    import duckdb

    from graphloom.plans import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = rows(registry.queries()["nquads_dump_graph"](spark, sf))
    assert got == sorted(con.execute(registry.oracle_sql()["nquads_dump_graph"]).fetchall())
    sizes = {t: con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("region", "nation", "customer", "supplier", "part", "orders")}
    assert len(got) == sum(n * sizes[t] for t, n in (("region", 2), ("nation", 3), ("customer", 5), ("supplier", 3), ("part", 5), ("orders", 4)))
    assert [(r.g, r.n) for r in registry.queries()["graph_fingerprint"](spark, sf).collect()] == [("http://example.org/kg/abox", len(got))]


def test_vector_links_of_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "MAX_BLOCKS", 2)
    rng = random.Random(9)
    hot = [rng.gauss(0, 1) for _ in range(4)]
    data = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [0.0] * 4)]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    cos = lambda x, y: dot(x, y) / max((dot(x, x) * dot(y, y)) ** 0.5, 1e-24)
    want = sorted((a, b, round(cos(x, y), 6)) for (a, x), (b, y) in itertools.combinations(data, 2) if cos(x, y) >= 0.35)
    frame = spark.createDataFrame(data, "id long, embedding array<double>")
    assert sorted((r.a, r.b, round(r.score, 6)) for r in similarity.vector_links(frame, 0.35).collect()) == want
    sizes = []
    links = similarity._class_links
    monkeypatch.setattr(similarity, "_class_links", lambda known, least: sizes.append(known.count()) or links(known, least))
    similarity.vector_links(frame, 0.35).count()
    assert sizes == [42]


def test_cycles_and_ancestors_against_plain_reach(spark):
    """Random graphs side by side, a chain longer than a round, nested and touching cycles, self-loops, nulls."""
    draw, pairs = random.Random(5), []
    for g in range(12):
        n = draw.randint(2, 14)
        pairs += [(100 * g + draw.randrange(n), 100 * g + draw.randrange(n)) for _ in range(draw.randint(1, 2 * n))]
    pairs += [(5000 + i, 5001 + i) for i in range(25)] + [(5025, 5020), (5022, 5010), (5003, 5003)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    reach = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    edges = spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in pairs] + [(None, "n00001"), ("n00001", None)], "child string, parent string")
    name = "n{:05}".format
    assert {tuple(r) for r in graph.ancestors(edges).collect()} == {(name(a), name(b)) for a, bs in reach.items() for b in bs}
    want = {(name(min(b for b in reach[a] if a in reach.get(b, ()))), name(a)) for a in reach if a in reach[a]}
    got = [tuple(r) for r in graph.cycles(edges).select("root", "node").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert graph.cycles(edges.limit(0)).count() == 0 and graph.ancestors(edges.limit(0)).count() == 0


def test_vector_blocks_agree(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    whole, blocks = (similarity.vector_top_k(v, v.filter("id % 3 = 0"), 4, n) for n in (2048, 5))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect())) and whole.count() == 80


def test_patterns_read_only_tables_of_their_predicate(spark):
    quads = mapping.to_quads(spark, "/root/testdata/sf0.001")
    plan = quads.filter(f"p = '{mapping.EX}placedBy'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
