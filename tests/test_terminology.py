from pyspark.sql import functions as F

from graphloom.operators import terminology as V


def tables(spark):
    c = spark.createDataFrame([("c1", "s", "urn:Pump", "active", "manual"), ("c2", "s", None, "active", "agent"), ("c3", "t", "bad", "weird", "manual"), ("c4", "none", "urn:Gone", None, None)], "iri string, scheme string, mapped string, status string, origin string")
    lab = spark.createDataFrame([("c1", "pref", "Pump", "en"), ("c1", "alt", "Old Pump", "en"), ("c2", "pref", "Valve", "en"), ("c2", "alt", "ＰＵＭＰ", "en"), ("c3", "pref", "A", "en"), ("c3", "pref", "B", "en"), ("c3", "hidden", "b", "EN")], "iri string, kind string, value string, lang string")
    rel = spark.createDataFrame([("c1", "broader", "c2"), ("c2", "broader", "c1"), ("c1", "related", "c3"), ("c3", "related", "c3")], "iri string, kind string, other string")
    return c, lab, rel


def test_rules(spark):
    c, lab, rel = tables(spark)
    got = {(r.iri, r.rule) for r in V.broken_rules(c, lab, rel, spark.createDataFrame([("s",), ("t",)], "scheme string")).collect()}
    assert got == {
        ("c4", "scheme not found"), ("c4", "no preferred label"), ("c3", "preferred label twice in a language"), ("c3", "label twice in a concept"), ("c1", "label of another concept"), ("c2", "label of another concept"),
        ("c1", "relation leaves the scheme"), ("c3", "relation to itself"), ("c1", "broader cycle"), ("c2", "broader cycle"), ("c3", "status"), ("c3", "mapping is no absolute IRI"),
    }


def test_sync(spark):
    c, lab, rel = tables(spark)
    ents = spark.createDataFrame([("urn:Pump", "Pump", 0), ("urn:x#Valve", "Valve", 1), ("urn:x#Valve2", "valve", 2), ("urn:x#Old", "old pump", 3), ("urn:x#Tank", "水箱", 4), ("urn:x#E", "!", 5)], "iri string, label string, rank int")
    assert {r.iri: r.mapped for r in V.drop_stale(c, ents).collect()} == {"c1": "urn:Pump", "c2": None, "c3": None, "c4": None}
    got = {r.iri: (r.action, r.concept, r.lang) for r in V.sync_entities(ents, c, lab, "s", "urn:v").collect()}
    assert got == {"urn:x#Valve": ("adopt", "c2", "en"), "urn:x#Valve2": ("conflict", None, "en"), "urn:x#Old": ("conflict", None, "en"), "urn:x#Tank": ("add", "urn:v#concept-Tank", "zh-CN")}
    assert V.missing_aliases(ents, c, lab, "s").count() == 0
    renamed = ents.withColumn("label", F.when(F.col("iri") == "urn:Pump", "New Pump").otherwise(F.col("label")))
    assert [tuple(r) for r in V.missing_aliases(renamed, c, lab, "s").collect()] == [("c1", "New Pump", "en")]
    both = c.withColumn("mapped", F.when(F.col("iri") == "c2", "urn:x#Valve").otherwise(F.col("mapped")))
    sub = spark.createDataFrame([("urn:Pump", "urn:x#Valve"), ("urn:x#Valve", "urn:Pump")], "child string, parent string")
    assert V.missing_broader(sub, both, rel).count() == 0
    assert [tuple(r) for r in V.missing_broader(sub, both, rel.filter("iri = 'c1'")).collect()] == [("c2", "c1")]


def test_proposals_and_decisions(spark):
    import hashlib
    import json

    p = spark.createDataFrame([(1, "add", '{"a":1}', None, "Pump", "a PUMP"), (2, "add", '{"a":1}', None, "Pump", "a pump"), (1, "add", '{"b":2}', "urn:x", "Ghost", "a pump")], "chunk_id long, action string, payload string, target string, term string, evidence string")
    p = p.withColumn("signature", V.proposal_signature(F.col("action"), F.col("payload"), F.col("target")))
    want = hashlib.sha256(json.dumps({"action": "add", "payload": {"a": 1}, "target_iri": None}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    chunks = spark.createDataFrame([(1, "This is a Pump."), (2, "a pump too")], "chunk_id long, text string")
    got = V.new_proposals(p, p.limit(0), chunks).collect()
    assert [(r.chunk_id, r.signature) for r in got] == [(1, want)]
    assert V.new_proposals(p, p, chunks).count() == 0
    q = spark.createDataFrame([(1, "pending"), (2, "accepted"), (3, "pending")], "id long, status string")
    d = spark.createDataFrame([(1, "rejected", 1), (1, "accepted", 2), (2, "rejected", 1)], "id long, status string, seq int")
    assert sorted(tuple(r) for r in V.decide(q, d).collect()) == [(1, "accepted"), (2, "accepted"), (3, "pending")]


def test_small_rules(spark):
    pairs = spark.createDataFrame([("Centrifugal Pump", "Pump"), ("Pump Station", "Pump")], "source string, replacement string")
    assert [r.source for r in V.replacements(pairs).collect()] == ["Centrifugal Pump"]
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "group string, cls string")
    up = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "node string, anc string")
    assert [tuple(r) for r in V.common_superclasses(members, up).collect()] == [("g", "x")]
