"""Evidence rules by cases, mentions of labels against plain loops, guards over a corpus."""

import random

import pytest

from graphloom.functions import evidence as E
from graphloom.operators import extraction, mentions


def test_grounding():
    assert E.grounded("Pump", "The pump runs.") and not E.grounded("Pump", "pumps run") and E.grounded("snake_case name", "a Snake Case name.") and E.grounded("温度", "当前温度为")
    assert not E.grounded("", "x") and not E.grounded("x", None) and E.grounded("水泵", "这个水泵很好。") and E.grounded("Ｐｕｍｐ", "a pump")
    assert E.grounded("pump", "the pump-station") and not E.written_in("the pump-station", "pump")  # normalized words part at the hyphen


def test_normalized_evidence():
    assert E.plain_text("at 10:30:45 :icon: A_b") == "at 10 30 45 icon a b"
    assert E.plain_text('see {{< ref text="Main pump" id=3 >}} and {{% note %}} <b>x</b> [y](http://z)') == "see main pump and x y"
    assert E.plain_text("ﬁne １２ Ümläut é") == "fine 12 ümläut é" and E.plain_label("Foo_Bar-[x](y)") == "foo bar x y"


def test_quotes():
    text = "The pump station hums. 水泵很好"
    assert E.quoted("Pump   STATION", text) and not E.quoted("pump stat", text) and not E.quoted("....", text) and not E.quoted("The", text)
    assert E.quoted("水泵很好", text) and not E.quoted(None, text) and not E.quoted("pump station", None)


@pytest.mark.parametrize(
    ("label", "text", "want"),
    [
        ("Pump_1", "the `ex:Pump_1` instance runs", True), ("Pump 1", "Pump-1 is an individual", True), ("Pump", "X is an instance of Pump", False), ("X", "X is an instance of Pump", True), ("P 1", "An instance called **P_1**.", True),
        ("P 1", "a part called P 1", False), ("水泵", "名为水泵的实例", True), ("水泵", "该水泵实例", True), ("水泵", "水泵是一个个体", True), ("水泵", "例如：水泵", False), ("P", "P is an example of it", False), ("P", "XP is an instance", False),
        ("P", "instance named Ps", False), ("!!", "!! is an instance", False), ("Ｐ", "P is the named individual", True),
    ],
)
def test_declarations(label, text, want):
    assert E.declared(label, text) is want


def test_structured_values():
    roles = E.value_roles('Pump type: Centrifugal\n- Color: red, blue;green | 红→绿\n分类：泵\nsee http://x.y/a,b\nkind: "Valve",\nmode: []\nlist: (a, b)\nset: Pump\nx：一、二')
    assert roles == {
        "centrifugal": {"type"}, "red blue green 红 绿": {"literal"}, "red": {"literal"}, "blue": {"literal"}, "green": {"literal"}, "红": {"literal"}, "绿": {"literal"}, "pump": {"literal"}, "泵": {"type"}, "x y a b": {"literal"}, "x y a": {"literal"},
        "valve": {"type"}, "a b": {"literal"}, "a": {"literal"}, "b": {"literal"}, "一 二": {"literal"},
    }
    pairs = E.value_roles('[{"type": "Pump", "maker": "ABB", "n": 5, "on": true},\n{"name": "Pump"}]')
    assert pairs["pump"] == {"type", "literal"} and pairs["abb"] == {"literal"} and pairs["5"] == {"literal"} and pairs["true"] == {"literal"}
    assert E.value_roles(None) == {} == E.value_roles("no pair here")


def plain_mentions(labels, chunks):
    return sorted((label, c) for label in {x for x in labels if x} for c, t in chunks if t and E.grounded(label, t))


@pytest.mark.parametrize("part", [2 << 20, 60])
def test_mentions(spark, monkeypatch, part):
    monkeypatch.setattr(mentions, "PART_BYTES", part)
    rng = random.Random(7)
    words = ["pump", "Pump", "pumps", "sta", "station", "pump_station", "水泵", "泵", "a-b", "a", "b", "Straße", "É1", "!?", "co_op"]
    labels = [" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(12)] + words + ["", "  ", None, "水泵 1", "pump station", "PUMP_STATION"]
    chunks = [(i, rng.choice(["", ". ", "，", " "]).join(rng.choices([*words, " ", " "], k=rng.randrange(0, 14)))) for i in range(120)] + [(200, None), (201, "pump " * 500), (202, "这个水泵1号很好。pump-station")]
    chunks += [(300 + i, "hot pump station") for i in range(50)]
    c = spark.createDataFrame([(*r, "z") for r in chunks], "chunk_id long, text string, label string").repartition(3)
    d = spark.createDataFrame([(x, 1) for x in labels], "label string, text int")
    got = sorted(map(tuple, mentions.mentions(d, c).collect()))
    assert got == plain_mentions(labels, chunks) and len(got) > 300
    first = sorted(map(tuple, mentions.first_mentions(d, c, 2).collect()))
    assert first == sorted({(label, x) for label, _ in got for x in sorted(x for other, x in got if other == label)[:2]})
    assert mentions.mentions(d.limit(0), c).count() == 0 == mentions.mentions(d, c.limit(0)).count()


def test_guards_over_the_corpus(spark):
    chunks = spark.createDataFrame([(1, "Type: Pump\nName: P-101\nPumps move water."), (2, "P-102 is an instance."), (3, "P-102 and Valve, 名为阀的实例")], "chunk_id long, text string")
    rows = [(1, "Pump", False), (1, "P-101", False), (3, "P-102", False), (3, "Valve", True), (1, "Ghost", False), (1, "date", False), (1, "Known", False), (3, "阀", False)]
    classes = spark.createDataFrame(rows, "chunk_id long, label string, verified boolean")
    got = {r.label: r.blocked for r in extraction.guard_classes(classes, chunks).collect()}
    assert got == {"Pump": None, "P-101": "value", "P-102": "individual", "Valve": None, "Ghost": "not grounded", "date": "datatype", "Known": "not grounded", "阀": "individual"}
    kept = extraction.guard_classes(classes, chunks, spark.createDataFrame([("known",), ("p_101",)], "label string"))
    assert kept.columns == ["chunk_id", "label", "verified", "blocked"]
    assert {r.label for r in kept.collect() if r.blocked is None} == {"Pump", "P-101", "Valve", "Known"}  # a known class needs no evidence
    sure = classes.withColumn("verified", classes["label"] == "P-101")
    assert {r.label: r.blocked for r in extraction.guard_classes(sure, chunks).collect()}["P-101"] is None
