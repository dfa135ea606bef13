"""Forms of Turtle, RDF/XML and line files: each is read right or refused."""

import glob

import pytest

from graphloom.functions import terms as T
from graphloom.sources import rdf
from graphloom.sources.rdf_parsers import resolved

P = "@prefix e: <http://e/> . "


def turtle(text, base="http://x/a/b"):
    return rdf.triples_of(text, "turtle", base, "s")


@pytest.mark.parametrize(
    ("reference", "want"),
    # the examples of RFC 3986, section 5.4, of http://a/b/c/d;p?q
    [("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
     ("g#s", "http://a/b/c/g#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"),
     ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"), ("g/../h", "http://a/b/c/h"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/../x", "http://a/b/c/g?y/../x")],
)
def test_references(reference, want):
    assert resolved("http://a/b/c/d;p?q", reference) == want


def test_turtle_forms():
    one = lambda t: turtle(P + t)[0][2]
    assert one("e:s e:p 'x' .") == ("literal", "x", None, None) and one("e:s e:p '''a'b\n\"c''' .")[1] == "a'b\n\"c" and one('e:s e:p "a\\tb\\u00e9\\"" .')[1] == 'a\tbé"'
    assert one("e:s e:p <\\u00e9> .")[1] == "http://x/a/é" and one("e:s e:p <c> .")[1] == "http://x/a/c" and one("e:s e:p <../z> .")[1] == "http://x/z" and one("e:s e:p <#f> .")[1] == "http://x/a/b#f"
    assert one("e:s e:p e:a:b .")[1] == "http://e/a:b" and one("e:s e:p e:a\\,b .")[1] == "http://e/a,b" and one("e:s e:p e:a.b .")[1] == "http://e/a.b" and one("e:s e:p e:a%20b.")[1] == "http://e/a%20b"
    assert one("e:s e:p 'x'@en-GB .")[3] == "en-GB" and one("e:s e:p '1'^^e:t .")[2] == "http://e/t" and [one(f"e:s e:p {x} .")[2][len(T.XSD) :] for x in ("1", "-1.5", "1e3", "1.E3", ".5")] == ["integer", "decimal", "double", "double", "decimal"]
    assert turtle("BASE <http://q/> PREFIX : <n#>\n:a a :B ; :c 1, 2 ; .") == [
        (("iri", "http://q/n#a", None, None), T.TYPE, ("iri", "http://q/n#B", None, None)), (("iri", "http://q/n#a", None, None), "http://q/n#c", ("literal", "1", T.XSD + "integer", None)), (("iri", "http://q/n#a", None, None), "http://q/n#c", ("literal", "2", T.XSD + "integer", None)),
    ]
    assert len(turtle(P + "[ e:p (1 [ e:q 2 ]) ] .")) == 6 and len(turtle(P + "[] e:p e:o .")) == 1
    for wrong in ("e:s e:p 'x", "e:s e:p .", "'x' e:p e:o .", "e:s 'p' e:o .", "f:s e:p e:o .", "e:s e:p 'a\\qb' .", "e:s e:p e:o", "e:s e:p <a b> ."):
        with pytest.raises(ValueError):
            turtle(P + wrong)


def xml(body, attrs=""):
    text = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:e="http://e/" {attrs}>{body}</rdf:RDF>'
    return [(s[1], p.replace(T.RDF, "rdf:"), o[1]) for s, p, o in rdf.triples_of(text, "rdfxml", "http://x/d", "s")], rdf.triples_of(text, "rdfxml", "http://x/d", "s")


def test_rdfxml_forms():
    got, _ = xml('<rdf:Description rdf:about="a"><e:p rdf:parseType="Resource"><e:q>1</e:q><e:r rdf:resource="#f"/></e:p></rdf:Description>')
    assert got == [("rdfimport_s_1", "http://e/q", "1"), ("rdfimport_s_1", "http://e/r", "http://x/d#f"), ("http://x/a", "http://e/p", "rdfimport_s_1")]
    got, full = xml('<rdf:Description rdf:about="a"><e:p rdf:parseType="Literal">x &lt; <b c="d">y</b></e:p></rdf:Description>')
    assert got == [("http://x/a", "http://e/p", 'x &lt; <b c="d">y</b>')] and full[0][2][2] == T.RDF + "XMLLiteral"
    assert xml('<rdf:Bag rdf:ID="b"><rdf:li>1</rdf:li><rdf:li rdf:resource="c"/></rdf:Bag>')[0] == [("http://x/d#b", "rdf:type", T.RDF + "Bag"), ("http://x/d#b", "rdf:_1", "1"), ("http://x/d#b", "rdf:_2", "http://x/c")]
    assert xml('<e:T rdf:about="a" rdf:type="http://e/U" e:n="v"/>')[0] == [("http://x/a", "rdf:type", "http://e/T"), ("http://x/a", "rdf:type", "http://e/U"), ("http://x/a", "http://e/n", "v")]
    assert xml('<rdf:Description rdf:about="a"><e:p e:n="v"/></rdf:Description>')[0] == [("rdfimport_s_1", "http://e/n", "v"), ("http://x/a", "http://e/p", "rdfimport_s_1")]
    got, _ = xml('<rdf:Description rdf:about="a" xml:base="http://y/z/"><e:p rdf:resource="q"/></rdf:Description><rdf:Description rdf:about=""><e:p rdf:resource="../r"/></rdf:Description>')
    assert got == [("http://y/z/a", "http://e/p", "http://y/z/q"), ("http://x/d", "http://e/p", "http://x/r")]
    got, _ = xml('<rdf:Description rdf:about="a"><e:p rdf:ID="st">v</e:p></rdf:Description>')
    assert ("http://x/d#st", "rdf:subject", "http://x/a") in got and ("http://x/d#st", "rdf:object", "v") in got and len(got) == 5
    _, full = xml('<rdf:Description rdf:about="a" xml:lang="en"><e:p>x</e:p><e:p xml:lang="">y</e:p><e:p rdf:datatype="http://t">z</e:p></rdf:Description>')
    assert [(o[1], o[2], o[3]) for *_, o in full] == [("x", None, "en"), ("y", None, None), ("z", "http://t", None)]
    assert len(xml('<e:T><e:p rdf:parseType="Collection"><e:A/><e:B/></e:p></e:T>')[0]) == 8
    for wrong in (
        '<rdf:Description rdf:about="a" rdf:ID="b"/>', '<rdf:li/>', '<rdf:Description><rdf:about/></rdf:Description>', '<rdf:Description rdf:li="1"/>', '<rdf:Description rdf:aboutEach="x"/>', '<e:T rdf:ID="x"/><e:T rdf:ID="x"/>',
        '<rdf:Description><e:p rdf:resource="a">text</e:p></rdf:Description>', '<rdf:Description><e:p><e:A/><e:B/></e:p></rdf:Description>', "<rdf:Description>text</rdf:Description>",
    ):
        with pytest.raises(ValueError):
            xml(wrong)


def _quads(spark, values, p="http://e/p"):
    return spark.createDataFrame([("http://g", "iri", f"http://s/{i}", p, "literal", v, None, None) for i, v in enumerate(values)], "g string, s_kind string, s string, p string, o_kind string, o string, o_dt string, o_lang string")


def test_round_trip_of_odd_text(spark, tmp_path):
    values = ["a\r\nb", "\ttab\r", " lead <&> \"q\" ", "é\U0001f600", ""]
    rdf.write_rdfxml(_quads(spark, values), str(tmp_path / "xml"))
    back = sorted(r.o for r in rdf.import_files(spark, str(tmp_path / "xml"), "http://g", "rdfxml").collect())
    assert back == sorted(values)
    for bad in (_quads(spark, ["\x01"]), _quads(spark, ["x"], "http://e/123"), _quads(spark, ["x\x0b"])):
        with pytest.raises(Exception, match="no XML"):
            rdf.write_rdfxml(bad, str(tmp_path / f"bad{id(bad)}"))


def test_trig_and_lines(spark, tmp_path):
    q = _quads(spark, ["a", 'b"\n'])
    rdf.write_trig(q.unionByName(q.selectExpr("cast(null as string) g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang")), str(tmp_path / "trig"))
    text = "\n".join(open(f, encoding="utf-8").read() for f in glob.glob(f"{tmp_path}/trig/part-*"))
    assert text.count("<http://g> { ") == 2 and text.count("\n{ ") + text.startswith("{ ") == 2 and '"b\\"\\n"' in text
    at = tmp_path / "lines.nq"
    at.write_text('<http://s/\\u00e9> <http://p> "a\\tb\\u0041\\b" <http://g> .\n# note\n\nno statement\n', encoding="utf-8")
    with pytest.raises(Exception, match="no statement"):
        rdf.read_nquads(spark, str(at)).collect()
    got = rdf.read_nquads(spark, str(at), skip=True).collect()
    assert [(r.s, r.o) for r in got] == [("http://s/é", "a\tbA\b")] and rdf.malformed(spark, str(at)).count() == 1
    ttl = tmp_path / "shape.ttl"
    ttl.write_text("@prefix op: <http://old#> . op:a op:b op:c .", encoding="utf-8")
    moved = rdf.import_files(spark, str(ttl), "http://g", prefix=("http://old#", "http://new#")).collect()
    assert [(r.s, r.p, r.o) for r in moved] == [("http://new#a", "http://new#b", "http://new#c")]
