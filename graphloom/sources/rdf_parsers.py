"""Parsers of one Turtle or RDF/XML document: terms are (kind, value, datatype, language)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from graphloom.functions import terms as T

_REFERENCE = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.DOTALL)


def resolved(base: str, reference: str) -> str:
    """A reference against a base, by RFC 3986."""
    scheme, place, path, query, fragment = _REFERENCE.match(reference).groups()
    if scheme is None:
        b_scheme, b_place, b_path, b_query, _ = _REFERENCE.match(base).groups()
        if b_scheme is None:
            return base + reference  # no absolute base: nothing to resolve against
        scheme = b_scheme
        if place is None:
            place = b_place
            if not path:
                path, query = b_path, query if query is not None else b_query
            elif not path.startswith("/"):
                path = "/" + path if b_place is not None and not b_path else b_path[: b_path.rfind("/") + 1] + path
        path = _without_dots(path)
    elif place is not None:
        path = _without_dots(path)
    return scheme + ":" + ("" if place is None else "//" + place) + path + ("" if query is None else "?" + query) + ("" if fragment is None else "#" + fragment)


def _without_dots(path: str) -> str:
    if "/." not in path and not path.startswith("."):
        return path
    steps = path.split("/")
    out: list[str] = []
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        if step == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
            out += [""] if last else []
        elif step == ".":
            out += [""] if last else []
        else:
            out.append(step)
    return "/".join(out) if not path.startswith("/") or (out and out[0] == "") else "/" + "/".join(out)


_LOCAL = r"(?:[\w:·-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%])"
_TURTLE = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)"""
    r"""|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*''')|(?P<str>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:\w(?:[\w.·-]*[\w·-])?)"""
    rf"""|(?P<name>(?:[^\W\d_](?:[\w.·-]*[\w·-])?)?:(?:{_LOCAL}(?:(?:{_LOCAL}|\.)*{_LOCAL})?)?)"""
    r"""|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<word>[A-Za-z]+)|(?P<mark>[;,.\[\]()])|(?P<space>\s+)""",
    re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\", "'": "'", "b": "\b", "f": "\f"}


def _points(raw: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))", lambda m: chr(int(m[1] or m[2], 16)), raw)


def _text(raw: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _ESCAPES:
            raise ValueError(f"no escape: \\{m[3]}")
        return _ESCAPES[m[3]]

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, raw, flags=re.DOTALL)


class Turtle:
    """A cursor over the tokens of one Turtle text; ``triples`` gives (subject, predicate, object)."""

    def __init__(self, text: str, base: str, scope: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TURTLE.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at offset {at}: {text[at : at + 30]!r}")
            if m.lastgroup not in ("comment", "space"):
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.scope, self.prefixes, self.n, self.names, self.out = 0, base, scope, {}, 0, {}, []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token != ("mark", value):
            raise ValueError(f"{value!r} expected, found {token[1]!r}")
        self.at += 1
        return token

    def fresh(self, name: str | None = None) -> tuple:
        if name is None or name not in self.names:
            self.n += 1
            self.names[name or f"[]{self.n}"] = ("bnode", f"rdfimport_{self.scope}_{self.n}", None, None)
        return self.names[name or f"[]{self.n}"]

    def resource(self, token: tuple[str, str]) -> tuple:
        if token[0] != "iri":
            raise ValueError(f"an IRI expected, found {token[1]!r}")
        return ("iri", resolved(self.base, _points(token[1][1:-1])), None, None)

    def prefixed(self, value: str) -> tuple:
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"prefix {prefix!r} is not declared")
        return ("iri", self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), None, None)

    def term(self) -> tuple:
        kind, value = self.take()
        if kind == "iri":
            return self.resource((kind, value))
        if kind == "name":
            return self.prefixed(value)
        if kind == "bnode":
            return self.fresh(value)
        if kind in ("str", "long"):
            body, dt, lang = _text(value[3:-3] if kind == "long" else value[1:-1]), None, None
            if self.peek()[0] == "lang":
                lang = self.take()[1][1:]
            elif self.peek()[0] == "dt":
                self.take()
                dt = self.resource(self.take())[1] if self.peek()[0] == "iri" else self.prefixed(self.take()[1])[1]
            return ("literal", body, dt, lang)
        if kind == "num":
            return ("literal", value, T.XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if (kind, value) in (("word", "true"), ("word", "false")):
            return ("literal", value, T.XSD + "boolean", None)
        if (kind, value) == ("mark", "["):
            node = self.fresh()
            if self.peek() != ("mark", "]"):
                self.pairs(node)
            self.take("]")
            return node
        if (kind, value) == ("mark", "("):
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.term())
            self.take(")")
            rest = ("iri", T.RDF + "nil", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.out += [(cell, T.RDF + "first", item), (cell, T.RDF + "rest", rest)]
                rest = cell
            return rest
        raise ValueError(f"no term: {value!r}")

    def verb(self) -> str:
        if self.peek() == ("word", "a"):
            self.take()
            return T.TYPE
        found = self.term()
        if found[0] != "iri":
            raise ValueError(f"no predicate: {found[1]!r}")
        return found[1]

    def pairs(self, subject: tuple) -> None:
        while True:
            predicate = self.verb()
            self.out.append((subject, predicate, self.term()))
            while self.peek() == ("mark", ","):
                self.take()
                self.out.append((subject, predicate, self.term()))
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.take()
            if self.peek() in (("mark", "."), ("mark", "]")):
                return

    def triples(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if (kind == "lang" and value in ("@prefix", "@base")) or (kind == "word" and value.lower() in ("prefix", "base")):
                self.take()
                if "prefix" in value.lower():
                    name = self.take()
                    if name[0] != "name" or not name[1].endswith(":"):
                        raise ValueError(f"no prefix: {name[1]!r}")
                    self.prefixes[name[1][:-1]] = self.resource(self.take())[1]
                else:
                    self.base = self.resource(self.take())[1]
                if value[0] == "@":
                    self.take(".")
                continue
            subject, bare = self.term(), value == "["
            if subject[0] == "literal":
                raise ValueError(f"a literal as subject: {subject[1]!r}")
            if not (bare and self.peek() == ("mark", ".")):
                self.pairs(subject)
            self.take(".")
        return self.out


_RDF, _XML = "{" + T.RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
#: Names that the grammar keeps for itself: no node element, no property element, no property attribute.
_NO_NODE = {_RDF + n for n in ("RDF", "ID", "about", "bagID", "parseType", "resource", "nodeID", "datatype", "li", "aboutEach", "aboutEachPrefix")}
_NO_PROPERTY = (_NO_NODE - {_RDF + "li"}) | {_RDF + "Description"}
_SYNTAX = {_RDF + n for n in ("ID", "about", "parseType", "resource", "nodeID", "datatype")}


class RdfXml:
    """Triples of one RDF/XML document; what the grammar does not allow fails."""

    def __init__(self, content: str, base: str, scope: str):
        self.root, self.base, self.scope, self.out, self.names, self.ids = ET.fromstring(content), base, scope, [], {}, set()

    def triples(self) -> list[tuple]:
        base, lang = self.inherited(self.root, self.base, None)
        for e in self.root if self.root.tag == _RDF + "RDF" else [self.root]:
            self.node(e, base, lang)
        return self.out

    def inherited(self, e: ET.Element, base: str, lang: str | None) -> tuple[str, str | None]:
        own = e.get(_XML + "base")
        return (base if own is None else resolved(base, own).partition("#")[0]), e.get(_XML + "lang", lang) or None

    def blank(self, name: str | None = None) -> tuple:
        return self.names.setdefault(name or f"[]{len(self.names)}", ("bnode", f"rdfimport_{self.scope}_{len(self.names) + 1}", None, None))

    def iri(self, reference: str, base: str) -> tuple:
        return ("iri", resolved(base, reference), None, None)

    def named(self, ident: str, base: str) -> tuple:
        found = self.iri("#" + ident, base)
        if found[1] in self.ids:
            raise ValueError(f"rdf:ID {ident!r} is given twice")
        self.ids.add(found[1])
        return found

    def name(self, tag: str) -> str:
        if not tag.startswith("{"):
            raise ValueError(f"{tag!r} has no namespace")
        return re.sub("[{}]", "", tag)

    def attributes(self, subject: tuple, e: ET.Element, base: str, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key in _SYNTAX or key.startswith(_XML):
                continue
            if key in _NO_PROPERTY or key == _RDF + "li":
                raise ValueError(f"{key!r} is no property attribute")
            self.out.append((subject, self.name(key), self.iri(value, base) if key == _RDF + "type" else ("literal", value, None, lang)))

    def node(self, e: ET.Element, base: str, lang: str | None) -> tuple:
        if e.tag in _NO_NODE:
            raise ValueError(f"{e.tag!r} is no node")
        base, lang = self.inherited(e, base, lang)
        given = [k for k in ("about", "ID", "nodeID") if e.get(_RDF + k) is not None]
        if len(given) > 1:
            raise ValueError(f"a node has {' and '.join(given)}")
        kind = given[0] if given else ""
        subject = self.iri(e.get(_RDF + "about"), base) if kind == "about" else self.named(e.get(_RDF + "ID"), base) if kind == "ID" else self.blank(e.get(_RDF + "nodeID"))
        if e.tag != _RDF + "Description":
            self.out.append((subject, T.TYPE, ("iri", self.name(e.tag), None, None)))
        self.attributes(subject, e, base, lang)
        self.properties(subject, e, base, lang)
        return subject

    def properties(self, subject: tuple, e: ET.Element, base: str, lang: str | None) -> None:
        if (e.text or "").strip() or any((c.tail or "").strip() for c in e):
            raise ValueError(f"text between the properties of {e.tag!r}")
        n = 0
        for child in e:
            if child.tag in _NO_PROPERTY:
                raise ValueError(f"{child.tag!r} is no property")
            n += child.tag == _RDF + "li"
            predicate = f"{T.RDF}_{n}" if child.tag == _RDF + "li" else self.name(child.tag)
            at, tongue = self.inherited(child, base, lang)
            value = self.value_of(child, at, tongue)
            self.out.append((subject, predicate, value))
            if child.get(_RDF + "ID") is not None:  # the statement has a name of its own
                of = self.named(child.get(_RDF + "ID"), at)
                told = (("type", ("iri", T.RDF + "Statement", None, None)), ("subject", subject), ("predicate", ("iri", predicate, None, None)), ("object", value))
                self.out += [(of, T.RDF + p, o) for p, o in told]

    def value_of(self, e: ET.Element, base: str, lang: str | None) -> tuple:
        parse, dt = e.get(_RDF + "parseType"), e.get(_RDF + "datatype")
        resource, ident = e.get(_RDF + "resource"), e.get(_RDF + "nodeID")
        if sum(x is not None for x in (parse, dt, resource, ident)) > 1:
            raise ValueError(f"{e.tag!r} has attributes that exclude each other")
        own = [k for k in e.attrib if k not in _SYNTAX and not k.startswith(_XML)]
        if parse == "Resource":
            value = self.blank()
            self.properties(value, e, base, lang)
            return value
        if parse == "Collection":
            rest = ("iri", T.RDF + "nil", None, None)
            for item in reversed([self.node(c, base, lang) for c in e]):
                cell = self.blank()
                self.out += [(cell, T.RDF + "first", item), (cell, T.RDF + "rest", rest)]
                rest = cell
            return rest
        if parse is not None:  # Literal, and what the grammar has no name for
            inner = (e.text or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            return ("literal", inner + "".join(ET.canonicalize(ET.tostring(c, encoding="unicode")) for c in e), T.RDF + "XMLLiteral", None)
        if resource is not None or ident is not None or own:
            if len(e) or (e.text or "").strip():
                raise ValueError(f"{e.tag!r} has attributes and content")
            value = self.iri(resource, base) if resource is not None else self.blank(ident)
            self.attributes(value, e, base, lang)
            return value
        if len(e):
            if len(e) > 1 or (e.text or "").strip() or (e[0].tail or "").strip() or dt is not None:
                raise ValueError(f"{e.tag!r} holds more than a node")
            return self.node(e[0], base, lang)
        return ("literal", e.text or "", None if dt is None else resolved(base, dt), None if dt is not None else lang)
