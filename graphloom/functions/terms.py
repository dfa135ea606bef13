"""Column functions on RDF terms, labels and keys. All stay inside the JVM.

Terms are flat columns ``<x>_kind`` ('iri', 'bnode', 'literal'), ``<x>``, ``<x>_dt``, ``<x>_lang``;
subjects have no datatype and language. Lengths and offsets count code points. Null in, null out,
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, LABEL, COMMENT = RDF + "type", RDFS + "label", RDFS + "comment"
SUBCLASS, DOMAIN, RANGE = RDFS + "subClassOf", RDFS + "domain", RDFS + "range"
DISJOINT, EQUIVALENT = OWL + "disjointWith", OWL + "equivalentClass"
CLASS, OBJECT_PROPERTY, DATA_PROPERTY = OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty"
NAMED_INDIVIDUAL = OWL + "NamedIndividual"
#: Names of datatypes that are understood, and what each stands for.
DATATYPES = {
    "string": "string", "text": "string", "str": "string", "integer": "integer", "int": "integer", "long": "integer", "float": "decimal", "double": "decimal",
    "decimal": "decimal", "number": "decimal", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "dateTime", "time": "time", "uri": "anyURI",
    "url": "anyURI", "anyuri": "anyURI",
}

#: Labels that identify nothing.
PLACEHOLDERS = ("untitled", "unknown", "n/a", "na", "none", "null", "tbd", "todo", "-")

_CJK = r"[㐀-䶿一-鿿豈-﫿]"


def nq_escape(x: Column) -> Column:
    """The five escapes of literals in N-Quads output."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return x


def subject_text(kind: Column, value: Column) -> Column:
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def object_text(kind: Column, value: Column, dt: Column, lang: Column) -> Column:
    """A term as N-Quads writes it; plain literals have no suffix."""
    quoted = F.concat(F.lit('"'), nq_escape(value), F.lit('"'))
    literal = (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(dt.isNull() | (dt == XSD + "string"), quoted)
        .otherwise(F.concat(quoted, F.lit("^^<"), dt, F.lit(">")))
    )
    return F.when(kind == "literal", literal).otherwise(subject_text(kind, value))


def line_of(prefix: str = "") -> Column:
    """The N-Quads line (without its end) of a quad row; a null graph is the default graph."""
    c = lambda n: F.col(prefix + n)
    graph = F.when(c("g").isNull(), F.lit(" .")).otherwise(F.concat(F.lit(" <"), c("g"), F.lit("> .")))
    return F.concat(
        subject_text(c("s_kind"), c("s")), F.lit(" <"), c("p"), F.lit("> "), object_text(c("o_kind"), c("o"), c("o_dt"), c("o_lang")), graph
    )


def to_wire(kind: Column, value: Column) -> Column:
    """How a term leaves a query: IRI text, ``_:label``, or the lexical value alone."""
    return F.when(kind == "bnode", F.concat(F.lit("_:"), value)).otherwise(value)


def triple_key(s: Column, p: Column, o_text: Column) -> Column:
    """``triple|`` and the SHA-256 of the statement; ``o_text`` is the object as written."""
    return F.concat(F.lit("triple|"), F.sha2(F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), o_text, F.lit(" .")), 256))


def axiom_key(kind: Column, a: Column, b: Column) -> Column:
    """``kind|a|b``; the ends of symmetric axioms in order."""
    both = kind.isin("disjoint", "equivalent")
    return F.concat_ws("|", kind, F.when(both, F.least(a, b)).otherwise(a), F.when(both, F.greatest(a, b)).otherwise(b))


def axiom_text(kind: Column, a: Column, b: Column) -> Column:
    """An axiom in words, from the labels of its ends."""
    verb = F.when(kind == "subclass", " is a kind of ").when(kind == "disjoint", " is disjoint with ").when(kind == "equivalent", " is the same as ").otherwise(" is related to ")
    return F.concat(a, verb, b)


def fact_key(kind: str, *parts: Column) -> Column:
    """``ind|iri``, ``data|s|p|v`` or ``obj|s|p|t``."""
    return F.concat_ws("|", F.lit(kind), *parts)


def short_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def local_name(iri: Column) -> Column:
    """What follows the last # or /; the whole IRI where nothing does."""
    tail = F.regexp_extract(iri, r"[^#/]*$", 0)
    return F.when(tail == "", iri).otherwise(tail)


def local_part(iri: Column, marks: str = "#/") -> Column:
    """What follows the last of the marks, though it be empty; ``#/:`` also cuts URNs and short names."""
    return F.regexp_extract(iri, f"[^{marks}]*$", 0)


def local_in_rules(iri: Column) -> Column:
    """The name in rule findings: what follows the last #, else the last /, where that is not empty; else the IRI."""
    fragment, step = local_part(iri, "#"), local_part(iri, "/")
    hashed, slashed = F.contains(iri, F.lit("#")) & (fragment != ""), F.contains(iri, F.lit("/")) & (step != "")
    return F.when(hashed, fragment).when(slashed, step).otherwise(iri)


def local_in_schema(iri: Column) -> Column:
    """The name in a schema: what follows the last #; without one the last step of the path, closing slashes aside."""
    return F.when(F.contains(iri, F.lit("#")), local_part(iri, "#")).otherwise(local_part(F.regexp_replace(iri, "/+$", ""), "/"))


def norm_label(x: Column) -> Column:
    """Lower-case words of a label: camel humps and anything but letters and digits separate."""
    humps = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(humps, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+", " ")))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def class_local_name(label: Column) -> Column:
    """PascalCase of the label's words; ``Class`` where there are none."""
    n = norm_label(label)
    return F.when(n == "", F.lit("Class")).otherwise(F.array_join(F.transform(F.split(n, " "), _capital), ""))


def property_local_name(label: Column) -> Column:
    """camelCase of the label's words; ``property`` where there are none."""
    n, pascal = norm_label(label), class_local_name(label)
    return F.when(n == "", F.lit("property")).otherwise(F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, F.lit(2), F.length(pascal))))


#: Full-width forms of the printable ASCII signs, as Unicode's compatibility forms have them.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(chr(c) for c in range(0x21, 0x7F))
#: Datatypes that a bare word names.
BARE_DATATYPES = ("string", "integer", "decimal", "boolean", "date", "datetime", "time", "anyuri")


def _datatype_token(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.translate(name, _WIDE + "\u3000", _NARROW + " ")), r"^<+|>+$", ""))


def is_datatype_label(label: Column) -> Column:
    """Does a class's label name a datatype, by prefix, IRI or one of the common bare names?"""
    token = _datatype_token(label)
    return F.coalesce((F.startswith(token, F.lit("xsd:")) | F.contains(token, F.lit("xmlschema#")) | token.isin(*BARE_DATATYPES)) & canonical_datatype(label).isNotNull(), F.lit(False))


def canonical_datatype(name: Column) -> Column:
    """XSD IRI of a datatype's name, alias or IRI; null where it is unknown."""
    token = _datatype_token(name)
    bare = F.regexp_replace(token, "^(?:xsd:|.*xmlschema#)", "")
    known = F.create_map(*[F.lit(x) for pair in DATATYPES.items() for x in pair])
    return F.concat(F.lit(XSD), F.try_element_at(known, bare))


#: Lexical forms of numbers.
XSD_INTEGER, XSD_DECIMAL, XSD_DOUBLE = r"[+-]?[0-9]+", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def xsd_valid(value: Column, dt: Column) -> Column:
    """Is a lexical value in its datatype's space? White space around it does not count; datatypes without a rule accept all."""
    kind, x = F.regexp_extract(dt, r"[^#]*$", 0), F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return (
        F.when(kind == "integer", x.rlike(f"^(?:{XSD_INTEGER})$"))
        .when(kind.isin("decimal", "float", "double"), x.rlike(f"^(?:{XSD_DOUBLE}|(?i:[+-]?(?:infinity|nan)))$"))
        .when(kind == "boolean", F.lower(x).isin("true", "false", "1", "0"))
        .otherwise(F.lit(True))
    )


def token_estimate(text: Column) -> Column:
    """One token for each CJK character and other sign, one for each four letters of a run; at least one unless empty."""
    pieces = F.regexp_extract_all(text, F.lit(rf"({_CJK}|[A-Za-z0-9_]+|[^\s])"), F.lit(1))
    costs = F.transform(pieces, lambda t: F.when(t.rlike("^[A-Za-z0-9_]"), F.ceil(F.length(t) / F.lit(4.0))).otherwise(F.lit(1)).cast("long"))
    total = F.aggregate(costs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.greatest(total, F.lit(1).cast("long")))


def guess_language(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{3400}-\x{9FFF}]"), F.lit("zh-CN")).otherwise(F.lit("en"))


def clamp_confidence(raw: Column) -> Column:
    """A confidence between 0 and 1; null where it is no finite number."""
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two normalized labels: 1 where equal, else shared words over the words of
    ``a`` (distinct) and ``b`` (with repeats) less the shared ones."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    both = F.size(F.array_intersect(wa, wb))
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(F.array_distinct(wa)) + F.size(wb) - both))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; vectors shorter than 1e-12 count as of length 1e-12."""
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def compositional_distinct(a: Column, b: Column) -> Column:
    """Do two labels differ by composition: all words of the shorter in the longer, but not its head?"""
    wa, wb = F.split(a, " "), F.split(b, " ")
    short, long_ = F.when(F.size(wa) <= F.size(wb), wa).otherwise(wb), F.when(F.size(wa) <= F.size(wb), wb).otherwise(wa)
    return (F.size(short) < F.size(long_)) & (F.size(F.array_except(short, long_)) == 0) & ~F.array_contains(short, F.element_at(long_, -1))


def _ascii_words(x: Column) -> Column:
    """Words of a label; empty unless each has an ASCII letter."""
    words = F.filter(F.split(norm_label(x), " "), lambda w: w != "")
    return F.when(F.forall(words, lambda w: w.rlike("[a-z]")), words).otherwise(F.array().cast("array<string>"))


def safe_subclass(sub: Column, sup: Column) -> Column:
    """Does the subclass's label end with the words of the superclass's, with words before them?"""
    ws, wp = _ascii_words(sub), _ascii_words(sup)
    tail = F.slice(ws, F.greatest(F.size(ws) - F.size(wp), F.lit(0)) + 1, F.size(wp))
    return (F.size(wp) > 0) & (F.size(ws) > F.size(wp)) & (tail == wp)


def head_mismatch(sub: Column, sup: Column) -> Column:
    """Does a compound label hold all words of its superclass's without sharing its head?"""
    ws, wp = _ascii_words(sub), F.filter(F.split(norm_label(sup), " "), lambda w: w != "")
    longer = (F.size(wp) > 0) & (F.size(ws) > F.size(wp)) & (F.size(F.array_except(wp, ws)) == 0)
    return longer & (F.try_element_at(ws, F.lit(-1)) != F.try_element_at(wp, F.lit(-1)))


def non_identifying(label: Column) -> Column:
    """Is a label a placeholder that names nothing? Null and empty are."""
    x = F.lower(F.trim(label))
    return F.coalesce(x, F.lit("")).isin("", *PLACEHOLDERS)
