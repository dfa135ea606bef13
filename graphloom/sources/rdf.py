"""RDF sources and sinks: line formats in column functions, document formats file by file.

N-Quads and N-Triples are read as lines and taken apart by one regular expression inside the JVM;
lines it does not match fail the read (or are left out, and told by ``malformed``). Turtle and RDF/XML need state
across lines, so each file is parsed in a task; a file is the unit of work and of failure.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions.text import arrow_udf
from graphloom.operators.store import SCHEMA
from graphloom.sources.mapping import QUAD, dealt
from graphloom.sources.rdf_parsers import RdfXml, Turtle

# Plain characters are taken as one run that gives nothing back: escapes and ends are other characters.
_IRI = r"<((?:[^<>\"{}|^`\\\x00-\x20]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)>"
_BNODE = r"_:([\p{L}\p{N}_][\p{L}\p{N}_.-]*)"
_LITERAL = rf'"((?:[^"\\\n\r]++|\\.)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^{_IRI})?'
LINE = rf"^\s*(?:{_IRI}|{_BNODE})\s*{_IRI}\s*(?:{_IRI}|{_BNODE}|{_LITERAL})\s*(?:{_IRI})?\s*\.\s*(?:#.*)?$"
#: Most triples of one import, and formats by file extension.
MAX_TRIPLES = 250_000
#: Most statements of a document that is written here.
DOCUMENT = 50_000
FORMATS = {"ttl": "turtle", "turtle": "turtle", "nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml"}


def unescape(x: Column) -> Column:
    """String escapes of a literal; backslashes are set aside while the others are resolved."""
    x = F.replace(x, F.lit("\\\\"), F.lit("\x00"))
    for shown, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'"), ('\\"', '"')):
        x = F.replace(x, F.lit(shown), F.lit(raw))
    points = F.regexp_extract_all(x, F.lit(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"), F.lit(0))

    def point(acc: Column, e: Column) -> Column:
        hexa = F.lpad(F.substring(e, F.lit(3), F.length(e)), 8, "0")
        return F.replace(acc, e, F.decode(F.unhex(hexa), "UTF-32"))

    x = F.aggregate(F.array_distinct(points), x, point)
    return F.replace(x, F.lit("\x00"), F.lit("\\"))


def _matched(lines: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("value", LINE, i)
    return lines.filter(F.col("value").rlike(LINE)).select(*[part(i).alias(f"m{i}") for i in range(1, 10)], "value")


def parse_lines(lines: DataFrame, to_graph: str | None = None) -> DataFrame:
    """(value) -> quads. A graph in the line stays; lines without one go to ``to_graph``."""
    m = _matched(lines)
    some = lambda c: F.when(F.col(c) != "", F.when(F.contains(c, F.lit("\\")), unescape(F.col(c))).otherwise(F.col(c)))
    kind = F.when(F.col("m4") != "", "iri").when(F.col("m5") != "", "bnode").otherwise("literal")
    return m.select(
        F.coalesce(some("m9"), F.lit(to_graph).cast("string")).alias("g"), F.when(F.col("m2") != "", "bnode").otherwise("iri").alias("s_kind"), F.coalesce(some("m1"), some("m2")).alias("s"),
        some("m3").alias("p"), kind.alias("o_kind"), F.coalesce(some("m4"), some("m5"), unescape(F.col("m6"))).alias("o"), some("m8").alias("o_dt"), some("m7").alias("o_lang"),
    )


def _bad(line: Column) -> Column:
    return (F.trim(line) != "") & ~line.rlike(r"^\s*#") & ~line.rlike(LINE)


def read_nquads(spark: SparkSession, path: str, to_graph: str | None = None, skip: bool = False) -> DataFrame:
    """Quads of line files. A line that holds something but no statement fails the read, or is left
    out with ``skip``."""
    lines = spark.read.text(path)
    if not skip:
        told = F.when(_bad(F.col("value")), F.raise_error(F.concat(F.lit("no statement: "), F.substring("value", 1, 200)))).otherwise(F.col("value"))
        lines = lines.select(told.alias("value"))
    return parse_lines(lines, to_graph)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines that hold something but no statement."""
    return spark.read.text(path).filter(_bad(F.col("value")))


def write_nquads(quads: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    quads.select(T.line_of().alias("value")).distinct().write.option("maxRecordsPerFile", rows_per_file).text(path)


def _write_documents(rows: DataFrame, path: str, block: Callable[[str, list[tuple]], str], head: str = "", tail: str = "", between: str = "\n") -> None:
    """(subject, p, v) rows as documents of at most DOCUMENT statements, each a file of its own.

    Rows are sorted by subject in tasks, where repeats meet, and a task holds one document at a
    time. A subject whose rows do not fit goes on in the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, items, last = [], [], None
        n = 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([head + between.join(blocks) + tail])], names=["value"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == last:
                    continue
                if items and (row[0] != last[0] or n == DOCUMENT):
                    blocks.append(block(last[0], items))
                    items = []
                if n == DOCUMENT:
                    yield whole()
                    blocks, n = [], 0
                items.append(row[1:])
                last, n = row, n + 1
        if items:
            blocks.append(block(last[0], items))
            yield whole()

    rows = rows.toDF("subject", "p", "v")
    dealt(rows, "subject").sortWithinPartitions("subject", "p", "v").mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_turtle(quads: DataFrame, path: str) -> None:
    """A block for each subject, predicates in order; subjects of one graph merge layer by layer."""
    p, o = F.concat(F.lit("<"), F.col("p"), F.lit("> ")), T.object_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    rows = quads.select(T.subject_text(F.col("s_kind"), F.col("s")), p, o)
    _write_documents(rows, path, lambda s, items: f"{s} " + " ;\n    ".join(p + o for p, o in items) + " .")


def write_trig(quads: DataFrame, path: str) -> None:
    """TriG: a block for each subject of a graph; every file is a document."""
    p, o = F.concat(F.lit("<"), F.col("p"), F.lit("> ")), T.object_text(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    open_ = F.when(F.col("g").isNull(), F.lit("{ ")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit("> { ")))
    rows = quads.select(F.concat(open_, T.subject_text(F.col("s_kind"), F.col("s"))), p, o)
    _write_documents(rows, path, lambda s, items: f"{s} " + " ;\n    ".join(p + o for p, o in items) + " . }")


def write_rdfxml(quads: DataFrame, path: str) -> None:
    """RDF/XML, a description for each subject; every file is a document. No quads, no document.

    What XML cannot say fails: control characters, and predicates that end in no name.
    """
    wrong = lambda test, why, c: F.when(test, F.raise_error(F.concat(F.lit(why), c))).otherwise(c)
    quads = quads.withColumn("o", wrong(F.col("o").rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]"), "no XML text: ", F.col("o")))
    quads = quads.withColumn("p", wrong(~F.col("p").rlike(r"[A-Za-z_][\w.-]*$"), "no XML name in ", F.col("p")))
    marks = lambda c: F.replace(F.replace(F.replace(c, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#9;"))
    safe = lambda c: marks(plain_safe(c))
    plain_safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    local = F.regexp_extract("p", r"[A-Za-z_][\w.-]*$", 0)
    space = F.substring("p", F.lit(1), F.length("p") - F.length(local))
    node = lambda kind, v, a, b: F.when(kind == "bnode", F.concat(F.lit(f' rdf:nodeID="{a}'), v, F.lit('"'))).otherwise(F.concat(F.lit(f' rdf:{b}="'), safe(v), F.lit('"')))
    opened = F.concat(F.lit("    <x:"), local, F.lit(' xmlns:x="'), safe(space), F.lit('"'))
    plain = F.col("o_dt").isNull() | (F.col("o_dt") == T.XSD + "string")
    mark = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"'))).when(plain, F.lit("")).otherwise(F.concat(F.lit(' rdf:datatype="'), safe(F.col("o_dt")), F.lit('"')))
    literal = F.concat(opened, mark, F.lit(">"), safe(F.col("o")), F.lit("</x:"), local, F.lit(">"))
    line = F.when(F.col("o_kind") == "literal", literal).otherwise(F.concat(opened, node(F.col("o_kind"), F.col("o"), "", "resource"), F.lit("/>")))
    rows = quads.select(node(F.col("s_kind"), F.col("s"), "", "about"), F.lit(""), line)
    described = lambda about, items: f"  <rdf:Description{about}>\n" + "\n".join(x for _, x in items) + "\n  </rdf:Description>"
    _write_documents(rows, path, described, f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{T.RDF}">\n', "\n</rdf:RDF>")


def write_jsonld(quads: DataFrame, path: str) -> None:
    """Expanded JSON-LD, an object for each subject; every file is a document."""
    ref = lambda kind, v: F.when(kind == "bnode", F.concat(F.lit("_:"), v)).otherwise(v)
    text = F.struct(F.col("o").alias("@value"), F.when(F.col("o_lang").isNull() & F.col("o_dt").isNotNull() & (F.col("o_dt") != T.XSD + "string"), F.col("o_dt")).alias("@type"), F.col("o_lang").alias("@language"))
    value = F.when(F.col("o_kind") == "literal", F.to_json(text)).otherwise(F.to_json(F.struct(ref(F.col("o_kind"), F.col("o")).alias("@id"))))
    rows = quads.select(ref(F.col("s_kind"), F.col("s")), "p", value)

    def node(subject: str, items: list[tuple]) -> str:
        values = (f"{json.dumps(p, ensure_ascii=False)}:[{','.join(v for _, v in some)}]" for p, some in groupby(items, itemgetter(0)))
        return ",".join([f'{{"@id":{json.dumps(subject, ensure_ascii=False)}', *values]) + "}"

    _write_documents(rows, path, node, "[\n", "\n]", ",\n")


def normalize_format(name: str | None) -> str | None:
    return FORMATS.get((name or "").strip().lower().lstrip(".")) or ({"application/rdf+xml": "rdfxml", "text/turtle": "turtle", "application/n-triples": "ntriples", "rdf/xml": "rdfxml"}.get((name or "").strip().lower()))


def sniff(content: str) -> str:
    head = content.lstrip()[:2000]
    if head.startswith("<?xml") or "<rdf:RDF" in head:
        return "rdfxml"
    if head.startswith("{") or head.startswith("["):
        return "jsonld"
    first = next((line for line in head.splitlines() if line.strip() and not line.lstrip().startswith("#")), "")
    return "ntriples" if re.match(r"\s*(<[^>]*>|_:\S+)\s+<[^>]*>\s+.*\.\s*$", first) and "@prefix" not in head else "turtle"


@arrow_udf("string")
def format_of(names: pd.Series, contents: pd.Series) -> pd.Series:
    """The format by a file's extension where that is known, else by its content."""
    return pd.Series([normalize_format((n or "").rpartition(".")[2]) or (None if c is None else sniff(c)) for n, c in zip(names, contents, strict=True)], dtype=object)


def triples_of(content: str, form: str, base: str, scope: str) -> list[tuple]:
    if form == "rdfxml":
        return RdfXml(content, base, scope).triples()
    if form in ("turtle", "ntriples"):
        return Turtle(content, base, scope).triples()
    raise ValueError(f"format {form!r} is not supported")


def import_files(spark: SparkSession, path: str, graph_iri: str, form: str | None = None, base: str = "", max_triples: int = MAX_TRIPLES, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Quads of Turtle, N-Triples and RDF/XML files, without repeats.

    The format is the given one, else by extension, else by content. Blank nodes are scoped by the
    file's content hash, so importing a file again gives the same quads. A file of more than
    ``max_triples`` distinct triples fails. ``prefix`` (from, to) replaces a namespace in the texts first.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("content"), F.substring(F.sha2("content", 256), 1, 12).alias("scope"))
    wanted = normalize_format(form) if form else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                f = batch.slice(i, 1).to_pylist()[0]
                if prefix:
                    f["content"] = f["content"].replace(*prefix)
                kind = wanted or normalize_format(f["path"].rpartition(".")[2]) or sniff(f["content"])
                found = list(dict.fromkeys(triples_of(f["content"], kind, base, f["scope"])))
                if len(found) > max_triples:
                    raise ValueError(f"{f['path']} has more than {max_triples} triples")
                rows = [(graph_iri, s[0], s[1], p, o[0], o[1], o[2], o[3]) for s, p, o in found]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=QUAD)

    return files.mapInArrow(run, SCHEMA).distinct()
