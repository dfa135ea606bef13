"""Queries on evidence: normalized texts, grounding, declarations, structured values, mentions of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import evidence as E
from graphloom.functions import text as X
from graphloom.operators import extraction, mentions
from graphloom.plans.catalog import query, read

#: SQL of ``evidence.plain_text`` (texts have no compatibility forms), and the signs of a word.
_W = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"


def _plain(x: str) -> str:
    links = rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]*\)', '\1', 'g')"
    shown = rf"""regexp_replace({links}, '\{{\{{[<%](?:[^}}]*?\btext\s*=\s*"([^"]*)")?[^}}]*?[>%]\}}\}}', ' \1 ', 'gs')"""
    return rf"lower(array_to_string(regexp_extract_all(replace(regexp_replace({shown}, '<[^>]+>', ' ', 'g'), '_', ' '), '[{_W}]+'), ' '))"


def _parts(spark, sf_dir):
    """The parts, dealt anew: a split holds too many small rows for work on texts."""
    return read(spark, sf_dir, "part").repartition("p_partkey")


_SHOWN = """'[' || p_name || '](http://x/y) {{< ref text="shown ' || p_brand || '" >}} {{% gone %}}See <b>' || p_type || '</b> at 10:30:45 :icon: a_b'"""


@query(f"SELECT p_partkey, 'pump a ' || lower(p_name) AS norm, {_plain(_SHOWN)} AS evidence FROM part")
def normalized_labels(spark, sf_dir):
    """Wide letters and spaces in labels; in evidence links, tags and short codes go but what they show stays."""
    label = F.concat(F.lit("  Ｐｕｍｐ\tＡ "), F.upper("p_name"), F.lit(" "))
    shown = F.concat(F.lit("["), "p_name", F.lit('](http://x/y) {{< ref text="shown '), "p_brand", F.lit('" >}} {{% gone %}}See <b>'), "p_type", F.lit("</b> at 10:30:45 :icon: a_b"))
    return _parts(spark, sf_dir).select("p_partkey", X.normalize_label(label).alias("norm"), E.normalize_evidence(shown).alias("evidence"))


@query(f"SELECT doc_id, md5({_plain('text')}) AS evidence, {_plain('source')} AS label FROM documents")
def evidence_texts(spark, sf_dir):
    """Whole documents by their normalized words."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(E.normalize_evidence("text").cast("binary")).alias("evidence"), E.normalize_class("source").alias("label"))


_CUTS = (
    "WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),"
    " s AS (SELECT doc_id, text, w[2] || '_' || w[3] AS surface, w[4][:-2] || ' ' || w[5] AS cut, upper(w[2] || ',  ' || w[3]) AS quote, w[2][1:2] AS short, w[7] || ' ' || w[8][:-2] AS half FROM d WHERE len(w) >= 8)"
)


def _within(phrase: str, least: int = 1) -> str:
    return f"length(replace({_plain(phrase)}, ' ', '')) >= {least} AND contains(' ' || plain || ' ', ' ' || {_plain(phrase)} || ' ')"


@query(
    f"{_CUTS}, p AS (SELECT *, {_plain('text')} AS plain FROM s) SELECT doc_id, {_within('surface')} AS surface, {_within('cut')} AS cut, {_within('quote', 4)} AS quote, {_within('short', 4)} AS short, {_within('half', 4)} AS half FROM p"
)
def grounded_forms(spark, sf_dir):
    """Words of each document as surfaces and quotes: with underscores, in capitals, cut within a word, too short."""
    d = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)")).alias("w")).filter(F.size("w") >= 8)
    w = lambda i: F.get("w", F.lit(i))
    less = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    surface, cut = F.concat(w(1), F.lit("_"), w(2)), F.concat(less(w(3)), F.lit(" "), w(4))
    quote, short, half = F.upper(F.concat(w(1), F.lit(",  "), w(2))), F.substring(w(1), 1, 2), F.concat(w(6), F.lit(" "), less(w(7)))
    says = {"surface": E.surface_is_grounded(surface, "text"), "cut": E.surface_is_grounded(cut, "text"), "quote": E.evidence_is_grounded(quote, "text"), "short": E.evidence_is_grounded(short, "text"), "half": E.evidence_is_grounded(half, "text")}
    return d.select("doc_id", *[c.alias(n) for n, c in says.items()])


#: Sentences that may declare a name; all of them are tried with every name.
_SAYINGS = (
    "{} is an instance of it.", "{} is a named individual.", "The `{}` is the instance.", "An individual called *{}* runs.", "the ex:{} instance", "名为{}的实例", "该 {} 个体", "{} 是一个实例",
    "{} is an example of it.", "A part called {}.", "例如：{}", "An instance named {}s.", "Not-{} is an individual.", "{} is a part.",
)
_BODY = r"array_to_string(string_split(p_name, ' '), '[\s_-]+')"


def _declares(text: str, body: str) -> str:
    """SQL of ``evidence.declared``; names and what stands next to them are ASCII."""
    w = "0-9A-Za-z_"
    x, q = f"'[`*_]*' || {body} || '[`*_]*'", f"'[`*_]*[A-Za-z][{w}-]*:' || {body} || '[`*_]*'"
    tests = [
        rf"'\bthe\s+' || {q} || '\s+(?:named\s+)?(?:instance|individual)\b'", rf"'(?:^|[^{w}-])' || {x} || '\s+is\s+(?:an?\s+|the\s+)?(?:named\s+)?(?:instance|individual)\b'",
        rf"'\b(?:instance|individual)\s+(?:named|called)\s+' || {x} || '(?:[^{w}-]|$)'", rf"'(?:名为|称为)\s*' || {x} || '\s*的?(?:实例|个体)'", rf"'该\s*' || {x} || '\s*(?:实例|个体)'", rf"{x} || '\s*是\s*(?:一个|该)?\s*(?:实例|个体)'",
    ]
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i)' || {t})" for t in tests) + ")"


@query(
    f"WITH s AS (SELECT p_partkey, p_name, unnest(range(0, {len(_SAYINGS)})) AS saying, unnest([" + ", ".join("'" + x.replace("{}", "' || p_name || '") + "'" for x in _SAYINGS) + "]) AS text FROM part)"
    f" SELECT p_partkey, saying::INTEGER AS saying, {_declares('text', _BODY)} AS declared FROM s"
)
def declared_individuals(spark, sf_dir):
    """Which sentences say that a name is one individual."""
    texts = F.array(*[F.concat(F.lit(x.split("{}")[0]), F.col("p_name"), F.lit(x.split("{}")[1])) for x in _SAYINGS])
    said = _parts(spark, sf_dir).select("p_partkey", "p_name", F.posexplode(texts).alias("saying", "text"))
    return said.select("p_partkey", "saying", E.declared_individual("p_name", "text").alias("declared"))


_FIELDS = """'Part type: ' || p_type || chr(10) || '- Made by: ' || p_brand || ',' || chr(10) || 'Words: [' || replace(p_name, ' ', ', ') || ']' || chr(10) || '分类：' || p_name || chr(10) || 'kinds: ' || p_type
 || chr(10) || 'see http://x.y/z' || chr(10) || '{"type": "' || p_brand || '", "size": ' || p_size || ', "name": "' || p_name || '|' || p_type || '"}'"""
_LINE = r"'(?m)^\s*(?:[-*]\s+)?([^:\n]{1,96})\s*[:：]\s*([^\n]+?)\s*$'"
_PAIR = r"""'"([^"\\]{1,96})"\s*:\s*("(?:\\.|[^"\\])*"|[-+]?\d+(?:\.\d+)?)'"""
_ROLES = f"""
  SELECT k.id AS id, value, array_to_string(list_sort(list_distinct(list(CASE WHEN string_split(key, ' ')[-1] IN ('category', 'class', 'kind', 'type', '类别', '分类', '种类', '类型') THEN 'type' ELSE 'literal' END))), ' ') AS roles
  FROM (
    SELECT id, {_plain('key')} AS key, {_plain('value')} AS value FROM (
      SELECT id, key, whole AS value FROM listed
      UNION ALL SELECT id, key, unnest(string_split_regex(items, '\\s*[,，;；|→]\\s*')) FROM listed WHERE regexp_matches(items, '[,，;；|→]') AND NOT contains(items, '://'))) k
  WHERE value <> '' GROUP BY ALL
"""
_LISTED = f"""
  pairs AS (
    SELECT id, unnest(regexp_extract_all(text, {_LINE}, 1)) AS key, unnest(regexp_extract_all(text, {_LINE}, 2)) AS raw FROM texts
    UNION ALL SELECT id, unnest(regexp_extract_all(text, {_PAIR}, 1)), unnest(regexp_extract_all(text, {_PAIR}, 2)) FROM texts),
  scalars AS (SELECT id, key, CASE WHEN regexp_matches(v, '^".*"$') THEN v[2:-2] ELSE v END AS whole FROM (SELECT id, key, trim(rtrim(trim(raw), ',')) AS v FROM pairs)),
  listed AS (SELECT *, CASE WHEN regexp_matches(whole, '^[\\[(].*[\\])]$') THEN whole[2:-2] ELSE whole END AS items FROM scalars)
"""


def _fields(c):
    nl = F.lit("\n")
    return F.concat(
        F.lit("Part type: "), c("p_type"), nl, F.lit("- Made by: "), c("p_brand"), F.lit(","), nl, F.lit("Words: ["), F.replace(c("p_name"), F.lit(" "), F.lit(", ")), F.lit("]"), nl, F.lit("分类："), c("p_name"), nl,
        F.lit("kinds: "), c("p_type"), nl, F.lit("see http://x.y/z"), nl, F.lit('{"type": "'), c("p_brand"), F.lit('", "size": '), c("p_size"), F.lit(', "name": "'), c("p_name"), F.lit("|"), c("p_type"), F.lit('"}'),
    )


@query(f"WITH texts AS (SELECT p_partkey AS id, {_FIELDS} AS text FROM part), {_LISTED} SELECT id AS p_partkey, value, roles FROM ({_ROLES})")
def structured_roles(spark, sf_dir):
    """The roles of every value in ``key: value`` lines and JSON pairs; lists count as a whole and by parts."""
    return _parts(spark, sf_dir).select("p_partkey", F.explode(E.structured_value_roles(_fields(F.col))).alias("r")).select("p_partkey", "r.value", F.array_join("r.roles", " ").alias("roles"))


# Guards: what a class must not be, by its own chunk and by the whole corpus.
_GUARDED = f"""
WITH source AS (
  SELECT p_partkey AS id, 'Type: ' || p_type || chr(10) || 'Made by: ' || p_brand || chr(10) || 'Size: ' || p_size || ' units' || chr(10) || 'We sell the ' || p_name || CASE WHEN p_size > 40 THEN ' is an instance of it.' ELSE ' is an example of it.' END AS text,
    [p_name, p_type, p_brand, upper(p_brand), 'xsd:integer', 'Date', 'Absent Thing', p_size || ' units', 'sell the'] AS labels, p_name FROM part),
texts AS (SELECT id, text, {_plain('text')} AS plain FROM source), {_LISTED},
roles AS ({_ROLES}),
cases AS (SELECT id, unnest(labels) AS label FROM source),
norms AS (SELECT *, {_plain('label')} AS norm FROM cases),
near AS MATERIALIZED (SELECT c.label, t.text FROM (SELECT DISTINCT label, norm FROM norms) c JOIN texts t ON contains(t.plain, 'instance') AND contains(t.plain, c.norm)),
named AS (SELECT DISTINCT label FROM near t WHERE {_declares('t.text', r"replace(regexp_replace(t.label, '[^a-zA-Z0-9 ]', '.', 'g'), ' ', '[\s_-]+')")})
SELECT c.id AS chunk_id, c.label, CASE WHEN c.label IN ('xsd:integer', 'Date') THEN 'datatype' WHEN c.label IN (SELECT label FROM named) THEN 'individual' WHEN r.roles = 'literal' THEN 'value'
  WHEN NOT contains(' ' || t.plain || ' ', ' ' || c.norm || ' ') THEN 'not grounded' END AS blocked
FROM norms c JOIN texts t USING (id) LEFT JOIN roles r ON r.id = c.id AND r.value = c.norm
"""


def _guarded(spark, sf_dir):
    c = F.col
    text = F.concat(F.lit("Type: "), c("p_type"), F.lit("\nMade by: "), c("p_brand"), F.lit("\nSize: "), c("p_size"), F.lit(" units\nWe sell the "), c("p_name"), F.when(c("p_size") > 40, " is an instance of it.").otherwise(" is an example of it."))
    labels = F.array(c("p_name"), c("p_type"), c("p_brand"), F.upper("p_brand"), F.lit("xsd:integer"), F.lit("Date"), F.lit("Absent Thing"), F.concat(c("p_size"), F.lit(" units")), F.lit("sell the"))
    p = _parts(spark, sf_dir)
    return p.select(c("p_partkey").alias("chunk_id"), F.posexplode(labels).alias("pos", "label")), p.select(c("p_partkey").alias("chunk_id"), text.alias("text"))


@query(_GUARDED)
def guarded_classes(spark, sf_dir):
    """Why a class does not enter the schema: a datatype, an individual anywhere, a value, not in its chunk."""
    return extraction.guard_classes(*_guarded(spark, sf_dir)).select("chunk_id", "label", "blocked")


# Mentions.
_LABELS = (
    "WITH w AS (SELECT DISTINCT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark WHERE text IS NOT NULL),"
    " l AS (SELECT w[1] AS label FROM w WHERE len(w) > 3 UNION SELECT w[2] || '_' || upper(w[3]) FROM w WHERE len(w) > 3 UNION SELECT 'para' UNION SELECT p_type FROM part UNION SELECT '水泵' UNION SELECT '泵 1号')"
)


def _labels(spark, sf_dir):
    """Words and pairs of words of the benchmark's texts, types of parts, and some Chinese names."""
    b = read(spark, sf_dir, "benchmark").filter("text is not null").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")).alias("w")).filter(F.size("w") > 3)
    w = lambda i: F.get("w", F.lit(i))
    each = b.select(F.explode(F.array(w(0), F.concat(w(1), F.lit("_"), F.upper(w(2))), F.lit("para"), F.lit("水泵"), F.lit("泵 1号"))).alias("label"))
    return each.unionByName(_parts(spark, sf_dir).select(F.col("p_type").alias("label"))).distinct()


def _texts(spark, sf_dir):
    """Documents and names of parts; some are within Chinese sentences."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit("这个水泵1号很好。"))).otherwise(F.col("text")).alias("text"))
    parts = _parts(spark, sf_dir).select((F.col("p_partkey") + 1_000_000_000).alias("chunk_id"), F.concat(F.lit("The "), F.col("p_type"), F.lit("-part; "), F.upper("p_type"), F.lit(" _x")).alias("text"))
    return docs.unionByName(parts)


_TEXTS = (
    "t AS (SELECT doc_id AS chunk_id, CASE WHEN lang = 'de' THEN text || '这个水泵1号很好。' ELSE text END AS text FROM documents WHERE text IS NOT NULL"
    " UNION ALL SELECT p_partkey + 1000000000, 'The ' || p_type || '-part; ' || upper(p_type) || ' _x' FROM part)"
)
_HELD = (
    f"{_LABELS}, {_TEXTS}, n AS (SELECT label, {_plain('label')} AS norm FROM l), p AS MATERIALIZED (SELECT chunk_id, ' ' || {_plain('text')} || ' ' AS plain FROM t),"
    " h AS (SELECT label, chunk_id FROM n JOIN p ON CASE WHEN regexp_matches(norm, '[㐀-鿿]') THEN contains(plain, norm) ELSE contains(plain, ' ' || norm || ' ') END)"
)


@query(f"{_HELD} SELECT label, chunk_id FROM h")
def label_mentions(spark, sf_dir):
    """Every text that holds a label, by automata over all forms of the labels."""
    return mentions.mentions(_labels(spark, sf_dir), _texts(spark, sf_dir))


@query(f"{_HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY chunk_id) AS i FROM h) SELECT label, chunk_id FROM r WHERE i <= 4")
def first_mentions(spark, sf_dir):
    """The first texts that hold each label."""
    return mentions.first_mentions(_labels(spark, sf_dir), _texts(spark, sf_dir))
