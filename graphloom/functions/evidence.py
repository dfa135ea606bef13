"""Is what a model asserts said in its source: surfaces, quotes, declarations, structured values.

The UDFs take whole columns; the helpers they call work on one text and are small. A word is a run
of letters, marks, decimal digits and connectors; a text is compared by its normalized words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import arrow_udf

# What counts as a word, a CJK sign, a field, a declaration.
W = r"\p{L}\p{Mn}\p{Nd}\p{Pc}"
CJK = regex.compile("[㐀-鿿豈-﫿]")
LINK = r"\[([^\]]+)\]\([^)]*\)"
SHORTCODE = r"\{\{[<%]\s*(.*?)\s*[>%]\}\}"
SHORTCODE_TEXT = r"\btext\s*=\s*([\"'])(.*?)\1"
TAG = r"<[^>]+>"
FIELD_LINE = r"^\s*(?:[-*]\s+)?([^:\n]{1,96})\s*[:：]\s*([^\n]+?)\s*$"
JSON_PAIR = r"\"([^\"\\]{1,96})\"\s*:\s*(\"(?:\\.|[^\"\\])*\"|[-+]?\d+(?:\.\d+)?|true|false|null)"
TYPE_FIELDS = ("category", "class", "kind", "type", "类别", "分类", "种类", "类型")
SEPARATORS = r"[,，;；|→]"
NO_VALUES = ("{}", "[]", "|", ">")
#: ``{x}`` is the label between signs of emphasis, ``{q}`` the same as a prefixed name.
DECLARATIONS = (
    r"\bthe\s+{q}\s+(?:named\s+)?(?:instance|individual)\b",
    r"(?<![{w}-]){x}\s+is\s+(?:an?\s+|the\s+)?(?:named\s+)?(?:instance|individual)\b",
    r"\b(?:instance|individual)\s+(?:named|called)\s+{x}(?![{w}-])",
    r"(?:名为|称为)\s*{x}\s*的?(?:实例|个体)",
    r"该\s*{x}\s*(?:实例|个体)",
    r"{x}\s*是\s*(?:一个|该)?\s*(?:实例|个体)",
)
LEAST_QUOTE = 4
#: Every declaration has one of these words.
_NOUN = regex.compile("instance|individual|实例|个体", regex.IGNORECASE)

_WORD, _LINK, _TAG = regex.compile(f"[{W}]+"), regex.compile(LINK), regex.compile(TAG)
_ASCII_WORD = re.compile("[0-9A-Za-z_]+")
_SHORTCODE, _SHOWN = regex.compile(SHORTCODE, regex.DOTALL), regex.compile(SHORTCODE_TEXT, regex.DOTALL | regex.IGNORECASE)
_FIELD, _PAIR, _PARTS = regex.compile(FIELD_LINE, regex.MULTILINE), regex.compile(JSON_PAIR, regex.IGNORECASE), regex.compile(rf"\s*{SEPARATORS}\s*")


def nfkc(x: str | None) -> str:
    return x if x and x.isascii() else unicodedata.normalize("NFKC", x or "")


@lru_cache(512)
def plain_text(x: str | None) -> str:
    """Normalized words joined by spaces: links keep their text, short codes the text they show, tags go."""

    def shown(m: regex.Match) -> str:
        text = _SHOWN.search(m[1])
        return f" {text[2]} " if text else " "

    x = nfkc(x)
    x = _LINK.sub(r"\1", x) if "[" in x else x
    x = _SHORTCODE.sub(shown, x) if "{{" in x else x
    x = (_TAG.sub(" ", x) if "<" in x else x).replace("_", " ")
    return " ".join((_ASCII_WORD if x.isascii() else _WORD).findall(x)).lower()


def plain_label(x: str | None) -> str:
    """A label's normalized words: as guards compare labels."""
    return " ".join(_WORD.findall(nfkc(x).lower().replace("_", " ")))


def phrase_in(source: str, phrase: str) -> bool:
    """Is a normalized phrase among a normalized source's words? CJK phrases may lie within a run."""
    if not phrase:
        return False
    return phrase in source if CJK.search(phrase) else f" {phrase} " in f" {source} "


def written_in(source: str, form: str) -> bool:
    """Does a form stand in a source (both in lower case) with no word sign or hyphen next to it?"""
    at = source.find(form)
    while at >= 0:
        around = source[at - 1 : at] + source[at + len(form) : at + len(form) + 1]
        if not any(c == "-" or _WORD.match(c) for c in around):
            return True
        at = source.find(form, at + 1)
    return False


def grounded(surface: str | None, source: str | None) -> bool:
    """Is a surface form in a source: as written in any case, or by its normalized words?"""
    form = (surface or "").strip()
    if not form or not source:
        return False
    return written_in(source.lower(), form.lower()) or phrase_in(plain_text(source), plain_text(form))


def quoted(quote: str | None, source: str | None) -> bool:
    """Does a source hold a quote of LEAST_QUOTE normalized signs or more, as whole words?"""
    words = plain_text(quote)
    return len(words.replace(" ", "")) >= LEAST_QUOTE and bool(source) and phrase_in(plain_text(source), words)


@lru_cache(4096)
def _declaration(words: tuple[str, ...]) -> regex.Pattern:
    body = r"[\s_-]+".join(map(regex.escape, words))
    x = rf"[`*_]*{body}[`*_]*"
    q = rf"[`*_]*[A-Za-z][{W}-]*:{body}[`*_]*"
    return regex.compile("|".join(p.format(x=x, q=q, w=W) for p in DECLARATIONS), regex.IGNORECASE)


def may_declare(source: str) -> bool:
    """Has a source a word that every declaration has?"""
    return bool(_NOUN.search(source))


def declared(label: str | None, source: str | None) -> bool:
    """Does the source say in so many words that a label names one individual?"""
    words = _WORD.findall(nfkc(label))
    if not words or not source or not may_declare(source):
        return False
    return bool(_declaration(tuple(words)).search(source))


def _scalar(x: str) -> str:
    x = x.strip().rstrip(",").strip()
    return x[1:-1].strip() if len(x) >= 2 and x[0] == x[-1] and x[0] in "\"'`" else x


def scalars(raw: str) -> list[str]:
    """A field's value, and its parts where it is a list; addresses are no lists."""
    whole = _scalar(raw)
    if not whole or whole in NO_VALUES:
        return []
    inner = whole[1:-1].strip() if len(whole) >= 2 and whole[0] in "[(" and whole[-1] in "])" else whole
    parts = _PARTS.split(inner) if "://" not in inner and regex.search(SEPARATORS, inner) else []
    return list(dict.fromkeys(x for x in (whole, *map(_scalar, parts)) if x))


@lru_cache(512)
def _values(raw: str) -> tuple[str, ...]:
    return tuple(v for v in map(plain_text, scalars(raw)) if v)


def value_roles(source: str | None) -> dict[str, set[str]]:
    """Normalized values of ``key: value`` lines and JSON pairs, each with its roles: type or literal."""
    roles: dict[str, set[str]] = {}
    for pattern in (_FIELD, _PAIR):
        for m in pattern.finditer(source or ""):
            key = plain_text(m[1])
            role = "type" if key and (key in TYPE_FIELDS or key.split(" ")[-1] in TYPE_FIELDS) else "literal"
            for value in _values(m[2]):
                roles.setdefault(value, set()).add(role)
    return roles


def _of_pairs(f):
    return lambda a, b: pd.Series([f(x, y) for x, y in zip(a, b, strict=True)])


@arrow_udf("string")
def normalize_evidence(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else plain_text(x))


@arrow_udf("string")
def normalize_class(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: None if x is None else plain_label(x))


@arrow_udf("boolean")
def surface_is_grounded(surfaces: pd.Series, sources: pd.Series) -> pd.Series:
    return _of_pairs(grounded)(surfaces, sources)


@arrow_udf("boolean")
def evidence_is_grounded(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    return _of_pairs(quoted)(quotes, sources)


@arrow_udf("boolean")
def declared_individual(labels: pd.Series, sources: pd.Series) -> pd.Series:
    return _of_pairs(declared)(labels, sources)


@arrow_udf("array<struct<value:string,roles:array<string>>>")
def structured_value_roles(texts: pd.Series) -> pd.Series:
    """Every structured value of a text with the set of its roles, in order."""
    return texts.map(lambda x: [{"value": v, "roles": sorted(r)} for v, r in sorted(value_roles(x).items())])


def non_type_values(texts: Column) -> Column:
    """Structured values of a text that no field declares a type."""
    bare = F.filter(structured_value_roles(texts), lambda v: ~F.array_contains(v["roles"], "type"))
    return F.transform(bare, lambda v: v["value"])
