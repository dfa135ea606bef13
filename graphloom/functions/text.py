"""Text functions that need Unicode normalization or scanning state, as Arrow UDFs.

The UDFs take whole columns; the helpers they call work on one text and are small.
"""

from __future__ import annotations

import re
import unicodedata
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CHUNK = "array<struct<idx:int,char_start:int,char_end:int,text:string,token_estimate:int>>"
_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[A-Za-z0-9_]+|[^\s]")
#: Kinds of places where a chunk may end or begin, each a pattern that ends at the place.
#: The sentence end is a fixed pattern.
_SENTENCE = re.compile(r"""[.!?;:。！？；：](?:["'”’)\]]*)\s+""")
_PARAGRAPH, _LINE, _SPACE = re.compile(r"\n\n"), re.compile(r"\n"), re.compile(r"\s")


def arrow_udf(ddl: str):
    """A column function from a function of Series; made on first use, when there is a session."""

    def wrap(f):
        made = []

        @wraps(f)
        def call(*columns):
            if not made:
                made.append(pandas_udf(f, ddl))
            return made[0](*columns)

        return call

    return wrap


def _squeezed(x: str) -> str:
    return " ".join(x.split())


@arrow_udf("string")
def normalize_label(labels: pd.Series) -> pd.Series:
    """NFKC, lower case, single spaces."""
    return labels.map(lambda x: None if x is None else _squeezed(unicodedata.normalize("NFKC", x).lower()))


def token_count(x: str) -> int:
    n = sum((len(t) + 3) // 4 if t[0].isascii() and (t[0].isalnum() or t[0] == "_") else 1 for t in _TOKEN.findall(x))
    return max(1, n) if x else 0


def _last_break(text: str, a: int, b: int, *kinds: re.Pattern) -> int | None:
    """End of the last place of the first kind that occurs between a and b."""
    for kind in kinds:
        last = None
        for last in kind.finditer(text, a, b):
            pass
        if last:
            return last.end()
    return None


def _pieces(text: str, size: int) -> list[tuple[int, int]]:
    """Paragraphs packed up to ``size``; a longer one is sliced at a break in its last two fifths."""
    spans, open_ = [], False
    gaps = [(0, 0), *((m.start(), m.end()) for m in re.finditer(r"\n\s*\n", text)), (len(text), len(text))]
    for (_, a), (b, _) in zip(gaps, gaps[1:]):
        if not text[a:b].strip():
            continue
        if b - a > size:
            while a < b:
                stop = min(a + size, b)
                if stop < len(text):
                    stop = _last_break(text, a + max(1, int(size * 0.6)), stop, _PARAGRAPH, _LINE, _SENTENCE, _SPACE) or stop
                spans.append((a, stop))
                a = stop
            open_ = False
        elif open_ and b - spans[-1][0] <= size:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
            open_ = True
    return spans


def _coalesced(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """A span next to one too short to stand alone joins it, up to a quarter over ``size``."""
    least, most = max(120, int(size * 0.35)), max(size, int(size * 1.25))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and min(b - a, out[-1][1] - out[-1][0]) < least and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _overlap_start(text: str, at: int) -> int:
    """Where a chunk that should begin at ``at`` begins: after the last break in the 400 before it."""
    if at <= 0:
        return 0
    found = _last_break(text, max(0, at - 400), at, _PARAGRAPH, _SENTENCE, _LINE, _SPACE)
    if found is not None:
        return found
    ahead = _SPACE.search(text, at, at + 240)  # no break: rather skip the rest of a long word
    return ahead.end() if ahead else at


def chunk(text: str | None, size: int = 1200, overlap: int = 150) -> list[dict]:
    """Chunks of about ``size`` characters; each but the first takes in about ``overlap`` before it."""
    if not text or not text.strip():
        return []
    size = max(1, size)
    overlap = max(0, min(overlap, size - 1))
    out = []
    for i, (a, b) in enumerate(_coalesced(_pieces(text, size), size)):
        begin = _overlap_start(text, a - overlap) if i and overlap else a
        out.append({"idx": i, "char_start": begin, "char_end": b, "text": text[begin:b], "token_estimate": token_count(text[begin:b])})
    return out


def chunk_udf(size: int = 1200, overlap: int = 150):
    """Arrow UDF that chunks a column of texts."""
    return arrow_udf(CHUNK)(lambda texts: texts.map(lambda x: chunk(x, size, overlap)))


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(doc_id, text) -> doc_id, idx, char_start, char_end, text, token_estimate."""
    return docs.select("doc_id", F.explode(chunk_udf(size, overlap)(F.col("text"))).alias("c")).select("doc_id", "c.*")


def evenly(n: int, most: int | None) -> list[int]:
    """Places of a sample of ``most`` spread over 0 to n - 1, both ends included; all without ``most``."""
    if most is None or n <= most:
        return list(range(n))
    if most == 1:
        return [n // 2]
    return sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def windows(label: str | None, text: str | None, reach: int = 320, most: int | None = None) -> list[tuple[int, int]]:
    """Merged spans of ``reach`` characters around a label's occurrences, in any of its forms.

    ``most`` takes an even sample of the occurrences; without it all count.
    """
    if not label or not text:
        return []
    forms = {label.strip(), label.rpartition(":")[2].strip(), label.replace("_", " ").strip()} - {""}
    found = sorted({m.start() for f in forms for m in re.finditer(re.escape(f), text, re.IGNORECASE)})
    hits = [found[i] for i in evenly(len(found), most)]
    out: list[tuple[int, int]] = []
    for h in hits:
        a, b = max(0, h - reach), min(len(text), h + len(label) + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@arrow_udf("array<struct<start:int,stop:int>>")
def _window_spans(labels: pd.Series, texts: pd.Series, most: pd.Series) -> pd.Series:
    found = (windows(l, t, most=None if pd.isna(n) else int(n)) for l, t, n in zip(labels, texts, most, strict=True))
    return pd.Series([[{"start": a, "stop": b} for a, b in spans] for spans in found])


def sampled_windows(label, text, most) -> Column:
    """As evidence_windows, around an even sample of a text's occurrences."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    shown = lambda w: F.struct(w["start"], w["stop"], F.substring(c(text), w["start"] + 1, w["stop"] - w["start"]).alias("text"))
    return F.transform(_window_spans(c(label), c(text), c(most)), shown)


def evidence_windows(label, text) -> Column:
    """Windows (start, stop, text) around a label's occurrences; tasks in Python tell places only."""
    return sampled_windows(label, text, F.lit(None).cast("int"))
