"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings.

Base kinds are regular expressions. Entropy spans come from candidate strings (runs of
characters that keys are written in): a window slides over the candidate, and the counts of its
characters are updated by the one that enters and the one that leaves, so that the entropy
log2(w) - sum(c log2 c) / w costs the same for any width. The candidate's character class (hex,
letters and digits, or base64) sets the bits at which a window is hot; the span runs from the
first to the last hot window. Candidates that the allow-list knows (letters only, digits only,
UUIDs, placeholders) and those that touch a base span are suppressed as a whole. With ``pieces``
what is left of them, cut at base spans and at =, is tested piece by piece as the kind ``piece``, and a
placeholder's word suppresses only the piece that holds it (lower-case path words before and after
a key are not part of its piece). Pieces within an entropy span are not told again.

All of it is column expressions inside one scan: no shuffle, no Python. Texts without any sign
of a candidate skip the costly part.

Defined results: a null text counts as empty and has no spans; rows are kept as they are,
repeats and null ids included; offsets are code points, end exclusive; other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound, free_name, text_or_empty

#: Fixed patterns of the base kinds, in their order.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_SIGN = r"[Aa][Ss][Ss][Ww]|[Ee][Cc][Rr][Ee][Tt]|[Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy", "piece")
#: Candidates of the entropy scan, and what the allow-list suppresses.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
CANDIDATE_SIGN = r"[0-9A-Za-z+/_=-]{20}"
ALLOWED = (
    r"^[A-Za-z_=/-]+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Xx]{6}|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]",
)
#: What may hold a piece: a placeholder's word, or a key after a name.
WORD = ALLOWED[-1]
NAMED_SIGN = r"=[0-9A-Za-z+/_-]{20}"
#: Path words around a key.
BEFORE, AFTER = r"^(?:[a-z]+[/-])+", r"(?:[/-][a-z]+)+$"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Bits at which a window of WINDOW characters is hot, by character class.
HOT_BITS = {"hex": 3.05, "alnum": 3.55, "base64": 3.75}


#: Numbers that a running sum takes one by one; sums of so many are added up first.
RUN = 32


def running_sums(numbers: Column) -> Column:
    """Sums of all numbers before each one.

    Appending to an array copies it, so sums run over blocks of RUN first and then inside each.
    """
    ints = F.array().cast("array<int>")
    begin = lambda at: F.struct(at.alias("at"), ints.alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    run = lambda xs, at: F.aggregate(xs, begin(at), step, lambda acc: acc["out"])

    def of(ns: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(ns) - 1) / RUN).cast("int"), F.lit(0)))
        part = lambda b: F.slice(ns, b * RUN + 1, RUN)
        sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda acc, x: acc + x))
        return bound(run(sums, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b: run(part(b), F.get(starts, b)))))

    return bound(numbers, of)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, kind_no, stop, body>> of leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    no = KINDS.index(kind)

    def of(g: Column) -> Column:
        # a gap and the match after it, by turns: a match starts where the gaps and matches before it end
        lengths = F.transform(g["found"], lambda body, i: F.length(F.get(g["gaps"], i)) + F.length(body))

        def placed(stops: Column) -> Column:
            one = lambda body, i: F.struct((F.get(stops, i) + F.length(F.get(g["gaps"], i))).alias("start"), body.alias("body"))
            spans = F.transform(g["found"], one)
            spans = spans if keep is None else F.filter(spans, lambda s: keep(s["body"]))
            return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), (s["start"] + F.length(s["body"])).alias("stop"), s["body"].alias("body")))

        return bound(running_sums(lengths), placed)

    return bound(F.struct(found.alias("found"), gaps.alias("gaps")), of)


_NO_SPANS = "array<struct<start:int,kind_no:int,stop:int,body:string>>"


def _when(sign: Column, spans: Column) -> Column:
    return F.when(sign, spans).otherwise(F.array().cast(_NO_SPANS))


def hot_range(candidate: Column, window: int = WINDOW) -> Column:
    """struct<first, last>: offsets of the first and last hot window of a candidate, or nulls.

    One pass: each step adds the character that enters, takes out the one that leaves, and
    corrects sum(c log2 c) by the two counts that changed.
    """
    chars = F.split(candidate, "")
    clogc = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    bits = (
        F.when(candidate.rlike("^[0-9a-f]+$") | candidate.rlike("^[0-9A-F]+$"), F.lit(HOT_BITS["hex"]))
        .when(candidate.rlike("^[0-9A-Za-z]+$"), F.lit(HOT_BITS["alnum"]))
        .otherwise(F.lit(HOT_BITS["base64"]))
    )
    codes = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)))
    given = F.struct(codes.alias("codes"), bits.alias("bits"))
    start = lambda g: F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def run(g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            enters, leaves = F.get(g["codes"], i), F.when(i >= window, F.get(g["codes"], i - window)).otherwise(F.lit(0))
            n_out = F.get(acc["counts"], leaves - 1)
            less = F.when(leaves > 0, F.get(clogc, n_out) - F.get(clogc, n_out - 1)).otherwise(F.lit(0.0))
            n_in = F.get(acc["counts"], enters - 1) - F.when(leaves == enters, 1).otherwise(0)
            total = acc["sum"] - less + F.get(clogc, n_in + 1) - F.get(clogc, n_in)
            counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == enters - 1, 1).otherwise(0) - F.when(j == leaves - 1, 1).otherwise(0))
            hot = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= g["bits"])
            at = (i - (window - 1)).cast("int")
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(hot & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"),
                F.when(hot, at).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(g["codes"]) - 1), start(g), step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return F.get(F.transform(F.array(given), run), F.lit(0))


def _allowed(body: Column) -> Column:
    return F.array_contains(F.array(*[body.rlike(p) for p in ALLOWED]), True)


def _hot(tried: Column, kind: str) -> Column:
    """Spans from the first to the last hot window of each candidate that has one."""
    ranged = F.transform(tried, lambda s: F.struct(s["start"].alias("start"), s["body"].alias("body"), hot_range(s["body"]).alias("hot")))
    hot = F.filter(ranged, lambda s: s["hot"]["first"].isNotNull())
    return F.transform(
        hot,
        lambda s: F.struct(
            (s["start"] + s["hot"]["first"]).alias("start"),
            F.lit(KINDS.index(kind)).alias("kind_no"),
            (s["start"] + s["hot"]["last"] + WINDOW).alias("stop"),
            F.substring(s["body"], s["hot"]["first"] + 1, s["hot"]["last"] - s["hot"]["first"] + WINDOW).alias("body"),
        ),
    )


def _entropy(text: Column, base: Column) -> Column:
    tried = F.filter(
        _spans(text, CANDIDATE, "entropy", keep=lambda body: ~_allowed(body)),
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    return _hot(tried, "entropy")


def _pieces(text: Column, base: Column, told: Column) -> Column:
    """Hot spans of what candidates hold besides base spans, names and placeholders."""
    ordered = F.array_sort(base)

    def free(s: Column) -> Column:  # the parts of a candidate between base spans
        inside = F.filter(ordered, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        zero = F.struct(s["start"].alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        part = lambda a, z: F.array(F.struct(a.alias("start"), z.alias("stop")))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))
        return F.aggregate(inside, zero, step, lambda acc: F.concat(acc["out"], part(acc["at"], s["stop"])))

    parts = F.filter(F.flatten(F.transform(_spans(text, CANDIDATE, "entropy"), free)), lambda g: g["stop"] - g["start"] >= WINDOW)

    def cut(g: Column) -> Column:
        runs = _spans(F.substring(text, g["start"] + 1, g["stop"] - g["start"]), f"[^=]{{{WINDOW},}}", "piece")
        return F.transform(runs, lambda r: F.struct((g["start"] + r["start"]).alias("start"), r["body"].alias("body")))

    def bare(r: Column) -> Column:
        body = F.regexp_replace(r["body"], BEFORE, "")
        return F.when(
            r["body"].rlike(WORD), F.struct((r["start"] + F.length(r["body"]) - F.length(body)).alias("start"), F.regexp_replace(body, AFTER, "").alias("body"))
        ).otherwise(r)

    tried = F.filter(F.transform(F.flatten(F.transform(parts, cut)), bare), lambda r: (F.length(r["body"]) >= WINDOW) & ~_allowed(r["body"]))
    return F.filter(_hot(tried, "piece"), lambda s: ~F.exists(told, lambda e: (e["start"] <= s["start"]) & (s["stop"] <= e["stop"])))


def find_secrets(docs: DataFrame, text_col: str = "text", into: str = "secrets", pieces: bool = False) -> DataFrame:
    """Adds ``into``: array<struct<start, kind_no, stop, body>>, ordered by start, then kind.

    ``kind_no`` indexes KINDS. A column named ``into`` is replaced; no other column is touched.
    """
    text = text_or_empty(text_col)
    assign = _when(
        text.rlike(ASSIGN_SIGN), _spans(text, ASSIGN, "assign", keep=lambda body: F.length(F.regexp_extract(body, ASSIGN, 2)) >= 6)
    )
    access = _when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access"))
    hexes = _when(text.rlike(HEX), _spans(text, HEX, "hex"))
    own = {n: free_name(docs, n) for n in ("_base", "_more", "_rest")}
    base, more, rest = (F.col(c) for c in own.values())
    found = docs.withColumn(own["_base"], F.concat(assign, access, hexes))
    found = found.withColumn(own["_more"], _when(text.rlike(CANDIDATE_SIGN), _entropy(text, base)))
    sign = F.lit(pieces) & text.rlike(CANDIDATE_SIGN) & ((F.size(base) > 0) | text.rlike(WORD) | text.rlike(NAMED_SIGN))
    found = found.withColumn(own["_rest"], _when(sign, _pieces(text, base, more)))
    return found.withColumn(into, F.array_sort(F.concat(base, more, rest))).drop(*own.values())


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", pieces: bool = False) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; null texts stay null.

    Overlapping spans (an assignment whose value is hex) are replaced once, as a whole.
    """
    columns, into = docs.columns, free_name(docs, "_secrets")
    found = find_secrets(docs, text_col, into, pieces)
    text = text_or_empty(text_col)

    def step(acc: Column, s: Column) -> Column:
        stop = F.greatest(acc["at"], s["stop"])
        more = F.when(
            s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        ).otherwise(acc["out"])
        return F.struct(stop.alias("at"), more.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        F.col(into), zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")
    )
    return found.withColumn(text_col, F.when(F.size(into) > 0, clean).otherwise(F.col(text_col))).select(*columns)
