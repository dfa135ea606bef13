"""The pseudonym query against a plain Python version, on whole real texts."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from graphloom.llm import pii, queries

SF = "/root/testdata/sf0.01"
KEY = "demonstration key"


def digest(kind, turn, other):
    return hashlib.sha256(f"{KEY}|{kind}|{turn}|{other}".encode()).hexdigest()


def chars(value, kind):
    c = list(value)
    for turn in range(pii.ROUNDS):
        moves = turn % 2
        d = digest(kind, turn, "".join(c[1 - moves :: 2]))
        for i in range(moves, len(c), 2):
            by = int(d[i % 32 * 2 : i % 32 * 2 + 2], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                at = ord(c[i]) - ord(first)
                if 0 <= at < n:
                    c[i] = chr(ord(first) + (at + by) % n)
                    break
    return "".join(c)


def pair(a, b, m, n, kind):
    for turn in range(pii.ROUNDS):
        if turn % 2:
            a = (a + int(digest(kind, turn, b)[:7], 16)) % m
        else:
            b = (b + int(digest(kind, turn, a)[:7], 16)) % n
    return a, b


def luhn(digits, ahead):
    return sum(d if (i + ahead) % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


FIRST, NEAR_DAYS, BEFORE_DAYS = datetime.date(1900, 1, 1), 73_000, 693_595


def real(y, m, d):
    try:
        return datetime.date(int(y), int(m), int(d))
    except ValueError:
        return None


def new_day(day):
    n = (day - FIRST).days
    near = 0 <= n < NEAR_DAYS
    m, k = (250, 292) if near else (1331, 2689)
    at = n if near else n + BEFORE_DAYS if n < 0 else n - NEAR_DAYS + BEFORE_DAYS
    a, b = pair(at // k, at % k, m, k, "date")
    to = a * k + b
    return FIRST + datetime.timedelta(to if near else to - BEFORE_DAYS if to < BEFORE_DAYS else to - BEFORE_DAYS + NEAR_DAYS)


#: Forms of the kinds, written out anew; where a form stands inside a longer number it is none.
FORMS = {
    "email": r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    "phone": r"\+\d{1,3} ?\(\d{3}\) ?\d{3}-\d{4}(?!-?\d)",
    "cards": r"(?<!\d-)(?:\d{4}([- ])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3}(?![-./ ]?\d))?(?!-?\d)|\d{4}([- ])\d{6}\2\d{4,5}(?!-?\d))",
    "spaced": r"\+\d(?:[-. ()]{0,2}\d){7,14}(?![-./]?\d)",
    "ip": r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<!\d-)\d{4}-\d\d-\d\d(?!-?\d)|(?<!\d/)\d\d/\d\d/\d{4}(?!/?\d)|(?<!\d\.)\d\d\.\d\d\.\d{4}(?!\.?\d)",
    "ssn": r"(?<!\d-)\d{3}-\d\d-\d{4}(?!-?\d)",
    "national": r"(?<!\d[-.])(?:(?:1[-. ])?(?:\(\d{3}\)[-. ]?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![-.]?\d)|0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}(?!-?\d))",
    "run": r"\d+",
}
EVERY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in {**FORMS, "cards": FORMS["cards"].replace(r"\1", r"\4").replace(r"\2", r"\5")}.items()), re.ASCII)


def card(value):
    digits = re.sub("[- ]", "", value)
    own = value if 13 <= len(digits) <= 19 and luhn(digits, 0) % 10 == 0 else value[:19] if len(value) > 19 and luhn(re.sub("[- ]", "", value[:19]), 0) % 10 == 0 else None
    if own is None:
        return None, value
    body = chars(own[:-1], "card")
    return "card", body + str(-luhn(re.sub("[- ]", "", body), 1) % 10) + value[len(own) :]


def replaced(form, value):
    if form == "email":
        name, at, host = value.partition("@")
        return "email", chars(name, "email") + at + host
    if form == "phone":
        head, at, tail = value.partition("(")
        return "phone", head + chars(at + tail, "phone")
    if form in ("spaced", "national"):
        head = re.match(r"(?:\+\d{1,3}(?!\d)|\+|0|1(?=[-. ]))?", value)[0]
        return "phone", head + chars(value[len(head) :], "phone")
    if form == "ip":
        o = value.split(".")
        if all(int(x) < 256 and str(int(x)) == x for x in o):
            hi, lo = pair(int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), 65536, 65536, "ip")
            return "ip", f"{hi // 256}.{hi % 256}.{lo // 256}.{lo % 256}"
    elif form == "date":
        day = real(*value.split("-")) if "-" in value else real(value[6:], value[3:5], value[:2])
        if day:
            new = new_day(day)
            y, m, d = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
            return "date", f"{y}-{m}-{d}" if "-" in value else f"{d}{value[2]}{m}{value[2]}{y}"
        if "-" not in value and real(value[6:], value[:2], value[3:5]):
            raise NotImplementedError("month-first dates are tested by their properties")
    elif form == "ssn" and not re.search("^(?:000|666|9..)|-00-|-0000$", value):
        area, group, serial = map(int, value.split("-"))
        a, b = pair(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return "ssn", f"{a + (2 if a >= 665 else 1):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    elif form == "cards" or (form == "run" and 13 <= len(value) <= 19):
        return card(value)
    return None, value


def brute(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def one(m):
        kind, new = replaced(m.lastgroup, m[0])
        if kind:
            counts[kind] += 1
        return new

    return EVERY.sub(one, text), counts


def test_query_on_real_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_pii_pseudonyms(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text, counts = brute(texts[r.doc_id])
        assert r.text == text and {k: r[f"n_{k}"] for k in pii.KINDS} == counts
    assert sum(r.text != texts[r.doc_id] for r in got) > 20


def test_made_up_texts(spark):
    texts = [
        "on 2001-09-09 and 09.09.2001 or 09/09/2001, not 31.02.2001 nor 2201-01-01", "a.b+c@d-e.co.uk, X9@y.z0; 255.255.255.255 1.2.3.4.5 01.2.3.4", "+49 (123) 456-7890 +1(123)456-7890 123-45-6789 900-12-3456",
        "4111111111111111 378282246310005 6011000990139424 4111-1111-1111-1111 41111111111111110", "é" * 50 + "4111111111111111" + "😀" * 3 + "x@y.zz",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(docs, KEY).select("doc_id", "text", F.to_json("pii").alias("pii")).collect()}
    for i, t in enumerate(texts):
        assert got[i].text == brute(t)[0]
