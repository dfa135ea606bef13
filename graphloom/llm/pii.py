"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

One regular expression finds candidates; a candidate is validated (Luhn sum, octets below 256,
days that exist, social security numbers that can be given) and replaced by a keyed permutation of
itself within its format: digits stay digits, letters stay letters of their case, a card's
pseudonym passes the Luhn check again, a date stays a real date in its notation. The permutation is
a keyed Feistel network: the value is dealt into two halves, and in each round one half is shifted
by a SHA-256 of key, kind, round and the other half. Equal values get equal pseudonyms in every
document, no two values of a format share one, and a pseudonym is itself a valid value, so that no
candidate that was left alone looks like one: records stay linked.

Candidates are whole: digits that are part of a longer number (123-45-67890, 1.2.3.2557) are not
rewritten. Cards and phone numbers are found in groups too, and characters that separate digits
stay in place. A date is read month-first only where it is no day-first one, and such dates are
permuted among themselves. Dates of 1900 to November 2099 stay there; the other days of the years
1 to 9999 are permuted among each other.

All of it is column expressions inside one scan: no shuffle, no Python, nothing shared between
rows. Texts without digit or @ are passed through unread. The key is a value of a one-row table
and no literal, so plans and event logs do not show it.

Defined results: a null text stays null, an empty one empty; candidates that fail validation stay
as they are; rows are kept as they are, repeats and null ids included; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound, free_name

ROUNDS = 6
KINDS = ("email", "phone", "ip", "date", "ssn", "card")
#: Candidates; earlier alternatives win. The last takes whole digit runs, so no other starts inside one.
EMAIL = r"[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
PHONE = r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?!-?[0-9])"
IP = r"(?<![0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
ISO_DATE = r"(?<![0-9]-)[0-9]{4}-[0-9]{2}-[0-9]{2}(?!-?[0-9])"
DATE = ISO_DATE + r"|(?<![0-9]/)[0-9]{2}/[0-9]{2}/[0-9]{4}(?!/?[0-9])|(?<![0-9]\.)[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?[0-9])"
SSN = r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])"
#: A card's separator is the same throughout; 4-4-4-4 may be followed by a group of a longer card or by another number.
GROUPED = r"(?<![0-9]-)(?:[0-9]{4}([- ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3}(?![-./ ]?[0-9]))?(?!-?[0-9])|[0-9]{4}([- ])[0-9]{6}\2[0-9]{4,5}(?!-?[0-9]))"
SPACED = r"\+[0-9](?:[-. ()]{0,2}[0-9]){7,14}(?![-./]?[0-9])"
NATIONAL = r"(?<![0-9][-.])(?:(?:1[-. ])?(?:\([0-9]{3}\)[-. ]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![-.]?[0-9])|0[0-9]{1,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}(?!-?[0-9]))"
CANDIDATE = "|".join((EMAIL, PHONE, GROUPED, SPACED, IP, DATE, SSN, NATIONAL, "[0-9]+"))
#: Days from FIRST_DAY on that are permuted among themselves, as ROWS * COLUMNS; the BEFORE days of
#: the years before it and those after them make up FAR_ROWS * FAR_COLUMNS others.
FIRST_DAY, ROWS, COLUMNS = "1900-01-01", 250, 292
BEFORE, FAR_ROWS, FAR_COLUMNS = 693_595, 1331, 2689
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Key = Column | str


def _hash(key: Key, kind: str, turn: int, other: Column) -> Column:
    """64 hex digits of the keyed round function."""
    return F.sha2(F.concat(key if isinstance(key, Column) else F.lit(key), F.lit(f"|{kind}|{turn}|"), other), 256)


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hex digest, counted round."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shift_char(c: Column, by: Column) -> Column:
    code = F.ascii(c)
    turned = lambda first, n: F.char(F.pmod(code - first + by, F.lit(n)) + first)
    return (
        F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)
    )


def _half(chars: Column, odd: int) -> Column:
    return F.filter(chars, lambda c, i: i % 2 == odd)


def feistel_chars(value: Column, key: Key, kind: str) -> Column:
    """Permutes the letters and digits of a string; other characters stay in place.

    Places of even and odd index are the halves; a place's class never changes, so strings of one
    format are permuted among themselves.
    """

    def turned(turn: int):
        moves = turn % 2

        def shift(y: Column) -> Column:  # the digest is bound here, not computed at each place
            return F.struct(F.transform(y["chars"], lambda c, i: F.when(i % 2 == moves, _shift_char(c, _byte(y["digest"], i))).otherwise(c)).alias("chars"))

        def one(x: Column) -> Column:
            digest = _hash(key, kind, turn, F.array_join(_half(x["chars"], 1 - moves), ""))
            return F.get(F.transform(F.array(F.struct(x["chars"].alias("chars"), digest.alias("digest"))), shift), F.lit(0))

        return one

    box = F.array(F.struct(F.split(value, "").alias("chars")))
    for turn in range(ROUNDS):
        box = F.transform(box, turned(turn))
    return F.array_join(F.get(box, F.lit(0))["chars"], "")


def feistel_pair(a: Column, b: Column, m: int | Column, n: int | Column, key: Key, kind: str, use) -> Column:
    """``use(p, q)`` of the permuted pair: 0 <= a < m and 0 <= b < n go to such a pair by rounds of
    modular addition to each in turn."""

    def add(x: Column, y: Column, size: Column, turn: int) -> Column:
        return F.pmod(x + F.conv(F.substring(_hash(key, kind, turn, y.cast("string")), 1, 7), 16, 10).cast("int"), size)

    def turned(turn: int):
        if turn % 2:
            return lambda x: F.struct(add(x["a"], x["b"], x["m"], turn).alias("a"), x["b"], x["m"], x["n"])
        return lambda x: F.struct(x["a"], add(x["b"], x["a"], x["n"], turn).alias("b"), x["m"], x["n"])

    whole = lambda x, name: (x if isinstance(x, Column) else F.lit(x)).cast("int").alias(name)
    box = F.array(F.struct(whole(a, "a"), whole(b, "b"), whole(m, "m"), whole(n, "n")))
    for turn in range(ROUNDS):
        box = F.transform(box, turned(turn))
    return bound(F.get(box, F.lit(0)), lambda x: use(x["a"], x["b"]))


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum; ``double_last`` where the check digit is still to come."""
    n = F.length(digits)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - 1 - i) % 2 == (0 if double_last else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda acc, x: acc + x)


def _real(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def _day(value: Column) -> Column:
    """Days since FIRST_DAY of a date that is not month-first; null if there is no such day."""
    part = lambda i, n: F.substring(value, i, n).cast("int")
    iso = F.substring(value, 5, 1) == "-"
    year = F.when(iso, part(1, 4)).otherwise(part(7, 4))
    month = F.when(iso, part(6, 2)).otherwise(part(4, 2))
    day = F.when(iso, part(9, 2)).otherwise(part(1, 2))
    return F.when(year > 0, F.datediff(_real(year, month, day), F.to_date(F.lit(FIRST_DAY))))


def _permuted_day(value: Column, day: Column, key: Key) -> Column:
    """A date whose ``_day`` is ``day``, permuted."""
    near, far = ROWS * COLUMNS, FAR_ROWS * FAR_COLUMNS
    inside = day.between(0, near - 1)

    def places(g: Column) -> Column:
        back = lambda a, b: bound(a * g["columns"] + b, date)
        return feistel_pair(F.floor(g["at"] / g["columns"]), g["at"] % g["columns"], g["rows"], g["columns"], key, "date", back)

    def date(to: Column) -> Column:
        days = F.when(inside, to).when(to < BEFORE, to - BEFORE).otherwise(to - BEFORE + near)
        return bound(F.date_format(F.date_add(F.to_date(F.lit(FIRST_DAY)), days.cast("int")), "yyyy-MM-dd"), written)

    def written(iso: Column) -> Column:
        mark = F.substring(value, 3, 1)
        turned = F.concat(F.substring(iso, 9, 2), mark, F.substring(iso, 6, 2), mark, F.substring(iso, 1, 4))
        return F.when(F.substring(value, 5, 1) == "-", iso).otherwise(turned)

    at = F.when(inside, day).when(day < 0, day + BEFORE).otherwise(day - near + BEFORE)
    size = lambda a, b, name: F.when(inside, a).otherwise(b).alias(name)
    return bound(F.struct(at.alias("at"), size(ROWS, FAR_ROWS, "rows"), size(COLUMNS, FAR_COLUMNS, "columns")), places)


def _month_first(value: Column) -> Column:
    """struct<year, month, day> of a date whose second number is a day that is no month; or null."""
    month, day, year = (F.substring(value, i, n).cast("int") for i, n in ((1, 2), (4, 2), (7, 4)))
    one = ~value.contains("-") & (day > 12) & (year > 0) & _real(year, month, day).isNotNull()
    return F.when(one, F.struct(year.alias("year"), month.alias("month"), day.alias("day")))


#: Months of 31 days, and the years that month-first dates keep to.
LONG, NEAR = (1, 3, 5, 7, 8, 10, 12), (1900, 2099)


def _permuted_month_first(value: Column, parts: Column, key: Key) -> Column:
    """Days up to the 28th change places with all such days of their years; later ones keep the day,
    and the 29th of February the month, so that only days that exist come out. Years of NEAR change
    among themselves, and so do the others."""
    year, month, day = parts["year"], parts["month"], parts["day"]
    near, leap, width = year.between(*NEAR), (day == 29) & (month == 2), NEAR[1] - NEAR[0] + 1
    ys = [y for y in range(1, 10_000) if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)]
    sides = [y for y in ys if NEAR[0] <= y <= NEAR[1]], [y for y in ys if not NEAR[0] <= y <= NEAR[1]]
    leaps = [F.split(F.lit(",".join(map(str, side))), ",").cast("array<int>") for side in sides]  # literals once planned
    longs = F.array(*map(F.lit, LONG))
    pick = lambda low, feb, most, other: F.when(day <= 28, low).when(leap, feb).when(day == 31, most).otherwise(other)

    def places(g: Column) -> Column:
        y, years = g["y"], g["years"]
        leap_at = F.when(near, F.array_position(leaps[0], year)).otherwise(F.array_position(leaps[1], year)) - 1
        a = pick(y * 12 + month - 1, leap_at, y, y)
        b = pick(day - 13, F.lit(0), F.array_position(longs, month) - 1, F.when(month == 1, 0).otherwise(month - 2))
        rows = pick(years * 12, F.when(near, len(sides[0])).otherwise(len(sides[1])), years, years)
        return feistel_pair(a, b, rows, pick(F.lit(16), F.lit(1), F.lit(7), F.lit(11)), key, "month-first date", written)

    def written(p: Column, q: Column) -> Column:
        to = F.when(day <= 28, F.floor(p / 12)).otherwise(p)
        plain = F.when(near, to + NEAR[0]).when(to < NEAR[0] - 1, to + 1).otherwise(to + 1 + width)
        new_year = F.when(leap, F.when(near, F.get(leaps[0], p)).otherwise(F.get(leaps[1], p))).otherwise(plain)
        new_month = pick(p % 12 + 1, F.lit(2), F.get(longs, q), F.when(q == 0, 1).otherwise(q + 2))
        new_day = F.when(day <= 28, q + 13).otherwise(day)
        padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat(padded(new_month, 2), F.substring(value, 3, 1), padded(new_day, 2), F.substring(value, 6, 1), padded(new_year, 4))

    y = F.when(near, year - NEAR[0]).when(year < NEAR[0], year - 1).otherwise(year - 1 - width)
    return bound(F.struct(y.alias("y"), F.when(near, width).otherwise(9999 - width).alias("years")), places)


def _permuted_date(value: Column, key: Key) -> Column:
    by_month = lambda parts: _permuted_month_first(value, parts, key)
    return bound(_day(value), lambda day: F.when(day.isNotNull(), _permuted_day(value, day, key)).otherwise(bound(_month_first(value), by_month)))


def _permuted_ssn(value: Column, key: Key) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999: what validation lets pass."""
    area, group, serial = (F.substring(value, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    padded = lambda x, n: F.lpad(x.cast("int").cast("string"), n, "0")
    written = lambda a, b: F.concat_ws("-", padded(a + F.when(a >= 665, 2).otherwise(1), 3), padded(F.floor(b / 9999) + 1, 2), padded(b % 9999 + 1, 4))
    return feistel_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn", written)


def _permuted_ip(value: Column, key: Key) -> Column:
    written = lambda a, b: F.concat_ws(".", F.floor(a / 256), a % 256, F.floor(b / 256), b % 256)

    def of(octets: Column) -> Column:
        o = [F.get(octets, F.lit(i)).cast("int") for i in range(4)]
        return feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip", written)

    return bound(F.split(value, r"\."), of)


def _permuted_card(value: Column, key: Key) -> Column:
    def of(own: Column) -> Column:
        checked = lambda b: F.concat(b, F.pmod(-luhn_sum(_digits(b), True), F.lit(10)).cast("string"), F.substring(value, F.length(own) + 1, F.length(value)))
        return bound(feistel_chars(F.substring(own, F.lit(1), F.length(own) - 1), key, "card"), checked)

    return bound(F.coalesce(_card_of(value), value), of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[- ]", "")


def _card_of(value: Column) -> Column:
    """The card at the start of a group of digits: the whole, or its first 4-4-4-4; or null."""
    first = F.substring(value, 1, 19)
    valid = lambda v: luhn_sum(_digits(v), False) % 10 == 0
    return F.when(F.length(_digits(value)).between(13, 19) & valid(value), value).when((F.length(value) > 19) & valid(first), first)


def kind_of(value: Column) -> Column:
    """The kind of a candidate that passes validation; null otherwise."""
    octets = F.split(value, r"\.")
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), F.lit("email"))
        .when(whole(PHONE), F.lit("phone"))
        .when(whole(IP), F.when(F.forall(octets, lambda o: (o.cast("int") < 256) & (o.cast("int").cast("string") == o)), F.lit("ip")))
        .when(whole(DATE), F.when(_day(value).isNotNull() | _month_first(value).isNotNull(), F.lit("date")))
        .when(whole(SSN), F.when(~value.rlike("^(?:000|666|9..)|-00-|-0000$"), F.lit("ssn")))
        .when(whole("[0-9]{13,19}"), F.when(luhn_sum(value, False) % 10 == 0, F.lit("card")))
        .when(whole(GROUPED), F.when(_card_of(value).isNotNull(), F.lit("card")))
        .when(whole(f"{SPACED}|{NATIONAL}"), F.lit("phone"))
    )


def pseudonym(value: Column, kind: Column, key: Key) -> Column:
    """The pseudonym of a valid value."""
    at = F.instr(value, "@")
    email = F.concat(feistel_chars(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))
    # what says which network is asked stays: the country code, + or a leading 0 or 1
    head = F.when(value.rlike(f"^(?:{PHONE})$"), F.instr(value, "(") - 1).otherwise(F.length(F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?![0-9])|\+|0|1(?=[-. ]))?", 0)))
    phone = F.concat(F.substring(value, F.lit(1), head), feistel_chars(F.substring(value, head + 1, F.length(value)), key, "phone"))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", _permuted_ip(value, key)).when(kind == "date", _permuted_date(value, key))
        .when(kind == "ssn", _permuted_ssn(value, key)).when(kind == "card", _permuted_card(value, key)).otherwise(value)
    )


def _count(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda x: x == kind))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymized and ``into`` added: map of kind to number of values.

    A column named ``into`` is replaced.
    """
    columns = [c for c in docs.columns if c != into]
    found, typed, new, secret = (free_name(docs, f"_{n}") for n in ("found", "typed", "new", "key"))
    text = F.col(text_col).cast("string")
    key_row = docs.sparkSession.createDataFrame([(key,)], "key string")
    sign = text.rlike("[0-9@]")
    held = docs.withColumn(secret, key_row.scalar())
    held = held.withColumn(found, F.when(sign, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    held = held.withColumn(typed, F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))))
    kinds = F.transform(F.filter(typed, lambda t: t["kind"].isNotNull()), lambda t: t["kind"])
    gaps = F.split(text, CANDIDATE, -1)
    rebuilt = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(F.col(new), i), F.lit(""))))), "")
    return held.withColumn(new, F.transform(typed, lambda t: pseudonym(t["value"], t["kind"], F.col(secret)))).select(
        *[F.when(F.size(kinds) > 0, rebuilt).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in columns],
        F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[_count(kinds, k).cast("long") for k in KINDS])).alias(into),
    )
