"""Format-preserving pseudonyms for personal data; DataFrame functions only.

A value that passes its validity check is mapped to a number (an e-mail address's local part
to its two halves), permuted by a keyed Feistel network over exactly the values that
are valid in its format, and written back with the separators it had.  The map depends on the key and the value alone:
equal values stay equal in every document, different values stay different.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.shared import documents, free_names

KEY = "example key, replace in production"
ROUNDS = 8

#: Formats in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d])(?!\.\d)"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d]|-\d)"
YEAR_DATE = r"(?<![\d/])\d{4}/\d{2}/\d{2}(?![\d]|/\d)"
DAY_DATE = r"(?<![\d./])\d{2}([./])\d{2}\1\d{4}(?![\d]|[./]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
#: A run of digit groups that may hold cards; if it can, it ends before a group that something else goes on with.
_RUN = r"(?<!\d)\d(?=(?:[ -]?\d){12})[\d -]*(?<=\d)(?!\d)"
CARD = rf"(?:{_RUN}(?![\w@%+]|[./-]\w)|{_RUN})"
PHONE = r"(?<![\d])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d])"
#: Numbers with a country code: after 00 only with a separator, without separators only after a plus sign.
ABROAD = r"(?<![\w+])(?:\+[1-9]\d{7,14}|(?:\+[1-9]\d{0,2}[ .-]?|00[1-9]\d{0,2}[ .-])(?:\(\d{1,5}\)[ .-]?)?\d{1,12}(?:[ .-]\d{2,8}){0,4})(?![\d])"

_ANY = "|".join(p.replace(r"([./])", r"(?<sep>[./])").replace(r"\1", r"\k<sep>") for p in (EMAIL, IPV4, ISO_DATE, YEAR_DATE, DAY_DATE, SSN, PHONE, ABROAD, CARD))
_OTHERS = _ANY.removesuffix("|" + CARD)
#: The first digits of country codes of one and two digits; all others have three.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Dates from 1900-01-01 up to and without 2100-01-01 are 17 * 4297 days.
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def feistel(a: Column, b: Column, na: Column | int, nb: Column | int, key: str, tweak: str | Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of pairs (a, b), 0 <= a < na, 0 <= b < nb, as struct(a, b).

    Even rounds add a keyed hash of b to a modulo na, odd rounds the reverse; each
    round can be undone, so the whole is a bijection for any na and nb up to 10**15.
    """
    na = F.lit(na).cast("long") if isinstance(na, int) else na.cast("long")
    nb = F.lit(nb).cast("long") if isinstance(nb, int) else nb.cast("long")
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def mixed(i: Column, half: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, na.cast("string"), nb.cast("string"), i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + mixed(i, s["b"]) % na) % na).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + mixed(i, s["a"]) % nb) % nb).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _number(digits: Column, start, length) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.coalesce(F.substring(digits, start, length).try_cast("long"), F.lit(0))


def _padded(n: Column, width: int | Column) -> Column:
    w = F.lit(width) if isinstance(width, int) else width
    return F.right(F.concat(F.lit("0" * 20), n.cast("string")), w)


def _refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced one by one."""
    chars = F.split(pattern, "")
    placed = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return placed["out"]


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10, the last digit counting once."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = _number(digits, i, 1)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0).cast("long"), lambda s, x: s + x)
    return total % 10


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is set so that the Luhn check holds."""

    def change(d: Column) -> Column:
        n = F.length(d) - 1
        left = F.floor(n / 2).cast("int")
        right = n - left
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        moved = feistel(_number(d, 1, left), _number(d, left + 1, right), power(left), power(right), key, "card")
        body = _let(moved, lambda m: F.concat(_padded(m["a"], left), _padded(m["b"], right)))
        whole = _let(body, lambda x: F.concat(x, ((F.lit(10) - _luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return _refill(value, whole)

    return _let(_digits(value), change)


def _cards(value: Column, key: str) -> Column:
    """A run of digit groups with its cards permuted and what is between them treated as text without cards.

    At each group, from the left, the longest run of whole groups with 13 to 19 digits
    that passes the Luhn check is a card.
    """

    def change(parts: Column) -> Column:
        def at(i: Column) -> Column:
            ends = F.sequence(i, F.least(F.size(parts), i + 18))
            whole = F.transform(ends, lambda j: F.array_join(F.slice(parts, i, j - i + 1), ""))
            fits = F.filter(whole, lambda x: F.trim(x).rlike(r"^\d(?:[ -]?\d){12,18}[ -]*$"))
            return F.filter(F.transform(fits, lambda x: F.regexp_replace(x, r"[ -]+$", "")), lambda x: _luhn(_digits(x)) == 0)

        def step(s: Column, i: Column) -> Column:
            card = F.element_at(at(i), -1)
            n = F.size(F.regexp_extract_all(card, F.lit(r"(\d+)"), F.lit(1)))
            tail = F.regexp_extract(parts[i + n - 2], r"\D*$", 0)
            return F.when(i < s["next"], s).otherwise(
                F.when(F.size(at(i)) > 0, F.struct(
                    F.concat(s["out"], F.array(F.struct(card.alias("x"), F.lit(True).alias("card")), F.struct(tail.alias("x"), F.lit(False).alias("card")))).alias("out"),
                    (i + n).alias("next"),
                )).otherwise(F.struct(F.concat(s["out"], F.array(F.struct(parts[i - 1].alias("x"), F.lit(False).alias("card")))).alias("out"), (i + 1).alias("next")))
            )

        start = F.struct(F.expr("cast(array() as array<struct<x: string, card: boolean>>)").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), F.size(parts)), start, step)["out"]

    def joined(found: Column) -> Column:
        # neighbouring gaps as one text, so that formats of several groups stay whole
        mark = F.array_join(F.transform(found, lambda f: F.when(f["card"], F.lit("\x01")).otherwise(f["x"])), "")
        gaps = F.transform(F.split(mark, "\x01", -1), lambda g: _plain(g, key))
        cards = F.transform(F.filter(found, lambda f: f["card"]), lambda f: _card(f["x"], key))
        return F.array_join(F.zip_with(gaps, cards, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

    return _let(_let(F.regexp_extract_all(value, F.lit(r"(\d+[ -]*)"), F.lit(1)), change), joined)


def _plain(text: Column, key: str) -> Column:
    """``text`` with its values of every format but cards replaced."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({_OTHERS})"), F.lit(0)), lambda v: _other(v, key).otherwise(v))
    return F.array_join(F.zip_with(F.split(text, _OTHERS, -1), found, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def _phone(value: Column, key: str) -> Column:
    """Area code, exchange and line, permuted inside one of three classes that make up all ten-digit numbers.

    Area codes and exchanges that don't start with 0 or 1 stay so; numbers with an
    area code below 200, and others with an exchange below 200, stay among themselves.
    """

    def change(d: Column) -> Column:
        at = F.length(d) - 10
        area, office, line = _number(d, at + 1, 3), _number(d, at + 4, 3), _number(d, at + 7, 4)
        low_area, low_office = area < 200, office < 200
        first = F.when(low_area, 0).otherwise(200)
        second = F.when(low_area | low_office, 0).otherwise(200)
        areas = F.when(low_area, 200).otherwise(800)
        offices = F.when(low_area, 1000).when(low_office, 200).otherwise(800)
        moved = feistel(area - first, (office - second) * 10_000 + line, areas, offices * 10_000, key, "phone")
        new = _let(moved, lambda m: F.concat(_padded(m["a"] + first, 3), _padded(m["b"] + second * 10_000, 7)))
        return _refill(value, F.concat(F.substring(d, F.lit(1), at), new))

    return _let(_digits(value), change)


def _ssn(value: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""

    def change(d: Column) -> Column:
        area, group, serial = _number(d, 1, 3), _number(d, 4, 2), _number(d, 6, 4)
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        rank = area - F.when(area > 666, 2).otherwise(1)
        moved = feistel(rank, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

        def write(m: Column) -> Column:
            new_area = m["a"] + F.when(m["a"] >= 665, 2).otherwise(1)
            return F.concat(_padded(new_area, 3), _padded(F.floor(m["b"] / 9999) + 1, 2), _padded(m["b"] % 9999 + 1, 4))

        return F.when(valid, _refill(value, _let(moved, write))).otherwise(value)

    return _let(_digits(value), change)


def _ipv4(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")

    def change(p: Column) -> Column:
        n = [p[i].cast("long") for i in range(4)]
        valid = (n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256)
        moved = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, key, "ipv4")

        def write(m: Column) -> Column:
            octets = [F.floor(m["a"] / 256), m["a"] % 256, F.floor(m["b"] / 256), m["b"] % 256]
            return F.concat_ws(".", *[o.cast("string") for o in octets])

        return F.when(valid, _let(moved, write)).otherwise(value)

    return _let(parts, change)


def _date(value: Column, fmt: str, key: str) -> Column:
    """The day number within two centuries; impossible dates and other centuries stay."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(fmt)).cast("date"), F.lit(_FIRST_DAY).cast("date"))

    def change(d: Column) -> Column:
        moved = feistel(F.floor(d / _DAYS[1]), d % _DAYS[1], _DAYS[0], _DAYS[1], key, "date")
        new = _let(moved, lambda m: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (m["a"] * _DAYS[1] + m["b"]).cast("int")), fmt))
        return F.when((d >= 0) & (d < _DAYS[0] * _DAYS[1]), new).otherwise(value)

    return _let(day, change)


def _us_date(value: Column, key: str) -> Column:
    """Month first, which only days from the 13th on tell: month and day are permuted among such dates.

    Months have 16 to 19 such days; where the network leads to a day that the month
    has not, it is walked on, which keeps the map one-to-one.
    """
    day = F.try_to_timestamp(value, F.lit("MM/dd/yyyy")).cast("date")

    def change(d: Column) -> Column:
        month = (F.year(d) - 1900) * 12 + F.month(d) - 1
        start = F.struct(month.cast("long").alias("a"), (F.day(d) - 13).cast("long").alias("b"), F.lit(False).alias("done"))
        first = lambda m: F.make_date((F.floor(m / 12) + 1900).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))

        def walk(s: Column, i: Column) -> Column:
            moved = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), (m["b"] + 13 <= F.day(F.last_day(first(m["a"])))).alias("done"))
            return F.when(s["done"], s).otherwise(_let(feistel(s["a"], s["b"], 2400, 19, key, "month first"), moved))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, walk)
        new = _let(found, lambda s: F.date_format(F.date_add(first(s["a"]), (s["b"] + 12).cast("int")), "MM/dd/yyyy"))
        return F.when((F.year(d) >= 1900) & (F.year(d) < 2100), new).otherwise(value)

    return F.coalesce(_let(day, change), value)


def _abroad(value: Column, key: str) -> Column:
    """The digits after the country code, their number and a leading zero kept; numbers of country code 1 as ``_phone`` has them."""

    def change(d: Column) -> Column:
        code = F.regexp_extract(d, _COUNTRY, 0)
        own = F.substring(d, F.length(code) + 1, F.length(d))
        n = F.length(own)
        left = F.floor(n / 2).cast("int")
        power = lambda k: F.pow(F.lit(10.0), k).cast("long")
        least = F.when(F.substring(own, 1, 1) == "0", F.lit(0).cast("long")).otherwise(power(left - 1))
        room = F.when(least == 0, power(left - 1)).otherwise(least * 9)
        moved = feistel(_number(own, 1, left) - least, _number(own, left + 1, n - left), room, power(n - left), key, F.concat(F.lit("abroad "), code))
        new = _let(moved, lambda m: F.concat(code, _padded(m["a"] + least, left), _padded(m["b"], n - left)))
        shown = F.when(value.startswith("00"), F.concat(F.lit("00"), new)).otherwise(new)
        return F.when((code == "1") & (n == 10), _phone(value, key)).when((n >= 6) & (F.length(d) <= 15), _refill(value, shown)).otherwise(value)

    return _let(F.regexp_replace(_digits(value), "^00", ""), change)


def _email(value: Column, key: str) -> Column:
    """The local part's letters and digits are permuted; their case, dots, marks and the domain stay.

    A Feistel network over the two halves of the local part: each round adds keyed digits
    of one half to the letters of the other, modulo 26 or 10, so different addresses stay
    different.  Addresses that differ in case alone stay linked.
    """
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    letter, digit = lambda c: c.rlike("^[A-Za-z]$"), lambda c: c.rlike("^[0-9]$")

    def change(chars: Column) -> Column:
        room = F.transform(chars, lambda c: F.when(letter(c), 26).when(digit(c), 10).otherwise(1))
        start = F.transform(chars, lambda c: F.when(letter(c), F.ascii(F.lower(c)) - 97).when(digit(c), F.ascii(c) - 48).otherwise(0))
        half = F.floor(F.size(chars) / 2).cast("int")

        def permuted(rooms: Column) -> Column:
            def step(s: Column, i: Column) -> Column:
                even = i % 2 == 0
                other = F.when(even, F.slice(s, half + 1, F.size(s))).otherwise(F.slice(s, F.lit(1), half))
                text = F.concat_ws("|", F.lit(key), F.lit("email"), domain, F.array_join(rooms, ","), i.cast("string"), F.array_join(other, ","))
                add = lambda d, k: F.conv(F.substring(d, k * 3 % 60 + 1, F.lit(3)), 16, 10).cast("int")
                return _let(F.sha2(text, 256), lambda d: F.transform(s, lambda x, k: F.when((k < half) == even, (x + add(d, k)) % rooms[k]).otherwise(x)))

            return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)

        def written(s: Column) -> Column:
            def one(c: Column, k: Column) -> Column:
                low = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), s[k] + 1, F.lit(1))
                return F.when(letter(c), F.when(c == F.lower(c), low).otherwise(F.upper(low))).when(digit(c), s[k].cast("string")).otherwise(c)

            return F.array_join(F.transform(chars, one), "")

        return F.concat(_let(_let(room, permuted), written), F.lit("@"), F.substring_index(value, "@", -1))

    return _let(F.split(local, ""), change)


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _other(value: Column, key: str) -> Column:
    return (
        F.when(value.rlike(_whole(EMAIL)), _email(value, key))
        .when(value.rlike(_whole(IPV4)), _ipv4(value, key))
        .when(value.rlike(_whole(ISO_DATE)), _date(value, "yyyy-MM-dd", key))
        .when(value.rlike(_whole(YEAR_DATE)), _date(value, "yyyy/MM/dd", key))
        .when(value.rlike(_whole(r"\d{2}\.\d{2}\.\d{4}")), _date(value, "dd.MM.yyyy", key))
        .when(
            value.rlike(_whole(r"\d{2}/\d{2}/\d{4}")),
            F.when(F.try_to_timestamp(value, F.lit("dd/MM/yyyy")).isNull(), _us_date(value, key)).otherwise(_date(value, "dd/MM/yyyy", key)),
        )
        .when(value.rlike(_whole(SSN)), _ssn(value, key))
        .when(value.rlike(_whole(PHONE)), _phone(value, key))
        .when(value.rlike(_whole(ABROAD)), _abroad(value, key))
    )


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one matched value; what fails its validity check stays as it is."""
    return _other(value, key).otherwise(_cards(value, key))


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with each valid number and date in ``text`` replaced; other columns unchanged.

    A text is split at the matches once and joined with their pseudonyms, so the
    work follows its length.  Null texts stay null, texts without a match come back
    as they were.  Repeated rows stay repeated and equal; an empty table stays empty.
    ``count`` names a column to add with the number of matches that changed; neighbouring
    cards are one match.
    """
    found, changed = free_names(docs, "found", "changed")
    matches = F.when(F.col(text).rlike(r"\d|@"), F.regexp_extract_all(F.col(text), F.lit(f"({_ANY})"), F.lit(0)))
    held = docs.withColumn(found, matches)
    held = held.withColumn(changed, F.transform(F.col(found), lambda v: pseudonym(v, key)))
    gaps = F.split(F.col(text), _ANY, -1)
    joined = F.array_join(F.zip_with(gaps, F.col(changed), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    shown = F.when(F.size(found) > 0, joined).otherwise(F.col(text))
    if count:
        differ = F.filter(F.zip_with(found, changed, lambda a, b: a != b), lambda x: x)
        held = held.withColumn(count, F.when(F.size(found) > 0, F.size(differ)).otherwise(0).cast("long"))
    return held.withColumn(text, shown).drop(found, changed)


def op1_pii_pseudonyms(spark, sf_dir):
    """Columns: doc_id, text with its pseudonyms, n_values that changed, whether the text changed.

    Null texts stay null, empty ones empty, long ones are read whole; ties and
    repeated rows come back repeated and equal; an empty table gives no row; other
    columns are not read.
    """
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), count="n_values")
    return out.select("doc_id", "text", "n_values", (F.col("n_values") > 0).alias("changed"))
