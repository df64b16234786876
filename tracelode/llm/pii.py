"""Pseudonyms for personal numbers and dates by a format-preserving Feistel network.

Found and validated: payment card numbers (13 to 19 digits that pass the Luhn check), social
security numbers, telephone numbers, IPv4 addresses, dates from 1900 to 2099, and e-mail
addresses. Each but the last is a number of a finite domain that is the product of two moduli; a
keyed Feistel network of modular additions permutes that domain, and the result is written in the
form of the original, valid again (Luhn digit, octets, calendar). So equal values get equal
pseudonyms in every document, different values different ones, and whoever has the key can invert
it; as in any permutation, a value may stand for itself. The local part of an address is neither
number nor date: it is replaced by 128 bits of a keyed digest of the lower-cased address, which has
no way back. Round values are from SHA-256. The key has no default: with a known key anyone can
invert the numbers. Plans, event logs and the UI show a key derived from it, never itself; the derived one inverts
these pseudonyms, too, so guard them, or set spark.sql.redaction.string.regex to [0-9a-f]{64}.

Spellings of cards: unbroken, or groups of 4-4-4-4, 4-4-4-4 with 1 to 3 more, 4-4-4 with 1 to 3 more,
4-6-5 and 4-6-4 digits, all parted by a space or all by a dash. If the first 16 of 17 to 19 grouped
digits pass the check, they are the card and the last group (a security code, say) stays; so the way
back is not unique for longer grouped cards. Spellings of phones: ten digits as 3-3-4 parted by spaces,
dots or dashes, the area code also in parentheses, with or without 1 or +1; and + with a country code
and 8 to 15 digits in all, unbroken or parted by single spaces, dots or dashes. The country code stays,
separators too, and spellings of one number are linked; a trunk (0) counts as a digit. Spellings of
dates, linked as well: year, month and day parted by dashes, slashes or dots, and day, month and year
parted by dots. Left alone: cards in other groups or that another group of four precedes, national
numbers in other groups or without separators, dates whose first part may be day or month, or with
names of months.

Defined results: null text gives null text and no finds. Numbers that fail their validation stay as
they are. Where two kinds could begin at one place, the first in PATTERNS wins. Texts of any length are
read whole and in time that grows with their length; no pattern recurses. Rows that repeat an id are
treated one by one, an empty table gives an empty result, and columns other than the named ones are
ignored, whatever their names. All in DataFrame functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_DATE = (
    rf"(?:(?<![\d.-]){_YEAR}-{_MONTH}-{_DAY}(?![\d-])"
    rf"|(?<![\d./-])(?:{_YEAR}/{_MONTH}/{_DAY}|{_YEAR}\.{_MONTH}\.{_DAY}|{_DAY}\.{_MONTH}\.{_YEAR})(?![\d/-]|\.\d))"
)
_SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
# After the last digit of a number in groups: no digit, nor one that a dot or dash ties to it.
_END = r"(?!\d|[.-]\d)"


def _parted(by: str) -> str:
    last = r"\d{1,3}(?![ .-]?\d)"
    return rf"\d{{4}}{by}(?:\d{{4}}{by}\d{{4}}(?:{by}\d{{4}}(?:{by}{last}|{_END})|{by}{last})|\d{{6}}{by}\d{{4,5}}{_END})"


_CARD = rf"(?<!\d)(?:\d{{13,19}}(?!\d)|{_parted(' ')}|{_parted('-')})"
# What a phone number does not run into.
_OTHER = f"(?!{_DATE}|{_SSN}|{_IP}|{_CARD})"
_PHONE = "|".join((
    r"(?<![\d+])\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)",
    rf"(?<![\d+])\+{_OTHER}1[ .-]?(?:\(\d{{3}}\) ?|\d{{3}}[ .-]?)\d{{3}}[ .-]?\d{{4}}{_END}",
    rf"(?<![\d+])\+{_OTHER}[2-9](?:(?:[ .-]{_OTHER})?\(?\d\)?){{7,14}}{_END}",
    rf"(?<![\d.,+-])(?:1[ .-]?)?\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}{_END}",
    r"(?<![\d.,+-])(?:1[ .-])?(?:\d{3} \d{3} |\d{3}-\d{3}-|\d{3}\.\d{3}\.)\d{4}(?![\d,]|[ .-]\d)",
))
#: kind -> pattern of a candidate.
PATTERNS = {
    # Possessive throughout: the JVM recurses once a round for any other repeated group, and a domain may have many labels.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "date": _DATE,
    "ssn": _SSN,
    "phone": _PHONE,
    "ip": _IP,
    "card": _CARD,
}
_ANY = "|".join(PATTERNS.values())
#: What any text with a match of these patterns has: an address sign, a plus before a digit, or two digits with at most a dot between them.
_MAY = r"@[A-Za-z0-9-]|\+\d|\d\.?\d"
#: Country codes that are not of three digits.
_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Days of the years 1900 to 2099 are 17 * 4297.
_DAY_ZERO, _DAYS = "1900-01-01", (17, 4297)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _feistel(index: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """The permutation of 0 .. a * b - 1, or its inverse. a, b and index are longs."""
    # Even rounds add to x, odd rounds to y; backwards the same is taken off in reverse.
    sign = -1 if back else 1
    rounds = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def run(v: Column) -> Column:
        def value(i: Column, half: Column) -> Column:
            text = F.concat_ws("/", F.lit(key), F.lit(kind), i.cast("string"), v["a"].cast("string"), v["b"].cast("string"), half.cast("string"))
            return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).try_cast("long")

        def step(s: Column, i: Column) -> Column:
            even = F.pmod(i, F.lit(2)) == 0
            x = F.when(even, F.pmod(s["x"] + sign * value(i, s["y"]), v["a"])).otherwise(s["x"])
            y = F.when(even, s["y"]).otherwise(F.pmod(s["y"] + sign * value(i, s["x"]), v["b"]))
            return F.struct(x.alias("x"), y.alias("y"))

        # Whole-number division: bodies of 16 digits and more have no exact double.
        halves = F.struct(F.call_function("div", v["n"], v["b"]).alias("x"), F.pmod(v["n"], v["b"]).alias("y"))
        return F.aggregate(rounds, halves, step, lambda s: s["x"] * v["b"] + s["y"])

    return _let(F.struct(index.alias("n"), a.alias("a"), b.alias("b")), run)


def round_key(key: str) -> str:
    """What rounds and digests are keyed by: derived on the driver, so that no plan, log or page of the UI holds the key itself."""
    return hashlib.sha256(b"tracelode pseudonyms\0" + key.encode()).hexdigest()


def _big(n: int) -> Column:
    return F.lit(n).cast("long")


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum of a string of digits; from the right, each second one is doubled, beginning with the second or (1) the first."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        v = F.substring(digits, -i, F.lit(1)).try_cast("int")
        return F.when(F.pmod(i + doubled_from, F.lit(2)) == 0, v * 2).otherwise(v)

    split = F.transform(places, worth)
    return F.aggregate(split, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _core(m: Column) -> Column:
    """The card in a match of the card pattern: without a last group behind 16 digits that are a card themselves."""
    first = F.substring(m, 1, 19)
    return F.when(m.rlike(r"^\d{4}[ -]") & (F.length(m) > 19) & (_luhn_sum(_digits(first), 0) % 10 == 0), first).otherwise(m)


def _in_form(m: Column, digits: Column) -> Column:
    """m with its digits replaced by the given ones, in order."""
    def sign(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(m), F.lit(1))), sign), "")


def _iso(m: Column) -> Column:
    """A date in any of its spellings as year-month-day."""
    part = lambda k, n: F.substring(m, k, n)
    return F.when(m.rlike(r"^\d{4}"), F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2))).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))


def kind_of(m: Column) -> Column:
    """Which validated kind a match of the common pattern is; null: it fails its validation."""
    luhn = _let(_digits(_core(m)), lambda d: _luhn_sum(d, 0) % 10 == 0)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\+|^(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
        .when(m.rlike(r"^\d{13,19}$|^\d{4}[ -]\d{4,6}[ -]"), F.when(luhn, "card"))
        .when(m.rlike(rf"^(?:{_YEAR}[-/.]\d\d[-/.]\d\d|\d\d\.\d\d\.{_YEAR})$"), F.when(F.try_to_date(_iso(m), "yyyy-MM-dd").isNotNull(), "date"))
        .when(m.contains("."), "ip")
        .otherwise("ssn")
    )


def _decimal(digits: Column, key: str, kind: str, back: bool) -> Column:
    """The permutation of all strings of as many digits."""
    ten = lambda n: F.pow(F.lit(10), n).cast("long")

    def run(d: Column) -> Column:
        half = F.floor(F.length(d) / 2)
        return F.lpad(_feistel(d.try_cast("long"), ten(F.length(d) - half), ten(half), key, kind, back).cast("string"), F.length(d), F.lit("0"))

    return _let(digits, run)


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a validated match (or, backwards, its original; e-mail addresses have no way back)."""
    num = lambda c: c.try_cast("long")
    key = round_key(key)

    def card(core: Column) -> Column:
        body = _let(_digits(core), lambda d: F.substring(d, F.lit(1), F.length(d) - 1))
        whole = _let(_decimal(body, key, "card", back), lambda d: F.concat(d, F.pmod(10 - _luhn_sum(d, 1) % 10, F.lit(10)).cast("string")))
        return F.concat(_let(whole, lambda d: _in_form(core, d)), F.substring(m, F.length(core) + 1, F.length(m)))

    def ip(parts: Column) -> Column:
        octet = lambda i: num(F.get(parts, F.lit(i)))
        n = _feistel(((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3), _big(65536), _big(65536), key, "ip", back)
        return _let(n, lambda v: F.concat_ws(".", *[F.pmod(F.shiftright(v, s), _big(256)).cast("string") for s in (24, 16, 8, 0)]))

    def phone(digits: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(digits, _CODE, 1)).otherwise(F.when(F.length(digits) == 11, "1").otherwise(""))
        own = lambda c: F.concat(c, _decimal(F.substring(digits, F.length(c) + 1, F.length(m)), key, "phone", back))
        return _let(_let(code, own), lambda d: _in_form(m, d))

    def date(iso: Column) -> Column:
        day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_DAY_ZERO).cast("date")).cast("long")
        return F.date_add(F.lit(_DAY_ZERO).cast("date"), _feistel(day, _big(_DAYS[0]), _big(_DAYS[1]), key, "date", back).cast("int")).cast("string")

    def in_spelling(d: Column) -> Column:
        year_first = F.replace(d, F.lit("-"), F.substring(m, 5, 1))
        return F.when(m.rlike(r"^\d{4}"), year_first).otherwise(F.concat_ws(".", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4)))

    def ssn(area: Column) -> Column:
        area = area - F.when(area > 666, 2).otherwise(1)
        n = _feistel((area * 99 + num(F.substring(m, 5, 2)) - 1) * 9999 + num(F.substring(m, 8, 4)) - 1, _big(898 * 99), _big(9999), key, "ssn", back)
        pad = lambda c, w: F.lpad(c.cast("string"), w, "0")

        def written(v: Column) -> Column:
            high = F.floor(v / 9999).cast("long")
            first = F.floor(high / 99).cast("long")
            first = first + F.when(first >= 665, 2).otherwise(1)
            return F.concat_ws("-", pad(first, 3), pad(F.pmod(high, _big(99)) + 1, 2), pad(F.pmod(v, _big(9999)) + 1, 4))

        return _let(n, written)

    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@"), F.get(F.split(m, "@"), F.lit(1)))
    out = F.when(kind == "card", _let(_core(m), card)).when(kind == "ip", _let(F.split(m, r"\."), ip)).when(kind == "phone", _let(_digits(m), phone))
    return out.when(kind == "date", _let(date(_iso(m)), in_spelling)).when(kind == "ssn", _let(num(F.substring(m, 1, 3)), ssn)).when(kind == "email", mail)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, text with pseudonyms, found (array of kind, original length in order)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("__t")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    # Nearly every text without a digit and a sign of these kinds is done after one cheap look.
    may = text.rlike(_MAY)
    d = d.withColumn("hits", F.when(may, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))))
    d = d.withColumn("hits", F.when(F.size("hits") > 0, F.transform("hits", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))
    done = F.transform("hits", lambda h: F.coalesce(pseudonym(h["m"], h["kind"], key), h["m"]))
    whole = F.array_join(F.zip_with(F.split(text, _ANY, -1), done, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    found = F.transform(F.filter("hits", lambda h: h["kind"].isNotNull()), lambda h: F.struct(h["kind"], F.length(F.when(h["kind"] == "card", _core(h["m"])).otherwise(h["m"])).alias("n")))
    return d.select("id", F.when(F.col("hits").isNotNull(), whole).otherwise(text).alias("text"), F.coalesce(found, F.array().cast("array<struct<kind:string,n:int>>")).alias("found"))
