"""Pseudonyms against plain Python: the same finds, the same numbers, whole texts of any length."""

import datetime
import hashlib
import random
import re

import pytest

from tracelode.llm import pii

KEY = "k"
DAY_ZERO = datetime.date(1900, 1, 1)


def feistel(index, a, b, kind):
    x, y = divmod(index, b)
    value = lambda i, half: int(hashlib.sha256(f"{pii.round_key(KEY)}/{kind}/{i}/{a}/{b}/{half}".encode()).hexdigest()[:14], 16)
    for i in range(pii.ROUNDS):
        x, y = ((x + value(i, y)) % a, y) if i % 2 == 0 else (x, (y + value(i, x)) % b)
    return x * b + y


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10


def in_form(m, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in m)


def decimal(digits, kind):
    half = len(digits) // 2
    return str(feistel(int(digits), 10 ** (len(digits) - half), 10**half, kind)).zfill(len(digits))


def plain(m):
    """(kind, pseudonym) of a match; (None, m) where it fails its validation."""
    only = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", "u" + hashlib.sha256(f"{pii.round_key(KEY)}/email/{m.lower()}".encode()).hexdigest()[:32] + "@" + m.split("@")[1]
    if m[0] == "+" or re.fullmatch(r"(1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m, re.A):
        code = re.match(pii._CODE[1:], only).group() if m[0] == "+" else only[: len(only) - 10]
        return "phone", in_form(m, code + decimal(only[len(code) :], "phone"))
    if re.fullmatch(r"\d{13,19}", m, re.A) or re.match(r"\d{4}[ -]\d{4,6}[ -]", m, re.A):
        core = m[:19] if not m.isdigit() and len(m) > 19 and luhn(re.sub("[^0-9]", "", m[:19])) == 0 else m
        own = re.sub("[^0-9]", "", core)
        if luhn(own):
            return None, m
        body = decimal(own[:-1], "card")
        return "card", in_form(core, body + next(c for c in "0123456789" if luhn(body + c) == 0)) + m[len(core) :]
    if parts := re.fullmatch(r"(\d{4})([-/.])(\d\d)[-/.](\d\d)|(\d\d)\.(\d\d)\.(\d{4})", m, re.A):
        y, sign, mo, d, d2, mo2, y2 = parts.groups()
        try:
            day = datetime.date(int(y or y2), int(mo or mo2), int(d or d2))
        except ValueError:
            return None, m
        new = DAY_ZERO + datetime.timedelta(feistel((day - DAY_ZERO).days, 17, 4297, "date"))
        return "date", new.strftime(f"%Y{sign}%m{sign}%d") if y else new.strftime("%d.%m.%Y")
    if "." in m:
        n = int.from_bytes(bytes(map(int, m.split("."))), "big")
        return "ip", ".".join(map(str, feistel(n, 65536, 65536, "ip").to_bytes(4, "big")))
    area, group, serial = map(int, m.split("-"))
    n = feistel(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    high, low = divmod(n, 9999)
    area, group = divmod(high, 99)
    return "ssn", f"{area + (2 if area >= 665 else 1):03}-{group + 1:02}-{low + 1:04}"


def plain_text(text):
    kinds, out, at = [], [], 0
    for m in re.finditer(pii._ANY, text, re.A):
        kind, new = plain(m.group())
        kinds += [kind] if kind else []
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join([*out, text[at:]]), kinds


def test_against_plain_python(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = digits(rng.choice((12, 14, 15, 15, 18)))
        whole = body + next(c for c in "0123456789" if luhn(body + c) == 0)
        return rng.choice((whole, " ".join(whole[k : k + 4] for k in range(0, len(whole), 4)), "-".join(whole[k : k + 4] for k in range(0, len(whole), 4)), whole + " 123"))

    make = [
        card,
        lambda: digits(16),
        lambda: f"{rng.randint(1, 999):03}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(rng.randint(0, 260)) for _ in range(4)),
        lambda: f"{rng.randint(1890, 2110)}{(s := rng.choice('-/.'))}{rng.randint(0, 13):02}{s}{rng.randint(0, 32):02}",
        lambda: f"{rng.randint(1, 31):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2099)}",
        lambda: rng.choice(("+1 (555) 123-4567", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+44 20 {digits(4)} {digits(4)}", f"1-{digits(3)}-{digits(3)}-{digits(4)}", f"+353{digits(8)}")),
        lambda: f"{rng.choice(('Ann.Lee', 'x_1', '%+'))}@{rng.choice(('a.org', 'B-c.Co.uk', 'nodot', '1.2'))}",
        lambda: rng.choice(("the", "é", "\n", "😀", "v1.2", "1,000", "10:30", "\\", "$1")),
    ]
    texts = [rng.choice((" ", " ", ", ", "", "-", "\n")).join(rng.choice(make)() for _ in range(rng.randint(0, 12))) for _ in range(600)]
    d = spark.createDataFrame([(i, t, 7, "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, id int, hits string, found string")
    got = {r.id: r for r in pii.pseudonymise(d, KEY).collect()}
    assert len({x.kind for r in got.values() for x in r.found}) == 6
    for i, t in enumerate(texts):
        want, kinds = plain_text(t)
        assert (got[i].text, [x.kind for x in got[i].found]) == (want, kinds), t


def test_long_texts_without_recursion(spark):
    n = 1_000_000
    texts = ["a@b" + ".c" * (n // 2), "1" * n, "." * n, "@" * n, *[x * (n // 20) for x in ("a@", "1.", "1-", "1111 ", "+1", "%+-")]]
    got = {r.id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    assert got[0].text.endswith("@b" + ".c" * (n // 2)) and [x.kind for x in got[0].found] == ["email"]
    assert all(got[i].text == t for i, t in enumerate(texts) if i)
    many = "on 2024-02-29 to 4111111111111111; " * 3000
    r = pii.pseudonymise(spark.createDataFrame([(1, many), (1, many)], "doc_id long, text string"), KEY).collect()
    assert r[0] == r[1] and len(r[0].found) == 6000 and len(r[0].text) == len(many) and r[0].text == r[0].text[: len(many) // 3000] * 3000


def test_spellings_of_a_date_are_linked_and_come_back(spark):
    from pyspark.sql import functions as F

    m = spark.createDataFrame([(t,) for t in ("2024-02-29", "2024/02/29", "2024.02.29", "29.02.2024")], "m string")
    f = m.withColumn("p", pii.pseudonym(F.col("m"), F.lit("date"), KEY)).withColumn("b", pii.pseudonym(F.col("p"), F.lit("date"), KEY, True)).collect()
    parts = {tuple(sorted(re.split("[-/.]", r.p))) for r in f}
    assert len(parts) == 1 and all(r.b == r.m for r in f)


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "")


def test_bodies_at_the_ends_of_their_halves_come_back(spark):
    from pyspark.sql import functions as F

    rng, cards = random.Random(3), []
    for n in range(13, 20):
        low = (n - 1) // 2
        heads = ["9" * (n - 1 - low), "0" * (n - 1 - low), "4" + "0" * (n - 2 - low), *["".join(rng.choice("0123456789") for _ in range(n - 1 - low)) for _ in range(8)]]
        for head in heads:
            for tail in ("9" * low, "0" * low, "0" * (low - 1) + "1", "9" * (low - 1) + "8"):
                body = head + tail
                cards.append(body + next(c for c in "0123456789" if luhn(body + c) == 0))
    cards = sorted(set(cards))
    m = spark.createDataFrame([(c,) for c in cards], "m string")
    f = m.withColumn("p", pii.pseudonym(F.col("m"), F.lit("card"), KEY)).withColumn("b", pii.pseudonym(F.col("p"), F.lit("card"), KEY, True)).collect()
    assert all(r.b == r.m and luhn(r.p) == 0 and len(r.p) == len(r.m) for r in f)
    assert len({r.p for r in f}) == len(cards)
    assert all(r.p == plain(r.m)[1] for r in f)


def test_no_plan_shows_the_key(spark):
    secret = "not-for-the-log-7c1"
    plan = pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), secret)._jdf.queryExecution().toString()
    assert secret not in plan
