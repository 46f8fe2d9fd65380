"""Pseudonyms against a plain Python twin, value by value, and texts made to trip the patterns."""

import datetime
import hashlib
import random
import re
import time

import pytest

from simloom.llm import pii_pseudonyms as pii

SECRET = "twin"
DIGEST = hashlib.sha256(SECRET.encode()).hexdigest()


def prf(tweak, i, x):
    return int(hashlib.sha256(f"{DIGEST}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(a, b, rows, columns, tweak):
    """The first round of b's new value comes from a as SQL writes it."""
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            a = (a + prf(tweak, i, b)) % rows
        else:
            b = (b + prf(tweak, i, a)) % columns
    return a, b


def digits(d, tweak):
    if not d:
        return d
    if len(d) == 1:
        return str((int(d) + 1 + prf(tweak, 0, "") % 9) % 10)
    half = len(d) // 2
    a, b = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), f"{tweak}{len(d)}")
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def letters(word, tweak):
    out = ""
    for j in range(0, len(word), 12):
        chunk = word[j : j + 12]
        if len(chunk) == 1:
            out += chr(97 + (ord(chunk) - 96 + prf(f"{tweak}{out}", 0, "") % 25) % 26)
            continue
        number = 0
        for c in chunk:
            number = number * 26 + ord(c) - 97
        half = len(chunk) // 2
        columns = 26 ** (len(chunk) - half)
        a, b = feistel(number // columns, number % columns, 26**half, columns, f"{tweak}{len(chunk)}{out}")
        number, back = a * columns + b, ""
        for _ in chunk:
            number, k = divmod(number, 26)
            back = chr(97 + k) + back
        out += back
    return out


def placed(original, new, places):
    new = iter(new)
    return "".join((next(new).upper() if c.isupper() else next(new)) if re.match(f"[{places}]", c) else c for c in original)


def only(text, places):
    return re.sub(f"[^{places}]", "", text)


def email(m):
    local, domain = m.split("@", 1)
    first = placed(local, letters(only(local.lower(), "a-z"), "email" + only(local, "0-9")), "A-Za-z")
    return placed(first, digits(only(first, "0-9"), "email" + only(first, "A-Za-z").lower()), "0-9") + "@" + domain


def luhn_digit(payload):
    total = sum(x if k % 2 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def card(m):
    d = only(m, "0-9")
    payload = digits(d[:-1], "card")
    return placed(m, payload + luhn_digit(payload), "0-9")


def phone(m):
    d = only(m, "0-9")
    kept = max(0, len(d) - 10)
    return placed(m, d[:kept] + digits(d[kept:], "phone"), "0-9")


def ip(m):
    o = list(map(int, m.split(".")))
    a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


AREAS = [k for k in range(1, 900) if k != 666]


def ssn(m):
    a, b = feistel(AREAS.index(int(m[:3])), (int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, *pii.SSN_GRID, "ssn")
    return f"{AREAS[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def parts(m):
    x = list(map(int, re.split("[-/.]", m)))
    if m[4] == "-":
        return x[0], x[1], x[2], False
    first = x[0] <= 12 < x[1]
    return x[2], x[0 if first else 1], x[1 if first else 0], first


def date(m):
    y, mo, d, first = parts(m)
    begin = datetime.date.fromisoformat(pii.FIRST_DAY)
    a, b = feistel(*divmod((datetime.date(y, mo, d) - begin).days, pii.DAY_GRID[1]), *pii.DAY_GRID, "date")
    new = begin + datetime.timedelta(days=a * pii.DAY_GRID[1] + b)
    if m[4] == "-":
        return new.isoformat()
    sep = "/" if "/" in m else "."
    w1, w2 = map(len, m.split(sep)[:2])
    p, q = (new.month, new.day) if first else (new.day, new.month)
    return f"{p:0{w1}d}{sep}{q:0{w2}d}{sep}{new.year}"


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m):
    s = m.replace(" ", "")
    rest = s[4:]
    new = placed(rest, digits(only(rest, "0-9"), "iban" + s[:2] + re.sub("[0-9]", "-", rest)), "0-9")
    return placed(m, s[:2] + f"{98 - mod97(new + s[:2] + '00'):02d}" + new, "A-Z0-9")


def twin(m):
    """The pseudonym of a match, or the match if it isn't valid."""
    if "@" in m:
        return email(m)
    if re.match("[A-Z]{2}", m):
        s = m.replace(" ", "")
        return iban(m) if 15 <= len(s) <= 34 and mod97(s[4:] + s[:4]) == 1 else m
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        return ssn(m) if int(m[:3]) in AREAS and int(m[4:6]) and int(m[7:]) else m
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d{1,2}([/.])\d{1,2}\1\d{4}", m):
        y, mo, d, _ = parts(m)
        try:
            datetime.date(y, mo, d)
        except ValueError:
            return m
        return date(m) if 1800 <= y < 2200 else m
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", m):
        return ip(m) if max(map(int, m.split("."))) < 256 else m
    n = only(m, "0-9")
    if re.fullmatch(r"[+(].*|\d{3}[ .-]\d{3}[ .-]\d{4}", m):
        return phone(m) if 7 <= len(n) <= 15 else m
    return card(m) if 13 <= len(n) <= 19 and luhn_digit(n[:-1]) == n[-1] else m


def value(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(r.choice("abcXYZ") for _ in range(n))
    day = datetime.date(1800, 1, 1) + datetime.timedelta(days=r.randrange(146_097))
    c = r.choice([d(12), d(15), d(18)])
    c += luhn_digit(c)
    body = r.choice(["WEST", ""]) + d(r.choice([14, 18]))
    made = "GB" + f"{98 - mod97(body + 'GB00'):02d}" + body
    return r.choice(
        [
            f"{w(r.randrange(1, 30))}.{d(r.randrange(0, 4))}{w(1)}@{w(3)}.example.com",
            f"{w(1)}@x.org",
            f"{d(3)}-{d(2)}-{d(4)}",
            day.isoformat(),
            f"{day.day}.{day.month}.{day.year}",
            f"{day.month:02d}/{day.day:02d}/{day.year}",
            ".".join(str(r.randrange(300)) for _ in range(4)),
            f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
            f"{d(3)}-{d(3)}-{d(4)}",
            c if len(c) != 16 else "-".join(c[k : k + 4] for k in range(0, 16, 4)),
            d(16),
            made,
            " ".join(made[k : k + 4] for k in range(0, len(made), 4)),
        ]
    )


def test_pseudonyms_equal_a_plain_twin(spark):
    r = random.Random(5)
    texts = [" ; ".join(value(r) for _ in range(r.randrange(1, 8))) + r.choice(["", " end", "\n"]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in pii.report(df, SECRET).collect()}
    pattern = re.compile(pii.PATTERN)
    changed = 0
    for k, t in enumerate(texts):
        want = pattern.sub(lambda m: twin(m[0]), t)
        changed += want != t
        assert got[k] == want, t
    assert changed > 400


LONG = {
    "labels": "a@" + "b." * 500_000,
    "labels with an end": "a@" + "bb." * 300_000 + "com",
    "local part": "a" * 1_000_000 + "@x.com",
    "at signs": "a@" * 500_000,
    "digits": "1" * 1_000_000,
    "groups": "1234 " * 200_000,
    "capitals": "GB82" + "WEST" * 250_000,
    "spaced capitals": "GB82" + " WEST" * 200_000,
    "dots": "1." * 500_000,
    "dates": "1/1/" * 250_000,
    "phones": "+1 " * 300_000 + "(",
    "dashes": "123-" * 250_000,
}


@pytest.mark.parametrize("name", LONG)
def test_texts_of_a_megabyte_dont_trip_the_patterns(spark, name):
    df = spark.createDataFrame([(1, LONG[name]), (2, "card 4845168114407329")], "doc_id long, text string")
    start = time.perf_counter()
    out = {x["doc_id"]: x["text"] for x in pii.report(df, SECRET).collect()}
    assert time.perf_counter() - start < 60
    assert len(out[1]) == len(LONG[name]) and out[2] == "card " + card("4845168114407329")


def test_key_comes_from_the_session(spark):
    with pytest.raises(ValueError):
        pii.key_of(spark)
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        assert pii.key_of(spark, "other") == "k"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
