import datetime
import hashlib
import random
import re

import pytest

from lexigrid.llm import pii


KEY = "a key for tests"


def run(spark, rows, key=KEY, **kw):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(df, key, **kw).collect()}


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_formats_and_validation(spark):
    cards = "4111111111111111 4111-1111-1111-1111 4111111111111112"
    got, n = run(spark, [cards])[0]
    a, b, c = got.split()
    assert n == 2 and a != "4111111111111111" and luhn(a) and re.fullmatch(r"\d{16}", a) and b.replace("-", "") == a and c == "4111111111111112"
    got, n = run(spark, ["DE89 3704 0044 0532 0130 00 and DE89370400440532013000 and DE88370400440532013000"])[0]
    x, y, z = got.split(" and ")
    assert n == 2 and x.replace(" ", "") == y and z == "DE88370400440532013000"
    moved = y[4:] + y[:4]
    assert int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1
    got, n = run(spark, ["10.0.0.1, 256.1.1.1, 1.2.3.4.5."])[0]
    assert n == 1 and got.endswith(", 256.1.1.1, 1.2.3.4.5.") and all(int(o) < 256 for o in got.split(",")[0].split("."))
    got, n = run(spark, ["2024-02-29 29.02.2024 02/29/2024 2023-02-29 1850-01-01"])[0]
    iso, dotted, slashed, *rest = got.split()
    assert n == 3 and rest == ["2023-02-29", "1850-01-01"]
    year, month, day = iso.split("-")
    assert dotted == f"{day}.{month}.{year}" and slashed == f"{month}/{day}/{year}" and iso != "2024-02-29"
    got, n = run(spark, ["123-45-6789 000-45-6789 666-45-6789 123-00-6789"])[0]
    assert n == 1 and got.endswith(" 000-45-6789 666-45-6789 123-00-6789")


def test_values_stay_linked_and_keys_differ(spark):
    rows = ["x a.Bc@mail.example.com", "A.bC@mail.example.com!", "+1 (423) 555-7379", "(423) 555-7379 423-555-7379", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    got = run(spark, rows)
    assert got[0][0][2:].lower() == got[1][0][:-1].lower() != "a.bc@mail.example.com"
    assert re.sub(r"\D", "", got[2][0])[1:] == re.sub(r"\D", "", got[3][0])[:10] == re.sub(r"\D", "", got[3][0])[10:] != "4235557379"
    assert got[2][0].startswith("+1 (") and got[4][0].startswith('token = "') and got[4][0] != rows[4] and len(got[4][0]) == len(rows[4])
    other = run(spark, rows, key="another key")
    assert all(other[i] != got[i] for i in got)


def test_text_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    for n in (1, 2, 3):
        values = df.select(F.substring("s", 4 - n, n).alias("s")).distinct()
        assert values.select(pii._feistel_text(F.col("s"), F.lit("k")).alias("t")).distinct().count() == 10**n
    days = spark.range(0, 72_900, 9).select(pii._feistel_pair(F.floor(F.col("id") / 270), F.col("id") % 270, (270, 270), F.lit("k"), lambda a, b: a * 270 + b).alias("t"))
    assert days.distinct().count() == 8100


# --- the same network in plain Python -------------------------------------------------------


def number(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def turned(c, by):
    for first, size in (("0", 10), ("a", 26), ("A", 26)):
        if ord(first) <= ord(c) < ord(first) + size and c.isascii():
            return chr(ord(first) + (ord(c) - ord(first) + by) % size)
    return c


def feistel_text(text, key):
    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(1, 9):
        a, b = b, "".join(turned(c, number(key, r, j, b.lower())) for j, c in enumerate(a, 1))
    return a + b


def feistel_pair(a, b, sides, key):
    for r in range(1, 9):
        if r % 2:
            a = (a + number(key, r, b)) % sides[0]
        else:
            b = (b + number(key, r, a)) % sides[1]
    return a, b


def refill(form, fill, kept):
    fill = iter(fill)
    return "".join(next(fill) if re.match(f"[{kept}]", c) else c for c in form)


def moved_day(day, key):
    x, y = feistel_pair(*divmod((day - datetime.date(1900, 1, 1)).days, 270), (270, 270), key)
    return datetime.date(1900, 1, 1) + datetime.timedelta(x * 270 + y)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def plain(kind, m):
    key = f"{hashlib.sha256(KEY.encode()).hexdigest()}|{kind}"
    if kind == "email":
        name, host, top = re.match(r"(.+)@(.+)(\.[A-Za-z]+)$", m).groups()
        return f"{feistel_text(name, key)}@{feistel_text(host, key)}{top}"
    if kind == "secret":
        head, value = re.match(r"([a-z]+ = \")(.+)$", m).groups()
        return head + feistel_text(value, key)
    if kind == "card":
        body = feistel_text(re.sub(r"\D", "", m)[:-1], key)
        return refill(m, body + next(str(d) for d in range(10) if luhn(f"{body}{d}")), "0-9")
    if kind == "iban":
        p = m.replace(" ", "")
        account = feistel_text(p[4:], key)
        return refill(m, f"{p[:2]}{98 - mod97(account + p[:2] + '00'):02d}{account}", "A-Z0-9")
    if kind == "ipv4":
        o = [int(x) for x in m.split(".")]
        a, b = feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        area, group, serial = map(int, m.split("-"))
        a, b = feistel_pair(areas.index(area) * 99 + group - 1, serial - 1, (898 * 99, 9999), key)
        return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "phone":
        d = re.sub(r"\D", "", m)
        ok = lambda x: x[0] >= "2" and x[3] >= "2"
        if ok(d):
            e = int(d[3:6]) - 200
            a, b = feistel_pair((int(d[:3]) - 200) * 100 + e // 8, e % 8 * 10_000 + int(d[6:]), (80_000, 80_000), key)
            d = f"{a // 100 + 200:03d}{a % 100 * 8 + b // 10_000 + 200:03d}{b % 10_000:04d}"
        else:
            d = feistel_text(d, key)
            while ok(d):
                d = feistel_text(d, key)
        return refill(m, d, "0-9")
    return moved_day(datetime.date.fromisoformat(m), key).isoformat()


def test_against_a_plain_network(spark):
    """Random values of every kind: the pseudonym is the plain network's, valid again, and different values stay different."""
    r = random.Random(11)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cases = []
    for _ in range(150):
        body = r.choice("45") + digits(14)
        card = body + next(str(d) for d in range(10) if luhn(f"{body}{d}"))
        account = digits(18)
        cases += [
            ("card", r.choice((card, " ".join(card[i : i + 4] for i in (0, 4, 8, 12)), "  ".join(card[i : i + 4] for i in (0, 4, 8, 12))))), ("iban", f"DE{98 - mod97(account + 'DE00'):02d}{account}"),
            ("ipv4", ".".join(str(r.randrange(256)) for _ in range(4))), ("ssn", f"{r.choice([x for x in range(1, 900) if x != 666]):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10_000):04d}"),
            ("phone", f"{digits(3)}-{digits(3)}-{digits(4)}"), ("email", f"{r.choice('abX')}{digits(2)}.q@mail.exa-mple{digits(1)}.org"), ("secret", f'token = "{digits(8)}abcXYZ{digits(4)}'),
            ("date", (datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(72_900))).isoformat()),
        ]
    got = run(spark, [m for _, m in cases])
    for k, (kind, m) in enumerate(cases):
        assert got[k] == (plain(kind, m), 1), (kind, m)
    for kind, fine in (("ssn", lambda x: not re.search(r"^(000|666|9)|-00-|0000$", x)), ("card", lambda x: luhn(re.sub(r"\D", "", x))), ("iban", lambda x: mod97(x[4:] + x[:4]) == 1)):
        old, new = zip(*((m, got[k][0]) for k, (q, m) in enumerate(cases) if q == kind), strict=True)
        assert all(map(fine, new)) and len({re.sub(r"\s", "", x) for x in new}) == len({re.sub(r"\s", "", x) for x in old})
    valid = [(m, got[k][0]) for k, (q, m) in enumerate(cases) if q == "phone"]
    assert all((a[0] >= "2" and a[4] >= "2") == (b[0] >= "2" and b[4] >= "2") for a, b in valid)


def test_values_are_found_in_their_surroundings(spark):
    rows = ["ES91 2100 0418 4502 0005 1332 CALL NOW", "ES91 2100 0418 4502 0005 1332 EUR", "ana@example.com-", "ana@example.com--x", "born 12 March 2020 or March 12, 2020", "am 12. März 2020", "le 12 mars 2020", "el 12 de marzo de 2020", "call 030 1234567 or 06 12 34 56 78", "4111  1111  1111  1111"]
    got = run(spark, rows)
    assert [n for _, n in got.values()] == [1, 1, 1, 1, 2, 1, 1, 1, 2, 1]
    assert got[0][0].endswith(" CALL NOW") and got[0][0][:-9] == got[1][0][:-4] and mod97((p := got[0][0][:-9].replace(" ", ""))[4:] + p[:4]) == 1
    assert got[2][0][:-1] == got[3][0][:-3] and got[2][0].endswith(".com-")
    a, b = re.match(r"born (.*) or (.*)$", got[4][0]).groups()
    day, month, year = a.split()
    assert b == f"{month} {day}, {year}" and month in pii.MONTHS["en"].split() and a != "12 March 2020"
    at = pii.MONTHS["en"].split().index(month)
    assert got[5][0] == f"am {day}. {pii.MONTHS['de'].split()[at]} {year}" and got[6][0] == f"le {day} {pii.MONTHS['fr'].split()[at]} {year}" and got[7][0] == f"el {day} de {pii.MONTHS['es'].split()[at]} de {year}"
    assert re.fullmatch(r"call 0\d\d \d{7} or 0\d \d\d \d\d \d\d \d\d", got[8][0])


def test_a_key_is_needed(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", 7)], "doc_id long, text string, n_pii int")
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(df)
    assert "some secret" not in pii.pseudonymise(df, "some secret")._jdf.queryExecution().toString()
    assert pii.pseudonymise(df, KEY, counted=None).first().n_pii == 7
    spark.conf.set("spark.lexigrid.pii.key", KEY)
    try:
        assert pii.pseudonymise(df).first().text == pii.pseudonymise(df, KEY).first().text
    finally:
        spark.conf.unset("spark.lexigrid.pii.key")


@pytest.mark.parametrize("clean", ["plain words", "", "version 2.1.3 of 1999", "a@b", "9999999999999999", "call 555-7379", "x=12345678901234567890123"])
def test_clean_texts_stay(spark, clean):
    assert run(spark, [clean])[0] == (clean, 0)


def test_edges(spark):
    long = "word " * 60_000
    rows = [None, "", long + "4111111111111111", "a@x.example.com" * 1, "a@x.example.com"]
    got = run(spark, rows)
    assert got[0] == (None, 0) and got[1] == ("", 0) and got[2][1] == 1 and got[2][0].startswith(long) and got[3] == got[4]
    wide = spark.createDataFrame([(1, "10.0.0.1", 8, "kept", 5)], "doc_id long, text string, n_chars long, _note string, parts int")
    r = pii.pseudonymise(wide, KEY).first()
    assert r._note == "kept" and r.n_chars == len(r.text) and r.parts == 5
    assert pii.pseudonymise(wide.limit(0), KEY).count() == 0
    plan = pii.pseudonymise(wide, KEY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
