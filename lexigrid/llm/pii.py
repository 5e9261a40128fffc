"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations only.

Found and validated are: card numbers (Luhn), IBANs (the country's length, modulo 97),
dates of the calendar in figures and in words, IPv4 addresses (octets), social security
numbers (assignable ranges), telephone numbers, e-mail addresses and secrets (values
named as a token, key or password). What fails its validation is left alone.

A value is permuted within its format by a keyed Feistel network whose round
function is SHA-256: a digit stays a digit, a letter a letter of its case, and
separators stay in place. Equal values, also in other spellings of the same
kind (spaces, hyphens, case), therefore get equal pseudonyms in all documents,
and different values different ones. A pseudonym passes its kind's validation: check
digits are computed anew, social security numbers, dates, addresses and North
American telephone numbers are permuted as places in the list of the valid ones.

The key is needed: an argument, or spark.lexigrid.pii.key; without one there is an
error. Only its SHA-256 enters the plan, which is as secret as the key itself where
plans and event logs are kept, since pseudonyms can be turned back with it.

Edge cases: a null text stays null with no value found; empty and very long
texts are taken whole; overlapping candidates are resolved from left to right; a
date outside 1900-01-01 to 2099-08-04 is left alone; repeated rows are treated
alike; an empty table gives an empty result; further columns are kept (but one
of the name that the count is given, which ours replaces; no count, no such loss).
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
_SIDE = 270  # dates are a square of this side, in days from 1900-01-01
#: Permutations that lead out of a set after at most so many steps, but for one case in 10**38.
_WALK = 200

# IBAN lengths by country, and month names.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}

_MONTH = "(?:" + "|".join(sorted({w for names in MONTHS.values() for x in names.split() for w in (x, x.capitalize())}, key=lambda x: (-len(x), x))) + ")"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{12,}"
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2})(?:" + "|".join(rf"(?:{'|'.join(c.split())})\d\d(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
_DAY_FIRST, _MONTH_FIRST = rf"(\d{{1,2}})(\.? (?:de )?)({_MONTH})((?: del?)? )(\d{{4}})", rf"({_MONTH})( )(\d{{1,2}})(,? )(\d{{4}})"
WRITTEN = rf"(?<![\p{{L}}\d./-])(?:\d{{1,2}}\.? (?:de )?{_MONTH}(?: del?)? \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}})(?![\p{{L}}\d])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}|\(?0\d{1,4}(?:\) ?|[ /.-])\d{2,8}(?:[ .-]\d{2,4}){0,4})(?![\w-])"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]{1,2}\d{4}){3}|\d{4}[ -]{1,2}\d{6}[ -]{1,2}\d{5})(?![\w-])"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV4, WRITTEN, DATE, SSN, PHONE, CARD))
#: A text without any of these has no candidate.
_HINT = r"[0-9@]|(?i:token|secret|key|passw|pwd)"


def _number(*parts: Column) -> Column:
    """A keyed pseudo-random number of 32 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8), 16, 10).cast("long")


def _chars(text: Column, made) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), made), "")).otherwise(F.lit(""))


def _turned(c: Column, by: Column) -> Column:
    """The character moved by a number within its class."""

    def within(first: int, size: int) -> Column:
        return F.chr(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))

    return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)


def _feistel_text(text: Column, key: Column) -> Column:
    """A permutation of the strings of the same character classes."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b"))

    def round_(acc: Column, r: Column) -> Column:
        moved = _chars(acc["a"], lambda j: _turned(F.substr(acc["a"], j, F.lit(1)), _number(key, r, j, F.lower(acc["b"]))))
        return F.struct(acc["b"].alias("a"), moved.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: F.concat(acc["a"], acc["b"]))


def _feistel_pair(a: Column, b: Column, sides: tuple[int, int], key: Column, made) -> Column:
    """made(a, b) of a permutation of the pairs of a number below the one side and one below the other."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def round_(acc: Column, r: Column) -> Column:
        a_moved = F.pmod(acc["a"] + _number(key, r, acc["b"]), F.lit(sides[0]))
        b_moved = F.pmod(acc["b"] + _number(key, r, acc["a"]), F.lit(sides[1]))
        return F.struct(F.when(r % 2 == 1, a_moved).otherwise(acc["a"]).alias("a"), F.when(r % 2 == 0, b_moved).otherwise(acc["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda acc: made(acc["a"], acc["b"]))


def _digits(n: Column, width: int) -> Column:
    return F.lpad(n.cast("long").cast("string"), width, "0")


def _only(text: Column, kept: str) -> Column:
    return F.regexp_replace(text, f"[^{kept}]", "")


def _refill(form: Column, fill: Column, kept: str) -> Column:
    """form with its kept characters replaced, in order, by those of fill."""

    def at(j: Column) -> Column:
        c = F.substr(form, j, F.lit(1))
        return F.when(c.rlike(f"[{kept}]"), F.substr(fill, F.length(_only(F.substr(form, F.lit(1), j), kept)), F.lit(1))).otherwise(c)

    return _chars(form, at)


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; every second digit from the right counts double, from position ``doubled``."""
    n = F.length(digits)

    def add(acc: Column, j: Column) -> Column:
        d = F.substr(digits, n - j + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(j % 2 == doubled % 2, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder of the number that letters (A is 10) and digits make."""

    def add(acc: Column, j: Column) -> Column:
        c = F.substr(text, j, F.lit(1))
        return F.when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(m: Column, key: Column) -> Column:
    digits = _only(m, "0-9")

    def sealed(body: Column) -> Column:
        return F.concat(body, F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string"))

    body = _feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key)
    new = F.element_at(F.transform(F.array(body), sealed), 1)
    return F.when(_luhn_sum(digits, 2) % 10 == 0, _refill(m, new, "0-9"))


def _iban(m: Column, key: Column) -> Column:
    plain = _only(m, "A-Z0-9")
    country = F.substr(plain, F.lit(1), F.lit(2))

    def sealed(account: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    valid = _mod97(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
    new = F.element_at(F.transform(F.array(_feistel_text(F.substr(plain, F.lit(5)), key)), sealed), 1)
    return F.when(valid, _refill(m, new, "A-Z0-9"))


def _ipv4(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    at = lambda i: F.element_at(octets, i)
    new = _feistel_pair(at(1) * 256 + at(2), at(3) * 256 + at(4), (65536, 65536), key, lambda a, b: F.concat_ws(".", *((x.cast("string")) for x in (F.floor(a / 256), a % 256, F.floor(b / 256), b % 256))))
    return F.when(~F.exists(octets, lambda x: x > 255), new)


def _date(m: Column, key: Column) -> Column:
    """In the notation of m; a slashed date is month first where that is valid."""
    sep = F.regexp_extract(m, r"\d([-/.])", 1)
    f = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    a, b, c = (F.element_at(f, i) for i in (1, 2, 3))

    def day(y: Column, mo: Column, d: Column) -> Column:
        return F.datediff(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, mo, d), F.lit("yyyy-MM-dd")), F.lit("1900-01-01").cast("date"))

    month_first = (sep == "/") & day(c, a, b).isNotNull()
    n = F.when(sep == "-", day(a, b, c)).when(month_first, day(c, a, b)).otherwise(day(c, b, a))
    wide = F.regexp_extract(m, r"^0|[-/.]0", 0) != ""
    style = F.when(sep == "-", "yyyy-MM-dd").when(sep == "/", F.when(month_first, F.when(wide, "MM/dd/yyyy").otherwise("M/d/yyyy")).otherwise(F.when(wide, "dd/MM/yyyy").otherwise("d/M/yyyy"))).otherwise(F.when(wide, "dd.MM.yyyy").otherwise("d.M.yyyy"))
    told = lambda x, y: F.date_add(F.lit("1900-01-01").cast("date"), (x * _SIDE + y).cast("int"))
    styles = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "d.M.yyyy")
    new = _feistel_pair(F.floor(n / _SIDE), n % _SIDE, (_SIDE, _SIDE), key, lambda x, y: reduce(lambda out, s: F.when(style == s, F.date_format(told(x, y), s)).otherwise(out), styles, F.lit(None).cast("string")))
    return F.when(n.between(0, _SIDE * _SIDE - 1), new)


def _written_date(m: Column, key: Column) -> Column:
    """In the notation and language of m."""
    day_first = m.rlike(r"^\d")
    part = lambda i, j: F.when(day_first, F.regexp_extract(m, f"^{_DAY_FIRST}$", i)).otherwise(F.regexp_extract(m, f"^{_MONTH_FIRST}$", j))
    day, month, year = part(1, 3), part(3, 1), part(5, 5)
    lists = [F.array(*(F.lit(x.lower()) for x in names.split())) for names in MONTHS.values()]
    mine = F.coalesce(*(F.when(F.array_contains(x, F.lower(month)), x) for x in lists))
    told = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year.cast("int"), F.array_position(mine, F.lower(month)).cast("int"), day.cast("int")), F.lit("yyyy-MM-dd"))
    n = F.datediff(told, F.lit("1900-01-01").cast("date"))

    def made(x: Column, y: Column) -> Column:
        date = F.date_add(F.lit("1900-01-01").cast("date"), (x * _SIDE + y).cast("int"))
        name = F.element_at(mine, F.month(date))
        name = F.when(month == F.initcap(month), F.initcap(name)).otherwise(name)
        d, y4 = F.dayofmonth(date).cast("string"), F.year(date).cast("string")
        return F.when(day_first, F.concat(d, part(2, 2), name, part(4, 4), y4)).otherwise(F.concat(name, part(2, 2), d, part(4, 4), y4))

    return F.when(n.between(0, _SIDE * _SIDE - 1), _feistel_pair(F.floor(n / _SIDE), n % _SIDE, (_SIDE, _SIDE), key, made))


def _ssn(m: Column, key: Column) -> Column:
    """Valid areas are 001 to 899 but 666, groups 01 to 99, serial numbers 0001 to 9999; the pairs are (area and group, serial)."""
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def made(a: Column, b: Column) -> Column:
        at = F.floor(a / 99)
        return F.concat_ws("-", _digits(F.when(at >= 665, at + 2).otherwise(at + 1), 3), _digits(a % 99 + 1, 2), _digits(b + 1, 4))

    return F.when(~m.rlike(r"^(000|666|9\d\d)|-00-|0000$"), _feistel_pair(place * 99 + group - 1, serial - 1, (898 * 99, 9999), key, made))


def _north_american(digits: Column, key: Column) -> Column:
    """Ten digits; valid numbers (area and exchange from 200) are permuted among themselves, others among the others."""
    valid = lambda d: d.rlike(r"^[2-9]\d\d[2-9]")
    area, exchange, line = (F.substr(digits, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (4, 3), (7, 4)))

    def made(a: Column, b: Column) -> Column:
        return F.concat(_digits(F.floor(a / 100) + 200, 3), _digits(a % 100 * 8 + F.floor(b / 10_000) + 200, 3), _digits(b % 10_000, 4))

    own = _feistel_pair((area - 200) * 100 + F.floor((exchange - 200) / 8), (exchange - 200) % 8 * 10_000 + line, (80_000, 80_000), key, made)
    odd = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), _feistel_text(digits, key), lambda d, _: F.when(valid(d), _feistel_text(d, key)).otherwise(d))
    return F.when(valid(digits), own).otherwise(odd)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays, and a leading zero; the other digits are permuted. A number has 7 to 15 digits, one with a leading zero 9 to 12."""
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\(?0(?!\d\d(?:\) ?|[.-])\d{3}[.-]\d{4}$))?", 0)
    rest = F.substr(m, F.length(code) + 1)
    digits = _only(rest, "0-9")
    new = F.when((F.length(digits) == 10) & code.isin("", "+1"), _north_american(digits, key)).otherwise(_feistel_text(digits, key))
    total = F.length(_only(m, "0-9"))
    fine = F.when(code.rlike("0$") & ~code.startswith("+"), total.between(9, 12)).otherwise(total.between(7, 15))
    return F.when(fine, F.concat(code, _refill(rest, new, "0-9")))


def _email(m: Column, key: Column) -> Column:
    """All but the top-level domain is permuted, name and host each for itself."""
    name, host, top = (F.regexp_extract(m, r"^([^@]+)@(.+)(\.[A-Za-z]+)$", i) for i in (1, 2, 3))
    return F.concat(_feistel_text(name, key), F.lit("@"), _feistel_text(host, key), top)


def _secret(m: Column, key: Column) -> Column:
    head, value = (F.regexp_extract(m, r"^([A-Za-z_-]+[\"']?\s*[:=]\s*[\"']?)(.+)$", i) for i in (1, 2))
    return F.concat(head, _feistel_text(value, key))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a candidate, or null if it fails its validation."""
    tagged = lambda kind: F.concat(key, F.lit("|" + kind))
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(m.contains("@"), _email(m, tagged("email")))
        .when(m.rlike(r"^[A-Za-z_-]{3,}[\"']?\s*[:=]"), _secret(m, tagged("secret")))
        .when(m.rlike(r"^[A-Z]{2}\d\d"), _iban(m, tagged("iban")))
        .when(m.rlike(r"\p{L}"), _written_date(m, tagged("date")))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _ipv4(m, tagged("ipv4")))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"), _date(m, tagged("date")))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _ssn(m, tagged("ssn")))
        .when(m.rlike(r"^\+|^\(|^0\d{1,4}[ /.-]\d|^\d{3}[.-]\d{3}[.-]\d{4}$") & ~whole(CARD), _phone(m, tagged("phone")))
        .otherwise(_card(m, tagged("card")))
    )


def secret_of(spark: SparkSession, key: str | None) -> str:
    """What the rounds are keyed with: the SHA-256 of the key that is given or set."""
    key = key or spark.conf.get("spark.lexigrid.pii.key", None)
    if not key:
        raise ValueError("give a key, or set spark.lexigrid.pii.key: anyone can turn pseudonyms of a known key back")
    return hashlib.sha256(key.encode()).hexdigest()


def pseudonymise(docs: DataFrame, key: str | None = None, counted: str | None = "n_pii") -> DataFrame:
    """docs with text rewritten, n_chars (if there is one) brought up to date where it was, and the number of values replaced in ``counted``."""
    secret = F.lit(secret_of(docs.sparkSession, key))
    text = F.col("text")
    candidates = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # The rows are carried as one column, so that no name of theirs can clash with ours.
    found = docs.select(F.struct("*").alias("row"), text.cast("string").alias("text")).withColumn("found", F.coalesce(candidates, F.array().cast("array<string>")))
    named = found.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, secret))).otherwise(F.array().cast("array<string>")))
    filled = F.zip_with("found", "new", lambda old, new: F.coalesce(new, old))
    parts = F.zip_with(F.split("text", ANY, -1), F.concat(filled, F.array(F.lit(""))), lambda between, value: F.concat(between, value))
    out = named.withColumn("n", F.size(F.filter("new", lambda x: x.isNotNull()))).withColumn("changed", F.when(F.col("n") > 0, F.array_join(parts, "")))
    changed = {"text": F.col("changed"), "n_chars": F.length("changed").cast("long")}
    old = lambda c: F.col("row").getField(c)
    kept = [F.when(F.col("n") > 0, changed[c]).otherwise(old(c)).alias(c) if c in changed else old(c).alias(c) for c in docs.columns if c != counted]
    return out.select(*kept, *([F.col("n").alias(counted)] if counted else []))
