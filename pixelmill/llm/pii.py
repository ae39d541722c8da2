"""Format-preserving pseudonyms for personal data, in column expressions only.

Numbers and dates that pass validation are permuted by a keyed Feistel network within their own format: a card
number becomes another that passes its check digit, a date another date, an address another address. The network is a
bijection, so equal values get equal pseudonyms in every document and unequal values unequal ones. E-mail addresses
and secrets, which have no fixed domain, get a keyed digest in their form.

Null text stays null. Text without a match is returned as it is, byte for byte. Every other column is kept.
The key is part of the query plan: keep plans and event logs as secret as the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> pattern; the first that matches at a place wins. Possessive runs keep each linear in the text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_+/=-]{0,40}\d)[A-Za-z0-9_+/=-]{16,}+[\"']?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "phone": r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 10


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's variable, not an expression copied to each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _draw(key: str, tag: str, i: Column, x: Column, below: Column) -> Column:
    """A keyed round value in [0, below)."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{tag}|"), i.cast("string"), F.lit("|"), below.cast("string"), F.lit("|"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % below


def feistel(value: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of [0, a*b): value = left*b + right; each round adds a draw to one half."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = (s["l"] + _draw(key, tag, i, s["r"], a)) % a
        return F.struct(left.alias("l"), ((s["r"] + _draw(key, tag, i + ROUNDS, left, b)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the strings of as many digits, 2 to 18 of them; the halves are permuted as integers."""
    return _let(digits, lambda d: _let(F.floor(F.length(d) / 2).cast("int"), lambda half: _let(F.length(d), lambda n: _permuted(d, half, n, key, tag))))


def _permuted(digits: Column, half: Column, n: Column, key: str, tag: str) -> Column:
    ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    left, right = F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1, n - half).cast("long")
    start = F.struct(left.alias("l"), right.alias("r"))
    a, b = ten(half), ten(n - half)

    def step(s: Column, i: Column) -> Column:
        new = (s["l"] + _draw(key, tag, i, s["r"], a)) % a
        return F.struct(new.alias("l"), ((s["r"] + _draw(key, tag, i + ROUNDS, new, b)) % b).alias("r"))

    join = lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, join)


def _digit(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1)).cast("int")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum with the last digit as check digit."""
    return _let(digits, _luhn)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = _digit(digits, n - i + 1)
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _poured(match: Column, digits: Column) -> Column:
    """match with its digits replaced, in order."""
    return _let(digits, lambda d: _pour(match, d))


def _pour(match: Column, digits: Column) -> Column:
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        return F.struct((s["at"] + is_digit.cast("int")).alias("at"), F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(match, ""), start, step, lambda s: s["out"])


def _check(body: Column) -> Column:
    return (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted. How far the last is from the check digit is kept: valid stays valid,
    and a number without a valid check digit keeps its link too."""

    def changed(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        off = (_digit(d, F.length(d)) - _check(body) + 10) % 10
        return _let(permute_digits(body, key, "card"), lambda b: F.concat(b, ((_check(b) + off) % 10).cast("string")))

    return _poured(m, _let(F.regexp_replace(m, r"\D", ""), changed))


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, r"^(\+\d{1,3}[ .(-]+|\+1(?=\d)|)", 1)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _poured(rest, permute_digits(F.regexp_replace(rest, r"\D", ""), key, "phone")))


def _ssn(m: Column, key: str) -> Column:
    return _poured(m, permute_digits(F.regexp_replace(m, r"\D", ""), key, "ssn"))


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    new = feistel(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    return _let(new, lambda x: F.concat_ws(".", *(F.shiftright(x, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0))))


def _date(m: Column, key: str) -> Column:
    """A day of 1900 to 2099 (17 * 4297 days) becomes another; what is no such day is permuted by its digits."""
    part = F.split(m, "[-/.]")
    iso, slash = m.contains("-"), m.contains("/")
    p = [F.lpad(F.element_at(part, k), 2, "0") for k in (1, 2)]
    day_first = ~iso & (~slash | (F.element_at(part, 1).cast("int") > 12))
    text = F.when(iso, m).when(day_first, F.concat_ws("-", F.element_at(part, 3), p[1], p[0])).otherwise(F.concat_ws("-", F.element_at(part, 3), p[0], p[1]))
    day = text.try_cast("date")
    old = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    moved = F.date_add(F.lit("1900-01-01").cast("date"), feistel(old, F.lit(17).cast("long"), F.lit(4297).cast("long"), key, "date").cast("int"))
    shape = _let(moved, lambda new: F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(~slash, F.date_format(new, "dd.MM.yyyy")).when(day_first, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy")))
    inside = F.coalesce((old >= 0) & (old < 17 * 4297), F.lit(False))
    return F.when(inside, shape).otherwise(_poured(m, permute_digits(F.regexp_replace(m, r"\D", ""), key, "day")))


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike(r"\d"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(value(c) > 9, acc * 100 + value(c)).otherwise(acc * 10 + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    """The account's digits are permuted in runs of up to 16; the two check digits follow from the result."""
    run = lambda s, tag: F.when(F.length(s) >= 2, permute_digits(s, key, tag)).otherwise(s)
    land = F.substr(m, F.lit(1), F.lit(2))

    def changed(body: Column) -> Column:
        old = F.regexp_replace(body, r"\D", "")
        new = _poured(body, F.concat(run(F.substr(old, F.lit(1), F.lit(16)), "iban1"), run(F.substr(old, F.lit(17), F.lit(20)), "iban2")))
        checked = lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), F.regexp_replace(b, r"\D", ""))
        return _let(new, checked)

    flat = F.replace(m, F.lit(" "), F.lit(""))
    digits = _let(F.substr(flat, F.lit(5), F.length(flat)), changed)
    return F.concat(land, _poured(F.substr(m, F.lit(3), F.length(m)), digits))


def _email(m: Column, key: str) -> Column:
    """The address as a whole decides the pseudonym, whatever its case."""
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    """The name and the quotes stay; the value becomes digest characters, as many as it had up to 64."""
    shape = r"^([^=:]*[=:]\s*[\"']?)(.*?)([\"']?)$"
    value = F.regexp_extract(m, shape, 2)
    digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), value), 256)
    return F.concat(F.regexp_extract(m, shape, 1), F.substr(digest, F.lit(1), F.least(F.length(value), F.lit(64))), F.regexp_extract(m, shape, 3))


_MAKE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonym(match: Column, key: str) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, _MAKE[kind](match, key)) if out is None else out.when(test, _MAKE[kind](match, key))
    return out.otherwise(F.lit("#"))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """df with its text's personal data replaced; count_col, if given, gets the number of replacements."""
    t = df[text_col].cast("string")
    may = t.rlike(r"[0-9@]")  # every pattern has a digit or an @
    df = df.withColumn("_pm_found", F.when(may, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    found = F.col("_pm_found")
    pieces = F.arrays_zip(F.split(t, ANY, -1).alias("gap"), found.alias("hit"))
    new = F.array_join(F.transform(pieces, lambda x: F.concat(F.coalesce(x["gap"], F.lit("")), F.when(x["hit"].isNull(), F.lit("")).otherwise(pseudonym(x["hit"], key)))), "")
    df = df.withColumn(text_col, F.when(F.size(found) > 0, new).otherwise(F.col(text_col)))
    if count_col:
        df = df.withColumn(count_col, F.when(F.size(found) > 0, F.size(found)).otherwise(0).cast("long"))
    return df.drop("_pm_found")
