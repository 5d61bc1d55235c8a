"""Format-preserving pseudonyms for private values, in DataFrame functions alone.

A value is read as a row of symbols, each with its own modulus (a digit 10, a letter 26 within its case, a hex digit
16, an IPv4 octet 256, a date's year, month and day 200, 12 and 31). Rounds of a Feistel network add to the symbols
at even places a keyed function of those at odd places, and the reverse: a permutation of all values of that format,
so equal values get equal pseudonyms in every document, different ones different, and the key's holder can invert
it. Values with inner rules are permuted within the valid ones: a card number's last digit is made anew from the
others; dates and social security numbers are permuted again until they are valid.

Replaced: e-mail addresses (all before the last dot), IPv4 addresses, payment card numbers that pass the Luhn test,
international and North American telephone numbers, valid dates with four-digit years from 1900 to 2099, valid US
social security numbers, IBANs with a right checksum, values after token / password / secret / api key and `=` or
`:`, and access key ids. Numbers that fail their test stay as they are.

Cases: null stays null, empty stays empty; values and texts of any length take time in proportion to it; ties and
repeated rows get the same pseudonyms; an empty table gives an empty table; all columns pass through, whatever their
names, and n_private (long) is added. It counts values that changed: a value that its permutation maps to itself is
not told from one that failed its test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneframe.llm.common import fresh

ROUNDS = 6
FIRST_YEAR, YEARS = 1900, 200
WALK = 64  # a step fails for 2 dates in 5 at most, so all do for none in 1e25; such a value would stay as it is

# a repeated group must be possessive here: Java matches any other with a stack frame a turn
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?=[A-Za-z0-9.\-]*?\.[A-Za-z]{2})[A-Za-z0-9]+(?:[.\-]+[A-Za-z0-9]+)*+"
LABEL = r"(?<![A-Za-z])(?i:token|password|passwd|pwd|secret|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
SECRET = LABEL + r"[A-Za-z0-9+/_\-]{8,}"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w./\-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\w|[./\-]\d)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w|[.\-]\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\w.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w|\.\d)"
HINT = "[0-9@=:]"  # no match of ANY is without one of these
ANY = "|".join([SECRET, EMAIL, ACCESS, IP, DATE, SSN, PHONE, IBAN, CARD])


def _once(value: Column, use) -> Column:
    """use(value), with value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def permute(values: Column, moduli: Column, key: str, kind: str) -> Column:
    """Feistel permutation of an integer array, each place modulo its own modulus (1: the place stays 0)."""

    def turn(now: Column, r: Column) -> Column:
        # hashed once a round, so that a long value takes linear time
        other = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.array_join(F.transform(now, lambda x, i: F.when(i % 2 == r % 2, x.cast("string")).otherwise("")), ",")), 256)
        return _once(
            other,
            lambda o: F.transform(
                F.arrays_zip(now.alias("x"), moduli.alias("m")),
                lambda z, i: F.when((i % 2 == r % 2) | (z["m"] == 1), z["x"]).otherwise(
                    (z["x"] + F.conv(F.substring(F.sha2(F.concat_ws("|", o, i.cast("string")), 256), 1, 12), 16, 10).cast("long")) % z["m"]
                ),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values, turn)


def _mod(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("long")


def _val(c: Column) -> Column:
    low = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
    return F.coalesce(F.ascii(c) - low, F.lit(0)).cast("long")


def _char(c: Column, v: Column) -> Column:
    low = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
    return F.coalesce(F.char(low + v), c)


def by_class(s: Column, key: str, kind: str) -> Column:
    """s with digits, lower and upper case letters permuted within their class; the rest stays."""
    return _once(
        _chars(s),
        lambda cs: _once(
            permute(F.transform(cs, _val), F.transform(cs, _mod), key, kind),
            lambda vs: F.array_join(F.zip_with(cs, vs, _char), ""),
        ),
    )


def by_hex(s: Column, key: str) -> Column:
    digits = F.lit("0123456789abcdef")
    new = _once(_chars(F.lower(s)), lambda cs: permute(F.transform(cs, lambda c: (F.instr(digits, c) - 1).cast("long")), F.transform(cs, lambda c: F.lit(16).cast("long")), key, "hex"))
    text = F.array_join(F.transform(new, lambda v: F.substring(digits, (v + 1).cast("int"), F.lit(1))), "")
    return F.when(s.rlike("[A-F]"), F.upper(text)).otherwise(text)


def _luhn_sum(digits: Column, skip: int) -> Column:
    """Sum of a digit string's digits from the right, every second one doubled; skip 1: starting with a doubled one."""
    return F.aggregate(
        F.transform(_chars(F.reverse(digits)), lambda c, i: F.when((i + skip) % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, x: a + x,
    )


def _fill(template: Column, digits: Column) -> Column:
    """template with its digits replaced in order."""
    done = F.aggregate(
        _chars(template),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
    )
    return done["s"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(s: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = by_class(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        new = _once(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, 1) % 10) % 10).cast("string")))
        return F.when(_luhn_sum(d, 0) % 10 == 0, _fill(s, new)).otherwise(s)

    return _once(_digits(s), of)


def _ip(s: Column, key: str) -> Column:
    return _once(
        F.transform(F.split(s, r"\."), lambda x: x.cast("long")),
        lambda v: F.when(F.exists(v, lambda x: x > 255), s).otherwise(F.array_join(F.transform(permute(v, F.transform(v, lambda _: F.lit(256).cast("long")), key, "ip"), lambda x: x.cast("string")), ".")),
    )


def _valid_day(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= last)


def _walk(values: Column, moduli: list[int], ok, key: str, kind: str) -> Column:
    """Permuted once, then again until ok: a permutation of the values that are ok."""
    mods = F.array(*(F.lit(m).cast("long") for m in moduli))
    first = permute(values, mods, key, kind)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda v, _: F.when(ok(v), v).otherwise(permute(v, mods, key, kind)))
    return _once(last, lambda v: F.when(ok(v), v).otherwise(values))


def _date(s: Column, key: str) -> Column:
    sep = F.regexp_extract(s, "[^0-9]", 0)
    iso = s.rlike("^[0-9]{4}")

    def of(p: Column) -> Column:
        year = F.when(iso, p[0]).otherwise(p[2])
        one, two = F.when(iso, p[1]).otherwise(p[0]), F.when(iso, p[2]).otherwise(p[1])
        day_first = (sep == ".") & ~iso
        plain = F.when(day_first, _valid_day(year, two, one)).otherwise(_valid_day(year, one, two))
        other = F.when(day_first, _valid_day(year, one, two)).otherwise(_valid_day(year, two, one))
        month_day = F.when(day_first == plain, F.array(two, one)).otherwise(F.array(one, two))  # the order that is valid
        kind_other = ~plain
        good = year.between(FIRST_YEAR, FIRST_YEAR + YEARS - 1) & (plain | (other & ~iso))

        def ok(v: Column) -> Column:
            y, m, d = v[0] + FIRST_YEAR, v[1] + 1, v[2] + 1
            return _valid_day(y, m, d) & (~kind_other | (d > 12))  # what was valid in one order only stays so

        def text(v: Column) -> Column:
            y, m, d = (v[0] + FIRST_YEAR).cast("string"), v[1] + 1, v[2] + 1
            month_leads = F.when(day_first, ~plain).otherwise(plain)
            a, b = F.when(month_leads, m).otherwise(d).cast("string"), F.when(month_leads, d).otherwise(m).cast("string")
            wide = F.when(iso | s.rlike("^[0-9]{2}[^0-9][0-9]{2}[^0-9]"), 2).otherwise(1)
            a, b = (F.when((wide == 2) & (F.length(x) < 2), F.concat(F.lit("0"), x)).otherwise(x) for x in (a, b))
            return F.when(iso, F.concat(y, sep, a, sep, b)).otherwise(F.concat(a, sep, b, sep, y))

        new = _walk(F.array(year - FIRST_YEAR, month_day[0] - 1, month_day[1] - 1), [YEARS, 12, 31], ok, key, "date")
        return F.when(good, _once(new, text)).otherwise(s)

    return _once(F.transform(F.split(s, "[^0-9]"), lambda x: x.cast("long")), of)


def _ssn(s: Column, key: str) -> Column:
    def ok(v: Column) -> Column:
        return ~v[0].isin(0, 666) & (v[0] < 900) & (v[1] > 0) & (v[2] > 0)

    def text(v: Column) -> Column:
        return F.concat_ws("-", F.lpad(v[0].cast("string"), 3, "0"), F.lpad(v[1].cast("string"), 2, "0"), F.lpad(v[2].cast("string"), 4, "0"))

    parts = F.transform(F.split(s, "-"), lambda x: x.cast("long"))
    return _once(parts, lambda p: F.when(ok(p), _once(_walk(p, [1000, 100, 10000], ok, key, "ssn"), text)).otherwise(s))


def _rest97(s: Column) -> Column:
    """Remainder by 97 of a string of digits and upper case letters, letters read as 10 to 35."""
    return F.aggregate(
        _chars(s),
        F.lit(0).cast("int"),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + _val(c).cast("int")) % 97).otherwise((a * 100 + _val(c).cast("int") + 10) % 97).cast("int"),
    )


def _iban(s: Column, key: str) -> Column:
    def of(c: Column) -> Column:
        country = F.substring(c, 1, 2)
        body = by_class(F.substring(c, F.lit(5), F.length(c)), key, "iban")

        def made(b: Column) -> Column:
            check = F.lpad((98 - _rest97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            flat = _chars(F.concat(country, check, b))
            spread = F.aggregate(
                _chars(s),
                F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
                lambda a, x: F.when(x == " ", F.struct(F.concat(a["s"], x).alias("s"), a["i"].alias("i"))).otherwise(F.struct(F.concat(a["s"], F.element_at(flat, a["i"])).alias("s"), (a["i"] + 1).alias("i"))),
            )
            return spread["s"]

        good = _rest97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1
        return F.when(good, _once(body, made)).otherwise(s)

    return _once(F.regexp_replace(s, " ", ""), of)


def _secret(s: Column, key: str) -> Column:
    label = F.regexp_extract(s, f"^{LABEL}", 0)
    value = F.substring(s, F.length(label) + 1, F.length(s))
    return F.concat(label, _once(value, lambda v: F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), by_hex(v, key)).otherwise(by_class(v, key, "secret"))))


def pseudonym(s: Column, key: str) -> Column:
    """Of one match of ANY."""
    full = lambda p: s.rlike(f"^(?:{p})$")
    head = F.regexp_extract(s, r"^\+\d{1,3}(?=[^\d])|^", 0)
    return (
        F.when(full(SECRET), _secret(s, key))
        .when(full(EMAIL), F.concat(by_class(F.regexp_extract(s, r"^(.*)\.[^.]*$", 1), key, "email"), F.regexp_extract(s, r"\.[^.]*$", 0)))
        .when(full(ACCESS), F.concat(F.substring(s, 1, 4), by_class(F.substring(s, F.lit(5), F.length(s)), key, "access")))
        .when(full(IP), _ip(s, key))
        .when(full(DATE), _date(s, key))
        .when(full(SSN), _ssn(s, key))
        .when(full(PHONE), F.concat(head, by_class(F.substring(s, F.length(head) + 1, F.length(s)), key, "phone")))
        .when(full(IBAN), _iban(s, key))
        .when(full(CARD), _card(s, key))
        .otherwise(s)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with private values in text_col replaced, and n_private, the number of values replaced."""
    if "n_private" in docs.columns:
        raise ValueError("column n_private is made here; rename yours")
    text = F.col(f"`{text_col}`")
    work = fresh(docs, "_values")  # found and made, in one column whose name no column of docs has
    found = docs.withColumn(work, F.struct(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).alias("found")))
    old = F.col(work)["found"]
    made = found.withColumn(work, F.struct(old.alias("found"), F.when(F.size(old) > 0, F.transform(old, lambda m: pseudonym(m, key))).alias("made")))
    new = F.col(work)["made"]
    # zip_with pads the shorter list with null; the texts between matches are one more than the matches
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    n = F.aggregate(F.zip_with(old, new, lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select(*(F.when(new.isNotNull(), joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), F.coalesce(n, F.lit(0).cast("long")).alias("n_private"))
