"""PII: format-preserving Feistel pseudonyms for validated numbers and dates; DataFrame functions only.

Found are e-mail addresses, IPv4 addresses, dates (ISO, or day, month and year in either order with points or strokes),
IBANs, payment cards and phone numbers. What passes its check (octets up to 255, days of the calendar from 1900 to
2099, remainder 1 modulo 97, Luhn sum, number of digits) is replaced by a keyed permutation of the values of its
format: a Feistel network over the two halves of the value, whose rounds add a keyed SHA-256 of one half to the
other, modulo the number of values that half can have. Signs, lengths and check digits stay right, so a pseudonym
passes the same checks. Equal values have equal pseudonyms in all documents, however they are punctuated; with the
key the permutation can be undone, which finds a value again unless its pseudonym passes a check together with
digits beside it.

An IBAN has the length of its country. Where a run of digit groups fails as a whole, the first longest part of whole
groups that is a card is taken, else the first longest that is a phone number. Runs are matched up to 19 digits, so a
card that begins in a run of more digits and ends behind its 19th is not found.

Defined results: a null text stays null; texts without findings stay as they are; a match that fails its check stays and
isn't counted. Repeated rows are treated alike. Extra columns pass through. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import bound, materialised

ROUNDS = 10
KEY = "pseudonyms-1"
KINDS = ("email", "ip", "date", "iban", "card", "phone")
#: Days of 1900 to 2099 are 17 * 4297, so a day has two halves without remainder.
DAY_ONE, DAYS = "1900-01-01", (17, 4297)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(n: int, countries: str) -> str:
    groups, rest = divmod(n - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "ip": r"(?<![\dA-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?<![\dA-Za-z])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)",
    "iban_of_country": rf"(?<![\dA-Za-z])(?:{'|'.join(_iban_of(*x) for x in IBAN_LENGTHS.items())})(?![A-Za-z0-9])",
    "iban": r"(?<![\dA-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "dotted": r"(?<![\dA-Za-z.])(?:\+?\d{1,3}\.)?\d{3}\.\d{3}\.\d{4}(?!\d|\.\d)",
    "number": r"(?<![\dA-Za-z])\+?\(?\d(?:[ ()-]{0,2}\d){7,18}(?!\d)",
}
ANY = "|".join(PATTERNS.values())
DOTTED = r"^(\+?\d{1,3}\.)?\d{3}\.\d{3}\.\d{4}$"
#: Characters of a block that is permuted at once.
LETTERS, DIGITS = 20, 30


def _round_value(key: Column, kind: str, i: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", key, F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of the pairs of ``a`` below ``size_a`` and ``b`` below ``size_b``, as a struct ``a, b``."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(s, i):
        value = lambda half: _round_value(key, kind, i, half)
        add = lambda x, y, size: F.pmod(x - F.pmod(y, size) if undo else x + F.pmod(y, size), size)
        left = F.struct(add(s["a"], value(s["b"]), size_a).alias("a"), s["b"].alias("b"))
        right = F.struct(s["a"].alias("a"), add(s["b"], value(s["a"]), size_b).alias("b"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(rounds, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("bigint"), lambda p, i: F.when(i > 0, p * base).otherwise(p))


def permuted_digits(digits: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of the strings of as many digits (up to 30)."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    value = lambda s: F.when(F.length(s) == 0, F.lit(0).cast("bigint")).otherwise(s.cast("bigint"))
    pair = feistel(value(F.left(digits, u)), value(F.right(digits, n - u)), _power(10, u), _power(10, n - u), key, kind, undo)
    part = lambda x, k: F.when(k > 0, F.lpad(x.cast("string"), k, "0")).otherwise("")
    return bound(pair, lambda p: F.concat(part(p["a"], u), part(p["b"], n - u)))


def _letters(s: Column) -> Column:
    """Lower-case letters as a number to the base 26."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda v, c: v * 26 + (F.ascii(c) - 97))


def _as_letters(v: Column, n: Column) -> Column:
    done = F.aggregate(
        F.sequence(F.lit(0), n), F.struct(v.alias("v"), F.lit("").alias("s")),
        lambda s, i: F.when(i == 0, s).otherwise(F.struct(((s["v"] - s["v"] % 26) / 26).cast("bigint").alias("v"), F.concat(F.char((s["v"] % 26 + 97).cast("int")), s["s"]).alias("s"))),
    )
    return done["s"]


def permuted_letters(letters: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of the strings of as many lower-case letters (up to 20)."""
    n = F.length(letters)
    u = F.floor(n / 2).cast("int")
    pair = feistel(_letters(F.left(letters, u)), _letters(F.right(letters, n - u)), _power(26, u), _power(26, n - u), key, kind, undo)
    return bound(pair, lambda p: F.concat(_as_letters(p["a"], u), _as_letters(p["b"], n - u)))


def _by_blocks(chars: Column, width: int, permuted) -> Column:
    """``chars`` with every block of up to ``width`` characters permuted."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(chars) - 1, F.lit(0)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: bound(F.substr(chars, i + 1, F.lit(width)), permuted)), "")


def _refilled(shape: Column, chars: Column, wanted: str) -> Column:
    """``shape`` with the characters that ``wanted`` matches replaced, in order, by ``chars``; letters keep their case."""

    def fill(new):
        put = lambda s: F.substr(new, s["i"] + 1, F.lit(1))
        return F.aggregate(
            F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
            lambda s, c: F.when(
                c.rlike(wanted), F.struct(F.concat(s["out"], F.when(c.rlike("[A-Z]"), F.upper(put(s))).otherwise(put(s))).alias("out"), (s["i"] + 1).alias("i"))
            ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))),
            lambda s: s["out"],
        )

    return bound(chars, fill)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last of which counts once."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") < 5, c.cast("int") * 2).otherwise(c.cast("int") * 2 - 9)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    )


def _date_of(m: Column) -> tuple[Column, Column]:
    """The day of a written date, and the pattern it is written in."""
    forms = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy")]
    day, form = F.lit(None).cast("date"), F.lit(None).cast("string")
    for start, pattern in forms:
        parsed = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
        day, form = F.when(m.rlike(start), parsed).otherwise(day), F.when(m.rlike(start), F.lit(pattern)).otherwise(form)
    # strokes: month first if that is a day of the calendar, else day first
    other = F.when(m.rlike(r"^\d{2}/"), F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).cast("date"))
    return F.coalesce(day, other), F.when(day.isNull() & other.isNotNull(), F.lit("dd/MM/yyyy")).otherwise(form)


def kind_of(m: Column) -> Column:
    """The kind of a match that passes its check, else null."""
    n = F.length(_digits(m))
    day, _ = _date_of(m)
    octets = F.transform(F.split(m, r"\."), lambda o: F.when(F.length(o) <= 3, o.cast("int")))
    plain = F.replace(m, F.lit(" "))
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o <= 255), F.lit("ip")))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), F.when(F.year(day).between(1900, 2099), F.lit("date")))
        .when(m.rlike("^[A-Z]{2}"), F.when(F.length(plain).between(15, 34) & (_mod97(plain) == 1), F.lit("iban")))
        .when(m.rlike(DOTTED), F.lit("phone"))
        .when(_is_card(m), F.lit("card"))
        .when(_is_phone(m), F.lit("phone"))
    )


def _is_card(m: Column) -> Column:
    return F.length(_digits(m)).between(13, 19) & ~F.startswith(m, F.lit("+")) & (luhn_sum(_digits(m)) % 10 == 0)


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15) & (F.startswith(m, F.lit("+")) | m.rlike(r"\d[ ()-]+\d+[ ()-]+\d"))


def _shorter(m: Column) -> Column:
    """The beginnings of a match that end with a word, the longest first."""

    def beginnings(words):
        n = F.size(words)
        text = lambda i, j: F.array_join(F.slice(words, i, j - i + 1), " ")
        each = lambda j: F.struct(F.lit("").alias("before"), text(F.lit(1), j).alias("body"), F.concat(F.lit(" "), text(j + 1, n)).alias("after"))
        return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), each))

    return bound(F.split(m, " "), beginnings)


def part_of(m: Column) -> Column:
    """What a match that fails its check begins with, the part of it that passes one, and the rest; null without one."""

    def longest(groups):
        n = F.size(groups)
        text = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")

        def part(i, j):
            lead = F.regexp_extract(text(i, j), "^[ )-]*", 0)
            before = F.concat(F.when(i > 1, text(F.lit(1), i - 1)).otherwise(""), lead)
            body = F.substr(text(i, j), F.length(lead) + 1)
            return F.struct(before.alias("before"), body.alias("body"), F.when(j < n, text(j + 1, n)).otherwise("").alias("after"))

        parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(n, i, F.lit(-1)), lambda j: part(i, j))))
        good = lambda check: lambda all_: F.get(F.filter(all_, lambda x: check(x["body"])), 0)
        return F.when(n > 1, bound(parts, lambda x: F.coalesce(good(_is_card)(x), good(_is_phone)(x))))

    iban = F.filter(_shorter(m), lambda x: (F.length(F.replace(x["body"], F.lit(" "))).between(15, 34)) & (_mod97(F.replace(x["body"], F.lit(" "))) == 1))
    return F.when(m.rlike(r"^\+?\(?\d[\d ()-]*$"), bound(F.regexp_extract_all(m, F.lit(r"[ ()+-]*\d+"), F.lit(0)), longest)).when(m.rlike("^[A-Z]{2}"), F.get(iban, 0))


def pseudonym(m: Column, kind: Column, key: Column, undo: bool = False) -> Column:
    """The pseudonym of a match of a kind, or the match itself if it has none."""
    digits, plain = _digits(m), F.replace(m, F.lit(" "))
    local, domain = F.substring_index(m, "@", 1), F.substr(m, F.length(F.substring_index(m, "@", 1)) + 1)
    name = _refilled(local, _by_blocks(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), LETTERS, lambda x: permuted_letters(x, key, "name", undo)), "[A-Za-z]")
    email = F.concat(_refilled(name, _by_blocks(_digits(local), DIGITS, lambda x: permuted_digits(x, key, "mail", undo)), "[0-9]"), domain)

    octet = F.transform(F.split(m, r"\."), lambda o: F.when(F.length(o) <= 3, o.cast("int")))
    half = F.lit(65536).cast("bigint")
    pair = feistel(F.get(octet, 0) * 256 + F.get(octet, 1), F.get(octet, 2) * 256 + F.get(octet, 3), half, half, key, "ip", undo)
    ip = bound(pair, lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)]))

    day, form = _date_of(m)
    number = F.datediff(day, F.lit(DAY_ONE).cast("date"))
    of_day = feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]).cast("bigint"), F.lit(DAYS[1]).cast("bigint"), key, "date", undo)
    new_day = bound(of_day, lambda d: F.date_add(F.lit(DAY_ONE).cast("date"), (d["a"] * DAYS[1] + d["b"]).cast("int")))
    date = F.lit(None).cast("string")
    for pattern in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"):
        date = F.when(form == pattern, F.date_format(new_day, pattern)).otherwise(date)

    account = F.substr(plain, F.lit(5))
    new_account = _refilled(account, permuted_digits(F.left(_digits(account), F.lit(30)), key, "iban", undo), "[0-9]")
    check = lambda a: F.lpad((98 - _mod97(F.concat(F.left(plain, F.lit(2)), F.lit("00"), a))).cast("string"), 2, "0")
    iban = _refilled(m, bound(new_account, lambda a: F.concat(F.left(plain, F.lit(2)), check(a), a)), "[A-Z0-9]")

    middle = F.concat(F.left(digits, F.lit(1)), permuted_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card", undo))
    last = lambda x: F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = _refilled(m, bound(middle, lambda x: F.concat(x, last(x))), "[0-9]")

    phone = _refilled(m, F.concat(F.left(digits, F.lit(1)), permuted_digits(F.substr(digits, F.lit(2)), key, "phone", undo)), "[0-9]")

    out = m
    for k, value in {"email": email, "ip": ip, "date": date, "iban": iban, "card": card, "phone": phone}.items():
        out = F.when(kind == k, value).otherwise(out)
    return out


#: Names of own columns beside those of any table.
FOUND, PARTS, KIND = "__llm_found", "__llm_parts", "__llm_kinds"


def with_pseudonyms(docs: DataFrame, key: str = KEY, undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and the kinds found, in text order, as :data:`KIND`."""
    text = docs["text"].cast("string")
    has = text.rlike(ANY)
    found = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = materialised(docs, found.alias(FOUND), F.when(has, F.split(text, ANY, -1)).alias(PARTS))
    secret = F.lit(key)
    whole = lambda m: F.struct(F.lit("").alias("before"), m.alias("body"), F.lit("").alias("after"))
    rows = materialised(rows, F.transform(FOUND, lambda m: F.when(kind_of(m).isNull(), F.coalesce(part_of(m), whole(m))).otherwise(whole(m))).alias(f"{FOUND}_cut"))
    rows = materialised(rows, F.transform(f"{FOUND}_cut", lambda x: kind_of(x["body"])).alias(f"{KIND}_all"))
    new = F.zip_with(f"{FOUND}_cut", f"{KIND}_all", lambda x, k: F.concat(x["before"], pseudonym(x["body"], k, secret, undo), x["after"]))
    rows = materialised(rows, new.alias(f"{FOUND}_new"), F.array_compact(f"{KIND}_all").alias(KIND))
    joined = F.array_join(F.zip_with(PARTS, F.array_append(f"{FOUND}_new", F.lit("")), lambda p, m: F.concat(p, m)), "")
    new = F.when(F.size(FOUND) == 0, F.col("text")).otherwise(joined)
    return rows.select(*[new.alias(c) if c == "text" else F.col(c) for c in docs.columns], KIND)


def _is(kind: str):
    return lambda x: x == kind


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonyms, and how many values of each kind were replaced."""
    out = with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *[F.size(F.filter(KIND, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS], "text")
