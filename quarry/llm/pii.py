"""Private values replaced in place by keyed pseudonyms of the same format. DataFrame functions only.

Validated numbers and dates go through a Feistel network over exactly the values their format allows, split as
Z_a x Z_b: left + F(right) mod a and right + F(left) mod b in turn, F from SHA-256 of the key, the kind, the round
and the half. That is a permutation, so equal values stay linked across documents and different ones stay
different; whoever has the key can undo it.

    kind   found as                                        values permuted
    card   13 to 19 digits, plain or in 4-4-4-4 or 4-6-5,  all digits but the last; the check digit follows
           Luhn-valid
    phone  (234) 567-8901, 234-567-8901, 234.567.8901,     area, exchange and line, valid ones (200 to 999 but N11)
           with +1 or not; +12345678901                    among the valid and others among the others; marks stay
           + and another country's code, 8 to 15 digits    the digits after the country code
    ssn    123-45-6789, of an issued form                  areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999
    ip     four numbers up to 255                          32 bits; written with leading zeros if it was so
    date   2024-02-29, 29/02/2024, 12/25/2024, real days   145,924 days from 1800-01-01; month/day only where it can't
                                                           be day/month, and then among such days

A phone needs a + or an area code in parentheses, or else valid codes. Ten bare digits are no phone: too much else is so.
E-mail addresses and quoted or bare hexadecimal secrets of 32 to 64 digits aren't numbers to permute: keyed SHA-256
gives another of their form. Digits that fail validation, like an order number, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, pick

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![\p{L}\p{N}])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])"
DATE = r"(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
PHONE = r"(?<![\p{L}\p{N}+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}|\+\d{8,15})(?!\d)"
#: Country codes of one and two digits; all others have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\p{L}\p{N}])"
ANY = "|".join((EMAIL, SECRET, DATE, SSN, IP, PHONE, CARD))
#: Where key_of() looks for the secret.
KEY_SETTING = "spark.quarry.pii.key"
KINDS = ("card", "phone", "ssn", "ip", "date", "email", "secret")
ROUNDS, FIRST_DAY, SIDE = 8, "1800-01-01", 382
#: Steps of a walk along the permutation to the next day that can only be month/day; three of five days are such.
WALK = 48


def key_of(spark: SparkSession) -> str:
    """The key that the session or the cluster holds in KEY_SETTING; raises if there is none."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return found


def _mac(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """value, from 0 to a * b - 1, permuted within them. a and b are longs below 2 ** 40."""

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        half = F.when(even, s["r"]).otherwise(s["l"])
        f = F.conv(F.substring(_mac(key, F.lit(kind), a, b, r, half), 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(f, a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(f, b), b)).alias("r"),
        )

    start = F.struct(value.cast("long").__mod__(a).alias("l"), F.floor(value.cast("decimal(20,0)") / a.cast("decimal(20,0)")).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] + a * s["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _tens(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def _digit_feistel(digits: Column, key: str, kind: str) -> Column:
    n = F.length(digits)
    low = F.floor(n / F.lit(2)).cast("int")
    return F.lpad(feistel(digits.cast("long"), _tens(low), _tens(n - low), key, kind).cast("string"), n, F.lit("0"))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum over digits from the right; those at places of this parity (0: the last) are doubled."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(F.pmod(i, F.lit(2)) == doubled, F.lit(2) * c.cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by these in turn."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["s"], F.when(digit, F.substr(digits, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), start, step, lambda a: a["s"])


def _month_first(m: Column) -> Column:
    """Whether a date with slashes can only be month/day."""
    return m.contains("/") & (F.substring(m, 4, 2) > "12")


def _date_of(m: Column) -> Column:
    form = lambda x: F.try_to_date(m, x) if hasattr(F, "try_to_date") else F.try_to_timestamp(m, F.lit(x)).cast("date")
    return F.when(~m.contains("/"), form("yyyy-MM-dd")).when(_month_first(m), form("MM/dd/yyyy")).otherwise(form("dd/MM/yyyy"))


def _code(c: Column) -> Column:
    """valid: whether an area or exchange code is 200 to 999 but N11; i: its place among the 792 valid ones or the 208 others."""
    tail = F.pmod(c, F.lit(100))
    good = (c >= 200) & (tail != 11)
    place = F.when(good, F.floor(c / F.lit(100) - 2) * 99 + tail - (tail > 11).cast("long")).when(c < 200, c).otherwise(F.lit(198) + F.floor(c / F.lit(100)))
    return F.struct(good.alias("valid"), place.cast("long").alias("i"))


def _code_at(valid: Column, i: Column) -> Column:
    tail = F.pmod(i, F.lit(99))
    good = F.floor(i / F.lit(99)) * 100 + 200 + tail + (tail >= 11).cast("long")
    return F.lpad(F.when(valid, good).when(i < 200, i).otherwise((i - 198) * 100 + 11).cast("long").cast("string"), 3, "0")


def _national(m: Column) -> Column:
    """The digits that are permuted: after the country code, if there is a +."""
    return F.when(m.startswith("+"), F.regexp_replace(_digits(m), COUNTRY, "")).otherwise(_digits(m))


def _is_phone(m: Column) -> Column:
    valid = lambda i: _code(F.substring(_digits(m), i, 3).cast("long"))["valid"]
    n = F.length(_digits(m))
    return F.when(m.startswith("+"), (n >= 8) & (n <= 15)).otherwise(m.contains("(") | (valid(1) & valid(4)))


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY, null if it isn't valid."""
    d = _digits(m)
    days = F.datediff(_date_of(m), F.lit(FIRST_DAY).cast("date"))
    octets = F.split(m, r"\.")
    area, group, serial = (F.substring(d, i, n) for i, n in ((1, 3), (4, 2), (6, 4)))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[0-9a-fA-F]{32,64}$"), "secret")
        .when(m.rlike(f"^(?:{DATE})$"), F.when((days >= 0) & (days < SIDE * SIDE), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when((area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000"), "ssn"))
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(m.rlike(f"^(?:{CARD})$"), F.when(F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, "card"))
        .when(_is_phone(m), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The replacement of a match of this kind; the match itself where kind is null."""
    d = _digits(m)

    def card() -> Column:
        body = let(F.substring(d, 1, 99), lambda x: _digit_feistel(F.substr(x, F.lit(1), F.length(x) - 1), key, "card"))
        return let(body, lambda b: _refill(m, F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string"))))

    def phone() -> Column:
        """Ten digits after +1, or without a country code, are area, exchange and line; others are permuted as they are."""
        n = _national(m)
        lead = F.substr(d, F.lit(1), F.length(d) - F.length(n))
        own = (F.length(n) == 10) & lead.isin("", "1")

        def parts(x: Column) -> Column:
            area, exchange = x["area"], x["exchange"]
            # with a valid area its exchange stays valid or not; with another one the exchange is any three digits
            wide = F.when(~area["valid"], F.lit(1000)).when(exchange["valid"], F.lit(792)).otherwise(F.lit(208)).cast("long")
            inner = F.when(area["valid"], exchange["i"]).otherwise(F.substring(n, 4, 3).cast("long"))
            a = F.when(area["valid"], F.lit(792)).otherwise(F.lit(208)).cast("long") * wide
            moved = feistel(area["i"] * wide + inner + a * F.substring(n, 7, 4).cast("long"), a, F.lit(10_000).cast("long"), key, "phone")

            def shown(v: Column) -> Column:
                code = v % a
                exchange_at = F.when(area["valid"], _code_at(exchange["valid"], F.pmod(code, wide))).otherwise(F.lpad(F.pmod(code, wide).cast("string"), 3, "0"))
                return F.concat(_code_at(area["valid"], F.floor(code / wide).cast("long")), exchange_at, F.lpad(F.floor(v / a).cast("long").cast("string"), 4, "0"))

            return let(moved, shown)

        ten = let(F.struct(_code(F.substring(n, 1, 3).cast("long")).alias("area"), _code(F.substring(n, 4, 3).cast("long")).alias("exchange")), parts)
        other = let(n, lambda x: _digit_feistel(x, key, "phone"))
        return let(F.concat(lead, F.when(own, ten).otherwise(other)), lambda x: _refill(m, x))

    def ssn() -> Column:
        area = F.substring(d, 1, 3).cast("long")
        index = (area - F.when(area > 666, 2).otherwise(1)) * 99 + F.substring(d, 4, 2).cast("long") - 1
        a, b = F.lit(898 * 99).cast("long"), F.lit(9999).cast("long")
        moved = feistel(index + a * (F.substring(d, 6, 4).cast("long") - 1), a, b, key, "ssn")

        def shown(x: Column) -> Column:
            i = F.floor((x % a) / F.lit(99)).cast("long")
            parts = ((i + F.when(i >= 665, 2).otherwise(1), 3), (x % a % 99 + 1, 2), (F.floor(x / a).cast("long") + 1, 4))
            return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])

        return let(moved, shown)

    def ip() -> Column:
        value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
        side = F.lit(65536).cast("long")
        padded = m.rlike(r"(^|\.)0\d")
        part = lambda x, k: F.pmod(F.shiftright(x, 8 * k), F.lit(256)).cast("string")
        shown = lambda x: F.concat_ws(".", *[F.when(padded, F.lpad(part(x, k), 3, "0")).otherwise(part(x, k)) for k in (3, 2, 1, 0)])
        return let(feistel(value, side, side, key, "ip"), shown)

    def date() -> Column:
        side = F.lit(SIDE).cast("long")
        move = lambda x: feistel(x, side, side, key, "date")
        day = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))
        start = F.datediff(_date_of(m), F.lit(FIRST_DAY).cast("date")).cast("long")

        def walk(s: Column, _: Column) -> Column:
            return F.when(s["done"], s).otherwise(let(move(s["x"]), lambda x: F.struct(x.alias("x"), (F.dayofmonth(day(x)) > 12).alias("done"))))

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("x"), F.lit(False).alias("done")), walk, lambda s: s["x"])
        moved = F.when(_month_first(m), walked).otherwise(move(start))
        return let(day(moved), lambda x: F.when(_month_first(m), F.date_format(x, "MM/dd/yyyy")).when(m.contains("/"), F.date_format(x, "dd/MM/yyyy")).otherwise(F.date_format(x, "yyyy-MM-dd")))

    secret = let(F.substr(F.concat(_mac(key, F.lit("secret"), F.lower(m))), F.lit(1), F.length(m)), lambda x: F.when(m == F.upper(m), F.upper(x)).otherwise(x))
    email = F.concat(F.lit("user."), F.substring(_mac(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@mail.invalid"))
    out = F.when(kind == "email", email).when(kind == "secret", secret)
    for name, made in (("card", card), ("phone", phone), ("ssn", ssn), ("ip", ip), ("date", date)):
        out = out.when(kind == name, made())
    return out.otherwise(m)


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with private values replaced, n_found, and n_<kind> for each kind: a row for each row.

    Null text stays null with no values. Texts without a digit or @ are passed on unread. Other columns are
    left out. Empty tables give an empty result. Raises ValueError without a key: with a known one the values can be undone.
    The key is part of the plan; spark.redaction.string.regex keeps it out of logs.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    rows = pick(docs, doc_id=doc_id, text=text)
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    swapped = F.transform(found, lambda m: let(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("new"))))

    def rebuilt(s: Column) -> Column:
        pieces = F.split(F.col("text"), ANY)
        count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
        joined = F.array_join(F.flatten(F.zip_with(pieces, s, lambda p, x: F.array(p, F.coalesce(x["new"], F.lit(""))))), "")
        return F.struct(
            F.when(F.size(s) == 0, F.col("text")).otherwise(joined).alias("text"),
            *[count(k).alias(f"n_{k}") for k in KINDS],
        )

    out = rows.select(F.col("doc_id").cast("long").alias("doc_id"), let(swapped, rebuilt).alias("r"))
    total = F.lit(0).cast("long")
    for k in KINDS:
        total = total + F.col(f"r.n_{k}")
    return out.select("doc_id", F.col("r.text").alias("text"), total.alias("n_found"), *[F.col(f"r.n_{k}").alias(f"n_{k}") for k in KINDS])
