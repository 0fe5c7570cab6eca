"""Operator 8: format-preserving Feistel pseudonyms for personal data.

Values are found by patterns and validated: payment cards (13 to 19 digits,
Luhn; also as some of the digit groups of a longer run), social security numbers (no impossible area, group or serial), IPv4
addresses (octets up to 255), dates (a day that exists, years 1800 to 2199)
and telephone numbers.  Each is ranked within the set of its format's valid
values, split into a pair (x, y) of Z_a x Z_b, and permuted by a keyed Feistel
network: x += F(y) mod a, y += F(x) mod b, ``ROUNDS`` times, F from SHA-256
of the key.  The result is again a valid value of the same format with the
same punctuation, and equal values get equal pseudonyms in all documents,
however they are punctuated.  The same key undoes it.

E-mail addresses and secrets (access keys, hexadecimal tokens, passwords) have
no such rank; they get keyed hash text of the same length and alphabet.

Everything is DataFrame expressions on a row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 5
#: days of the 400 years from 1800-01-01, = 189 * 773
EPOCH, DAYS_A, DAYS_B = "1800-01-01", 189, 773

#: every pattern starts at a run's beginning or is bounded, so that a scan is
#: linear in the text's length; no group repeats without a bound, which the
#: matcher would do by recursion, a stack frame each time.  A domain name has
#: at most 127 labels of up to 63 characters.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}+[A-Za-z]{2,63}+"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
PASSWORD = r"(?<=(?i:password=))[^\s\"']+"
TOKEN = r"(?<![0-9A-Za-z])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: one group, or groups as on a card
PRINTED = r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: digit groups that may hold a card: a run of any length (13 digits at least)
#: that ends at a boundary, else up to 19 digits
RUN = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]{11,}[0-9](?![0-9A-Za-z@_%+]|\.[0-9])|" + CARD
OTHERS = "|".join([EMAIL, ACCESS_KEY, PASSWORD, TOKEN, PHONE, IPV4, DATE, SSN])
ANY = f"{OTHERS}|{RUN}"
#: what a text with a match has at least
HINT = "[0-9@]|(?i:password=)|AKIA|[A-Fa-f]{32}"


def _digest(key: str, tweak: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]).cast("binary"), 256)


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tweak: str, back: bool = False) -> Column:
    """struct(x, y): the pair permuted in Z_a x Z_b; ``back`` undoes it."""
    def f(step: Column, side: str, value: Column, mod: Column) -> Column:
        return F.conv(F.substring(_digest(key, f"{tweak}{side}", step, value, mod), 1, 15), 16, 10).cast("bigint") % mod

    def forth(s: Column, k: Column) -> Column:
        return F.transform(F.array(F.pmod(s.x + f(k, "x", s.y, a), a)), lambda n: F.struct(
            n.alias("x"), F.pmod(s.y + f(k, "y", n, b), b).alias("y")
        ))[0]

    def undo(s: Column, k: Column) -> Column:
        return F.transform(F.array(F.pmod(s.y - f(k, "y", s.x, b), b)), lambda n: F.struct(
            F.pmod(s.x - f(k, "x", n, a), a).alias("x"), n.alias("y")
        ))[0]

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(F.reverse(steps) if back else steps, start, undo if back else forth)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def fill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(
        F.concat(s.out, F.substring(digits, s.at, F.lit(1))).alias("out"), (s.at + 1).alias("at")
    )).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.at.alias("at")))
    return F.aggregate(F.split(pattern, ""), start, put, lambda s: s.out)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permute_digits(digits: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A digit string (2 to 36 digits) permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    pair = feistel(
        F.substring(digits, F.lit(1), half).cast("bigint"), F.substring(digits, half + 1, n).cast("bigint"),
        _ten_to(half), _ten_to(n - half), key, tweak, back,
    )
    return _let(pair, lambda p: F.concat(F.lpad(p.x.cast("string"), half, "0"), F.lpad(p.y.cast("string"), n - half, "0")))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    places = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.element_at(F.array(*[F.lit(2 * d // 10 + 2 * d % 10) for d in range(10)]), c.cast("int") + 1)
        )), F.lit(0), lambda s, d: s + d,
    )


def _card(digits: Column, key: str, back: bool) -> Column:
    inner = permute_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card", back)
    return _let(F.concat(F.substring(digits, 1, 1), inner), lambda d: F.concat(
        d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")
    ))


def _ssn(digits: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    rank = F.when(area < 666, area - 1).otherwise(area - 2)
    pair = feistel(rank, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", back)
    return _let(pair, lambda p: F.concat(
        F.lpad((p.x + F.when(p.x < 665, 1).otherwise(2)).cast("string"), 3, "0"),
        F.lpad((F.floor(p.y / 9999) + 1).cast("string"), 2, "0"), F.lpad((p.y % 9999 + 1).cast("string"), 4, "0"),
    ))


def _ipv4(v: Column, key: str, back: bool) -> Column:
    part = F.split(v, "\\.")
    octet = lambda i: part[i].cast("bigint")
    pair = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ip", back)
    return _let(pair, lambda p: F.concat_ws(
        ".", *[x.cast("string") for x in (F.floor(p.x / 256), p.x % 256, F.floor(p.y / 256), p.y % 256)]
    ))


def _ymd(v: Column) -> Column:
    return F.when(v.contains("-"), _digits(v)).otherwise(
        F.concat(F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))
    )


def _day(ymd: Column) -> Column:
    """The day, by its month's first day and an offset (never fails)."""
    month = F.greatest(F.least(F.substring(ymd, 5, 2).cast("int"), F.lit(12)), F.lit(1))
    year = F.greatest(F.substring(ymd, 1, 4).cast("int"), F.lit(1))
    return F.date_add(F.make_date(year, month, F.lit(1)), F.substring(ymd, 7, 2).cast("int") - 1)


def _date(v: Column, key: str, back: bool) -> Column:
    rank = F.datediff(_day(_ymd(v)), F.lit(EPOCH).cast("date"))
    pair = feistel(F.floor(rank / DAYS_B), rank % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), key, "date", back)
    return _let(pair, lambda p: _let(
        F.date_add(F.lit(EPOCH).cast("date"), (p.x * DAYS_B + p.y).cast("int")),
        lambda d: F.when(v.contains("-"), F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd.MM.yyyy")),
    ))


def _phone(v: Column, key: str, back: bool) -> Column:
    """The country code stays; the rest is permuted."""
    code = F.when(v.startswith("+"), F.regexp_extract(v, r"^\+([17]|[0-9]{1,3}(?=[ .(-])|[0-9]{2})", 1)).otherwise(F.lit(""))
    return _let(code, lambda c: F.concat(
        F.when(v.startswith("+"), F.lit("+")).otherwise(F.lit("")), c,
        _let(F.substring(v, F.length(c) + F.when(v.startswith("+"), 2).otherwise(1), F.length(v)),
             lambda rest: fill(rest, permute_digits(_digits(rest), key, "phone", back))),
    ))


def _hash_text(v: Column, key: str, tweak: str, n: Column) -> Column:
    h = _digest(key, tweak, v)
    return F.substring(F.repeat(h, F.ceil(n / 64).cast("int")), F.lit(1), n)


def _secret(v: Column, key: str) -> Column:
    """Hash text in the value's own case.  Case doesn't tell hexadecimal
    tokens apart."""
    plain = F.when(v.rlike(f"^(?:{TOKEN})$"), F.lower(v)).otherwise(v)
    hashed = _hash_text(plain, key, "secret", F.length(v))
    return F.when(v.rlike(f"^(?:{ACCESS_KEY})$"), F.concat(F.lit("AKIA"), F.upper(F.substring(hashed, 1, 16)))).when(
        v.rlike("[A-Z]") & ~v.rlike("[a-z]"), F.upper(hashed)
    ).otherwise(hashed)


def _email(v: Column, key: str) -> Column:
    """Local part and domain name hashed to their own lengths; the top-level
    domain stays.  Case doesn't tell addresses apart."""
    name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    top = F.substring_index(domain, ".", -1)
    known = F.length(domain) - F.length(top) - 1
    return F.concat(_hash_text(F.lower(v), key, "email", F.length(name)), F.lit("@"),
                    _hash_text(F.lower(domain), key, "domain", known), F.lit("."), top)


def kind_of(v: Column) -> Column:
    """Kind of a match after validation, or null."""
    d = _digits(v)
    octets = F.split(v, "\\.")
    is_ = lambda pattern: v.rlike(f"^(?:{pattern})$")
    day = _ymd(v)
    return (
        F.when(v.contains("@") & is_(EMAIL), F.lit("email"))
        .when(is_(IPV4), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(is_(DATE), F.when(
            F.substring(day, 1, 4).cast("int").between(1800, 2199) & F.substring(day, 5, 2).cast("int").between(1, 12)
            & (F.substring(day, 7, 2).cast("int") >= 1) & (F.month(_day(day)) == F.substring(day, 5, 2).cast("int"))
            & (F.substring(day, 7, 2).cast("int") <= 31), F.lit("date")))
        .when(is_(SSN), F.when(
            ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9")
            & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"), F.lit("ssn")))
        .when(is_(PHONE), F.lit("phone"))
        .when(is_(CARD) & F.length(d).between(13, 19), F.when(luhn_sum(d) % 10 == 0, F.lit("card")))
        .when(v.rlike(r"^[0-9 -]*$"), F.lit(None).cast("string"))
        .otherwise(F.lit("secret"))
    )


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The text's pieces between the pattern's matches (one more), and these."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _part(v: Column, kind: Column) -> Column:
    return F.struct(v.alias("v"), kind.cast("string").alias("kind"))


def _rescanned(text: Column) -> Column:
    """array<struct(v, kind)>: the text of a run beside its cards in parts."""
    between, found = _pieces(text, OTHERS)
    return F.flatten(F.zip_with(between, found, lambda piece, v: F.array(
        _part(F.coalesce(piece, F.lit("")), F.lit(None)), _part(F.coalesce(v, F.lit("")), kind_of(F.coalesce(v, F.lit(""))))
    )))


def _cards(bits: Column) -> Column:
    """array<struct(odd, long, i, j)>, best first: the consecutive groups of
    13 to 19 digits whose Luhn sum is right.  ``bits`` are a run's digit groups
    and the separators between them, ``i`` to ``j`` the places of a card in
    it.  Cards as they are printed come before others, longer before shorter."""
    last = F.size(bits) - 1
    text = lambda i, j: F.array_join(F.slice(bits, i + 1, j - i + 1), "")
    ends = lambda i: F.sequence(i, F.least(i + F.lit(36), last), F.lit(2))
    odd = lambda v: F.when(v.rlike(PRINTED), 0).otherwise(1)

    def card(v: Column, i: Column, j: Column) -> Column:
        d = _digits(v)
        valid = v.rlike(f"^(?:{CARD})$") & F.length(d).between(13, 19)
        return F.when(valid, F.when(luhn_sum(d) % 10 == 0, F.struct(
            odd(v).alias("odd"), (-F.length(d)).alias("long"), i.alias("i"), j.alias("j")
        )))

    found = F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(2)), lambda i: F.transform(
        ends(i), lambda j: _let(text(i, j), lambda v: card(v, i, j))
    )))
    return F.array_sort(F.filter(found, lambda c: c.isNotNull()))


def _run_parts(run: Column) -> Column:
    """array<struct(v, kind)>: a run's cards, and the rest scanned without
    them for the other kinds."""
    def split(bits: Column) -> Column:
        places = "array<struct<i:int,j:int>>"
        apart = lambda a, b: (a.j < b.i) | (b.j < a.i)
        chosen = F.array_sort(F.aggregate(_cards(bits), F.array().cast(places), lambda s, c: F.when(
            F.forall(s, lambda t: apart(c, t)), F.concat(s, F.array(F.struct(c.i.alias("i"), c.j.alias("j"))))
        ).otherwise(s)))
        text = lambda i, j: F.array_join(F.slice(bits, i + 1, F.greatest(j - i + 1, F.lit(0))), "")
        return _let(chosen, lambda cs: F.concat(
            F.flatten(F.transform(cs, lambda c, k: F.concat(
                _rescanned(text(F.when(k == 0, 0).otherwise(F.get(cs, k - 1).j + 1), c.i - 1)),
                F.array(_part(text(c.i, c.j), F.lit("card"))),
            ))),
            _rescanned(text(F.coalesce(F.get(cs, F.size(cs) - 1).j + 1, F.lit(0)), F.size(bits) - 1)),
        ))

    return _let(F.regexp_extract_all(run, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), split)


def pseudonym(v: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a validated value; ``back`` undoes it (not for
    e-mail addresses and secrets, which stay then)."""
    d = _digits(v)
    return (
        F.when(kind == "card", fill(v, _card(d, key, back)))
        .when(kind == "ssn", fill(v, _ssn(d, key, back)))
        .when(kind == "ip", _ipv4(v, key, back))
        .when(kind == "date", _date(v, key, back))
        .when(kind == "phone", _phone(v, key, back))
        .when(kind == "email", v if back else _email(v, key))
        .when(kind == "secret", v if back else _secret(v, key))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the found values of ``text_col`` replaced, ``n_pii``
    (validated values found) and ``pii_kinds`` (their kinds, sorted, joined by
    commas).

    Null texts stay null with 0 values; rows repeat as they are; input
    columns ``n_pii`` and ``pii_kinds`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_pii", "pii_kinds")]
    text = F.col(text_col).cast("string")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)))
    is_run = lambda v: v.rlike("^[0-9][0-9 -]{11,}[0-9]$") & (F.length(_digits(v)) >= 13)
    hits = F.transform(F.col("__pii_found"), lambda v: F.when(is_run(v), _run_parts(v)).otherwise(F.array(_part(v, kind_of(v)))))
    new = F.transform(F.col("__pii_hits"), lambda parts: F.array_join(F.transform(
        parts, lambda h: F.when(h.kind.isNull(), h.v).otherwise(pseudonym(h.v, h.kind, key))
    ), ""))
    pieces = F.split(text, ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(
        pieces, F.col("__pii_new"), lambda piece, v: F.array(F.coalesce(piece, F.lit("")), F.coalesce(v, F.lit("")))
    )))
    valid = F.filter(F.flatten("__pii_hits"), lambda h: h.kind.isNotNull())
    out = (
        docs.select(*names).withColumn("__pii_found", F.coalesce(found, F.array().cast("array<string>")))
        .withColumn("__pii_hits", hits).withColumn("__pii_new", new)
    )
    return out.select(
        *[F.when(F.size("__pii_hits") > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(c) for c in names],
        F.size(valid).alias("n_pii"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(valid, lambda h: h.kind))), ",").alias("pii_kinds"),
    )
