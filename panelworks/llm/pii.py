"""Format-preserving Feistel pseudonyms, in Spark SQL expressions alone.

Every value found in a text is replaced by one of its own format.  Digits and
dates run through an alternating Feistel network whose round function is a keyed
SHA-256, a bijection of their domain: equal values stay equal in all documents
and different values stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_YEAR = "(?:19|20)[0-9]{2}"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_SHORT = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Spellings of a day whose reading is certain: how Spark reads and writes them, and their pattern.
DAYS = {
    "yyyy-MM-dd": rf"(?<![0-9A-Za-z_-]){_YEAR}-[0-9]{{2}}-[0-9]{{2}}(?![0-9A-Za-z_-])",
    "yyyy/MM/dd": rf"(?<![0-9A-Za-z_/]){_YEAR}/[0-9]{{2}}/[0-9]{{2}}(?![0-9A-Za-z_/])",
    "dd.MM.yyyy": rf"(?<![0-9A-Za-z_.])[0-9]{{2}}\.[0-9]{{2}}\.{_YEAR}(?![0-9A-Za-z_]|\.[0-9])",
    "MMMM d, yyyy": rf"{_B}{_MONTH} [0-9]{{1,2}}, {_YEAR}{_E}",
    "MMMM d yyyy": rf"{_B}{_MONTH} [0-9]{{1,2}} {_YEAR}{_E}",
    "d MMMM yyyy": rf"{_B}[0-9]{{1,2}} {_MONTH} {_YEAR}{_E}",
    "MMM d, yyyy": rf"{_B}{_SHORT} [0-9]{{1,2}}, {_YEAR}{_E}",
    "d MMM yyyy": rf"{_B}[0-9]{{1,2}} {_SHORT} {_YEAR}{_E}",
}
#: Country codes of one and two digits, as fixed values; all others have three.
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
_CARD = r"[0-9](?:[ -]?[0-9]){11,18}"
#: The kinds of value in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]+@(?:[0-9A-Za-z-]+\.)+[A-Za-z]{2,}",
    "token": _B + r"(?:(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])",
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)" + _E,
    "secret": _B + r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}" + _E,
    "ip": r"(?<![0-9A-Za-z_.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z_]|\.[0-9])",
    **DAYS,
    "slashes": rf"(?<![0-9A-Za-z_/])[0-9]{{2}}/[0-9]{{2}}/{_YEAR}(?![0-9A-Za-z_/])",
    "abroad": r"(?<![0-9A-Za-z_+])\+[1-9][0-9]{0,2}(?:[ .()/-]{0,2}[0-9]){6,13}" + _E,
    "phone": r"(?<![0-9A-Za-z_+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _E,
    "trunk": r"(?<![0-9A-Za-z_+.-])0[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}" + _E,
    "ssn": r"(?<![0-9A-Za-z_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_-])",
    "card": r"(?<![0-9A-Za-z_.-])" + _CARD + r"(?![0-9A-Za-z_]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _round(key: str, kind: str, k: int, value: Column, size: Column) -> Column:
    """A keyed number below size."""
    digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|{k}|"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), size)


def _step(key: str, kind: str, k: int, left: Column, right: Column):
    def even(p: Column) -> Column:
        return F.struct(F.pmod(p["l"] + _round(key, kind, k, p["r"], left), left).alias("l"), p["r"].alias("r"))

    def odd(p: Column) -> Column:
        return F.struct(p["l"].alias("l"), F.pmod(p["r"] + _round(key, kind, k, p["l"], right), right).alias("r"))

    return odd if k % 2 else even


def _feistel(key: str, kind: str, pair: Column, left: Column, right: Column) -> Column:
    """The network over pairs ``struct(l, r)`` with l below left and r below right."""
    for k in range(ROUNDS):
        pair = _let(pair, _step(key, kind, k, left, right))
    return pair


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits as another of the same length."""

    def body(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        left, right = F.pow(F.lit(10), u).cast("bigint"), F.pow(F.lit(10), n - u).cast("bigint")
        start = F.struct(F.substr(d, F.lit(1), u).cast("bigint").alias("l"), F.substr(d, u + 1).cast("bigint").alias("r"))
        # the length is part of the key, so that formats are permuted apart
        return _let(_feistel(key, kind, start, left, right), lambda p: F.concat(F.lpad(p["l"].cast("string"), u, "0"), F.lpad(p["r"].cast("string"), n - u, "0")))

    return _let(digits, body)


def refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced, in order, by those of ``digits``."""
    one = lambda a, i: F.when(F.substr(value, i, F.lit(1)).rlike("[0-9]"), F.struct(F.concat(a["s"], F.substr(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(a["s"], F.substr(value, i, F.lit(1))).alias("s"), a["k"].alias("k"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), one)["s"]


def luhn(digits: Column) -> Column:
    """The check digit that belongs behind a string of digits, as a number."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: _let(F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: a + F.when(x > 9, x - 9).otherwise(x)),
    )
    return (F.lit(1000) - total) % 10


def _card(value: Column, key: str) -> Column:
    """Of a number with the right check digit, all digits but that one are permuted, and it is set anew; others stay."""

    def body(d: Column) -> Column:
        head, last = F.substr(d, F.lit(1), F.length(d) - 1), F.substr(d, F.lit(-1)).cast("int")
        new = _let(permute_digits(head, key, "card"), lambda new: F.concat(new, luhn(new).cast("string")))
        return F.when(luhn(head) == last, refill(value, new)).otherwise(value)

    return _let(F.regexp_replace(value, "[ -]", ""), body)


def _mod97(text: Column) -> Column:
    def step(a: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    """A valid account number's digits are permuted and its check digits set anew, however it is spaced.

    A short word behind it isn't part of it; a card's number behind something
    that is no account number is a card's.
    """
    valid = lambda v: _let(F.replace(v, F.lit(" "), F.lit("")), lambda c: _mod97(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))) == 1)

    def new(v: Column) -> Column:
        def compact(c: Column) -> Column:
            land, body = F.substr(c, F.lit(1), F.lit(2)), F.substr(c, F.lit(5))
            digits = F.regexp_replace(body, "[A-Z]", "")
            moved = F.when(F.length(digits) >= 2, refill(body, permute_digits(digits, key, "iban"))).otherwise(body)
            check = lambda b: F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0")
            return _let(moved, lambda b: refill(v, F.concat(check(b), F.regexp_replace(b, "[A-Z]", ""))))

        return _let(F.replace(v, F.lit(" "), F.lit("")), compact)

    head = F.regexp_replace(value, " [0-9A-Z]{1,4}$", "")
    card = F.regexp_extract(value, _B + _CARD + "$", 0)
    front = F.substr(value, F.lit(1), F.length(value) - F.length(card))
    return (
        F.when(valid(value), new(value))
        .when((head != value) & valid(head), F.concat(new(head), F.substr(value, F.length(head) + 1)))
        .when((card != "") & (F.length(front) > 4), F.concat(front, _card(card, key)))
        .otherwise(value)
    )


def _ip(value: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        n = lambda k: p[k].cast("bigint")
        pair = F.struct((n(0) * 256 + n(1)).alias("l"), (n(2) * 256 + n(3)).alias("r"))
        return _let(
            _feistel(key, "ip", pair, F.lit(65536), F.lit(65536)),
            lambda q: F.concat_ws(".", *(x.cast("string") for x in (F.floor(q["l"] / 256), q["l"] % 256, F.floor(q["r"] / 256), q["r"] % 256))),
        )

    return _let(F.split(value, r"\."), body)


#: Days from 1900-01-01 to 2099-12-31: 17 * 4297, the sizes of the network's halves.
_DAYS = (17, 4297)


_FIRST = "1900-01-01"


def _permuted_day(n: Column, key: str) -> Column:
    """The number of a day, from the first on, as another."""
    pair = F.struct(F.floor(n / _DAYS[1]).cast("bigint").alias("l"), (n % _DAYS[1]).cast("bigint").alias("r"))
    return _let(_feistel(key, "date", pair, F.lit(_DAYS[0]), F.lit(_DAYS[1])), lambda p: (p["l"] * _DAYS[1] + p["r"]).cast("int"))


def _day(n: Column) -> Column:
    return F.date_add(F.lit(_FIRST).cast("date"), n)


def _number(value: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(_FIRST).cast("date"))


def _date(value: Column, key: str, form: str) -> Column:
    """A day of 1900 to 2099 as another; strings that are no day stay."""
    return F.coalesce(_let(_number(value, form), lambda n: F.when(n.isNotNull(), F.date_format(_day(_permuted_day(n, key)), form))), value)


def _slashes(value: Column, key: str) -> Column:
    """Day before month where that is a day; else month before day.

    Of the second reading are just the days after a month's twelfth, so they are
    permuted until another such one comes, and the two readings never meet.
    """

    def walk(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), n, lambda a, i: F.when((i > 1) & (F.dayofmonth(_day(a)) > 12), a).otherwise(_permuted_day(a, key)))

    other = _let(_number(value, "MM/dd/yyyy"), lambda n: F.when(n.isNotNull(), F.date_format(_day(walk(n)), "MM/dd/yyyy")))
    return F.when(_number(value, "dd/MM/yyyy").isNotNull(), _date(value, key, "dd/MM/yyyy")).otherwise(F.coalesce(other, value))


def _digits_after(value: Column, prefix: Column, key: str, kind: str) -> Column:
    rest = F.substr(value, F.length(prefix) + 1)
    return F.concat(prefix, refill(rest, permute_digits(F.regexp_replace(rest, "[^0-9]", ""), key, kind)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, by the first kind whose pattern it is."""
    keyed = lambda kind: F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256)
    is_a = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    email = F.concat(F.lit("user"), F.substr(keyed("email"), F.lit(1), F.lit(16)), F.lit("@mail.invalid"))
    secret = F.substr(F.concat(keyed("secret"), keyed("secret2")), F.lit(1), F.length(value))
    # what names the issuer stays; the rest, of any length, is a keyed hash again and again
    issuer = F.regexp_extract(value, r"^(?:(?:sk|pk|rk)_(?:live|test)_|AKIA|gh[opsu]_|xox[abprs]-|AIza)", 0)
    token = F.concat(issuer, F.substr(F.repeat(F.upper(keyed("token")), F.ceil(F.length(value) / 64).cast("int")), F.lit(1), F.length(value) - F.length(issuer)))
    cases = {
        "iban": _iban(value, key),
        "secret": secret,
        "ip": _ip(value, key),
        **{form: _date(value, key, form) for form in DAYS},
        "slashes": _slashes(value, key),
        "abroad": _digits_after(value, F.regexp_extract(value, _COUNTRY, 0), key, "phone"),
        "phone": _digits_after(value, F.lit(""), key, "phone"),
        "trunk": _digits_after(value, F.lit("0"), key, "phone"),
        "ssn": _digits_after(value, F.lit(""), key, "ssn"),
    }
    out = F.when(value.contains("@"), email).when(is_a("token"), token)
    for kind, made in cases.items():
        out = out.when(is_a(kind), made)
    return out.otherwise(_card(value, key))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with the personal values of ``text`` replaced, and ``n_chars`` (where it is there) counted anew.

    Equal values become equal pseudonyms in all rows, so texts that repeat stay
    equal; days and telephone numbers are linked across spellings, too.  Numbers
    without a valid check digit, and dates that are no day, stay.  A null text
    stays null, an empty one empty, and a very long one is worked on whole; a
    text without such values is unchanged; other columns and rows pass as they
    are.  The key becomes part of the plan: keep event logs as secret as the key.
    """
    return _replaced(docs, key).drop("_pw_found", "_pw_new", "_pw_changed")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    text = F.col("text")
    some = text.rlike("[0-9]") | text.contains("@")
    docs = docs.withColumn("_pw_found", F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    parts = F.split(text, ANY, -1)
    docs = docs.withColumn("_pw_new", F.transform(F.col("_pw_found"), lambda v: pseudonym(v, key)))
    docs = docs.withColumn("_pw_changed", F.when(F.size("_pw_found") > 0, F.size(F.filter(F.zip_with("_pw_found", "_pw_new", lambda a, b: a != b), lambda x: x))))
    joined = F.array_join(F.zip_with(parts, F.concat("_pw_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    docs = docs.withColumn("text", F.when(F.col("_pw_changed") > 0, joined).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.when(F.col("_pw_changed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return docs


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_found``: as pseudonymise(), with the number of values that were replaced."""
    made = _replaced(docs.select("doc_id", "text"), key)
    return made.select("doc_id", "text", F.coalesce("_pw_changed", F.lit(0)).alias("n_found"))
