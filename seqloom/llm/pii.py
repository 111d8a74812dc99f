"""Format-preserving pseudonyms for numbers and dates by a keyed Feistel network.

A validated value is permuted among the values of its own format: card numbers
stay card numbers with a right check digit, phone numbers, addresses, social
security numbers and dates keep their shape. The same value gets the same
pseudonym in every document, so links survive; with the key it can be undone.
What has no number format of its own (the local part of an e-mail address, a
secret) gets letters and digits permuted place by place from a keyed digest.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._spark import let

ROUNDS = 8
#: One pattern for each kind, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|sk-[A-Za-z0-9_-]{20,200}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})(?![0-9A-Za-z])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3}[ .-]?\d{4}(?!\d)",
    "national": r"(?<![\w+.(-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-]|\.\d)",
    "ssn": r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2}|\d{2}\.\d{2}\.(?:19|20)\d{2})(?![\d/-]|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no value of any kind (a secret without a digit is not one).
HINT = "[0-9@]"
#: Days from 1900-01-01 to 2099-12-31, both included, as a product.
DAYS = (17, 4297)
#: Area numbers that are given out (001 to 899 without 666), and group and serial numbers (01 to 99, 0001 to 9999).
SSNS = (898, 99 * 9999)
#: Area codes 200 to 999; exchanges 200 to 999 with line numbers.
NATIONAL = (800, 800 * 10_000)
#: A kind's date format, by the shape of the value.
DATES = {r"^\d{4}-": "yyyy-MM-dd", r"^\d\d/": "MM/dd/yyyy", r"^\d\d\.": "dd.MM.yyyy"}


def _round(key: Column, kind: str, k: int, half: Column, n: Column) -> Column:
    """A keyed round function: 15 hexadecimal digits of SHA-256, below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit(k), n, half), 256), 1, 15), 16, 10).cast("decimal(20,0)")


def feistel_pair(place: Column, sizes: tuple[int, int], key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of 0 .. a * b - 1 for sizes (a, b): a Feistel network on the residues of a place, exact without any search."""
    a, b = sizes

    def step(k: int, s: Column) -> Column:
        side, other, size = ("a", "b", a) if k % 2 == 0 else ("b", "a", b)
        f = F.pmod(_round(key, kind, k, s[other].cast("string"), F.lit(f"{a}x{b}")), F.lit(size)).cast("long")
        new = F.pmod(s[side] - f if undo else s[side] + f, F.lit(size).cast("long"))
        return F.struct((new if side == "a" else s["a"]).alias("a"), (new if side == "b" else s["b"]).alias("b"))

    state = let(place.cast("long"), lambda p: F.struct(F.floor(p / b).cast("long").alias("a"), F.pmod(p, F.lit(b).cast("long")).alias("b")))
    for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        state = let(state, partial(step, k))
    return let(state, lambda s: s["a"] * b + s["b"])


def feistel(digits: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """A permutation of the strings of n decimal digits, 2 <= n <= 36, by an unbalanced Feistel network."""

    def start(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        return F.struct(d.substr(F.lit(1), cut).alias("a"), d.substr(cut + 1, n - cut).alias("b"))

    def step(k: int, s: Column) -> Column:
        # Even rounds change a by b, odd rounds b by a: lengths never change.
        side, other = ("a", "b") if k % 2 == 0 else ("b", "a")
        width = F.length(s[side])
        mod = F.rpad(F.lit("1"), (width + 1).cast("int"), F.lit("0")).cast("decimal(20,0)")
        f = _round(key, kind, k, s[other], F.length(s["a"]) + F.length(s["b"]))
        own = s[side].cast("decimal(20,0)")
        moved = F.pmod(own - F.pmod(f, mod), mod) if undo else F.pmod(own + F.pmod(f, mod), mod)
        new = F.lpad(moved.cast("decimal(20,0)").cast("string"), width, F.lit("0"))
        return F.struct((new if side == "a" else s["a"]).alias("a"), (new if side == "b" else s["b"]).alias("b"))

    state = start(digits)
    for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        state = let(state, partial(step, k))
    return let(state, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order by digits."""
    parts = F.split(shape, r"(?<=\d)|(?=\d)")
    return let(
        digits,
        lambda d: F.aggregate(
            parts,
            F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
            lambda a, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(a["out"], d.substr(a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
            lambda a: a["out"],
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _digest(value: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit("text"), value), 256)


def _email(v: Column, key: Column, undo: bool) -> Column:
    return F.concat(F.lit("u"), F.substring(_digest(F.lower(v), key), 1, 12), F.lit("@"), F.substring_index(v, "@", -1))


def _secret(v: Column, key: Column, undo: bool) -> Column:
    # Known prefixes stay; longer secrets than a digest take more of them.
    prefix = F.regexp_extract(v, r"^(?:sk-|AKIA|ghp_)?", 0)
    n = F.length(v) - F.length(prefix)
    new = F.concat(prefix, F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), lambda i: _digest(F.concat(v, F.when(i > 0, i.cast("string")).otherwise("")), key)), ""), F.lit(1), n))
    return F.when(v == F.upper(v), F.upper(new)).otherwise(new)


def _phone(v: Column, key: Column, undo: bool) -> Column:
    country = F.regexp_extract(v, r"^\+\d{1,3}", 0)
    rest = F.substring(v, F.length(country) + 1, F.length(v))
    return F.concat(country, _fill(rest, feistel(_digits(rest), key, "phone", undo)))


def _national(v: Column, key: Column, undo: bool) -> Column:
    def renew(d: Column) -> Column:
        place = (F.substring(d, 1, 3).cast("long") - 200) * NATIONAL[1] + (F.substring(d, 4, 3).cast("long") - 200) * 10_000 + F.substring(d, 7, 4).cast("long")
        return let(feistel_pair(place, NATIONAL, key, "national", undo), lambda p: F.concat((F.floor(p / NATIONAL[1]) + 200).cast("string"), F.lpad((F.pmod(p, F.lit(NATIONAL[1]).cast("long")) + 2_000_000).cast("string"), 7, "0")))

    return _fill(v, let(_digits(v), renew))


def _ssn(v: Column, key: Column, undo: bool) -> Column:
    def renew(d: Column) -> Column:
        area = F.substring(d, 1, 3).cast("long")
        place = (area - F.when(area < 666, 1).otherwise(2)) * SSNS[1] + (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
        return let(feistel_pair(place, SSNS, key, "ssn", undo), lambda p: let(F.floor(p / SSNS[1]), lambda a: let(F.pmod(p, F.lit(SSNS[1]).cast("long")), lambda r: F.concat(
            F.lpad((a + F.when(a < 665, 1).otherwise(2)).cast("string"), 3, "0"), F.lpad((F.floor(r / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(r, F.lit(9999).cast("long")) + 1).cast("string"), 4, "0")))))

    return _fill(v, let(_digits(v), renew))


def _card(v: Column, key: Column, undo: bool) -> Column:
    def renew(d: Column) -> Column:
        body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", undo)
        return let(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return _fill(v, let(_digits(v), renew))


def _ip(v: Column, key: Column, undo: bool) -> Column:
    # Place by place: addresses of one network stay in one network.
    parts = [feistel_pair(F.get(F.split(v, r"\."), k).cast("long"), (16, 16), key, f"ip{k}", undo) for k in range(4)]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _day(v: Column, shape: str) -> Column:
    """Days from 1900-01-01, or null if v is no day of the calendar."""
    return F.when(v.rlike(shape), F.datediff(F.try_to_date(v, DATES[shape]), F.lit("1900-01-01").cast("date")))


def _date(v: Column, key: Column, undo: bool) -> Column:
    first = F.lit("1900-01-01").cast("date")
    new = let(feistel_pair(F.coalesce(*[_day(v, s) for s in DATES]), DAYS, key, "date", undo), lambda d: F.date_add(first, d.cast("int")))
    out = v
    for shape, form in DATES.items():
        out = F.when(v.rlike(shape), F.date_format(new, form)).otherwise(out)
    return out


_MAKE = {"email": _email, "secret": _secret, "phone": _phone, "national": _national, "ssn": _ssn, "card": _card, "ip": _ip, "date": _date}


def kind_of(value: Column) -> Column:
    """The kind of a matched value, or null if it is not valid: a card whose Luhn sum is wrong, an address beyond 255, no day of the calendar, an area number that is not given out."""
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") < 256)
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike(r"^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|sk-.*|AKIA.*|ghp_.*)$"), F.when(value.rlike("[0-9]"), F.lit("secret")))
        .when(value.rlike(r"^\+"), F.lit("phone"))
        .when(value.rlike(r"^\(?\d{3}(?:\) ?|[ .-])\d{3}[ .-]\d{4}$"), F.lit("national"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(value.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), F.when(octets, F.lit("ip")))
        .when(value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\1\d{4})$"), F.when(F.coalesce(*[_day(value, s) for s in DATES]).isNotNull(), F.lit("date")))
        .when(F.pmod(luhn_sum(_digits(value)), F.lit(10)) == 0, F.lit("card"))
    )


def pseudonym(value: Column, kind: Column, key: Column, undo: bool = False) -> Column:
    """The pseudonym of a value of a kind; undo gives back numbers and dates (not e-mail addresses and secrets)."""
    out = value
    for name, make in _MAKE.items():
        out = F.when(kind == name, make(value, key, undo)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """doc_id, text, n_values, kinds for every row of docs(doc_id, text).

    text: with every valid value replaced; kinds: of the replaced values, in
    order. Row by row, no shuffle. A null text stays null with n_values 0;
    repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows. Whole texts are read; the cost is linear in the text. Of two
    kinds that match at a place, the first of PATTERNS is taken. The key comes
    as a table of one row, so that it is no literal of the plan.
    """
    one = F.broadcast(docs.sparkSession.createDataFrame([(key,)], "_key string"))
    # A text without a digit or @ is not searched for values.
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)))
    spans = docs.select("doc_id", "text", found.alias("found")).crossJoin(one)

    def renew(values: Column) -> Column:
        kinds = F.transform(values, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
        return F.transform(kinds, lambda x: F.struct(F.coalesce(x["kind"], F.lit("")).alias("kind"), pseudonym(x["v"], x["kind"], F.col("_key"), undo).alias("new")))

    some = F.size("found") > 0
    renewed = spans.withColumn("new", F.when(some, renew(F.col("found"))))
    pieces = F.split("text", ANY)
    text = F.when(some, F.array_join(F.zip_with(pieces, F.col("new"), lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit("")))), "")).otherwise(F.col("text"))
    kinds = F.coalesce(F.when(some, F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k != "")), F.array().cast("array<string>"))
    return renewed.select("doc_id", text.alias("text"), F.size(kinds).cast("long").alias("n_values"), kinds.alias("kinds"))
