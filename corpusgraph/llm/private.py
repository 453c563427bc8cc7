"""Format-preserving pseudonyms for personal data, in SQL functions only.

Matches of one combined pattern are taken out of a text, validated (Luhn for card
numbers, octets for addresses, the calendar for dates, country codes for phones, areas,
groups and serials that are issued for national numbers) and put back as keyed
pseudonyms of the same format.  Numbers and dates go through an alternating
Feistel network over their own domain: digits over 10**n, addresses over 2**32,
national numbers over those that may be issued, dates over the 146,097 days of the Gregorian cycle 1700 to 2099.  That is a
permutation, so equal values stay equal in every document and different ones
stay apart.  The round function is SHA-256 keyed with ``key``, which the caller
gives: who has it can undo the pseudonyms.  Card numbers keep a valid check digit,
phone numbers their country code (so one number is linked however it is written), all
keep their separators.
Mail addresses and credentials, which are no numbers, become keyed digests.

A first look for a digit, ``@``, ``=`` or ``:`` keeps most texts away from the
large pattern.  No row moves between tasks.

Edge cases: null text stays null with counts of 0; empty and very long texts are
treated alike (groups that repeat without bound are possessive, which the matcher
runs as a loop, not by recursion); digits that fail their validation stay; a card is found between other
groups of digits where it stands in a usual layout; only dates written YYYY-MM-DD are
touched; every column of the input
is kept, ``text`` and (if present) ``n_chars`` change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 8
# Assigned country codes of one, two and three digits.
CODES = (
    "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    "|21[12368]|2[2346][0-9]|25[0-8]|29[01789]|35[0-9]|37[0-9]|38[0-35-79]|42[013]|50[0-9]|59[0-9]"
    "|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[08]|88[0-3689]|96[0-8]|97[0-79]|99[2-68]"
)
COUNTRY = rf"^\+(?:{CODES})"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z])(?i:password|passwd|token|secret|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_-]{12,}+[\"']?",
    "date": r"(?<![0-9.-])(?:1[789]|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "address": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# digit groups one blank or hyphen apart, 13 digits at least, up to where a date, address or national number begins
PATTERNS["card"] = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{PATTERNS['date']}|{PATTERNS['address']}|{PATTERNS['national']})[0-9]++)*+"
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# digits in the groups of a card, and how many groups these are
LAYOUTS = {"4-4-4-4-3": 5, "4-4-4-4": 4, "4-6-5": 3, "4-6-4": 3, "1[3-9]": 1}
ANY = "|".join(PATTERNS.values())
HINT = "[0-9@=:]|AKIA"


def _prf(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of the pairs (a, b) of Z(size_a) x Z(size_b), as a struct."""

    def step(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["a"] + F.pmod(_prf(key, tag, i, s["b"]), size_a), size_a).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_prf(key, tag, i, s["a"]), size_b), size_b).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits(d: Column, tag: str, key: str) -> Column:
    """Permute a string of 2 to 19 digits among those of its length."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    ten = lambda n: F.round(F.pow(F.lit(10.0), n)).cast("long")
    f = feistel(F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"), ten(u), ten(v), F.concat(F.lit(tag), F.length(d).cast("string")), key)
    # bound once, for both halves
    return F.transform(F.array(f), lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")))[0]


def luhn(d: Column) -> Column:
    """Luhn sum of a digit string modulo 10."""

    def add(s: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return s + x - F.when(x > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["k"] + F.when(digit, F.lit(1)).otherwise(F.lit(0))).alias("k"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), put)["out"]


def _national(d: Column, key: str) -> Column:
    """Permute nine digits among the numbers that may be issued: 898 areas, 99 groups, 9,999 serials."""
    part = lambda at, n: F.substring(d, at, n).cast("long")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("long")
    f = feistel(area, (part(4, 2) - 1) * 9999 + part(6, 4) - 1, F.lit(898), F.lit(99 * 9999), F.lit("national"), key)
    fill = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.transform(F.array(f), lambda s: F.concat(fill(s["a"] + 1 + (s["a"] >= 665).cast("long"), 3), fill(F.floor(s["b"] / 9999) + 1, 2), fill(s["b"] % 9999 + 1, 4)))[0]


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def kind_of(m: Column) -> Column:
    whole = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    valid = {
        "date": F.try_to_date(m, "yyyy-MM-dd").isNotNull(),
        "phone": ~m.startswith("+") | F.concat(F.lit("+"), _bare(m)).rlike(COUNTRY),
        "national": ~m.rlike("^(?:000|666|9)|-00-|-0000$"),  # never issued
    }
    out = F.when(m.contains("@"), F.lit("email"))
    for k in ("secret", "date", "address", "phone", "national"):
        out = out.when(whole(k), F.when(valid.get(k, F.lit(True)), F.lit(k)))
    return out.otherwise(F.when(F.length(_bare(m)).between(13, 19), F.when(luhn(_bare(m)) == 0, F.lit("card"))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parts_of(m: Column) -> Column:
    """A match as pieces, of which some are values: groups of digits are cut around the cards in them.

    Cards in a usual layout are looked for at every group, the first of overlapping
    ones counts; what lies between is cut into the longest runs of 13 to 19 digits.
    """

    def cards(groups: Column) -> Column:
        def groups_of_card(i: Column) -> Column:
            digits = lambda n: F.array_join(F.transform(F.slice(groups, i + 1, F.lit(n)), _bare), "")
            sizes = F.array_join(F.transform(F.slice(groups, i + 1, F.lit(5)), lambda g: F.length(_bare(g)).cast("string")), "-")
            fits = [F.when(sizes.rlike(f"^{form}(?:-|$)"), F.when(_let(digits(n), luhn) == 0, F.lit(n))) for form, n in LAYOUTS.items()]
            return F.coalesce(*fits)

        runs = F.filter(F.transform(groups, lambda g, i: F.struct(i.alias("at"), groups_of_card(i).alias("n"))), lambda r: r["n"].isNotNull())
        none = F.array().cast("array<struct<at:int,n:int>>")
        first = lambda s, r: F.when(r["at"] >= s["end"], F.struct(F.concat(s["runs"], F.array(r)).alias("runs"), (r["at"] + r["n"]).alias("end"))).otherwise(s)
        return F.aggregate(runs, F.struct(none.alias("runs"), F.lit(0).alias("end")), first)["runs"]

    def cut(groups: Column, runs: Column) -> Column:
        text = lambda a, b: F.array_join(F.slice(groups, a + 1, b - a), "")
        rest = lambda t: F.regexp_extract_all(t, F.lit(rf"{RUN}|[0-9]+[ -]?|[ -]"), F.lit(0))
        end = lambda r: F.coalesce(r["at"] + r["n"], F.lit(0))
        around = F.transform(runs, lambda r, j: F.concat(rest(text(end(F.get(runs, j - 1)), r["at"])), F.array(text(r["at"], end(r)))))
        return F.concat(F.flatten(around), rest(text(end(F.get(runs, F.size(runs) - 1)), F.size(groups))))

    split = _let(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), lambda g: _let(cards(g), lambda r: cut(g, r)))
    return F.when(m.rlike("^[0-9 -]{13,}$"), split).otherwise(F.array(m))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for a match; a match without a kind stays."""
    hash_ = lambda tag, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), m).cast("binary"), 256), 1, n)
    d = _bare(m)
    country = F.length(_bare(F.regexp_extract(F.concat(F.regexp_extract(m, r"^\+", 0), d), COUNTRY, 0)))
    local = F.substring(d, country + 1, F.length(d))
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    card = F.transform(F.array(_digits(body, "card", key)), lambda x: F.concat(x, F.pmod(F.lit(10) - luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))[0]
    octet = lambda i: F.split(m, r"\.")[i].cast("long")
    net = F.transform(
        F.array(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), F.lit("address"), key)),
        lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if top else s[h] % 256).cast("string") for h in "ab" for top in (True, False))),
    )[0]
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit("1700-01-01").cast("date"))
    date = F.transform(
        F.array(feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), F.lit("date"), key)),
        lambda s: F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), (s["a"] * 773 + s["b"]).cast("int")), "yyyy-MM-dd"),
    )[0]
    return F.coalesce(
        F.when(kind == "email", F.concat(F.lit("user-"), hash_("email", 12), F.lit("@example.invalid")))
        .when(kind == "secret", F.concat(F.regexp_extract(m, "^[^=:]*[=:] ?(?=.)", 0), F.lit("[credential "), hash_("secret", 8), F.lit("]")))
        .when(kind == "date", date)
        .when(kind == "address", net)
        .when(kind == "phone", _refill(m, F.concat(F.substring(d, F.lit(1), country), _digits(local, "phone", key))))
        .when(kind == "national", _refill(m, _national(d, key)))
        .when(kind == "card", _refill(m, card)),
        m,
    )


def pseudonymise(docs: DataFrame, key: str, kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with ``text`` cleaned, and the column ``kinds`` (the kind of each replaced match, in text order)."""
    found_, new_ = free_name(docs, "pii_found"), free_name(docs, "pii_new")
    text = F.col("text")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    one = lambda m: F.transform(F.array(kind_of(m)), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("put")))[0]
    new = F.transform(found_, lambda m: F.transform(parts_of(m), one))
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, new_, lambda g, p: F.concat(g, F.coalesce(F.array_join(F.transform(p, lambda x: x["put"]), ""), F.lit("")))), "")
    out = docs.withColumn(found_, found).withColumn(new_, new).withColumn("text", F.when(F.size(found_) > 0, joined).otherwise(text))
    out = out.withColumn(kinds, F.coalesce(F.filter(F.transform(F.flatten(new_), lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(kinds) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(found_, new_)


def clean_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the cleaned text, and how many values of each kind were replaced."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    n = lambda k: F.size(F.filter("pii_kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), *map(n, PATTERNS))
