"""PII by format-preserving pseudonyms, with DataFrame functions only.

Personal numbers and dates are found, validated and replaced by a keyed permutation of their own format: a card number by
another of the same length with a right check digit, a telephone number by one with the same layout, an address of the
internet by another, a date by another date in the same layout, the digits and letters of an e-mail name by others.  The
permutation is a Feistel network over pairs of residues, so it can be undone with the key and equal values stay linked
across documents.  What fails its validation is left alone.

A text is cut at the matches of one pattern, and only what matches passes through the networks.

Rows: a null text stays null, an empty one empty; texts are processed whole; repeated rows and null doc_ids are carried;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import warnings
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
SECRET = "spark.tessera.pseudonym.key"  # where the key is looked for if no argument gives it
NO_SECRET = "known to all"  # a key for tests and benches alone


class How(NamedTuple):
    """The key, and whether to undo."""

    key: str
    back: bool = False


EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}+\.(?=[A-Za-z0-9-]))++[A-Za-z]{2,24}"
CARD = r"(?:[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}"
KINDS = {"email": EMAIL, "card": CARD, "ssn": SSN, "phone": PHONE, "date": DATE, "ip": IPV4}
#: One scan finds all kinds; the leftmost wins, then the earlier kind.
BEFORE = r"(?<![A-Za-z0-9_])(?<![0-9][.-])"
AFTER = r"(?![A-Za-z0-9_]|[.-][0-9])"
NUMBERS = BEFORE + r"(?=[0-9(+])(?:" + "|".join(KINDS[k] for k in ("card", "ssn", "phone", "date", "ip")) + ")" + AFTER
ANY = BEFORE + r"(?:" + EMAIL + r"|(?=[0-9(+])(?:" + "|".join(KINDS[k] for k in ("card", "ssn", "phone", "date", "ip")) + "))" + AFTER


def mixed(value: Column, label: str, k: int, size: Column | int, how: How) -> Column:
    """A round's keyed number below ``size``: 15 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(how.key), F.lit(label), F.lit(str(k)), value.cast("string")), 256), 1, 15), 16, 10).cast("long") % size


def feistel(value: Column, a: int, b: int, label: str, rounds: int = ROUNDS, how: How = How(NO_SECRET)) -> Column:
    """A keyed permutation of 0 .. a*b - 1: the halves are residues modulo ``a`` and ``b``, moved in turn."""
    pair = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    steps = range(rounds - 1, -1, -1) if how.back else range(rounds)
    sign = -1 if how.back else 1

    def step(p: Column, k: int) -> Column:
        if k % 2 == 0:
            moved = F.pmod(p["l"] + sign * mixed(p["r"], label, k, a, how), F.lit(a))
            return F.struct(moved.alias("l"), p["r"].alias("r"))
        moved = F.pmod(p["r"] + sign * mixed(p["l"], label, k, b, how), F.lit(b))
        return F.struct(p["l"].alias("l"), moved.alias("r"))

    # One variable per round: a bare expression would be copied into each of its uses.
    def chain(p: Column, left: list[int]) -> Column:
        return F.transform(F.array(p), lambda x: step(x, left[0]) if len(left) == 1 else chain(step(x, left[0]), left[1:]))[0]

    whole = chain(pair, list(steps))
    return F.transform(F.array(whole), lambda p: p["l"] * b + p["r"])[0]


def let(value: Column, f) -> Column:
    """Name a value, so that it is computed once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def luhn(digits: Column) -> Column:
    """The check digit that completes ``digits``."""
    at = F.sequence(F.lit(1), F.length(digits))
    n = F.length(digits)
    each = F.transform(at, lambda i: let(F.substr(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda s, d: s + d), F.lit(10)).cast("string")


def pour(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, in order, by ``digits``."""
    parts = F.split(layout, "[0-9]")
    out = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.concat(F.substr(digits, i, F.lit(1)), F.element_at(parts, (i + 1).cast("int"))))
    return F.concat(parts[0], F.array_join(out, ""))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def permuted_digits(digits: Column, label: str, low: int, high: int, how: How) -> Column:
    """A permutation of the strings of as many digits, a network for every length from ``low`` to ``high``."""
    out = digits
    for n in range(low, high + 1):
        out = F.when(F.length(digits) == n, padded(feistel(digits.cast("long"), 10 ** (n // 2), 10 ** (n - n // 2), f"{label}{n}", how=how), n)).otherwise(out)
    return out


def card(v: Column, how: How) -> Column:
    """The first six digits (the issuer) stay, the middle is permuted, the check digit is made anew."""

    def replace(d: Column) -> Column:
        head, middle = F.substring(d, 1, 6), F.substr(d, F.lit(7), F.length(d) - 7)
        return let(F.concat(head, permuted_digits(middle, "card", 6, 12, how)), lambda x: pour(v, F.concat(x, luhn(x))))

    valid = lambda d: (F.length(d).between(13, 19)) & (luhn(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1))
    return let(only_digits(v), lambda d: F.when(valid(d), replace(d)))


def ssn(v: Column, how: How) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999, each in its range after the permutation too."""
    area, group, serial = (F.substring(v, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1

    def spell(x: Column) -> Column:
        high = F.floor(x / (99 * 9999)).cast("long")
        return F.concat_ws("-", padded(F.when(high >= 665, high + 2).otherwise(high + 1), 3), padded(F.floor(x / 9999).cast("long") % 99 + 1, 2), padded(x % 9999 + 1, 4))

    return F.when(valid, let(number, lambda x: let(feistel(x, 898 * 9, 11 * 9999, "ssn", how=how), spell)))


def phone(v: Column, how: How) -> Column:
    """The last ten digits: area and exchange of 100 or more, or below, are so afterwards; the country digit stays."""

    def replace(d: Column) -> Column:
        ten = F.substring(d, -10, 10)
        area, exchange, line = (F.substring(ten, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))

        def moved(low: tuple[int, int], size: tuple[int, int]) -> Column:
            def spell(x: Column) -> Column:
                return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), padded(F.floor(x / (size[1] * 10000)).cast("long") + low[0], 3), padded(F.floor(x / 10000).cast("long") % size[1] + low[1], 3), padded(x % 10000, 4))

            number = ((area - low[0]) * size[1] + exchange - low[1]) * 10000 + line
            return let(number, lambda x: let(feistel(x, size[0] * 100, size[1] * 100, f"phone{low[0]}:{low[1]}", how=how), lambda y: pour(v, spell(y))))

        far = F.when(exchange >= 100, moved((100, 100), (900, 900))).otherwise(moved((100, 0), (900, 100)))
        return F.when(area >= 100, far).otherwise(F.when(exchange >= 100, moved((0, 100), (100, 900))).otherwise(moved((0, 0), (100, 100))))

    return let(only_digits(v), replace)


def ip(v: Column, how: How) -> Column:
    """Four octets up to 255, without leading zeros."""
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))

    def replace(o: Column) -> Column:
        number = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
        spell = lambda x: F.concat_ws(".", *[(F.floor(x / 256**k).cast("long") % 256).cast("string") for k in (3, 2, 1, 0)])
        return F.when((F.array_max(o) <= 255) & ~v.rlike(r"(^|\.)0[0-9]"), let(number, lambda x: let(feistel(x, 65536, 65536, "ip", how=how), spell)))

    return let(octets, replace)


def date(v: Column, how: How) -> Column:
    """A real day of 1900 to 2099 goes to another; in layouts that name the day or month first, the day is read first."""
    iso, mark = F.instr(v, "-") > 0, F.substring(v, 3, 1)
    text = F.when(iso, v).otherwise(F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2)))
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    first, days = F.to_date(F.lit("1900-01-01")), 73049  # 73049 = 11 * 29 * 229 days from 1900 to 2099

    def spell(x: Column) -> Column:
        new = F.date_add(first, x.cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))

    return F.when(day.isNotNull(), let(F.datediff(day, first).cast("long"), lambda x: let(feistel(x, 319, days // 319, "date", how=how), spell)))


def email(v: Column, how: How) -> Column:
    """Letters and digits of the name are moved within their alphabet, each by the name's other half; the domain stays.

    The halves of the name take turns: one is shifted, character by character, by a keyed stream made of the other.
    """
    name, rest = F.regexp_extract(v, "^[^@]*", 0), F.regexp_extract(v, "@.*$", 0)

    def shifted(text: Column, other: Column, k: int) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(how.key), F.lit("email"), F.lit(str(k)), F.length(text).cast("string"), other), 256)

        def one(i: Column) -> Column:
            c = F.substr(text, i, F.lit(1))
            move = F.conv(F.substr(stream, ((i - 1) % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
                at = F.position(c, F.lit(letters))
                moved = F.substr(F.lit(letters), F.pmod(at - 1 + (-move if how.back else move), F.lit(len(letters))) + 1, F.lit(1))
                out = F.when(at > 0, moved).otherwise(out)
            return out

        return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))

    half = F.floor(F.length(name) / 2).cast("int")
    pair = F.struct(F.substr(name, F.lit(1), half).alias("l"), F.substr(name, half + 1, F.length(name)).alias("r"))

    def turn(k: int):
        return lambda p: F.struct((shifted(p["l"], p["r"], k) if k % 2 == 0 else p["l"]).alias("l"), (shifted(p["r"], p["l"], k) if k % 2 else p["r"]).alias("r"))

    for k in (3, 2, 1, 0) if how.back else (0, 1, 2, 3):
        pair = let(pair, turn(k))
    return let(pair, lambda p: F.concat(p["l"], p["r"], rest))


REPLACE = {"email": email, "card": card, "ssn": ssn, "phone": phone, "date": date, "ip": ip}


def kind_of(v: Column) -> Column:
    return reduce(lambda other, k: F.when(v.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(other), reversed(list(KINDS)), F.lit("none"))


def pseudonym(v: Column, how: How) -> Column:
    """(kind, new value) of a match; kind is null and the value unchanged where the validation fails."""
    kind = kind_of(v)
    new = F.lit(None).cast("string")
    for k, f in REPLACE.items():
        new = F.when(kind == k, f(v, how)).otherwise(new)
    return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, v).alias("value")))


def pseudonymise(docs: DataFrame, back: bool = False, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_<kind>..., n_found): whole texts with pseudonyms in place; ``back`` undoes it with the same key.

    The key is ``key``, or the session's ``spark.tessera.pseudonym.key``.  Without either a key that all know is used, with a
    warning.  A key is a literal of the plan, so who may read plans may read it.
    """
    key = key or docs.sparkSession.conf.get(SECRET, None)
    if not key:
        warnings.warn(f"neither an argument nor {SECRET} gives a key: anyone can undo these pseudonyms", stacklevel=2)
    how = How(key or NO_SECRET, back)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("old"))
    # Cut at the matches: one more piece than there are matches.  Texts without @ need not be searched for e-mail.
    pieces, found = F.array("old"), F.array().cast("array<string>")
    for hint, pattern in (("[0-9]", NUMBERS), ("@", ANY)):
        pieces = F.when(F.col("old").rlike(hint), F.split("old", pattern)).otherwise(pieces)
        found = F.when(F.col("old").rlike(hint), F.regexp_extract_all("old", F.lit(f"({pattern})"), F.lit(1))).otherwise(found)
    cut = rows.select("doc_id", "old", pieces.alias("pieces"), found.alias("found"))
    new = cut.withColumn("new", F.transform("found", lambda v: pseudonym(v, how)))
    later = F.transform(F.slice("pieces", F.lit(2), F.size("found")), lambda p, i: F.concat(F.get("new", i)["value"], p))
    text = F.when(F.size("found") > 0, F.concat(F.get("pieces", F.lit(0)), F.array_join(later, ""))).otherwise(F.col("old"))
    count = lambda k: F.size(F.filter("new", lambda n: n["kind"] == k)).cast("long")
    return new.select("doc_id", text.alias("text"), *[count(k).alias(f"n_{k}") for k in KINDS], F.size(F.filter("new", lambda n: n["kind"].isNotNull())).cast("long").alias("n_found"))
