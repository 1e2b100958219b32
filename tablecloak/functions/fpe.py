"""Format-preserving keyed bijection over text, as a native expression.

The characters of the charset are permuted among themselves; every other character stays in its place. A body
is cut in blocks of equal length (one block up to 18 to 34 characters), and every block is a Feistel network on
two halves with keyed SHA-256 rounds, tweaked by the body length and block number. This is not certified FF1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DomainTooSmall, InvalidRule
from ..keys import feistel, int_div
from . import checksums

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# The charsets a rule may name. VIN leaves out I, O and Q.
CHARSETS = {
    "digits": DIGITS,
    "alpha": LOWER,
    "alphanum": DIGITS + LOWER,
    "ALPHANUM": DIGITS + LOWER.upper() + LOWER,
    "vin": "0123456789ABCDEFGHJKLMNPRSTUVWXYZ",
}
MIN_DOMAIN = 10_000


def let(x: Column, f) -> Column:
    """Bind x once inside an expression."""
    return F.element_at(F.transform(F.array(x), f), 1)


def min_length(charset: str) -> int:
    return math.ceil(math.log(MIN_DOMAIN) / math.log(len(CHARSETS[charset])) - 1e-9)


def half_length(charset: str) -> int:
    """Longest half whose domain stays under 2^59, so sums stay inside a bigint."""
    return int(59 * math.log(2) / math.log(len(CHARSETS[charset])))


def _to_number(s: Column, charset: str) -> Column:
    alphabet = CHARSETS[charset]
    if charset == "digits":
        return s.cast("bigint")
    return F.aggregate(
        F.split(s, ""), F.lit(0).cast("bigint"),
        lambda acc, ch: acc * len(alphabet) + F.instr(F.lit(alphabet), ch) - 1,
    )


def _to_text(x: Column, width: Column, powers: Column, charset: str) -> Column:
    alphabet = CHARSETS[charset]
    if charset == "digits":
        return F.lpad(x.cast("string"), width, F.lit("0"))
    digit = lambda i: F.lit(alphabet).substr(
        (int_div(x, F.element_at(powers, i + 1)) % len(alphabet) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(width - 1, F.lit(0)), digit), "")


def _permute_body(body: Column, key: bytes, charset: str, inverse: bool) -> Column:
    radix, half = len(CHARSETS[charset]), half_length(charset)
    powers = F.array(*[F.lit(radix**i).cast("bigint") for i in range(half + 1)])

    def block(text: Column, tweak: Column) -> Column:
        u = F.floor(F.length(text) / 2).cast("int")
        v = F.length(text) - u
        s = feistel(
            key, tweak, _to_number(text.substr(F.lit(1), u), charset),
            _to_number(text.substr(u + 1, v), charset),
            F.element_at(powers, u + 1), F.element_at(powers, v + 1), inverse,
        )
        return let(s, lambda t: F.concat(_to_text(t["l"], u, powers, charset), _to_text(t["r"], v, powers, charset)))

    def all_blocks(b: Column) -> Column:
        n = F.length(b)
        count = F.ceil(n / (2 * half)).cast("int")

        def one(i: Column) -> Column:
            start, end = F.floor(i * n / count).cast("int"), F.floor((i + 1) * n / count).cast("int")
            return let(b.substr(start + 1, end - start), lambda t: block(t, F.concat_ws("|", n.cast("string"), i.cast("string"))))

        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), "")

    return let(body, all_blocks)


def _put_back(c: Column, out: Column, charset: str) -> Column:
    """Write the permuted characters into the places the charset characters had."""
    inside = f"[{CHARSETS[charset]}]"

    def walk(acc: Column, ch: Column, o: Column) -> Column:
        hit = ch.rlike(inside)
        return F.struct(
            F.concat(acc["s"], F.when(hit, o.substr(acc["k"], F.lit(1))).otherwise(ch)).alias("s"),
            (acc["k"] + F.when(hit, 1).otherwise(0)).alias("k"),
        )

    def place(o: Column) -> Column:
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
        walked = F.aggregate(F.split(c, ""), start, lambda a, ch: walk(a, ch, o), lambda a: a["s"])
        return F.when(F.length(o) == F.length(c), o).otherwise(walked)

    return let(out, place)


def body_of(c: Column, charset: str) -> Column:
    return F.regexp_replace(c, f"[^{CHARSETS[charset]}]", "")


def too_short(c: Column, charset: str, check_digits: int = 0) -> Column:
    """True where the value has too few charset characters to hide in."""
    return F.length(body_of(c, charset)) < min_length(charset) + check_digits


def fpe_text(c: Column, key: bytes, charset: str = "digits", luhn: bool = False, inverse: bool = False) -> Column:
    """Null where the value is null or too short; callers count those as format errors."""
    if charset not in CHARSETS:
        raise InvalidRule(f"unknown charset {charset!r}")
    if luhn and charset != "digits":
        raise InvalidRule("validate_luhn needs charset digits")

    def whole(b: Column) -> Column:
        if not luhn:
            return _permute_body(b, key, charset, inverse)
        body = b.substr(F.lit(1), F.length(b) - 1)
        return let(_permute_body(body, key, charset, inverse), lambda x: F.concat(x, checksums.luhn_digit(x)))

    ok = c.isNotNull() & ~too_short(c, charset, int(luhn))
    return F.when(ok, _put_back(c, let(body_of(c, charset), whole), charset))


def fpe_number(c: Column, key: bytes, width: int, inverse: bool = False) -> Column:
    """Bijection of the integers with up to ``width`` digits; the sign stays."""
    if width < 4:
        raise DomainTooSmall("fpe over integers needs a width of 4 digits or more")
    if width > 18:
        raise InvalidRule("fpe over integers goes up to 18 digits")
    u = width // 2
    ml, mr = F.lit(10**u).cast("bigint"), F.lit(10 ** (width - u)).cast("bigint")
    x = F.abs(c.cast("bigint"))
    s = feistel(key, F.lit(f"int|{width}"), int_div(x, mr), x % mr, ml, mr, inverse)
    out = let(s, lambda t: t["l"] * mr + t["r"])
    return F.when(x < 10**width, F.when(c < 0, -out).otherwise(out))


def fpe_checksum(c: Column, key: bytes, checksum: str, inverse: bool = False) -> Column:
    """Permute the body, recompute the check positions. Reverses exactly when the input was valid."""
    p = lambda body, charset="digits": _permute_body(body, key, charset, inverse)
    sub = lambda a, n: F.substring(c, a, n)
    if checksum == "luhn":
        return fpe_text(c, key, "digits", luhn=True, inverse=inverse)
    if checksum == "npi":
        out = let(F.concat(sub(1, 1), p(sub(2, 8))), lambda x: F.concat(x, checksums.npi_digit(x)))
        return F.when(c.rlike("^[0-9]{10}$"), out)
    if checksum in ("ean13", "gtin"):
        body = c.substr(F.lit(1), F.length(c) - 1)
        out = let(p(body), lambda x: F.concat(x, checksums.gtin_digit(x)))
        shape = "^[0-9]{13}$" if checksum == "ean13" else "^([0-9]{8}|[0-9]{12,14})$"
        return F.when(c.rlike(shape), out)
    if checksum == "isbn13":
        out = let(F.concat(sub(1, 3), p(sub(4, 9))), lambda x: F.concat(x, checksums.gtin_digit(x)))
        return F.when(c.rlike("^97[89][0-9]{10}$"), out)
    if checksum == "vin":
        def build(x: Column) -> Column:
            head, tail = F.substring(x, 1, 8), F.substring(x, 9, 8)
            return F.concat(head, checksums.vin_digit(F.concat(head, F.lit("0"), tail)), tail)
        out = let(p(F.concat(sub(1, 8), sub(10, 8)), "vin"), build)
        return F.when(c.rlike("^[A-HJ-NPR-Z0-9]{17}$"), out)
    if checksum == "iban":
        # digits of the account part move, its letters stay, since countries fix where letters go
        bban = c.substr(F.lit(5), F.length(c))
        moved = _put_back(bban, let(body_of(bban, "digits"), lambda b: p(b)), "digits")
        out = let(moved, lambda b: F.concat(sub(1, 2), checksums.iban_digits(sub(1, 2), b), b))
        return F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & ~too_short(bban, "digits"), out)
    raise InvalidRule(f"unknown checksum {checksum!r}")
