"""FF1 (NIST SP 800-38G) as a native expression: ten Feistel rounds whose function is an AES CBC-MAC.

Spark's ``aes_encrypt`` with a zero initial vector gives the whole chain at once; its block before the padding is the MAC. Two
halves of a text are whole numbers below 10^18, the MAC's first 8 or 12 bytes are taken modulo a power of the radix in
decimals, and the rounds are a native ``aggregate``, so nothing leaves the JVM and the expression does not grow with the rounds.

Texts whose domain is under a million are too short, and those of more than two halves of 18 digits (11 of 36 signs) are too long;
both give null, which callers count as format errors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRule
from . import checksums, fpe
from .fpe import let

ROUNDS = 10
MIN_DOMAIN = 1_000_000
ZERO_IV = b"\0" * 16


def half_length(charset: str) -> int:
    """Longest half whose numbers stay under 10^18."""
    return int(18 / math.log10(len(fpe.CHARSETS[charset])) + 1e-9)


def min_length(charset: str) -> int:
    return math.ceil(math.log(MIN_DOMAIN) / math.log(len(fpe.CHARSETS[charset])) - 1e-9)


def _hex(x: Column, digits: int | Column) -> Column:
    return F.lpad(F.lower(F.hex(x.cast("bigint"))), digits, F.lit("0"))


def _mac(message: Column, key: bytes) -> Column:
    """Hex of the CBC-MAC of a message in hex, of whole blocks: the last block but that of the padding."""
    sealed = F.aes_encrypt(F.unhex(message), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(ZERO_IV))
    return F.hex(F.substring(sealed, -32, 16))


def _remainder(digits: Column, m: Column) -> Column:
    """A number of 24 hex digits modulo m <= 10^18, four bytes at a time; in bigint where m < 2^31, in decimals above."""
    wide = lambda x: x.cast("decimal(38,0)")
    step = lambda acc, w: wide((acc * F.lit(1 << 32) + w) % wide(m))

    def folded(d: Column) -> Column:
        words = F.array(*[F.conv(F.substring(d, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(3)])
        return F.when(m < F.lit(1 << 31), F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: (acc * F.lit(1 << 32) + w) % m)).otherwise(
            F.aggregate(words, wide(F.lit(0)), lambda acc, w: step(acc.cast("decimal(18,0)"), w.cast("decimal(10,0)"))).cast("bigint"))

    return let(digits, folded)


def ff1_body(body: Column, key: bytes, charset: str = "digits", tweak: bytes = b"", inverse: bool = False) -> Column:
    """The encrypted text of a text that has characters of the charset only and a length that fits."""
    if len(key) not in (16, 24, 32):
        raise InvalidRule("FF1 needs an AES key of 16, 24 or 32 bytes")
    radix, half, t = len(fpe.CHARSETS[charset]), half_length(charset), len(tweak)
    # by length of the right half: bytes of its number, bytes taken of the MAC
    sizes = [math.ceil(math.ceil(v * math.log2(radix)) / 8) for v in range(half + 1)]
    table = lambda values: F.array(*[F.lit(x) for x in values])
    powers = F.array(*[F.lit(radix**i).cast("bigint") for i in range(half + 1)])
    at = lambda values, i: F.element_at(values, (i + 1).cast("int"))

    def parts(text: Column) -> Column:
        """What all rounds of a text share."""
        n = F.length(text)
        u = F.floor(n / 2).cast("int")
        v = n - u
        size = at(table(sizes), v)
        head = F.concat(F.lit("010201" + f"{radix:06x}" + "0a"), _hex(u % 256, 2), _hex(n, 8), F.lit(f"{t:08x}" + tweak.hex()),
                        F.repeat(F.lit("00"), F.pmod(-t - size - 1, F.lit(16)).cast("int")))
        return F.struct(text.alias("text"), u.alias("u"), v.alias("v"), size.alias("size"), head.alias("head"), at(powers, u).alias("mu"), at(powers, v).alias("mv"))

    def run(p: Column) -> Column:
        text, u, v, size, head, mu, mv = (p[x] for x in ("text", "u", "v", "size", "head", "mu", "mv"))

        def turn(i: Column, known: Column, moved: Column) -> Column:
            """``moved`` with the round's number added, or taken away."""
            m = F.when(i % 2 == 0, mu).otherwise(mv)
            mac = _mac(F.concat(head, _hex(i, 2), _hex(known, 2 * size)), key)
            taken = F.lpad(mac.substr(F.lit(1), 8 * F.ceil(size / 4).cast("int") + 8), 24, F.lit("0"))
            y = _remainder(taken, m)
            return F.pmod(moved - y, m) if inverse else (moved + y) % m

        def step(acc: Column, i: Column) -> Column:
            if inverse:
                return F.struct(turn(i, acc["a"], acc["b"]).alias("a"), acc["a"].alias("b"))
            return F.struct(acc["b"].alias("a"), turn(i, acc["b"], acc["a"]).alias("b"))

        start = F.struct(fpe._to_number(text.substr(F.lit(1), u), charset).alias("a"), fpe._to_number(text.substr(u + 1, v), charset).alias("b"))
        order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        done = F.aggregate(table(order), start, step)
        return let(done, lambda x: F.concat(fpe._to_text(x["a"], u, powers, charset), fpe._to_text(x["b"], v, powers, charset)))

    return let(let(body, parts), run)


def unfit(c: Column, charset: str = "digits", check_digits: int = 0) -> Column:
    """True where a value has too few or too many characters of the charset."""
    n = F.length(fpe.body_of(c, charset)) - check_digits
    return (n < min_length(charset)) | (n > 2 * half_length(charset))


def ff1_text(c: Column, key: bytes, charset: str = "digits", luhn: bool = False, tweak: bytes = b"", inverse: bool = False) -> Column:
    """The characters of the charset are encrypted, every other one stays in its place. With ``luhn`` the last digit is worked out
    anew."""
    if charset not in fpe.CHARSETS:
        raise InvalidRule(f"unknown charset {charset!r}")
    if luhn and charset != "digits":
        raise InvalidRule("validate_luhn needs charset digits")

    def whole(b: Column) -> Column:
        if not luhn:
            return ff1_body(b, key, charset, tweak, inverse)
        moved = ff1_body(b.substr(F.lit(1), F.length(b) - 1), key, charset, tweak, inverse)
        return let(moved, lambda x: F.concat(x, checksums.luhn_digit(x)))

    ok = c.isNotNull() & ~unfit(c, charset, int(luhn))
    return F.when(ok, fpe._put_back(c, let(fpe.body_of(c, charset), whole), charset))
