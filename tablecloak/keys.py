"""Keyed randomness as native expressions.

Masking is keyed by a secret of 32 bytes or more; generation by a seed or master key. The driver derives one
subkey per purpose, and only subkeys enter a plan. A cell's randomness is HMAC-SHA256 of what identifies the
cell, so it does not depend on partitions, retries or row order. One digest holds four independent draws.
"""

from __future__ import annotations

import hashlib
import hmac
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import WeakSecret

BLOCK = 64
ROUNDS = 8
DRAWS = 4


def check_secret(secret: bytes | str) -> bytes:
    raw = bytes.fromhex(secret) if isinstance(secret, str) else bytes(secret)
    if len(raw) < 32:
        raise WeakSecret("a mask secret needs 32 bytes or more")
    return raw


def subkey(secret: bytes, *labels: object) -> bytes:
    """Derived on the driver. Labels are length prefixed, so ("a","bc") and ("ab","c") differ."""
    msg = b"".join(len(t := str(x).encode()).to_bytes(4, "big") + t for x in labels)
    return hmac.new(secret, msg, hashlib.sha256).digest()


def seed_key(seed: int | None = None, master: bytes | None = None, label: str = "") -> bytes:
    """Generation key: the seed, or a master key with a label when given."""
    if master is not None:
        return subkey(master, "generate", label)
    return subkey(b"tablecloak-seed", "generate", int(seed or 0))


def pads(key: bytes) -> tuple[bytes, bytes]:
    k = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_hex(key: bytes, msg: Column) -> Column:
    """HMAC-SHA256 of a text column as 64 hex digits; null in, null out."""
    ipad, opad = pads(key)
    inner = F.sha2(F.concat(F.lit(ipad), msg.cast("string").cast("binary")), 256)
    return F.sha2(F.concat(F.lit(opad), F.unhex(inner)), 256)


def row_message(*parts: Column) -> Column:
    """Text that identifies a row. Every part has its length before it and a null part is a sign of its own, so different
    rows have different texts whatever their cells hold."""
    text = [p.cast("string") for p in parts]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def word(digest: Column, draw: int = 0) -> Column:
    """Draw number ``draw`` (0 to 3) as a 60 bit integer."""
    return F.conv(F.substring(digest, 1 + 16 * draw, 15), 16, 10).cast("bigint")


def unit(digest: Column, draw: int = 0) -> Column:
    """Draw number ``draw`` as a double in [0, 1), 52 bits."""
    return F.conv(F.substring(digest, 1 + 16 * draw, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def pick(digest: Column, n: int | Column, draw: int = 0) -> Column:
    """Index in [0, n)."""
    return word(digest, draw) % (F.lit(n).cast("bigint") if isinstance(n, int) else n)


def never_null(x: Column) -> Column:
    """For a drawn number used as a join key: a key that cannot be null gets no null filter, which would work the
    whole draw out a second time."""
    return F.coalesce(x, F.lit(-1).cast("bigint"))


def int_div(x: Column, n: int | Column) -> Column:
    """Exact integer division of non-negative bigints (a double quotient would round past 2^53)."""
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    return F.call_function("div", x, n)


def _round_word(key: bytes, tweak: Column, i: Column, half: Column) -> Column:
    """One keyed digest a round: SHA-256 of a 32 byte subkey and the message, cut to 60 bits. The cut leaves nothing
    to extend, so the second pass of an HMAC would only cost time here."""
    msg = F.concat(tweak, F.lit("|"), i.cast("string"), F.lit("|"), half.cast("string"))
    return word(F.sha2(F.concat(F.lit(key), msg.cast("binary")), 256))


def feistel(key: bytes, tweak: Column, left: Column, right: Column, m_left: Column, m_right: Column,
            inverse: bool = False) -> Column:
    """Alternating Feistel on Z_a x Z_b (Black and Rogaway 2002), keyed SHA-256 rounds; struct(l, r) of bigint.

    An even round adds F(right) to left mod a, an odd round adds F(left) to right mod b; halves swap places
    every round, so after an even number of rounds they are back. The loop is a native ``aggregate``: nothing
    leaves the JVM and the expression does not grow with the number of rounds.
    """
    rounds = list(range(ROUNDS))
    steps = F.array(*[F.lit(r) for r in (reversed(rounds) if inverse else rounds)])

    def step(acc: Column, i: Column) -> Column:
        m = F.when((i % 2) == 0, m_left).otherwise(m_right)
        if inverse:
            f = _round_word(key, tweak, i, acc["l"])
            return F.struct(((acc["r"] - f % m + m) % m).alias("l"), acc["l"].alias("r"))
        f = _round_word(key, tweak, i, acc["r"])
        return F.struct(acc["r"].alias("l"), ((acc["l"] + f % m) % m).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(steps, start, step)


def permute(key: bytes, index: Column, n: int, inverse: bool = False, tweak: str = "perm") -> Column:
    """Keyed bijection of [0, n). Exact, needs no state and no shuffle.

    [0, n) sits inside Z_a x Z_b with a = ceil(sqrt n), b = ceil(n / a); a result past n is walked again.
    At most a*b - n < a values lie outside, so a walk is at most that long; past ``walks`` steps (chance under
    b ** -16) the expression raises instead of returning a wrong value.
    """
    if n <= 1:
        return F.when(index.isNotNull(), F.lit(0).cast("bigint"))
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    walks = min(a * b - n, 16)

    def once(x: Column) -> Column:
        s = feistel(key, F.lit(f"{tweak}|{n}"), int_div(x, b),
                    x % F.lit(b), F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), inverse)
        return F.element_at(F.transform(F.array(s), lambda t: t["l"] * F.lit(b) + t["r"]), 1)

    start = once(index.cast("bigint"))
    if walks == 0:
        return start
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), start, lambda x, _: F.when(x < n, x).otherwise(once(x))
    )
    if walks < a * b - n:
        walked = F.element_at(
            F.transform(
                F.array(walked),
                lambda x: F.when(x >= n, F.raise_error(F.lit("permutation walk too long")).cast("bigint")).otherwise(x),
            ),
            1,
        )
    return F.when(index.isNotNull(), walked)


# The same rules as text for DuckDB, used by the oracles.


def sql_hmac(key: bytes, msg: str) -> str:
    ipad, opad = pads(key)
    return f"sha256(from_hex('{opad.hex()}') || from_hex(sha256(from_hex('{ipad.hex()}') || encode({msg}))))"


def sql_row_message(*parts: str) -> str:
    return "(" + " || ".join(f"coalesce(length(({p})::VARCHAR)::VARCHAR || ':' || ({p})::VARCHAR, '-')" for p in parts) + ")"


def sql_word(digest: str, draw: int = 0) -> str:
    return f"('0x' || substr({digest}, {1 + 16 * draw}, 15))::BIGINT"


def sql_unit(digest: str, draw: int = 0) -> str:
    return f"(('0x' || substr({digest}, {1 + 16 * draw}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _sql_keyed(key: bytes, msg: str) -> str:
    return f"sha256(from_hex('{key.hex()}') || encode({msg}))"


def sql_feistel(key: bytes, tweak: str, left: str, right: str, m_left: str, m_right: str) -> str:
    """A DuckDB struct {l, r}; integer arithmetic in HUGEINT is avoided by taking the word mod m first."""
    half = "CASE WHEN ri_ % 2 = 0 THEN acc_.r ELSE acc_.l END"
    f = sql_word(_sql_keyed(key, f"({tweak}) || '|' || ri_::VARCHAR || '|' || ({half})::VARCHAR"))
    return (
        f"list_reduce(range(0, {ROUNDS}), lambda acc_, ri_: {{"
        f"'l': CASE WHEN ri_ % 2 = 0 THEN (acc_.l + {f} % ({m_left})) % ({m_left}) ELSE acc_.l END, "
        f"'r': CASE WHEN ri_ % 2 = 0 THEN acc_.r ELSE (acc_.r + {f} % ({m_right})) % ({m_right}) END}}, "
        f"{{'l': ({left})::BIGINT, 'r': ({right})::BIGINT}})"
    )


def sql_permute(key: bytes, index: str, n: str, tweak: str = "perm") -> str:
    """Permutation of [0, n) with n an SQL expression; walks 16 times like the rule allows."""
    a = f"ceil(sqrt(({n})::DOUBLE))::BIGINT"
    b = f"((({n}) + {a} - 1) // {a})"
    def once(x: str) -> str:
        s = sql_feistel(key, f"'{tweak}|' || ({n})::VARCHAR", f"({x}) // {b}", f"({x}) % {b}", a, b)
        return f"list_transform([{s}], lambda fs_: fs_.l * {b} + fs_.r)[1]"
    return (f"list_reduce(range(0, 17), lambda px_, pw_: CASE WHEN pw_ > 0 AND px_ < ({n}) THEN px_ ELSE "
            f"{once('px_')} END, ({index})::BIGINT)")
