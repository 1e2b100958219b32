"""Check digits as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# VIN transliteration (ISO 3779), position weights, and the NPI issuer prefix.
VIN_VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5,
    "P": 7, "R": 9, "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
NPI_PREFIX = "80840"


def _digit(s: Column, pos: Column) -> Column:
    return s.substr(pos, F.lit(1)).cast("int")


def _sum(s: Column, term) -> Column:
    """Sum of term(digit at position, position) over the 1-based positions of s."""
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda a, i: a + term(s.substr(i, F.lit(1)), i))


def luhn_valid(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]+$"), F.call_function("luhn_check", s)).otherwise(F.when(s.isNotNull(), F.lit(False)))


def luhn_digit(body: Column) -> Column:
    """The digit that makes body || digit pass Luhn."""
    n = F.length(body)

    def term(ch: Column, i: Column) -> Column:
        d = ch.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return ((F.lit(10) - _sum(body, term) % 10) % 10).cast("string")


def npi_valid(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]{10}$"), F.call_function("luhn_check", F.concat(F.lit(NPI_PREFIX), s))).otherwise(
        F.when(s.isNotNull(), F.lit(False)))


def npi_digit(body9: Column) -> Column:
    return luhn_digit(F.concat(F.lit(NPI_PREFIX), body9))


def _mod97(alnum: Column) -> Column:
    """Remainder of the number read from the text with A=10 ... Z=35, folded one character at a time."""
    def step(acc: Column, i: Column) -> Column:
        v = F.conv(alnum.substr(i, F.lit(1)), 36, 10).cast("int")
        return F.when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(alnum)), F.lit(0), step)


def iban_valid(s: Column) -> Column:
    c = F.regexp_replace(s, " ", "")
    ok = c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    turned = F.concat(c.substr(F.lit(5), F.length(c)), F.substring(c, 1, 4))
    return F.when(ok, _mod97(turned) == 1).otherwise(F.when(s.isNotNull(), F.lit(False)))


def iban_digits(country: Column, bban: Column) -> Column:
    return F.lpad((F.lit(98) - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0")


def _vin_value(ch: Column) -> Column:
    letters = "".join(VIN_VALUES)
    digits = "".join(str(v) for v in VIN_VALUES.values())
    return F.translate(ch, letters, digits).cast("int")


def vin_digit(s: Column) -> Column:
    """The character position 9 should hold."""
    w = F.array(*[F.lit(x) for x in VIN_WEIGHTS])
    r = _sum(s, lambda ch, i: _vin_value(ch) * F.element_at(w, i)) % 11
    return F.when(r == 10, F.lit("X")).otherwise(r.cast("string"))


def vin_valid(s: Column) -> Column:
    ok = s.rlike("^[A-HJ-NPR-Z0-9]{17}$")
    # position 9 weighs 0, but a letter there still needs a value, so it is read as 0
    body = F.concat(F.substring(s, 1, 8), F.lit("0"), F.substring(s, 10, 8))
    return F.when(ok, vin_digit(body) == F.substring(s, 9, 1)).otherwise(F.when(s.isNotNull(), F.lit(False)))


def gtin_digit(body: Column) -> Column:
    """EAN-13, ISBN-13 and every GTIN: weights 3, 1 from the right."""
    n = F.length(body)
    total = _sum(body, lambda ch, i: ch.cast("int") * F.when((n - i) % 2 == 0, F.lit(3)).otherwise(F.lit(1)))
    return ((F.lit(10) - total % 10) % 10).cast("string")


def gtin_valid(s: Column, lengths: tuple[int, ...] = (8, 12, 13, 14)) -> Column:
    ok = s.rlike("^[0-9]+$") & F.length(s).isin(*lengths)
    body = s.substr(F.lit(1), F.length(s) - 1)
    return F.when(ok, gtin_digit(body) == F.right(s, F.lit(1))).otherwise(F.when(s.isNotNull(), F.lit(False)))


def ean13_valid(s: Column) -> Column:
    return gtin_valid(s, (13,))


def isbn13_valid(s: Column) -> Column:
    c = F.regexp_replace(s, "-", "")
    return gtin_valid(c, (13,)) & c.rlike("^97[89]")


def cusip_digit(body8: Column) -> Column:
    def term(ch: Column, i: Column) -> Column:
        v = F.conv(ch, 36, 10).cast("int")
        v = F.when(i % 2 == 0, v * 2).otherwise(v)
        return F.floor(v / 10).cast("int") + v % 10

    return ((F.lit(10) - _sum(body8, term) % 10) % 10).cast("string")


VALIDATORS = {
    "luhn": luhn_valid, "npi": npi_valid, "iban": iban_valid, "vin": vin_valid, "gtin": gtin_valid,
    "ean13": ean13_valid, "isbn13": isbn13_valid,
}
