"""Personal data detectors: patterns for whole cells and for spans inside prose.

Patterns stay in the subset that Java and RE2 read alike (no look-around, no back-references).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checksums


@dataclass(frozen=True)
class Detector:
    id: str
    cell: str                 # pattern for a whole cell
    strategy: str             # default strategy
    provider: str | None = None
    span: str | None = None   # pattern inside prose
    token: str | None = None
    check: str | None = None  # "luhn", "npi" or "iban"
    needs: str | None = None  # text every span of this kind contains; a plain search rules most texts out


# Detector ids with their default strategy and provider. The patterns are our own.
DETECTORS = (
    Detector("email", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", "faker", "person_email",
             r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[EMAIL]", needs="@"),
    Detector("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "hash", None, r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"),
    Detector("us_phone", r"^(\+?1[ .-]?)?(\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$", "faker", "person_phone",
             r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}\b", "[PHONE]"),
    Detector("person_name", r"^[A-Z][a-z]+( [A-Z]\.?)?( [A-Z][a-z]+)+$", "faker", "person_full_name"),
    Detector("iso_date", r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$", "date_shift"),
    Detector("us_date", r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/([0-9]{4}|[0-9]{2})$", "date_shift"),
    Detector("eu_date", r"^(0?[1-9]|[12][0-9]|3[01])[.](0?[1-9]|1[0-2])[.]([0-9]{4}|[0-9]{2})$", "date_shift"),
    Detector("us_zip", r"^[0-9]{5}(-[0-9]{4})?$", "truncate"),
    Detector("address_street", r"^[0-9]+ ([A-Z][a-z]+ )+(St|Street|Ave|Avenue|Rd|Road|Ln|Lane|Dr|Drive|Blvd|Way|Ct)\.?$",
             "faker", "address_street"),
    Detector("address_city", r"^[A-Z][a-z]+( [A-Z][a-z]+)?, [A-Z]{2}$", "faker", "address_city"),
    Detector("mrn", r"^MRN[- ]?[0-9]{6,10}$", "hash", None, r"\bMRN[- ]?[0-9]{6,10}\b", "[MRN]"),
    Detector("npi", r"^[12][0-9]{9}$", "hash", None, None, None, "npi"),
    Detector("ndc", r"^([0-9]{4,5}-[0-9]{3,4}-[0-9]{1,2})$", "hash"),
    Detector("icd10", r"^[A-TV-Z][0-9][0-9A-Z](\.[0-9A-Z]{1,4})?$", "truncate", None,
             r"\b[A-TV-Z][0-9][0-9]\.[0-9]{1,4}\b", "[ICD10]"),
    Detector("pan", r"^[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}$", "fpe", None,
             r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b", "[CARD]", "luhn"),
    Detector("cvv", r"^[0-9]{3,4}$", "redact"),
    Detector("iban", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", "hash", None, r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b",
             "[IBAN]", "iban"),
    Detector("uuid", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "faker", "uuid",
             r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "[UUID]", needs="-"),
    Detector("ipv4", r"^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$", "redact", None,
             r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.](?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\b", "[IP]"),
    Detector("url", r"^https?://[^ ]+$", "redact", None, r"https?://[A-Za-z0-9./?=&_%#:~+-]+", "[URL]", needs="://"),
)
BY_ID = {d.id: d for d in DETECTORS}
# spans are replaced in this order, so a long pattern is gone before a shorter one can cut into it
SPANS = tuple(BY_ID[i] for i in ("url", "email", "uuid", "iban", "pan", "ssn", "us_phone", "mrn", "ipv4", "icd10"))


def cell_hit(d: Detector, c: Column) -> Column:
    """True where the whole cell is of this kind; null cells are null."""
    hit = c.rlike(d.cell)
    return hit & verified(d, c) if d.check else hit


def verified(d: Detector, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if d.check == "luhn":
        return F.length(digits).between(12, 19) & checksums.luhn_valid(digits)
    if d.check == "npi":
        return checksums.npi_valid(s)
    if d.check == "iban":
        return checksums.iban_valid(s)
    return F.lit(True)


def may_hold(d: Detector, text: Column) -> Column:
    """False only where the text cannot hold a span: it lacks a literal every span has, or any digit. Cheap next to
    the pattern itself, and most texts stop here."""
    return text.contains(d.needs) if d.needs else text.rlike("[0-9]")


def spans(d: Detector, text: Column) -> Column:
    """Array of the spans of one detector, checksum applied."""
    found = F.regexp_extract_all(text, F.lit(d.span), F.lit(0))
    if d.check:
        found = F.filter(found, lambda s: verified(d, s))
    return F.when(may_hold(d, text), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
