"""Synthetic value providers.

A provider is a formula from an index in [0, size) to a value, so it needs no lookup table, no join and no state,
and ``unique`` is a permutation of the index. Names and places are ordinary public words of our own choice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..keys import int_div, pick
from . import checksums, locales
from .fpe import let

FIRST = ("Ada", "Amir", "Bea", "Carl", "Chen", "Dana", "Eli", "Emma", "Finn", "Gita", "Hugo", "Ines", "Ivan", "Jana",
         "Joel", "Kara", "Karl", "Lena", "Liam", "Lucy", "Mara", "Marc", "Maya", "Milo", "Nina", "Noah", "Olga", "Omar",
         "Paul", "Rosa", "Ruth", "Saul", "Tara", "Theo", "Uma", "Vera", "Wade", "Yara", "Zane", "Zoe")
LAST = ("Abbott", "Baker", "Bell", "Brooks", "Castro", "Cohen", "Cole", "Cruz", "Diaz", "Dixon", "Ellis", "Evans",
        "Fisher", "Flores", "Ford", "Garcia", "Grant", "Hayes", "Hill", "Hunt", "Ito", "Jensen", "Khan", "Kim", "Lane",
        "Lee", "Lopez", "Marsh", "Meyer", "Moss", "Nolan", "Novak", "Olsen", "Ortiz", "Park", "Patel", "Perez", "Quinn",
        "Reed", "Rossi", "Ryan", "Sato", "Shaw", "Silva", "Stone", "Tan", "Vega", "Wang", "Ward", "West")
STREETS = ("Oak", "Maple", "Cedar", "Pine", "Elm", "Lake", "Hill", "River", "Park", "Mill", "Church", "Spring", "Ridge",
           "Garden", "Forest", "Meadow", "Sunset", "Willow", "Orchard", "Harbor")
SUFFIXES = ("St", "Ave", "Rd", "Ln", "Dr", "Way")
CITIES = ("Austin,TX,787", "Boise,ID,837", "Boston,MA,021", "Chicago,IL,606", "Dallas,TX,752", "Denver,CO,802",
          "Detroit,MI,482", "Fresno,CA,937", "Honolulu,HI,968", "Houston,TX,770", "Juneau,AK,998", "Lincoln,NE,685",
          "Memphis,TN,381", "Miami,FL,331", "Mobile,AL,366", "Newark,NJ,071", "Omaha,NE,681", "Orlando,FL,328",
          "Phoenix,AZ,850", "Portland,OR,972", "Raleigh,NC,276", "Reno,NV,895", "Seattle,WA,981", "Tucson,AZ,857",
          "Tulsa,OK,741")
STATES = ("AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
          "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK",
          "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY")
DOMAINS = ("example.com", "example.org", "example.net", "mail.example", "post.example")
LOREM = ("lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do", "eiusmod", "tempor",
         "incididunt", "ut", "labore", "et", "dolore", "magna", "aliqua", "enim", "minim", "veniam", "quis", "nostrud")
JOBS = ("Accountant", "Analyst", "Architect", "Baker", "Buyer", "Chemist", "Clerk", "Coach", "Designer", "Editor",
        "Engineer", "Farmer", "Geologist", "Librarian", "Manager", "Nurse", "Pilot", "Planner", "Teacher", "Writer")
ICD_LETTERS = "ABCDEFGHIJKLMNOPQRSTVWXYZ"


@dataclass(frozen=True)
class Provider:
    size: int
    at: Callable[[Column], Column]
    from_digest: Callable[[Column], Column] | None = None


def item(words: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def _pad(i: Column, width: int) -> Column:
    return F.lpad(i.cast("string"), width, "0")


def _part(i: Column, below: int) -> Column:
    """The index left over once the parts below (product of their sizes) are used up."""
    return int_div(i, below)


def _full_name(i: Column) -> Column:
    return F.concat(item(FIRST, i), F.lit(" "), item(LAST, _part(i, len(FIRST))))


NAMES = len(FIRST) * len(LAST)


def _email(i: Column) -> Column:
    return F.concat(
        F.lower(item(FIRST, i)), F.lit("."), F.lower(item(LAST, _part(i, len(FIRST)))),
        _part(i, NAMES * len(DOMAINS)).cast("string"), F.lit("@"), item(DOMAINS, _part(i, NAMES)),
    )


def _phone(i: Column) -> Column:
    return F.concat(F.lit("("), (F.lit(200) + _part(i, 100) % 800).cast("string"), F.lit(") 555-01"), _pad(i % 100, 2))


def _street(i: Column) -> Column:
    n = len(STREETS)
    return F.concat(
        (_part(i, n * len(SUFFIXES)) + 1).cast("string"), F.lit(" "), item(STREETS, i), F.lit(" "),
        item(SUFFIXES, _part(i, n)),
    )


def _place(i: Column, part: int) -> Column:
    return F.split(item(CITIES, i), ",")[part]


def _zip(i: Column) -> Column:
    return F.concat(_place(i, 2), _pad(_part(i, len(CITIES)) % 100, 2))


def _address(i: Column) -> Column:
    return F.concat(_street(_part(i, len(CITIES) * 100)), F.lit(", "), _place(i, 0), F.lit(", "), _place(i, 1),
                    F.lit(" "), _zip(i))


def _ssn(i: Column) -> Column:
    """Area 900 to 999, which is never issued."""
    return F.concat((F.lit(900) + _part(i, 99 * 9999) % 100).cast("string"), F.lit("-"),
                    _pad(_part(i, 9999) % 99 + 1, 2), F.lit("-"), _pad(i % 9999 + 1, 4))


def _npi(i: Column) -> Column:
    body = F.concat((F.lit(1) + _part(i, 10**8) % 2).cast("string"), _pad(i % 10**8, 8))
    return let(body, lambda b: F.concat(b, checksums.npi_digit(b)))


def _ndc(i: Column) -> Column:
    return F.concat(_pad(_part(i, 10**6) % 10**5, 5), F.lit("-"), _pad(_part(i, 100) % 10**4, 4), F.lit("-"), _pad(i % 100, 2))


def _icd10(i: Column) -> Column:
    return F.concat(item(tuple(ICD_LETTERS), _part(i, 1000)), _pad(_part(i, 10) % 100, 2), F.lit("."), (i % 10).cast("string"))


def _iban(i: Column) -> Column:
    """German layout: 8 digit bank, 10 digit account."""
    bban = _pad(i, 18)
    return let(bban, lambda b: F.concat(F.lit("DE"), checksums.iban_digits(F.lit("DE"), b), b))


def _pan(i: Column) -> Column:
    """Test range 400000."""
    body = F.concat(F.lit("400000"), _pad(i % 10**9, 9))
    return let(body, lambda b: F.concat(b, checksums.luhn_digit(b)))


def _ein(i: Column) -> Column:
    return F.concat(_pad(_part(i, 10**7) % 90 + 10, 2), F.lit("-"), _pad(i % 10**7, 7))


def _cusip(i: Column) -> Column:
    body = F.concat(_pad(_part(i, 100) % 10**6, 6), _pad(i % 100, 2))
    return let(body, lambda b: F.concat(b, checksums.cusip_digit(b)))


def _uuid(hex32: Column) -> Column:
    s = lambda a, n: F.substring(hex32, a, n)
    return F.concat(s(1, 8), F.lit("-"), s(9, 4), F.lit("-4"), s(14, 3), F.lit("-8"), s(18, 3), F.lit("-"), s(21, 12))


def _lorem(i: Column) -> Column:
    n = len(LOREM)
    return F.concat_ws(" ", *[item(LOREM, _part(i, n**k)) for k in range(4)])


def _date(first: str, i: Column) -> Column:
    return F.date_add(F.lit(first).cast("date"), i.cast("int"))


PROVIDERS: dict[str, Provider] = {
    "person_first_name": Provider(len(FIRST), lambda i: item(FIRST, i)),
    "person_last_name": Provider(len(LAST), lambda i: item(LAST, i)),
    "person_name": Provider(NAMES, _full_name),
    "person_full_name": Provider(NAMES, _full_name),
    "person_email": Provider(NAMES * len(DOMAINS) * 10**6, _email),
    "person_phone": Provider(80_000, _phone),
    "date_of_birth": Provider(25_000, lambda i: _date("1940-01-01", i)),
    "address_street": Provider(len(STREETS) * len(SUFFIXES) * 999, _street),
    "address_city": Provider(len(CITIES), lambda i: _place(i, 0)),
    "address_state": Provider(len(STATES), lambda i: item(STATES, i)),
    "address_zip": Provider(len(CITIES) * 100, _zip),
    "address_full": Provider(len(CITIES) * 100 * len(STREETS) * len(SUFFIXES) * 999, _address),
    "synthetic_ssn": Provider(100 * 99 * 9999, _ssn),
    "synthetic_mrn": Provider(10**8, lambda i: F.concat(F.lit("MRN"), _pad(i, 8))),
    "synthetic_npi": Provider(2 * 10**8, _npi),
    "synthetic_ndc": Provider(10**11, _ndc),
    "synthetic_icd10": Provider(len(ICD_LETTERS) * 1000, _icd10),
    "synthetic_iban": Provider(10**17, _iban),
    "synthetic_account_number": Provider(10**12, lambda i: _pad(i, 12)),
    "synthetic_pan": Provider(10**9, _pan),
    "synthetic_ein": Provider(90 * 10**7, _ein),
    "synthetic_cusip": Provider(10**8, _cusip),
    "synthetic_member_id": Provider(10**9, lambda i: F.concat(F.lit("M"), _pad(i, 9))),
    "synthetic_plan_id": Provider(10**5, lambda i: F.concat(F.lit("PLN-"), _pad(i, 5))),
    "uuid": Provider(2**59, lambda i: _uuid(F.lpad(F.lower(F.hex(i)), 32, "0")), _uuid),
    "lorem": Provider(len(LOREM) ** 4, _lorem),
    "job": Provider(len(JOBS), lambda i: item(JOBS, i)),
    # dates relative to a fixed day, so a run can be repeated
    "date_this_year": Provider(366, lambda i: _date("2024-01-01", i)),
    "date_this_decade": Provider(1827, lambda i: _date("2020-01-01", i)),
    "date_time_this_year": Provider(
        366 * 86_400, lambda i: F.timestamp_seconds(F.lit(1_704_067_200) + i).cast("timestamp")),
}
# Generation names for the same providers.
ALIASES = {
    "name": "person_full_name", "first_name": "person_first_name", "last_name": "person_last_name",
    "email": "person_email", "phone_number": "person_phone", "street_address": "address_street",
    "city": "address_city", "state_abbr": "address_state", "zipcode": "address_zip", "address": "address_full",
    "ssn": "synthetic_ssn", "uuid4": "uuid", "text": "lorem", "sentence": "lorem", "iban": "synthetic_iban",
    "credit_card_number": "synthetic_pan", "ein": "synthetic_ein",
}
COMPOSITES: dict[str, tuple[int, dict[str, Callable[[Column], Column]]]] = {
    "composite_person": (NAMES, {
        "first_name": lambda i: item(FIRST, i), "last_name": lambda i: item(LAST, _part(i, len(FIRST))),
        "full_name": _full_name}),
    "composite_name_email": (NAMES * len(DOMAINS) * 10**6, {
        "first_name": lambda i: item(FIRST, i), "last_name": lambda i: item(LAST, _part(i, len(FIRST))),
        "email": _email}),
    "composite_address": (len(CITIES) * 100 * len(STREETS) * len(SUFFIXES) * 999, {
        "street": lambda i: _street(_part(i, len(CITIES) * 100)), "city": lambda i: _place(i, 0),
        "state": lambda i: _place(i, 1), "zip": _zip}),
    "composite_city_state_zip": (len(CITIES) * 100, {
        "city": lambda i: _place(i, 0), "state": lambda i: _place(i, 1), "zip": _zip}),
}


def register_provider(name: str, size: int, at: Callable[[Column], Column]) -> None:
    """Add a custom provider: a column function of an index in [0, size)."""
    PROVIDERS[name] = Provider(size, at)


def get_provider(name: str, **kwargs: object) -> Provider:
    name = ALIASES.get(name, name)
    if name == "random_choice":
        values = tuple(kwargs.get("values") or ())
        if not values:
            raise InvalidRule("random_choice needs values")
        return Provider(len(values), lambda i: item(values, i))
    if name in ("random_int_range", "random_int", "pyint"):
        lo, hi = int(kwargs.get("min", 0)), int(kwargs.get("max", 9999))
        if hi < lo:
            raise InvalidRule("random_int needs min <= max")
        return Provider(hi - lo + 1, lambda i: i + F.lit(lo).cast("bigint"))
    if name == "pybool":
        return Provider(2, lambda i: i == 1)
    if name == "bothify":
        text = str(kwargs.get("text", "## ??"))
        sizes = [10 if ch == "#" else 26 if ch == "?" else 1 for ch in text]
        total = 1
        parts = []
        for ch, s in zip(text, sizes):
            below = total
            parts.append((ch, below))
            total *= s
        return Provider(total, lambda i: F.concat(*[
            (_part(i, b) % 10).cast("string") if ch == "#"
            else F.char(F.lit(97) + _part(i, b) % 26) if ch == "?" else F.lit(ch) for ch, b in parts]))
    if name not in PROVIDERS:
        raise InvalidRule(f"unknown provider {name!r}")
    locale = str(kwargs.get("locale") or locales.DEFAULT)
    own = {} if locale == locales.DEFAULT else locales.localized(locale)
    return Provider(*own[name]) if name in own else PROVIDERS[name]


def value_from_digest(p: Provider, digest: Column, draw: int = 0) -> Column:
    if p.from_digest is not None and draw == 0:
        return p.from_digest(digest)
    return p.at(pick(digest, p.size, draw))


