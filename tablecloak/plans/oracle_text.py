"""Helpers that write the rules as DuckDB text."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import providers as P
from ..functions.checksums import VIN_VALUES, VIN_WEIGHTS
from ..keys import seed_key, sql_hmac, sql_row_message, sql_unit, sql_word, subkey
from .registry import SECRET, SEED


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: Sequence[str]) -> str:
    return "[" + ",".join(q(x) for x in items) + "]"


def item(items: Sequence[str], i: str) -> str:
    return f"list_extract({words(items)}, (({i}) % {len(items)}) + 1)"


def mask_hmac(msg: str, purpose: str, space: str) -> str:
    return sql_hmac(subkey(SECRET, purpose, space), msg)


def row_hmac(msg: str, purpose: str, table: str, column: str) -> str:
    return sql_hmac(subkey(SECRET, purpose, table, column, "by-row"), sql_row_message(msg))


def cell_hmac(table: str, column: str, i: str) -> str:
    """Digest of a generated cell."""
    return sql_hmac(subkey(seed_key(SEED), table, column), f"({i})::VARCHAR")


def pick(digest: str, n: int | str, draw: int = 0) -> str:
    return f"({sql_word(digest, draw)} % {n})"


unit = sql_unit


def pad(x: str, n: int) -> str:
    return f"lpad(({x})::VARCHAR, {n}, '0')"


def luhn_digit(body: str) -> str:
    """Sum from the right, the last body digit doubled."""
    return (f"((10 - list_sum(list_transform(range(1, length({body}) + 1), lambda pos_: "
            f"CASE WHEN (length({body}) - pos_) % 2 = 0 THEN CASE WHEN substr({body}, pos_, 1)::INT * 2 > 9 "
            f"THEN substr({body}, pos_, 1)::INT * 2 - 9 ELSE substr({body}, pos_, 1)::INT * 2 END "
            f"ELSE substr({body}, pos_, 1)::INT END)) % 10) % 10)::INT::VARCHAR")


def gtin_digit(body: str) -> str:
    return (f"((10 - list_sum(list_transform(range(1, length({body}) + 1), lambda pos_: substr({body}, pos_, 1)::INT * "
            f"CASE WHEN (length({body}) - pos_) % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT::VARCHAR")


def mod97(alnum: str) -> str:
    """Letters become two digits, the whole is read as one number modulo 97 in pieces."""
    value = "strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ch) - 1"
    digits = f"array_to_string(list_transform(string_split({alnum}, ''), lambda ch: ({value})::VARCHAR), '')"
    return f"list_reduce(string_split({digits}, ''), lambda acc, d: (acc * 10 + d::INT) % 97, 0)"


def iban_digits(country: str, bban: str) -> str:
    return f"lpad((98 - {mod97(f'({bban} || {country} || {chr(39)}00{chr(39)})')})::VARCHAR, 2, '0')"


def vin_digit(s: str) -> str:
    table = "".join(VIN_VALUES)
    nums = "".join(str(v) for v in VIN_VALUES.values())
    weights = "[" + ",".join(map(str, VIN_WEIGHTS)) + "]"
    total = (f"(list_sum(list_transform(range(1, 18), lambda pos_: translate(substr({s}, pos_, 1), '{table}', '{nums}')::INT"
             f" * {weights}[pos_])) % 11)::INT")
    return f"CASE WHEN {total} = 10 THEN 'X' ELSE ({total})::VARCHAR END"


def cusip_digit(body: str) -> str:
    v = f"substr({body}, pos_, 1)::INT * CASE WHEN pos_ % 2 = 0 THEN 2 ELSE 1 END"
    return (f"((10 - list_sum(list_transform(range(1, 9), lambda pos_: ({v}) // 10 + ({v}) % 10)) % 10) % 10)::INT::VARCHAR")


F_, L_ = len(P.FIRST), len(P.LAST)
N_ = F_ * L_
D_ = len(P.DOMAINS)
S_, X_ = len(P.STREETS), len(P.SUFFIXES)
C_ = len(P.CITIES)


def _street(i: str) -> str:
    return (f"((({i}) // {S_ * X_} + 1)::VARCHAR || ' ' || {item(P.STREETS, i)} || ' ' || "
            f"{item(P.SUFFIXES, f'(({i}) // {S_})')})")


def _place(i: str, part: int) -> str:
    return f"split_part({item(P.CITIES, i)}, ',', {part + 1})"


def _zip(i: str) -> str:
    return f"({_place(i, 2)} || {pad(f'(({i}) // {C_}) % 100', 2)})"


def _full(i: str) -> str:
    return f"({item(P.FIRST, i)} || ' ' || {item(P.LAST, f'(({i}) // {F_})')})"


def _email(i: str) -> str:
    return (f"(lower({item(P.FIRST, i)}) || '.' || lower({item(P.LAST, f'(({i}) // {F_})')}) || "
            f"(({i}) // {N_ * D_})::VARCHAR || '@' || {item(P.DOMAINS, f'(({i}) // {N_})')})")


def _npi(i: str) -> str:
    b = f"((1 + (({i}) // 100000000) % 2)::VARCHAR || {pad(f'({i}) % 100000000', 8)})"
    pre = f"('80840' || {b})"
    return f"({b} || {luhn_digit(pre)})"


def _pan(i: str) -> str:
    b = f"('400000' || {pad(f'({i}) % 1000000000', 9)})"
    return f"({b} || {luhn_digit(b)})"


def _cusip(i: str) -> str:
    b = f"({pad(f'(({i}) // 100) % 1000000', 6)} || {pad(f'({i}) % 100', 2)})"
    return f"({b} || {cusip_digit(b)})"


def _iban(i: str) -> str:
    b = pad(i, 18)
    return f"('DE' || {iban_digits(q('DE'), b)} || {b})"


PROVIDER_SQL = {
    "person_first_name": lambda i: item(P.FIRST, i),
    "person_last_name": lambda i: item(P.LAST, i),
    "person_name": _full,
    "person_full_name": _full,
    "person_email": _email,
    "person_phone": lambda i: f"('(' || (200 + (({i}) // 100) % 800)::VARCHAR || ') 555-01' || {pad(f'({i}) % 100', 2)})",
    "date_of_birth": lambda i: f"(DATE '1940-01-01' + ({i})::INT)",
    "address_street": _street,
    "address_city": lambda i: _place(i, 0),
    "address_state": lambda i: item(P.STATES, i),
    "address_zip": _zip,
    "address_full": lambda i: f"({_street(f'(({i}) // {C_ * 100})')} || ', ' || {_place(i, 0)} || ', ' || {_place(i, 1)} || ' ' || {_zip(i)})",
    "synthetic_ssn": lambda i: (f"((900 + (({i}) // {99 * 9999}) % 100)::VARCHAR || '-' || {pad(f'(({i}) // 9999) % 99 + 1', 2)}"
                                f" || '-' || {pad(f'({i}) % 9999 + 1', 4)})"),
    "synthetic_mrn": lambda i: f"('MRN' || {pad(i, 8)})",
    "synthetic_npi": _npi,
    "synthetic_ndc": lambda i: (f"({pad(f'(({i}) // 1000000) % 100000', 5)} || '-' || {pad(f'(({i}) // 100) % 10000', 4)}"
                                f" || '-' || {pad(f'({i}) % 100', 2)})"),
    "synthetic_icd10": lambda i: (f"({item(tuple(P.ICD_LETTERS), f'(({i}) // 1000)')} || {pad(f'(({i}) // 10) % 100', 2)}"
                                  f" || '.' || (({i}) % 10)::VARCHAR)"),
    "synthetic_iban": _iban,
    "synthetic_account_number": lambda i: pad(i, 12),
    "synthetic_pan": _pan,
    "synthetic_ein": lambda i: f"({pad(f'(({i}) // 10000000) % 90 + 10', 2)} || '-' || {pad(f'({i}) % 10000000', 7)})",
    "synthetic_cusip": _cusip,
    "synthetic_member_id": lambda i: f"('M' || {pad(i, 9)})",
    "synthetic_plan_id": lambda i: f"('PLN-' || {pad(i, 5)})",
    "lorem": lambda i: "concat_ws(' ', " + ", ".join(item(P.LOREM, f"(({i}) // {len(P.LOREM) ** k})") for k in range(4)) + ")",
    "job": lambda i: item(P.JOBS, i),
    "date_this_year": lambda i: f"(DATE '2024-01-01' + ({i})::INT)",
    "date_this_decade": lambda i: f"(DATE '2020-01-01' + ({i})::INT)",
    "date_time_this_year": lambda i: f"(TIMESTAMP '2024-01-01' + to_seconds({i}))",
}


def uuid_of(h: str) -> str:
    s = lambda a, n: f"substr({h}, {a}, {n})"
    return f"({s(1, 8)} || '-' || {s(9, 4)} || '-4' || {s(14, 3)} || '-8' || {s(18, 3)} || '-' || {s(21, 12)})"


def provider(name: str, digest: str, draw: int = 0) -> str:
    """Value of a provider drawn from a digest."""
    name = P.ALIASES.get(name, name)
    if name == "uuid" and draw == 0:
        return uuid_of(digest)
    return PROVIDER_SQL[name](pick(digest, P.PROVIDERS[name].size, draw))


def weighted(u: str, categories: Sequence, weights: Sequence[float] | None) -> str:
    w = weights or [1.0] * len(categories)
    total, run, out = float(sum(w)), 0.0, "CASE"
    for c, x in list(zip(categories, w))[:-1]:
        run += x
        out += f" WHEN {u} < {run / total!r}::DOUBLE THEN {q(c)}"
    if len(categories) == 1:
        return q(categories[0])
    return out + f" ELSE {q(categories[-1])} END"
