"""Column-pattern bundles and policy rules: they choose strategies on the driver and add nothing at run time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..errors import InvalidRule, PolicyFailed
from .masks import Rule, keep as keep_rules, rule

_ISO = "%Y-%m-%d"
# Preset column names with their strategies.
PRESETS: dict[str, dict[str, Rule]] = {
    "hipaa": {
        "first_name": rule("*", "faker", provider="person_first_name"),
        "last_name": rule("*", "faker", provider="person_last_name"),
        "street": rule("*", "faker", provider="address_street"),
        "city": rule("*", "faker", provider="address_city"),
        "zip": rule("*", "geo_generalize", type="zip", cascade=["zip5", "zip3", "state", "suppress"], k_threshold=20_000),
        "dob": rule("*", "date_shift", "patient_dates", min_days=-30, max_days=30, date_format=_ISO),
        "admission_date": rule("*", "date_shift", "patient_dates", min_days=-30, max_days=30, date_format=_ISO),
        "discharge_date": rule("*", "date_shift", "patient_dates", min_days=-30, max_days=30, date_format=_ISO),
        "phone": rule("*", "faker", provider="person_phone"),
        "fax": rule("*", "faker", provider="person_phone"),
        "email": rule("*", "faker", provider="person_email"),
        "ssn": rule("*", "fpe", "ssn_identity", charset="digits"),
        "mrn": rule("*", "fpe", "mrn_identity", charset="ALPHANUM"),
        "account_number": rule("*", "fpe", "account_identity", charset="ALPHANUM"),
        "vehicle_id": rule("*", "fpe", "vehicle_identity", charset="ALPHANUM"),
        **{c: rule("*", "redact") for c in ("health_plan_id", "license_number", "device_id", "url", "ip_address", "biometric_id")},
    },
    "pci": {
        "cardholder_name": rule("*", "faker", provider="person_name"),
        "card_number": rule("*", "fpe", "pan_identity", charset="digits", validate_luhn=True),
        "card_expiry": rule("*", "redact"), "cvv": rule("*", "redact"),
        "billing_zip": rule("*", "truncate", length=3),
        "email": rule("*", "faker", provider="person_email"),
        "transaction_id": rule("*", "hash", "transaction_identity"),
        "transaction_date": rule("*", "date_shift", "transaction_dates", min_days=-30, max_days=30, date_format=_ISO),
    },
    "gdpr": {
        "full_name": rule("*", "faker", provider="person_name"),
        "email": rule("*", "faker", provider="person_email"),
        "phone": rule("*", "faker", provider="person_phone"),
        "city": rule("*", "faker", provider="address_city"),
        "device_id": rule("*", "hash", "device_identity"),
        "country": rule("*", "passthrough"),
        "postal_code": rule("*", "truncate", length=3),
        "salary": rule("*", "shuffle"),
        **{c: rule("*", "redact") for c in ("ip_address", "user_agent", "national_id", "passport_number", "ethnicity",
                                            "religion", "health_condition")},
    },
    "ccpa": {
        "full_name": rule("*", "faker", provider="person_name"),
        "email": rule("*", "faker", provider="person_email"),
        "phone": rule("*", "faker", provider="person_phone"),
        "street": rule("*", "faker", provider="address_street"),
        "zip": rule("*", "truncate", length=3),
        "ssn": rule("*", "fpe", "ssn_identity", charset="digits"),
        "account_number": rule("*", "fpe", "account_identity", charset="ALPHANUM"),
        "device_id": rule("*", "hash", "device_identity"),
        "household_id": rule("*", "hash", "household_identity"),
        "purchase_date": rule("*", "date_shift", "purchase_dates", min_days=-30, max_days=30, date_format=_ISO),
        **{c: rule("*", "redact") for c in ("ip_address", "geolocation", "browsing_history", "biometric_id", "license_number", "passport_number")},
    },
}
# The edition of each preset, its date and the digest of its rules. A preset named with a date is that edition or refused.
EDITION = "2026-06-28"


def preset_digest(name: str) -> str:
    """What a preset's rules are, in 16 hex digits: it changes with any of them."""
    rules = sorted((c, r.strategy, r.namespace or "", sorted((k, str(v)) for k, v in r.options.items())) for c, r in PRESETS[name].items())
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def pinned(name: str) -> str:
    """``name@date``: how to name the preset so that a later edition does not change a run."""
    if name not in PRESETS:
        raise InvalidRule(f"unknown preset {name!r}")
    return f"{name}@{EDITION}"


def preset_rules(name: str, columns: Sequence[str], keep: Sequence[str] = (), default: str = "redact") -> list[Rule]:
    """Rules of a preset for the columns it knows; the others take the default unless kept. ``name`` may be pinned to an edition,
    ``hipaa@2026-06-28``; one that is not there is refused rather than replaced."""
    name, _, edition = name.partition("@")
    if name not in PRESETS:
        raise InvalidRule(f"unknown preset {name!r}")
    if edition and edition != EDITION:
        raise InvalidRule(f"preset {name!r} has the edition {EDITION}, not {edition}")
    bundle = PRESETS[name]
    out = []
    for c in columns:
        if c in keep:
            out += keep_rules(c)
        else:
            out.append(replace(bundle[c], columns=(c,)) if c in bundle else rule(c, default))
    return out


# fixed values: what a rule may match on, most specific first (D)
LEVELS = ("column", "classification", "tag", "logical_type", "role", "table")


@dataclass(frozen=True)
class Policy:
    """Rules by column, classification, tag, logical type, role or table. The most specific match wins; within a
    level the first written wins. ``forbid`` and ``require`` are checked before any action."""

    default: str = "redact"
    rules: tuple[tuple[str, str, Rule], ...] = ()
    forbidden: tuple[tuple[str, str, str], ...] = ()
    required: tuple[tuple[str, str, str], ...] = field(default=())

    def match(self, level: str, value: str, rule: Rule) -> Policy:
        if level not in LEVELS:
            raise InvalidRule(f"policy cannot match on {level!r}")
        return replace(self, rules=(*self.rules, (level, value, rule)))

    def forbid(self, strategy: str, level: str, value: str) -> Policy:
        return replace(self, forbidden=(*self.forbidden, (strategy, level, value)))

    def require(self, strategy: str, level: str, value: str) -> Policy:
        return replace(self, required=(*self.required, (strategy, level, value)))


def _facts(table: str, name: str, dtype: T.DataType, classes: Mapping[str, str], tags: Mapping[str, Sequence[str]],
           roles: Mapping[str, str]) -> dict[str, set[str]]:
    return {"column": {name, f"{table}.{name}"}, "classification": {classes.get(name, "")}, "tag": set(tags.get(name, ())),
            "logical_type": {dtype.typeName()}, "role": {roles.get(name, "")}, "table": {table}}


def _matches(pattern: str, facts: set[str]) -> bool:
    """``*`` stands for any characters; everything else for itself."""
    return any(re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), x) for x in facts if x)


def resolve_policy(policy: Policy, table: str, schema: T.StructType, classifications: Mapping[str, str] = {},
                   tags: Mapping[str, Sequence[str]] = {}, roles: Mapping[str, str] = {}) -> list[Rule]:
    out = []
    for f in schema.fields:
        facts = _facts(table, f.name, f.dataType, classifications, tags, roles)
        hit = next((r for lvl in LEVELS for (lv, v, r) in policy.rules
                    if lv == lvl and _matches(v, facts[lvl])), None)
        chosen = replace(hit, columns=(f.name,)) if hit else rule(f.name, policy.default)
        for strategy, lvl, v in policy.forbidden:
            if chosen.strategy == strategy and _matches(v, facts[lvl]):
                raise PolicyFailed(f"{table}.{f.name}: {strategy} is forbidden on {lvl} {v}")
        for strategy, lvl, v in policy.required:
            if _matches(v, facts[lvl]) and chosen.strategy != strategy:
                raise PolicyFailed(f"{table}.{f.name}: {strategy} is required on {lvl} {v}")
        out.append(chosen)
    return out
