"""Entities inside free text, without leaving the JVM: whole texts, any length."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..functions.detectors import BY_ID, SPANS, Detector, may_hold, spans, verified
from ..functions.fpe import fpe_text, let
from ..functions.providers import get_provider
from ..keys import hmac_hex, pick


def redact_text(c: Column, detectors: Sequence[str] | None = None, token: str | None = None) -> Column:
    """Replace every detected span; the surrounding text stays. Checksum-gated kinds (card, IBAN) replace only the
    spans that pass."""
    used = [d for d in SPANS if detectors is None or d.id in detectors]

    def apply(text: Column, group: Sequence[Detector]) -> Column:
        for d in group:
            mark = token or d.token
            if d.check:
                # gaps and spans alternate, so each span is judged at its own place
                found = F.regexp_extract_all(text, F.lit(d.span), F.lit(0))
                new = _weave(F.split(text, d.span, -1), F.transform(found, _judge(d, mark)))
            else:
                new = F.regexp_replace(text, d.span, mark)
            text = F.when(may_hold(d, text), new).otherwise(text) if d.needs else new
        return text

    # kinds that need a digit come last and share one look for a digit
    literal, digits = [d for d in used if d.needs], [d for d in used if not d.needs]
    if not literal:
        return F.when(c.rlike("[0-9]"), apply(c, digits)).otherwise(c)
    return let(apply(c, literal), lambda t: F.when(t.rlike("[0-9]"), apply(t, digits)).otherwise(t)) if digits else apply(c, literal)


def _judge(d: Detector, mark: str):
    return lambda s: F.when(verified(d, s), F.lit(mark)).otherwise(s)


def _label(d: Detector):
    return lambda s: F.struct(F.lit(d.id).alias("detector"), s.alias("span"))


def _weave(gaps: Column, tokens: Column) -> Column:
    """gap token gap token ... gap"""
    return F.array_join(F.flatten(F.zip_with(
        gaps, tokens, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")


# fixed values: which strategy a detector may take inside text
TEXT_STRATEGIES = ("fake", "fpe", "redact", "passthrough")
FAKES = {"email": "person_email", "us_phone": "person_phone", "ssn": "synthetic_ssn", "uuid": "uuid",
         "pan": "synthetic_pan", "iban": "synthetic_iban", "icd10": "synthetic_icd10", "mrn": "synthetic_mrn"}
FPE_OK = ("ssn", "us_phone", "mrn", "pan", "uuid")


def mask_text(c: Column, key: bytes, detectors: Mapping[str, str], unmatched: str = "passthrough",
              token: str | None = None) -> Column:
    """Each detector gets a strategy: fake, fpe, redact or passthrough. Text between spans passes or, with
    ``unmatched='redact'``, every word there becomes the token; separators stay. One pass over one combined
    pattern, so a span is masked once."""
    for d, s in detectors.items():
        if d not in BY_ID or BY_ID[d].span is None:
            raise InvalidRule(f"text detector {d!r} is not known")
        if s not in TEXT_STRATEGIES or (s == "fake" and d not in FAKES) or (s == "fpe" and d not in FPE_OK):
            raise InvalidRule(f"text detector {d!r} cannot take strategy {s!r}")
    if unmatched not in ("passthrough", "redact"):
        raise InvalidRule("unmatched is passthrough or redact")
    used = [d for d in SPANS if d.id in detectors]
    pattern = "|".join(f"(?:{d.span})" for d in used)

    def one(t: Column) -> Column:
        out = F
        for d in used:
            out = out.when(t.rlike(f"^(?:{d.span})$") & verified(d, t), _mask_span(t, d.id, detectors[d.id], key))
        # what looks like a span and fails its check is text like any other
        return out.otherwise(hide(t) if unmatched == "redact" else t)

    hide = lambda g: F.regexp_replace(g, r"[\p{L}\p{N}]+", token or "[TEXT]")
    gaps = F.split(c, pattern, -1)
    if unmatched == "redact":
        gaps = F.transform(gaps, hide)
    woven = _weave(gaps, F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), one))
    if unmatched == "redact":
        return woven
    some = reduce(lambda a, b: a | b, [c.contains(n) for n in sorted({d.needs for d in used if d.needs})]
                  + ([c.rlike("[0-9]")] if any(not d.needs for d in used) else []))
    return F.when(some, woven).otherwise(c)


def _mask_span(t: Column, detector: str, strategy: str, key: bytes) -> Column:
    if strategy == "passthrough":
        return t
    if strategy == "redact":
        return F.lit(BY_ID[detector].token)
    if strategy == "fake":
        p = get_provider(FAKES[detector])
        return let(pick(hmac_hex(key, t), p.size), p.at)
    charset = "ALPHANUM" if detector == "uuid" else "digits"
    return F.coalesce(fpe_text(t, key, charset, luhn=detector == "pan"), F.lit(BY_ID[detector].token))


def find_entities(c: Column, detectors: Sequence[str] | None = None) -> Column:
    """Array of (detector, span) found in a text."""
    parts = [F.transform(spans(d, c), _label(d)) for d in SPANS if detectors is None or d.id in detectors]
    return F.flatten(F.array(*parts))


def count_entities(c: Column, detectors: Sequence[str] | None = None) -> dict[str, Column]:
    def count(d: Detector) -> Column:
        n = F.size(spans(d, c)) if d.check else F.regexp_count(c, F.lit(d.span))
        return F.when(may_hold(d, c), n).otherwise(0)

    return {d.id: count(d) for d in SPANS if detectors is None or d.id in detectors}
