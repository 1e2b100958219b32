"""Refusals. Messages name tables, columns and rules, never a cell value."""


class Refused(Exception):
    """Base of every refusal; ``code`` is stable and machine readable."""

    code = "refused"

    def __init__(self, message: str):
        super().__init__(f"[{self.code}] {message}")


def _refusal(name: str, code: str, doc: str) -> type[Refused]:
    return type(name, (Refused,), {"code": code, "__doc__": doc})


WeakSecret = _refusal("WeakSecret", "weak_secret", "The mask secret is missing or under 32 bytes.")
UndeclaredColumn = _refusal("UndeclaredColumn", "undeclared_column", "Source and rules disagree on columns.")
InvalidRule = _refusal("InvalidRule", "invalid_rule", "A rule or option is not valid.")
NamespaceRequired = _refusal("NamespaceRequired", "namespace_required", "The strategy needs a namespace.")
NumberUsedAsText = _refusal("NumberUsedAsText", "formula_number_used_as_text", "A number is used as text without text().")
UniquenessImpossible = _refusal("UniquenessImpossible", "uniqueness_impossible", "The domain is smaller than the number of rows.")
DomainTooSmall = _refusal("DomainTooSmall", "domain_too_small", "A keyed bijection over this few values would not hide anything.")
OrphansFound = _refusal("OrphansFound", "orphans_found", "Child keys have no parent and the policy is fail.")
CycleRefused = _refusal("CycleRefused", "table_cycle", "Tables depend on each other in a circle.")
BudgetExceeded = _refusal("BudgetExceeded", "budget_exceeded", "The subset is larger than its budget.")
VaultMiss = _refusal("VaultMiss", "vault_miss", "A token is not in the vault; nothing is written.")
VaultExists = _refusal("VaultExists", "vault_exists", "A vault is create-only.")
CodecUnavailable = _refusal("CodecUnavailable", "codec_unavailable", "This Spark build has no such codec.")
LossyWrite = _refusal("LossyWrite", "lossy_write", "A value does not fit its output field.")
DriftRefused = _refusal("DriftRefused", "scan_drift", "The scan drifted from its baseline.")
PolicyFailed = _refusal("PolicyFailed", "policy_failed", "A policy with mode fail has violations.")
NotStreamable = _refusal("NotStreamable", "not_streamable", "The strategy needs the whole column.")
PrivacyBudget = _refusal("PrivacyBudget", "privacy_budget", "The snapshots cost more than the declared budget.")
