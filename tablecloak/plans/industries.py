"""Linked starter sets, three tables each. Row counts scale together."""

from __future__ import annotations

from ..operators.generate import Gen, GenTable, gen


def _seq(name: str, start: int = 1) -> Gen:
    return gen(name, "sequence", start=start, step=1)


def _fake(name: str, kind: str, **kwargs) -> Gen:
    return gen(name, "faker", faker_type=kind, faker_kwargs=kwargs)


def _cat(name: str, categories: list[str], weights: list[float] | None = None) -> Gen:
    return gen(name, "categorical", categories=categories, weights=weights)


def _ref(name: str, table: str, column: str | None = None) -> Gen:
    return gen(name, "reference", reference_table=table, reference_column=column or name)


# Tables, row counts, columns, categories and weights of the starter sets.
INDUSTRIES: dict[str, tuple[tuple[str, int, list[Gen]], ...]] = {
    "banking": (
        ("customers", 1000, [_seq("customer_id", 100000), _fake("first_name", "first_name"), _fake("last_name", "last_name"),
                             _fake("email", "email"), _fake("city", "city"), _cat("segment", ["Retail", "Premier", "Private"], [0.75, 0.2, 0.05])]),
        ("accounts", 1800, [_seq("account_id", 5000000), _ref("customer_id", "customers"),
                            _cat("account_type", ["Checking", "Savings", "Credit card", "Loan"], [0.45, 0.3, 0.15, 0.1]),
                            _fake("opened_on", "date_this_decade"), gen("currency", "constant", value="USD")]),
        ("transactions", 10000, [_seq("transaction_id"), _ref("account_id", "accounts"), _fake("posted_on", "date_this_year"),
                                 _fake("amount", "random_int", min=1, max=4000),
                                 _cat("channel", ["Card", "Transfer", "ATM", "Direct debit", "Cheque"], [0.5, 0.2, 0.1, 0.15, 0.05])]),
    ),
    "healthcare": (
        ("patients", 1000, [_seq("patient_id", 100000), _fake("first_name", "first_name"), _fake("last_name", "last_name"),
                            _fake("date_of_birth", "date_of_birth"), _fake("phone", "phone_number"), _fake("city", "city"),
                            _cat("insurance_plan", ["Basic", "Standard", "Premium", "Self-pay"], [0.3, 0.4, 0.2, 0.1])]),
        ("visits", 3000, [_seq("visit_id"), _ref("patient_id", "patients"), _fake("visit_date", "date_this_year"),
                          _cat("visit_type", ["Checkup", "Emergency", "Specialist", "Follow-up", "Lab"], [0.35, 0.1, 0.2, 0.25, 0.1])]),
        ("claims", 3000, [_seq("claim_id"), _ref("visit_id", "visits"), _fake("amount_billed", "random_int", min=50, max=5000),
                          _cat("claim_status", ["Approved", "Pending", "Denied"], [0.7, 0.2, 0.1])]),
    ),
    "hr": (
        ("departments", 12, [_seq("department_id"), _cat("department_name", ["Engineering", "Marketing", "Sales", "HR", "Finance", "Support"]),
                             _fake("cost_center", "bothify", text="CC-####")]),
        ("employees", 500, [_seq("employee_id", 1000), _ref("department_id", "departments"), _fake("first_name", "first_name"),
                            _fake("last_name", "last_name"), _fake("email", "email"), _fake("job_title", "job"), _fake("hired_on", "date_this_decade")]),
        ("payroll", 3000, [_seq("payroll_id"), _ref("employee_id", "employees"), _fake("pay_date", "date_this_year"),
                           _fake("gross_pay", "random_int", min=1500, max=12000)]),
    ),
    "insurance": (
        ("policyholders", 1000, [_seq("policyholder_id", 100000), _fake("first_name", "first_name"), _fake("last_name", "last_name"),
                                 _fake("email", "email"), _fake("state", "state_abbr")]),
        ("policies", 1500, [_seq("policy_id", 700000), _ref("policyholder_id", "policyholders"),
                            _cat("product", ["Auto", "Home", "Life", "Renters", "Travel"], [0.35, 0.3, 0.15, 0.15, 0.05]),
                            _fake("start_date", "date_this_decade"), _fake("annual_premium", "random_int", min=150, max=4000)]),
        ("claims", 600, [_seq("claim_id"), _ref("policy_id", "policies"), _fake("filed_on", "date_this_year"),
                         _fake("claim_amount", "random_int", min=100, max=25000),
                         _cat("claim_status", ["Open", "Paid", "Denied", "Withdrawn"], [0.25, 0.55, 0.15, 0.05])]),
    ),
    "retail": (
        ("customers", 1000, [_seq("customer_id", 10000), _fake("first_name", "first_name"), _fake("last_name", "last_name"), _fake("email", "email"),
                             _fake("city", "city"), _cat("loyalty_tier", ["None", "Silver", "Gold"], [0.6, 0.3, 0.1])]),
        ("orders", 3000, [_seq("order_id"), _ref("customer_id", "customers"), _fake("ordered_on", "date_this_year"),
                          _cat("status", ["New", "Paid", "Shipped", "Returned"], [0.1, 0.3, 0.5, 0.1])]),
        ("order_lines", 8000, [_seq("line_id"), _ref("order_id", "orders"),
                               _cat("product_category", ["Apparel", "Home", "Electronics", "Beauty", "Grocery"], [0.25, 0.2, 0.15, 0.15, 0.25]),
                               _fake("quantity", "random_int", min=1, max=5), _fake("unit_price", "random_int", min=3, max=400)]),
    ),
    "telecom": (
        ("subscribers", 1000, [_seq("subscriber_id", 100000), _fake("first_name", "first_name"), _fake("last_name", "last_name"),
                               _fake("email", "email"), _fake("city", "city")]),
        ("lines", 1400, [_seq("line_id"), _ref("subscriber_id", "subscribers"), _fake("phone_number", "phone_number"),
                         _cat("plan", ["Prepaid", "Basic", "Unlimited", "Family"], [0.2, 0.3, 0.35, 0.15]), _fake("activated_on", "date_this_decade")]),
        ("call_records", 10000, [_seq("call_id"), _ref("line_id", "lines"), _fake("started_at", "date_time_this_year"),
                                 _fake("duration_seconds", "random_int", min=5, max=3600), _cat("call_type", ["Voice", "SMS", "Data"], [0.4, 0.3, 0.3])]),
    ),
}


def industry(name: str, scale: float = 1.0) -> list[GenTable]:
    return [GenTable(t, max(1, round(n * scale)), tuple(cols)) for t, n, cols in INDUSTRIES[name]]
