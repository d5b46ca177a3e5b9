"""Policy: every threshold and fixed vocabulary the gates use, as one object.

Results depend on an explicit ``as_of`` date and on these values, never on the
wall clock, so a run can be repeated.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace
from decimal import Decimal

# --- Fixed values (must equal the reference for identical results) ---------
# Accepted currency codes.
CURRENCIES = ("USD", "CAD", "EUR", "GBP", "AUD", "JPY", "CHF")
# Document types, invoice statuses, severities, escalation levels, check statuses.
DOCUMENT_TYPES = ("invoice", "receipt", "purchase_order", "statement", "unknown")
INVOICE_STATUSES = ("pending", "processing", "validated", "flagged", "approved", "rejected", "on_hold")
SEVERITIES = ("low", "medium", "high", "critical")
ESCALATION_LEVELS = ("none", "l1_manager", "l2_controller", "l3_vp_cfo", "human_review")
CHECK_STATUSES = ("pass", "fail", "warning", "skipped")
# Agent roles (actors).
ROLE_INTAKE = "document_intake_specialist"
ROLE_EXTRACTION = "data_extraction_analyst"
ROLE_VALIDATION = "validation_officer"
ROLE_ANOMALY = "anomaly_detection_specialist"
ROLE_RECONCILIATION = "reconciliation_manager"
ROLE_GOVERNANCE = "governance_engine"
# Risk weight per anomaly severity.
SEVERITY_WEIGHTS = {"critical": Decimal("0.40"), "high": Decimal("0.25"),
                    "medium": Decimal("0.10"), "low": Decimal("0.05")}
# Human review vocabularies.
REVIEW_DECISIONS = ("approve", "adjust_and_approve", "reject", "escalate_further")
RATIONALE_CATEGORIES = (
    "amount_within_variance", "vendor_confirmed_correction", "po_mismatch_resolved",
    "duplicate_confirmed_void", "anomaly_is_legitimate", "requires_senior_review",
    "policy_exception_granted", "other",
)
# Review decision -> resulting invoice status.
REVIEW_STATUS = {"approve": "approved", "adjust_and_approve": "approved",
                 "reject": "rejected", "escalate_further": "on_hold"}
# Statuses from which a manual approval is accepted.
APPROVABLE_STATUSES = ("pending", "processing", "validated", "flagged", "on_hold")
# Document classifier keywords, per type, in tie-break order.
CLASSIFIER_KEYWORDS = (
    ("invoice", ("invoice", "invoice #", "invoice number", "bill to", "amount due",
                 "invoice date", "remit to", "net 30", "payment terms")),
    ("receipt", ("receipt", "payment received", "paid", "thank you for your payment",
                 "transaction id", "receipt number")),
    ("purchase_order", ("purchase order", "po number", "po #", "ship to", "requisition",
                        "order confirmation", "ordered by")),
    ("statement", ("statement", "account statement", "balance forward", "statement date",
                   "outstanding balance", "previous balance")),
)
# Field extraction patterns, per field, tried in order; group 1 is the value.
FIELD_PATTERNS = {
    "invoice_number": (r"invoice\s*(?:#|no\.?|number)[:\s]*([A-Z0-9\-]+)",
                       r"inv\s*(?:#|no\.?)[:\s]*([A-Z0-9\-]+)"),
    "po_number": (r"p\.?o\.?\s*(?:#|no\.?|number)[:\s]*([A-Z0-9\-]+)",
                  r"purchase\s+order\s*(?:#|no\.?)[:\s]*([A-Z0-9\-]+)"),
    "vendor_name": (r"from[:\s]+([A-Za-z][A-Za-z0-9 ,\.&-]{3,60})\n",
                    r"bill\s+from[:\s]+([A-Za-z][A-Za-z0-9 ,\.&-]{3,60})\n",
                    r"vendor[:\s]+([A-Za-z][A-Za-z0-9 ,\.&-]{3,60})\n"),
    "total": (r"(?:grand\s+)?total\s*(?:due|amount)?[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
              r"amount\s+due[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
              r"total\s+amount[:\s]*\$?\s*([\d,]+\.?\d{0,2})"),
    "subtotal": (r"subtotal[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
                 r"sub\s*total[:\s]*\$?\s*([\d,]+\.?\d{0,2})"),
    "tax": (r"(?:sales\s+)?tax[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
            r"hst[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
            r"gst[:\s]*\$?\s*([\d,]+\.?\d{0,2})",
            r"vat[:\s]*\$?\s*([\d,]+\.?\d{0,2})"),
    "invoice_date": (r"invoice\s+date[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                     r"date[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                     r"dated[:\s]*(\w+ \d{1,2},?\s+\d{4})",
                     r"invoice\s+date[:\s]*(\w+ \d{1,2},?\s+\d{4})"),
    "due_date": (r"due\s+(?:date|by)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                 r"payment\s+due[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
                 r"due\s+(?:date|by)[:\s]*(\w+ \d{1,2},?\s+\d{4})"),
    "currency": (r"\b(USD|CAD|EUR|GBP|AUD|JPY|CHF)\b",),
}
# Line-item row: description, 2+ spaces, quantity, unit price, line total.
LINE_ITEM_PATTERN = r"^(.{5,50}?)\s{2,}(\d+(?:\.\d+)?)\s+\$?([\d,]+\.\d{2})\s+\$?([\d,]+\.\d{2})"
# Date formats tried in order (Python strptime order: m/d/Y, d/m/Y, Y-m-d, m-d-Y,
# d-m-Y, "Month d, Y", "Month d Y", "Mon d, Y", "Mon d Y", m/d/y, d/m/y).
DATE_FORMATS = ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M-d-yyyy", "d-M-yyyy",
                "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy",
                "M/d/yy", "d/M/yy")
# Policy-chunk split: blank lines, or before a 1-3 '#' header.
CHUNK_SPLIT = r"\n{2,}|(?=#{1,3} )"
CHUNK_MIN_CHARS = 50


@dataclass(frozen=True)
class GateRule:
    """One governance gate: name, threshold and whether it is applied."""
    name: str
    threshold: Decimal | None = None
    enabled: bool = True


# The thresholds that results must agree with.
@dataclass(frozen=True)
class Policy:
    as_of: _dt.date = _dt.date(2000, 6, 1)
    ocr_threshold: Decimal = Decimal("0.85")
    agent_threshold: Decimal = Decimal("0.70")
    variance_threshold: Decimal = Decimal("0.10")
    materiality_l1: Decimal = Decimal("5000")
    materiality_l2: Decimal = Decimal("25000")
    materiality_l3: Decimal = Decimal("100000")
    duplicate_days: int = 90
    future_days: int = 7
    stale_days: int = 180
    arithmetic_tolerance: Decimal = Decimal("1.00")
    line_tolerance: Decimal = Decimal("0.02")
    round_number_floor: Decimal = Decimal("1000")
    # outlier severity bounds (strictly greater than)
    outlier_critical: Decimal = Decimal("0.50")
    outlier_high: Decimal = Decimal("0.30")
    outlier_medium: Decimal = Decimal("0.15")
    flag_risk_floor: Decimal = Decimal("0.25")
    disabled_gates: frozenset = field(default_factory=frozenset)

    def enabled(self, gate: str) -> bool:
        return gate not in self.disabled_gates

    def with_(self, **kw) -> "Policy":
        return replace(self, **kw)

    def rules(self) -> list[GateRule]:
        """The policy table (rule, threshold, enabled)."""
        rows = [("ocr_confidence_gate", self.ocr_threshold),
                ("duplicate_detection", Decimal(self.duplicate_days)),
                ("unknown_vendor", None),
                ("variance_threshold", self.variance_threshold),
                ("materiality_gate", self.materiality_l1),
                ("agent_confidence_gate", self.agent_threshold)]
        return [GateRule(n, t, self.enabled(n)) for n, t in rows]


DEFAULT_POLICY = Policy()
