"""The bilingual word lists, weights and texts the controls work with."""

from __future__ import annotations

from decimal import Decimal

# Payment legs
PAYMENT_KINDS = ("zahlung", "payment", "auszahlung", "disbursement", "zahlungslauf")
NOT_PAYMENTS = ("eingang", "incoming", "gutschrift", "erstattung", "ausgangsrechnung", "receipt")
INSTALMENT_WORDS = ("rate", "raten", "instal", "abschlag")
SPLIT_REVERSAL_WORDS = ("storno", "reversal", "rückbuchung", "cancel")

# Vendor master changes
CREATION_WORDS = ("neuanlage", "anlage", "angelegt", "creation", "create", "new")
VENDOR_WORDS = ("kreditor", "vendor", "supplier", "lieferant")
CARRY_FORWARD_WORDS = ("saldenvortrag", "vortrag", "opening", "carry")
RIGHT_CREATE = ("anlegen", "stammdaten", "create", "master")
RIGHT_POST = ("buchen", "post", "journal")
RIGHT_PAY = ("zahlungslauf", "zahlung", "payment", "pay")

# Capitalised repairs
REPAIR_WORDS = ("reparatur", "instandhaltung", "instandsetzung", "wartung", "austausch", "überholung",
                "ueberholung", "generalüberholung", "repair", "maintenance", "overhaul", "replacement",
                "servicing", "refurbish")
ADDITION_WORDS = ("acquisition", "zugang", "addition", "anschaffung", "zuschreibung")
BALANCE_SHEET_WORDS = ("bilanz", "balance", "asset", "aktiv", "anlage")
INVESTMENT_WORDS = ("investitionsantrag", "investment request", "capex", "ia-", "invest")

# Forensic searches
REVERSAL_WORDS = ("storno", "reversal", "rückbuchung", "rueckbuchung", "cancel", "cancellation")
CREDIT_NOTE_WORDS = ("gutschrift", "credit note", "credit memo", "erstattung")
CONTRACT_WORDS = ("vertrag", "rahmenvertrag", "dienstleistungsvertrag", "werkvertrag", "contract",
                  "service agreement", "framework agreement")

# Expected first-digit shares, log10(1 + 1/d)
BENFORD = {
    1: Decimal("0.301030"), 2: Decimal("0.176091"), 3: Decimal("0.124939"), 4: Decimal("0.096910"),
    5: Decimal("0.079181"), 6: Decimal("0.066947"), 7: Decimal("0.057992"), 8: Decimal("0.051153"),
    9: Decimal("0.045757"),
}

# Record control over capital expenditure
REPAIR_TRIGGERS = ("repair", "maintenance", "reparatur", "wartung", "instandhaltung")
REPLACEMENT_TRIGGERS = ("replacement", "overhaul", "servicing", "restoration", "austausch", "ersatz",
                        "überholung", "restaurierung")
SUPPORT_TERMS = {
    "distinct_new_asset": ("new asset", "neue anlage"),
    "project_reference": ("project", "projekt"),
    "investment_approval": ("investment approval", "investitionsfreigabe"),
    "separable_major_component": ("major component", "separable component", "wesentliche komponente"),
    "useful_life_extension": ("useful life extension", "verlängerung der nutzungsdauer"),
    "capacity_or_quality_improvement": ("capacity increase", "quality improvement", "kapazitätserhöhung"),
    "required_for_new_asset_operation": ("bring into operation", "inbetriebnahme"),
    "reversal_or_reclassification": ("reversal", "reclassification", "storno", "umbuchung"),
}
CAPEX_SIGNALS = (
    "repair_or_maintenance_language", "replacement_overhaul_service_language", "posted_to_asset_account",
    "no_distinct_asset_or_project_reference", "no_investment_approval",
    "no_useful_life_or_capacity_improvement", "multiple_repair_like_additions",
)
VENDOR_SIGNALS = (
    "missing_vendor_creation_event", "new_vendor", "creator_equals_approver", "create_and_pay_permission",
    "same_user_creates_posts_pays", "rapid_first_invoice", "rapid_first_payment",
    "invoice_paid_unusually_quickly", "missing_independent_approval", "missing_approval_log",
    "no_prior_vendor_history", "missing_service_or_delivery_evidence",
)
CORE_CONFLICTS = ("creator_equals_approver", "create_and_pay_permission", "same_user_creates_posts_pays")

# Admission
REASON_TEXT = {
    "evidence_and_controls_support": "Evidence and deterministic controls fully support the finding.",
    "counter_evidence_present": "Supported counter-evidence resolves the allegation.",
    "counter_evidence_conflicting": "Evidence is conflicting.",
    "counter_test_incomplete": "One or more required counter-tests are incomplete or unsupported.",
    "material_uncertainty": "Material uncertainty remains.",
    "accounting_judgement": "Accounting judgement is required.",
    "supporting_evidence_incomplete": "Supporting evidence is incomplete.",
    "evidence_chain_missing": "The evidence chain is missing, malformed, or unresolved.",
    "calculation_support_missing": "The calculation is uncited or cannot be replayed.",
    "control_support_missing": "No valid deterministic control supports the assertion.",
}
REASON_CODES = tuple(REASON_TEXT)
VERDICTS = ("CONFIRMED", "HUMAN_REVIEW", "DISMISSED", "REJECTED")

# Investigation plan: the tools of each risk category, in order
CATEGORY_PRIORITY = {"vendor_sod": 90, "cutoff": 80, "capitalisation": 70, "split_payment": 60,
                     "anomaly_discovery": 50}
CATEGORY_PLAN = {
    "vendor_sod": ("check_vendor_creation_and_approval", "find_related_entities", "check_user_permissions",
                   "reconcile_vendor_invoices_and_payments", "find_contract_or_service_evidence",
                   "find_independent_approval", "compare_peer_vendors", "submit_case_to_admission"),
    "split_payment": ("cluster_payments", "find_reversal", "find_independent_approval",
                      "submit_case_to_admission"),
    "capitalisation": ("inspect_asset_additions", "submit_case_to_admission"),
    "cutoff": ("test_period_cutoff", "submit_case_to_admission"),
    "anomaly_discovery": ("submit_case_to_admission",),
}
REFUTER_TOOLS = ("find_reversal", "find_credit_note", "find_independent_approval",
                 "find_contract_or_service_evidence", "compare_peer_vendors")
VERDICT_STATUS = {
    "CONFIRMED": ("submitted", "confirm"), "DISMISSED": ("dismissed", "dismiss"),
    "HUMAN_REVIEW": ("awaiting_auditor", "human_review"), "REJECTED": ("insufficient_evidence", "reject"),
}
CONTROL_ORDER = ("vendor_sod", "split_payment", "capitalisation", "cutoff", "anomaly_discovery")
