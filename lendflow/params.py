"""Policy parameters and fixed values.

Everything here is a constant the results depend on.  The numeric policy sits in a frozen
dataclass so a stress grid (X2) can vary it as data; the strings are output formats that
must stay exactly as written.
"""

from __future__ import annotations

from dataclasses import dataclass, asdict


@dataclass(frozen=True)
class PolicyParams:
    # Serviceability buffer, DTI ceiling, expense floor (HEM), expense tolerance,
    # share of gross income kept after tax, loan term in months, years used to capitalise debts.
    buffer: float = 0.03
    dti_limit: float = 6.0
    hem: float = 2420.0
    expense_tolerance: float = 500.0
    net_ratio: float = 0.70
    months: int = 360
    debt_years: int = 5

    def as_dict(self) -> dict:
        return asdict(self)


DEFAULT_POLICY = PolicyParams()

# ---------------------------------------------------------------------------------------------
# Status, recommendation and decision domains.
PASS = "PASS"
BREACH = "BREACH"
AUTO_APPROVE = "AUTO_APPROVE"
ESCALATED_REFERRAL = "ESCALATED_REFERRAL"
AUTO_APPROVED = "AUTO_APPROVED"
PENDING_REVIEW = "PENDING_REVIEW"
APPROVED_OVERRIDE = "APPROVED_OVERRIDE"
DECLINED = "DECLINED"
APPROVED_WITH_EXCEPTION = "APPROVED_WITH_EXCEPTION"
INFO_REQUESTED = "INFO_REQUESTED"
DECISION_DOMAIN = (
    AUTO_APPROVED, PENDING_REVIEW, APPROVED_OVERRIDE, DECLINED, APPROVED_WITH_EXCEPTION, INFO_REQUESTED,
)

# Breach codes, in the order breaches are listed.
BREACH_CODES = ("DTI", "EXPENSE", "SERVICEABILITY")

# Texts written by the assessment.
DEFAULT_NOTES = "No additional qualitative context provided."
SYSTEM_UNDERWRITER = "SYSTEM_AUTO_EXECUTION"
AUTO_NOTES = "All ratios within mandated thresholds."
AUTO_MEMO_TEMPLATE = "Application {id} meets all APRA and ASIC credit policies. Clean auto-approval granted."
NO_BREACHES = "NONE"
BREACH_SEPARATOR = "; "
NOT_AVAILABLE = "N/A"
MASKED_PERSON = "<PERSON>"
REDACTED_PERSON = "[REDACTED_PERSON]"
UNKNOWN_APPLICANT = "Unknown Applicant"
NARRATIVE_DEFAULT = "None provided."
SUMMARY_FALLBACK = (
    "Automated summary unavailable due to system timeout. Please refer to raw applicant notes."
)
MEMO_FALLBACK = (
    "**SYSTEM FAILURE**: Unable to generate AI Credit Memo due to API error. "
    "MANDATORY MANUAL UNDERWRITER REVIEW REQUIRED."
)
SCOPE_REFUSAL = (
    "\U0001F512 **Scope Restriction:** I am authorized exclusively to assist with credit file evaluation, "
    "financial ratio analysis, and APRA/ASIC regulatory compliance for this application. "
    "I cannot assist with general programming, coding tasks, or unrelated queries."
)
COPILOT_ERROR = "Copilot Error: "
NO_COMPLETION = "no completion"
UNKNOWN_SOURCE = "Unknown Source"
UNKNOWN_PAGE = "Unknown Page"

# Decision notes must hold at least this many characters once stripped.
MIN_NOTE_CHARS = 10

# Chunking of the regulation corpus (characters) and retrieval depth.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 150
CHUNK_SEPARATORS = ("\n\n", "\n", ".", " ")
RETRIEVAL_K = 2
RETRIEVAL_K_DEFAULT = 3

# Prompt texts.  {name} marks a value filled in per row.
MEMO_SYSTEM_PROMPT = "You are an expert Australian banking credit risk officer."
MEMO_PROMPT_TEMPLATE = """You are a Senior Risk Officer at an Australian ADI.
Draft a concise, auditable Credit Memorandum for Application ID: {application_id}.

Applicant: {applicant_name}
Gross Annual Income: ${gross_annual_income}
Loan Requested: ${requested_loan_amount}

Narrative Context:
{narrative}

Deterministic Metrics:
- Debt-to-Income (DTI): {calculated_dti}x
- Stressed Monthly Repayment: ${stressed_monthly_repayment}
- Stressed Monthly Net Surplus: ${net_monthly_surplus}

Identified Breaches:
{breaches}

Regulatory Citations (Grounding Context):
{citations}

Summarize the risks, reference the exact APRA/ASIC citations, and recommend why this file must be halted for human underwriter review.
Keep the output under 150 words."""
SUMMARY_PROMPT_TEMPLATE = """You are an underwriting assistant. Summarize the following applicant notes into a brief, 
professional 2-sentence narrative context for a credit officer. Focus purely on facts.

Applicant Notes: {notes}"""
COPILOT_SYSTEM_PROMPT = (
    "You are an auditable Senior Credit AI Copilot for Australian residential mortgage underwriting. "
    "Answer the underwriter's question using the active applicant record and the retrieved regulatory policy excerpts.\n"
    "Cite the exact document title, page number, and paragraph whenever explaining policy breaches or decision rules.\n"
    "Keep the response concise, professional, and directly relevant to the question."
)
COPILOT_PROMPT_TEMPLATE = """[Active Application Record: {application_id}]
- Applicant Name: {name}
- Calculated DTI: {calculated_dti}x
- Net Monthly Surplus: ${net_monthly_surplus}
- System Recommendation: {system_recommendation}
- Identified Policy Breaches: {policy_breaches}
- Underwriter Status: {underwriter_decision}

[Retrieved APRA / ASIC Policy Documentation]
{citations}

[Underwriter Question]
{question}"""
