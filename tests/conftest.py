import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# The four sample payloads (FIXTURES.md §1).
PERSONAS = [
    dict(application_id="APP-101", applicant_name="Sarah Jenkins", gross_annual_income=165000,
         declared_living_expenses=2500, requested_loan_amount=600000, property_valuation=850000,
         base_interest_rate=0.0635, existing_debts_monthly=0, cdr_verified_expenses_monthly=2450),
    dict(application_id="APP-102", applicant_name="Rajiv Patel", gross_annual_income=140000,
         declared_living_expenses=1800, requested_loan_amount=850000, property_valuation=1060000,
         base_interest_rate=0.0635, existing_debts_monthly=1500, cdr_verified_expenses_monthly=1850),
    dict(application_id="APP-103", applicant_name="Alex Chen", gross_annual_income=150000,
         declared_living_expenses=1600, requested_loan_amount=700000, property_valuation=900000,
         base_interest_rate=0.0635, existing_debts_monthly=0, cdr_verified_expenses_monthly=3450),
    dict(application_id="APP-104", applicant_name="Emma Wright", gross_annual_income=95000,
         declared_living_expenses=2400, requested_loan_amount=680000, property_valuation=750000,
         base_interest_rate=0.0635, existing_debts_monthly=800, cdr_verified_expenses_monthly=2500),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lendflow.session import build_session, checkpoint_dir
    s = build_session("local[8]", app_name="lendflow-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
    s.stop()


def write_payloads(directory, payloads):
    os.makedirs(directory, exist_ok=True)
    for p in payloads:
        with open(os.path.join(directory, f"{p['application_id']}.json"), "w") as f:
            json.dump(p, f, indent=4)
    return str(directory)


@pytest.fixture
def persona_dir(tmp_path):
    return write_payloads(tmp_path / "raw", PERSONAS)
