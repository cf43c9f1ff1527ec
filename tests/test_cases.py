"""Whole analysis of single texts: what is found, what is refused, what comes out."""

import fixed_vectors
import pytest

from veilmark.operators import metrics
from veilmark.plans.analyze import Options, analyze_documents

OWN = {  # id: (text, wanted types, unwanted types)
    "counted": ("That clip got 9123456780 views in a week", [], ["PHONE"]),
    "reached by phone": ("You can phone the desk on 9123456780 after lunch", ["PHONE"], []),
    "prefixed phone": ("Mobile: +91-9123456780", ["PHONE"], []),
    "serial": ("Serial: 9123456780", [], ["PHONE"]),
    "decimals": ("Release 2.9123456780 is out", [], ["PHONE"]),
    "card": ("Credit Card: 4111111111111111", ["CREDIT_CARD"], []),
    "no checksum": ("Credit Card: 4111111111111112", [], ["CREDIT_CARD"]),
    "tax number": ("PAN Card: FGHIJ5678K was submitted", ["PAN"], []),
    "mail": ("mail lea@example.org about it", ["EMAIL"], []),
    "unset address": ("bind to 0.0.0.0 first", [], ["IP_ADDRESS"]),
    "server": ("The server address is 10.20.30.41", ["IP_ADDRESS"], []),
    "prose": ("Nothing in this sentence names anybody.", [], ["EMAIL", "PHONE", "PAN"]),
    "nothing": ("", [], []),
}
CASES = [(name, *case) for name, case in {**fixed_vectors.VECTORS, **OWN}.items()]


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame([(c[0], c[1]) for c in CASES] + [("NULL", None)], "doc_id string, text string")
    return analyze_documents(docs, Options(keep_original=True, encryption_key=bytes(range(32)))).cache()


def test_all_cases_pass(spark, results):
    cases = spark.createDataFrame(
        [(c[0], c[0], c[1], c[2], c[3], c[1] if c[0] in fixed_vectors.UNCHANGED else None) for c in CASES]
        + [("absent", "no such document", "", [], [], None)],
        "case_id string, description string, text string, should_detect array<string>, should_reject array<string>, "
        "check_anonymized_contains string")
    checked = metrics.check_expectations(results, cases)
    assert [r.case_id for r in checked.filter("not passed").collect()] == ["absent"]
    assert tuple(metrics.pass_counts(checked).first()) == (len(CASES) + 1, len(CASES))


def test_goldens(results):
    rows = {r.document_id: r for r in results.collect()}
    for name, (base, final, level, text) in fixed_vectors.GOLDEN.items():
        risk = rows[name].risk_analysis
        assert risk.base_risk_score == pytest.approx(base, abs=0.011), name
        assert risk.risk_score == pytest.approx(final, abs=0.011), name
        assert (risk.risk_level, rows[name].anonymized_text) == (level, text)
    confidence = {n: [e.confidence for e in rows[n].entities] for n in rows}
    assert confidence["FW-1"] == [pytest.approx(0.132, abs=1e-4)]
    assert confidence["EC-1"] == [pytest.approx(0.16, abs=1e-4)]
    assert confidence["EC-2"] == [pytest.approx(0.18, abs=1e-4)]
    assert rows["POSITIVE"].risk_analysis.quasi_identifier_analysis.total_correlation_score == 90.0
    assert rows["nothing"].risk_analysis.recommendations == ["No PII detected. Document appears safe."]
    assert rows["NULL"].risk_analysis.entity_count == 0 and rows["NULL"].anonymized_text == ""


def test_invariants(results):
    for row in results.collect():
        for entity in row.entities:
            assert 0 <= entity.confidence <= 1
            if entity.strategy == "REDACT":
                assert entity.original_value not in row.anonymized_text
        assert row.encrypted and row.encrypted_payload.key_size == 256


def test_original_values_are_opt_in(spark):
    shown = analyze_documents(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    assert "original_value" not in shown.schema["entities"].dataType.elementType.names
    assert not any("key" in name for name in shown.columns)
