"""Fusion, splicing, masking, combinations: small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions import anonymize, fuse, quasi, risk
from veilmark.functions.detect import SPANS_TYPE
from veilmark.operators import tables
from veilmark.plans import analyze
from veilmark.sources import annotations as ann


def span(kind, start, end, conf, source, value="v"):
    return (kind, value, start, end, conf, source)


def fused(spark, regex, transformer=(), spacy=()):
    row = spark.createDataFrame([(list(regex), list(transformer), list(spacy))],
                                f"a {SPANS_TYPE}, b {SPANS_TYPE}, c {SPANS_TYPE}")
    return row.select(fuse.fuse(F.col("a"), F.col("b"), F.col("c")).alias("f")).first().f


def test_two_sources_fuse_and_boost(spark):
    (one,) = fused(spark, [span("EMAIL", 0, 10, 0.90, "regex")], [span("EMAIL", 0, 10, 0.85, "transformer")])
    assert (one.confidence, one.source, one.detector_count) == (0.954, "regex+transformer", 2)
    assert len(fused(spark, [span("EMAIL", 0, 10, 0.9, "regex"), span("PHONE", 50, 60, 0.9, "regex")])) == 2
    assert fused(spark, []) == []


def test_grouping_is_first_fit(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        spans = []
        for _ in range(rng.randint(0, 9)):
            start = rng.randint(0, 25)
            spans.append(span("NAME", start, start + rng.randint(1, 12), 0.5, "regex"))
        rows.append((i, sorted(spans, key=lambda s: s[2])))
    got = spark.createDataFrame(rows, f"i int, s {SPANS_TYPE}").select(
        "i", fuse.group_overlaps(F.col("s")).alias("g")).collect()

    def iou(a, b):
        shared = min(a[3], b[3]) - max(a[2], b[2])
        return 0 if shared <= 0 else shared / (a[3] - a[2] + b[3] - b[2] - shared)

    for row in got:
        groups = []
        for s in rows[row.i][1]:
            home = next((g for g in groups if any(iou(s, m) >= 0.5 for m in g)), None)
            groups.append([s]) if home is None else home.append(s)
        # Groups come out run by run of overlapping spans; both orders are by first member.
        assert [[tuple(m) for m in g] for g in row.g] == groups


def test_risk_of_types(spark):
    assert risk.WEIGHTS["AADHAAR"] == pytest.approx(86) and risk.DEFAULT_WEIGHT == 50
    assert risk.WEIGHTS["NAME"] * 0.75 == pytest.approx(39.3)


def test_masks_and_generalizations(spark):
    cases = [
        ("EMAIL", "john@gmail.com", "j***@gmail.com"), ("EMAIL", "none", "***@***.***"), ("EMAIL", "a@b@c", "a***@b@c"),
        ("PHONE", "+91-9876543210", "91****3210"), ("PHONE", "123", "****123"), ("PHONE", "12", "****"),
        ("NAME", "Ravi K Rao", "R... K R.."), ("IP_ADDRESS", "1.2.3.4", "1.2.***. ***"),
        ("IP_ADDRESS", "1.2", "***.***.***. ***"), ("PAN", "ABCDE1234F", "A********F"), ("X", "ab", "**"), ("X", "", ""),
    ]
    rows = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t string, v string")
    got = rows.select("i", anonymize.mask(F.col("v"), F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [c[2] for c in cases]
    general = [
        ("DATE", "12/05/2026", "05/2026"), ("DATE", "2026-05-12", "2026-05"), ("DATE_OF_BIRTH", "1.2.99", "XX/2/99"),
        ("DATE", "May", "[DATE_GENERALIZED]"), ("AGE", "27", "25-30"), ("AGE", "old", "[AGE_RANGE]"),
        ("AGE", "007", "5-10"), ("PINCODE", "560001", "5600XX"), ("PINCODE", "1", "[PIN_GENERALIZED]"),
        ("PHONE", "9876543210", "9876XXXXXX"), ("PHONE", "1", "[PHONE_GENERALIZED]"), ("GENDER", "male", "[GENERALIZED]"),
        ("SALARY", "85000", "85XXX"),
    ]
    rows = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(general)], "i int, t string, v string")
    got = rows.select("i", anonymize.k_anonymize(F.col("v"), F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [c[2] for c in general]


def test_overlapping_spans_are_spliced_right_to_left(spark):
    kind = "array<struct<start:int,end:int,anonymized_value:string>>"
    texts = [("0123456789", [(2, 8, "<A>"), (4, 6, "<B>")]), ("0123456789", [(0, 1, "x"), (0, 2, "y")]), ("abc", [])]

    def brute(text, spans):
        for start, end, new in sorted(spans, key=lambda s: -s[0]):
            text = text[:start] + new + text[end:]
        return text

    rows = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], f"i int, t string, s {kind}")
    got = rows.select("i", anonymize.apply_to_text(F.col("t"), F.col("s")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [brute(t, s) for t, s in texts]


def test_pseudonyms_and_tokens_in_one_document(spark):
    kind = "array<struct<entity_type:string,value:string,anonymization_strategy:string>>"
    spans = [("PHONE", "9876543210", "PSEUDONYMIZE"), ("PHONE", "9", "PSEUDONYMIZE"), ("NAME", "9", "PSEUDONYMIZE"),
             ("NAME", "Al", "PSEUDONYMIZE"), ("PHONE", "9876543210", "TOKENIZE"), ("NAME", "9876543210", "TOKENIZE"),
             ("NAME", "Al", None)]
    rows = spark.createDataFrame([(spans,)], f"s {kind}")
    got = rows.select(anonymize.anonymize_entities(F.col("s")).alias("a")).first().a
    values = [g.anonymized_value for g in got]
    assert values[0] == "PHONE_PSEUDO_001_7619EE" and values[1].startswith("PHONE_PSEUDO_002_")
    assert values[2] == values[1] and values[3].startswith("NAME_PSEUDO_001_")
    assert values[4] == values[5] == "PHONE_TOKEN_7619EE8C" and values[6] == "A."
    assert got[6].strategy_applied == "MASK"


def test_combinations(spark):
    rows = spark.createDataFrame([(["NAME", "PAN", "AADHAAR"],), (["NAME", "DATE_OF_BIRTH", "PINCODE"],), ([],)],
                                 "t array<string>")
    a, b, c = (r.q for r in rows.select(quasi.analyze_combinations(F.col("t")).alias("q")).collect())
    assert [r.combination for r in a.correlation_risks] == [["AADHAAR", "NAME", "PAN"]]
    assert (a.total_correlation_score, a.re_identification_level, len(a.recommendations)) == (80.0, "HIGH", 3)
    assert b.total_correlation_score == 65.0 and c.re_identification_level == "LOW" and c.recommendations == []


def test_table_forms_agree_with_arrays(spark):
    docs = spark.createDataFrame(
        [(i, f"Name: x | Aadhaar: 2345 6789 {1000 + i} | PAN: ABCDE1234F phone 9876543210 mail a{i}@b.co c@d.org e@f.org g@h.org")
         for i in range(20)], "doc_id int, text string")
    found = spark.createDataFrame([(i, "PERSON", "Asha Rao", 6, 7, 0.9, "transformer") for i in range(0, 20, 2)],
                                  "doc_id int, label string, text string, start int, end int, score double, source string")
    stages = analyze.with_risk(analyze.with_validation(analyze.with_detections(analyze.with_clean_text(
        ann.attach_annotations(docs, ann.read_annotations(found)))))).cache()
    spans = stages.select("doc_id", F.explode(F.col("judged")["accepted"]).alias("d")).select("doc_id", "d.*")
    kept = tables.without_subsets(tables.matched_rules(spans))
    by_table = {r.doc_id: r.correlation_score for r in tables.correlation_scores(kept).collect()}
    by_array = {r.doc_id: r.s for r in stages.select(
        "doc_id", F.col("assessed.quasi.total_correlation_score").alias("s")).collect()}
    assert by_table == by_array
    scores = {r.doc_id: r.risk_score for r in tables.document_risk(docs, spans).collect()}
    for row in stages.select("doc_id", F.col("assessed.risk.risk_score").alias("s")).collect():
        assert scores[row.doc_id] == pytest.approx(row.s, abs=0.006)
