"""Documents with few spans are judged in plain columns: the same as the array functions give, and generated code."""

import pytest
from pyspark.sql import functions as F

from veilmark.functions import context, detect, fuse, quasi, risk
from veilmark.functions.detect import SPANS_TYPE
from veilmark.functions.text import exact_round, with_once
from veilmark.plans import analyze

PARTS = ["Phone: 9876543210 for details", "Order ID: 9876543211 followers", "card 4532015112830366 at ZIP 560001", "code ABCDE1234F",
         "password: secret pwd a1!", "server 11.20.30.40, born 2024-01-15", "mail x@example.com", "Version 3.9876543219", "licence KA0112345678901"]


@pytest.fixture(scope="module")
def docs(spark):
    name = ("NAME", "Ann", 0, 3, 0.77777, "transformer")
    rows = [(1000, None, None), (1001, "", [name]), (1002, "plain words", None)]
    for n in range(1, 8):
        for first in range(len(PARTS)):
            text = "Ann; ".join((PARTS * 2)[first:first + n])
            rows.append((len(rows), text, [name] if (n + first) % 2 else None))
    given = spark.createDataFrame(rows, f"doc_id int, text string, annotations {SPANS_TYPE}")
    return analyze.with_detections(analyze.with_clean_text(given))


def test_few_spans_are_judged_like_many(docs):
    fused = F.col("detected")["fused"]
    both = with_once(context.with_validated(docs, fused, F.col("clean_text"), "v"), "want", context.validate_context(fused, F.col("clean_text")))
    got = both.select("doc_id", "v", "want").collect()
    sizes = {len(row.want) for row in got}
    assert {0, 1, context.FEW, context.FEW + 1} <= sizes
    assert all(row.v == row.want for row in got)


def test_one_span_is_fused_like_a_group(spark, docs):
    found = analyze.with_regex_spans(docs.select("doc_id", "clean_text"))
    want = found.select("doc_id", fuse.fuse("regex_spans").alias("want"))
    alone = analyze.with_detections(docs.select("doc_id", "clean_text")).select("doc_id", F.col("detected")["fused"].alias("got"))
    rows = want.join(alone, "doc_id").collect()
    assert any(len(row.want) == 1 for row in rows) and all(row.got == row.want for row in rows)


def test_windows_of_few_spans_are_cut_outside_lambdas(docs):
    """Steps of few spans stand in projections of their own, not inside an interpreted function."""
    df = context.with_validated(docs, F.col("detected")["fused"], F.col("clean_text"), "v")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    cut = [line for line in plan.split("\n") if "AS __window0" in line]
    assert len(cut) == 1 and "aggregate(" not in cut[0].partition("AS __window0")[0].rpartition("CASE WHEN")[2]


def test_rounding_of_a_bound_column(spark):
    numbers = spark.range(4000).select((F.col("id") * 0.00005 + 0.00005 / 3 * (F.col("id") % 3)).alias("x"))
    assert numbers.filter(exact_round(F.col("x"), 4) != exact_round(F.col("x"), 4, bound=True)).count() == 0


def test_gates_lose_no_match(spark):
    texts = ["ABCDE1234F", "ABC1234567", "KA0112345678901", "A1234567", "29ABCDE1234F1Z5", "4532015112830366", "4222222222222", "378282246310005"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detect.candidates(F.col("t")).alias("c")).collect()
    found = {row.t: {c.entity_type for c in row.c} for row in rows}
    kinds = ["PAN", "VOTER_ID", "DRIVING_LICENSE", "PASSPORT", "GST_NUMBER", "CREDIT_CARD", "CREDIT_CARD", "CREDIT_CARD"]
    assert all(kind in found[t] for t, kind in zip(texts, kinds))


def test_documents_with_nothing_accepted_get_constants(spark):
    """The constants are what the general functions give, and a text of rejected spans only is as one without any."""
    spans = F.slice(F.array(F.struct(
        F.lit("PHONE").alias("entity_type"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"))), F.col("id").cast("int") + 1, 0)
    both = [risk.classify_document(risk.classify_entities(spans)).alias("a"), risk.no_risk().alias("b"),
            quasi.no_combinations().alias("c"), quasi.reid_level(F.lit(0.0)).alias("level"), quasi.reid_recommendations(
                quasi.reid_level(F.lit(0.0)), F.slice(quasi._rules(), 1, 0), F.transform(spans, lambda d: d["entity_type"])).alias("advice")]
    (row,) = spark.range(1).select(*both).collect()
    assert row.a.asDict(True) == row.b.asDict(True)
    assert (row.c.re_identification_level, row.c.recommendations, row.c.correlation_risks) == (row.level, row.advice, [])

    docs = spark.createDataFrame([("none", "plain words"), ("null", None), ("rejected", "Order ID: 9876543210 followers"),
                                  ("kept", "Call me at 9876543210 now")], "doc_id string, text string")
    found = {r.document_id: r for r in analyze.analyze_documents(docs, analyze.Options(keep_original=True)).collect()}
    assert [len(found[d].entities) for d in ("none", "null", "rejected", "kept")] == [0, 0, 1, 1]
    for name in ("none", "null", "rejected"):
        assert found[name].risk_analysis == found["none"].risk_analysis and found[name].token_map == {}
        assert (found[name].risk_analysis.risk_level, found[name].risk_analysis.entity_count) == ("LOW", 0)
    assert found["rejected"].anonymized_text == "Order ID: 9876543210 followers"
    assert found["rejected"].entities[0].sensitivity_level == "IGNORED" and found["kept"].risk_analysis.entity_count == 1
