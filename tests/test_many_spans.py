"""Documents with very many spans: the same results as plain code, and work that stays near n log n."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions import anonymize
from veilmark.functions.text import first_alike, rank_alike
from veilmark.operators.spans import overlap_pairs
from veilmark.plans import analyze

SPLICE = "array<struct<start:int,end:int,anonymized_value:string>>"


def brute(text, spans):
    for start, end, new in sorted(spans, key=lambda s: -s[0]):
        text = text[:start] + new + text[end:]
    return text


def test_islands_equal_the_splice_of_the_whole_document(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        text = "".join(rng.choices("abc d😀\n", k=rng.choice([5, 30, 200, 9000])))
        spans = []
        for _ in range(rng.randint(0, 14)):
            start = rng.randint(0, min(len(text), 120))
            spans.append((start, min(len(text), start + rng.choice([0, 1, 3, 8, 40])), "R" * rng.choice([0, 1, 2, 9, 30])))
        rows.append((i, text, spans))
    frame = spark.createDataFrame(rows, f"i int, t string, s {SPLICE}")
    got = {r.i: r.o for r in frame.select("i", anonymize.apply_to_text(F.col("t"), F.col("s")).alias("o")).collect()}
    for i, text, spans in rows:
        assert got[i] == brute(text, spans), (text, spans)


def test_first_and_rank_of_equal_elements(spark):
    rng = random.Random(2)
    lists = [[rng.choice("abcde") if rng.random() < .9 else None for _ in range(n)] for n in (0, 1, 2, 40, 700)]
    frame = spark.createDataFrame(list(enumerate(lists)), "i int, x array<string>")
    for r in frame.select("i", "x", first_alike(F.col("x")).alias("f"), rank_alike(F.col("x")).alias("r")).collect():
        assert r.f == [r.x.index(v) for v in r.x]
        assert r.r == [r.x[:j + 1].count(v) for j, v in enumerate(r.x)]


def plain_entities(spans):
    tokens, pseudonyms, counts, out = {}, {}, {}, []
    for value, kind, strategy in spans:
        if strategy == "TOKENIZE":
            tokens.setdefault(value, kind)
        if strategy == "PSEUDONYMIZE" and value not in pseudonyms:
            counts[kind] = counts.get(kind, 0) + 1
            pseudonyms[value] = f"{kind}_PSEUDO_{counts[kind]:03d}_"
    for value, kind, strategy in spans:
        out.append(f"{tokens[value]}_TOKEN_" if strategy == "TOKENIZE" else pseudonyms[value] if strategy == "PSEUDONYMIZE" else None)
    return out, tokens


def test_tokens_and_pseudonyms_of_many_spans(spark):
    rng = random.Random(5)
    rows = [[(f"v{rng.randint(0, n // 2)}", rng.choice(["PHONE", "NAME"]), rng.choice(["TOKENIZE", "PSEUDONYMIZE", "MASK", None])) for _ in range(n)]
            for n in (0, 1, 5, 60, 600)]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, s array<struct<value:string,entity_type:string,anonymization_strategy:string>>")
    for r in frame.select("i", anonymize.anonymize_document(F.col("s")).alias("d")).collect():
        want, tokens = plain_entities(rows[r.i])
        for got, start in zip(r.d.spans, want, strict=True):
            assert start is None or got.anonymized_value.startswith(start)
        assert {v: t.split("_TOKEN_")[0] for v, t in r.d.token_map.items()} == tokens


JUDGED = ("struct<accepted:array<struct<entity_type:string,value:string,start:int,end:int,confidence:double,source:string,context_notes:array<string>>>,"
          "rejected:array<struct<entity_type:string,value:string,start:int,end:int,confidence:double,source:string,context_notes:array<string>>>>")


def test_scores_meet_their_spans(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        spans = [(rng.choice(["PHONE", "PAN"]), "v", s, s + rng.randint(1, 2), 0.9, "regex", []) for s in rng.choices(range(8), k=rng.randint(0, 9))]
        scores = [(rng.choice(["PHONE", "PAN", None]), rng.randint(0, 8), rng.randint(1, 10), round(rng.random(), 2)) for _ in range(rng.randint(0, 25))]
        rows.append((i, (spans, []), scores if i % 7 else None))
    frame = spark.createDataFrame(rows, f"i int, j {JUDGED}, s {analyze.SCORES_TYPE}")
    found = frame.select("i", analyze._scores_in_order(F.col("j")["accepted"], F.coalesce("s", F.array().cast(analyze.SCORES_TYPE))).alias("f"),
                         analyze.rescore(F.col("j"), F.col("s")).alias("r")).collect()
    for r in found:
        spans, scores = rows[r.i][1][0], rows[r.i][2] or []
        want = [next((p for t, a, b, p in scores if (t, a, b) == (k, s, e)), None) for k, _, s, e, *_ in spans]
        assert r.f == want and len(r.r.accepted) + len(r.r.rejected) == len(spans)


def test_overlapping_pairs(spark):
    rng = random.Random(11)
    lists = [[(s, s + rng.choice([0, 1, 2, 5, 30]), f"T{rng.randint(0, 3)}") for s in rng.choices(range(40), k=n)] for n in (0, 1, 2, 9, 40, 300)]
    frame = spark.createDataFrame(list(enumerate(lists)), "doc_id int, s array<struct<start:int,end:int,entity_type:string>>")
    found = overlap_pairs(frame, "s")
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.ordinal_a, r.ordinal_b, r.type_a, r.type_b, r.iou))
    for doc, own in enumerate(lists):
        want = []
        for i, a in enumerate(own):
            for j, b in enumerate(own[i + 1:], i + 1):
                if a[0] < b[1] and b[0] < a[1]:
                    shared = max(0, min(a[1], b[1]) - max(a[0], b[0]))
                    want.append((i, j, a[2], b[2], shared / (a[1] - a[0] + b[1] - b[0] - shared) if shared else 0.0))
        assert sorted(got.get(doc, [])) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def seconds(frame, column):
    best = 9e9
    for _ in range(3):
        start = time.time()
        frame.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        best = min(best, time.time() - start)
    return best


@pytest.mark.parametrize("what", ["rescore", "tokens", "splice"])
def test_four_times_the_spans_take_about_four_times_the_work(spark, what):
    """Quadratic work would take sixteen times as long."""
    took = []
    for n in (16_000, 64_000):
        base = spark.range(1).select(F.sequence(F.lit(0), F.lit(n - 1)).alias("ids"), F.repeat(F.lit("word "), n * 2).alias("text"))
        if what == "rescore":
            spans = F.transform("ids", lambda i: F.struct(F.lit("PHONE").alias("entity_type"), F.lit("v").alias("value"), (i * 10).cast("int").alias("start"),
                                                          (i * 10 + 5).cast("int").alias("end"), F.lit(.9).alias("confidence"), F.lit("regex").alias("source"),
                                                          F.array(F.lit("n")).alias("context_notes")))
            scores = F.transform("ids", lambda i: F.struct(F.lit("PHONE").alias("entity_type"), (i * 20).cast("int").alias("start"),
                                                           (i * 20 + 5).cast("int").alias("end"), F.lit(.5).alias("pii_score")))
            frame = base.select(F.struct(spans.alias("accepted"), F.slice(spans, 1, 0).alias("rejected")).alias("j"), scores.alias("s"))
            column = F.size(analyze.rescore(F.col("j"), F.col("s"))["accepted"])
        elif what == "tokens":
            spans = F.transform("ids", lambda i: F.struct(F.concat(F.lit("v"), (i % (n // 2)).cast("string")).alias("value"), F.lit("PHONE").alias(
                "entity_type"), F.when(i % 2 == 0, "TOKENIZE").otherwise("PSEUDONYMIZE").alias("anonymization_strategy")))
            frame, column = base.select(spans.alias("s")), F.size(anonymize.anonymize_document(F.col("s"))["spans"])
        else:
            spans = F.transform("ids", lambda i: F.struct((i * 10).cast("int").alias("start"), (i * 10 + F.when(i % 100 == 0, 12).otherwise(5)).cast(
                "int").alias("end"), F.lit("[X]").alias("anonymized_value")))
            frame, column = base.select("text", spans.alias("s")), F.length(anonymize.apply_to_text(F.col("text"), F.col("s")))
        took.append(seconds(frame, column))
    assert took[1] < 8 * took[0] + 0.5, took
    print(what, took)
