"""Input texts made from the given tables.

The tables hold few identifiers, so each of these views writes a text around
the keys of one whole table. The expressions are plain SQL that both engines
read alike; everything computed from them is written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import analyze
from ..sources.annotations import attach_annotations, read_annotations

_AADHAAR = "cast(234567890000 + c_custkey * 7919 AS string)"
_ACCOUNT = "CASE s_suppkey % 3 WHEN 0 THEN 'Account number is ' WHEN 1 THEN 'acct ' ELSE 'a/c no. ' END"

# name: (table, document key, text)
TEXTS = {
    "documents": ("documents", "concat('doc-', cast(doc_id AS string))", "text"),
    "pages": ("pages", "concat('page-', cast(page_id AS string))", "html"),
    "talk": ("conversations", "concat('talk-', cast(conv_id AS string), '-', cast(turn AS string))", "text"),
    "kyc": ("customer", "concat('kyc-', cast(c_custkey AS string))",
            f"concat('Name: ', c_name, ' | Aadhaar: ', substr({_AADHAAR},1,4), ' ', substr({_AADHAAR},5,4), ' ', "
            f"substr({_AADHAAR},9,4), ' | PAN: ABCDE', lpad(cast(c_custkey % 10000 AS string),4,'0'), "
            "'F | Email: user', cast(c_custkey AS string), '@mail.example.com | Phone: 9', "
            "lpad(cast(c_custkey AS string),9,'0'))"),
    "label": ("orders", "concat('label-', cast(o_orderkey AS string))",
              "concat(CASE o_orderkey % 6 WHEN 0 THEN 'Order ID: ' WHEN 1 THEN 'Tracking: ' WHEN 2 THEN 'Phone: ' "
              "WHEN 3 THEN 'Call me at ' WHEN 4 THEN 'Serial: ' ELSE 'Mobile = ' END, "
              "'9', lpad(cast(o_orderkey AS string),9,'0'), "
              "CASE WHEN o_orderkey % 5 = 0 THEN ' followers' ELSE ' for details' END)"),
    "version": ("part", "concat('version-', cast(p_partkey AS string))",
                "concat('Release ', p_name, ' 3.9', lpad(cast(p_partkey AS string),9,'0'), ' or card ', "
                "'453201511283', lpad(cast(p_partkey AS string),4,'0'), ' at ZIP ', cast(100000 + p_partkey AS string), "
                "' code LMNOP', lpad(cast(p_partkey % 10000 AS string),4,'0'), 'Q')"),
    "fin": ("supplier", "concat('fin-', cast(s_suppkey AS string))",
            f"concat({_ACCOUNT}, lpad(cast(s_suppkey * 104729 AS string),12,'7'), "
            "' IFSC: HDFC0', lpad(cast(s_suppkey AS string),6,'0'), ' UPI: u', cast(s_suppkey AS string), "
            "'@okaxis GST 29ABCDE', lpad(cast(s_suppkey % 10000 AS string),4,'0'), 'F1Z5 server ', "
            "cast(11 + s_suppkey % 200 AS string), '.20.30.40 password: ', "
            "CASE s_suppkey % 3 WHEN 0 THEN 'Secret@123!' WHEN 1 THEN 'policy' ELSE 'a1!' END, "
            "' Pin: ', cast(560000 + s_suppkey % 1000 AS string), "
            "' on 2024-01-15 see https://example.com/a user: bob', cast(s_suppkey AS string), "
            "' mail x', cast(s_suppkey AS string), '@example.com, then y@example.com z@example.com w@example.com')"),
    "gov": ("part", "concat('gov-', cast(p_partkey AS string))",
            "concat('Voter ABC', lpad(cast(p_partkey AS string),7,'1'), ' licence KA01', "
            "lpad(cast(p_partkey AS string),11,'2'), ' passport A1', lpad(cast(p_partkey % 100000 AS string),5,'2'), '7')"),
}

# Findings of outside models on the customer texts: (label, text, start, end, score, source)
_NAME = ["CASE c_custkey % 3 WHEN 0 THEN 'ABC' WHEN 1 THEN c_name ELSE concat(' Ann ', c_name) END", "cast(6 AS bigint)",
         "6 + length(c_name)"]
ANNOTATIONS = [
    ["CASE c_custkey % 5 WHEN 0 THEN 'ORG' WHEN 1 THEN 'MONEY' WHEN 2 THEN 'PER' ELSE 'PERSON' END", *_NAME,
     "(40 + c_custkey % 60) / 1e2", "'transformer'"],
    ["CASE c_custkey % 4 WHEN 0 THEN 'CARDINAL' WHEN 1 THEN 'DATE' ELSE 'PERSON' END", *_NAME, "0e0", "'spacy'"],
    ["CASE c_custkey % 7 WHEN 0 THEN 'TIME' ELSE 'MISC' END", "substr(c_name, 1, 12)", "cast(6 AS bigint)",
     "cast(18 AS bigint)", "(50 + c_custkey % 50) / 1e2", "'transformer'"],
]
ANNOTATION_COLUMNS = ["label", "text", "start", "end", "score", "source"]

# Scores of an outside sentence scorer for the phone number of each customer text.
SCORE = "(c_custkey % 100) / 1e2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, text = TEXTS[name]
    return analyze.spread(table(spark, sf_dir, source).selectExpr(f"{key} AS doc_id", f"{text} AS text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, ``(doc_id, text)``."""
    whole, *others = [texts(spark, sf_dir, name) for name in TEXTS]
    for other in others:
        whole = whole.unionAll(other)
    return whole


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with a time, a processing time and a name, from the number in their id."""
    docs = corpus(spark, sf_dir).withColumn("number", F.regexp_extract("doc_id", "[0-9]+", 0).cast("bigint"))
    return docs.select("doc_id", "text", F.timestamp_seconds(F.lit(1704067200) + F.col("number") * 977).alias("ts"),
                       (F.col("number") % 50).cast("double").alias("processing_time_ms"), F.concat(F.lit("text "), "doc_id").alias("document_name"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outside findings on the customer texts; one pass over the table."""
    rows = [F.struct(*[F.expr(e).alias(c) for e, c in zip(found, ANNOTATION_COLUMNS)]) for found in ANNOTATIONS]
    key = TEXTS["kyc"][1]
    exploded = table(spark, sf_dir, "customer").select(F.expr(key).alias("doc_id"), F.explode(F.array(*rows)).alias("a"))
    return exploded.select("doc_id", "a.*")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for the customers' phone numbers, keyed by span."""
    source, key, text = TEXTS["kyc"]
    return table(spark, sf_dir, source).selectExpr(
        f"{key} AS doc_id", "'PHONE' AS entity_type", f"cast(length({text}) - 10 AS int) AS start",
        f"cast(length({text}) AS int) AS end", f"{SCORE} AS pii_score")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.with_clean_text(corpus(spark, sf_dir))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach_annotations(corpus(spark, sf_dir), read_annotations(annotations(spark, sf_dir)))
    return analyze.with_detections(analyze.with_clean_text(docs))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.with_validation(detected(spark, sf_dir))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.with_risk(judged(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return analyze.assemble_result(assessed(spark, sf_dir), analyze.Options(keep_original=True, **options))
