"""Whole analysis of a table of documents as a chain of narrow projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anonymize, clean, confidence, context, crypto, detect, fuse, quasi, risk, verify
from ..functions import fixed_values as fixed
from ..functions.detect import SPANS_TYPE
from ..functions.text import exact_round, let, running, saved_column, with_once
from ..sources.annotations import read_annotations
from ..sources.colocated import StoredDocuments
from ..sources.files import (csv_docs, file_suffix, quarantined_files, read_bytes, reject_blank_docs, route_by_type, size_gate, text_docs,
                             unreadable)
from ..sources.listing import list_tree
from ..sources.parts import rows_to_text

UNEVEN, SHARES, MANY_SPLITS = 1.25, 4, 16  # a split's rows over a core's share, shares a core of a dealt input, splits a core that are left alone
SCORES_TYPE = "array<struct<entity_type:string,start:int,end:int,pii_score:double>>"


@dataclass(frozen=True)
class Options:
    """Switches of an analysis.

    ``encryption_key``: 32 bytes; when set, the anonymized text is also encrypted.
    ``keep_original``: keep original values in the entity list (off by default).
    ``normal_form``: apply Unicode NFKC while cleaning.
    """

    encryption_key: bytes | None = None
    keep_original: bool = False
    normal_form: bool = True


def _column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in fewer splits than there are cores, or whose rows lie in a few of them.

    Analysis costs far more per byte than reading, so one small file must not
    become one long task. A file is cut by its bytes, but a Parquet row group is
    read by one task only: splits can be many and all but a few of them empty, so
    their rows are counted (from the footers). Inputs with enough even splits
    are left alone, as are those with very many: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits < cores:
        return df.repartition(cores)
    if splits >= MANY_SPLITS * cores:
        return df
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one number a split
    return df.repartition(SHARES * cores) if max(rows, default=0) * cores > UNEVEN * sum(rows) else df


def with_clean_text(df: DataFrame, options: Options = Options()) -> DataFrame:
    return df.withColumn("clean_text", clean.clean_text(F.col("text"), normal_form=options.normal_form))


@saved_column
def _candidates() -> Column:
    return detect.candidates(F.col("clean_text"))


@saved_column
def _regex_spans() -> Column:
    return detect.to_spans(detect.suppress_overlaps(F.col("candidates")))


def with_regex_spans(df: DataFrame) -> DataFrame:
    """Add ``regex_spans``: the pattern spans of ``clean_text``.

    One column per step: deeply nested lambdas take the analyzer many rounds.
    """
    return with_once(with_once(df, "candidates", _candidates()), "regex_spans", _regex_spans()).drop("candidates")


@saved_column
def _detected(outside: str | None) -> Column:
    none = F.array().cast(SPANS_TYPE)
    given = none if outside is None else F.coalesce(F.col(outside), none)
    bound = F.struct(F.col("regex_spans").alias("regex"), given.alias("outside"))

    def split_sources(b: Column) -> Column:
        return F.struct(
            b["regex"].alias("regex"),
            F.filter(b["outside"], lambda d: d["source"] == "transformer").alias("transformer"),
            F.filter(b["outside"], lambda d: d["source"] != "transformer").alias("spacy"))

    def fused(s: Column) -> Column:
        return F.struct(
            F.size(s["regex"]).alias("regex_count"), F.size(s["transformer"]).alias("transformer_count"),
            F.size(s["spacy"]).alias("spacy_count"),
            fuse.fuse(s["regex"], s["transformer"], s["spacy"]).alias("fused"))

    # One span and nothing to merge it with, the most common find: plain columns, which are generated code.
    zero = F.lit(0)
    single = F.struct(F.size("regex_spans").alias("regex_count"), zero.alias("transformer_count"), zero.alias("spacy_count"),
                      F.array(fuse.alone(F.get("regex_spans", zero), bound=True)).alias("fused"))
    return F.when((F.size("regex_spans") == 1) & (F.size(given) == 0), single).otherwise(
        let(bound, lambda b: let(split_sources(b), fused)))


def with_detections(df: DataFrame) -> DataFrame:
    """Add ``detected``: span counts per source and the fused spans of all sources."""
    fused = _detected("annotations" if "annotations" in df.columns else None)
    return with_once(with_regex_spans(df), "detected", fused).drop("regex_spans")


@saved_column
def _judged() -> Column:
    def sides(v: Column) -> Column:
        return let(context.accepted(v), lambda kept: F.struct(
            F.when(F.size(kept) == 0, kept).otherwise(confidence.recalibrate(kept)).alias("accepted"), context.rejected(v).alias("rejected")))

    spans = F.col("validated")
    return F.when(F.size(spans) == 0, F.struct(spans.alias("accepted"), spans.alias("rejected"))).otherwise(let(spans, sides))


def with_validation(df: DataFrame) -> DataFrame:
    """Add ``judged``: recalibrated accepted spans and rejected spans."""
    validated = context.with_validated(df, F.col("detected")["fused"], F.col("clean_text"), "validated")
    return with_once(validated, "judged", _judged()).drop("validated")


def _scores_in_order(spans: Column, scores: Column) -> Column:
    """The score of each span, null where there is none; of several for one span the first.

    Both sides are sorted together, scores before the span they are for, and each span looks
    at the last score before it: n log n, however many there are.
    """
    none = F.lit(None).cast("double")

    def keyed(x: Column, kind: int, at: Column, score: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity_type"].alias("entity_type"),
                        F.lit(kind).alias("kind"), at.alias("at"), score.alias("score"))

    def found(b: Column) -> Column:
        def own(x: Column, j: Column) -> Column:
            given = F.get(b["sorted"], F.get(b["last"], j))
            same = (given["start"] == x["start"]) & (given["end"] == x["end"]) & (given["entity_type"] == x["entity_type"])
            return F.struct(x["at"].alias("at"), x["kind"].alias("kind"), F.when(same, given["score"]).alias("score"))

        matched = F.filter(F.transform(b["sorted"], own), lambda x: x["kind"] == 1)
        return F.transform(F.array_sort(matched), lambda x: x["score"])

    def last(ordered: Column) -> Column:
        places = F.transform(ordered, lambda x, j: F.when(x["kind"] == 0, j).otherwise(F.lit(-1)))
        return F.struct(ordered.alias("sorted"), running(places, F.greatest).alias("last"))

    together = F.concat(F.transform(scores, lambda s, i: keyed(s, 0, -i, s["pii_score"])), F.transform(spans, lambda d, i: keyed(d, 1, i, none)))
    return let(F.array_sort(together), lambda o: let(last(o), found))


def rescore(judged: Column, scores: Column) -> Column:
    """Apply verifier scores to accepted spans and move the weak ones to the rejected."""
    def apply(d: Column, score: Column) -> Column:
        noted = F.when(score.isNull(), d["context_notes"]).otherwise(
            F.concat(d["context_notes"], F.array(verify.verifier_note(score))))
        return d.withField("confidence", verify.verified_confidence(d["confidence"], score)).withField(
            "context_notes", noted)

    def scored(b: Column) -> Column:
        return let(_scores_in_order(b["judged"]["accepted"], b["scores"]), lambda found: F.zip_with(
            b["judged"]["accepted"], found, apply))

    def split(b: Column, spans: Column) -> Column:
        strong = F.filter(spans, lambda d: d["confidence"] >= fixed.RETHRESHOLD)
        weak = F.filter(spans, lambda d: d["confidence"] < fixed.RETHRESHOLD)
        return F.struct(strong.alias("accepted"), F.concat(b["judged"]["rejected"], weak).alias("rejected"))

    bound = F.struct(judged.alias("judged"), F.coalesce(scores, F.array().cast(SCORES_TYPE)).alias("scores"))
    return let(bound, lambda b: let(scored(b), lambda spans: split(b, spans)))


@saved_column
def _rescored() -> Column:
    return rescore(F.col("unscored"), F.col("scores"))


def with_rescored(df: DataFrame) -> DataFrame:
    """``judged`` after the verifier scores of the column ``scores``."""
    return with_once(df.withColumnRenamed("judged", "unscored"), "judged", _rescored())


@saved_column
def _assessed() -> Column:
    def assess(b: Column) -> Column:
        types = F.map_keys(b["risk"]["entity_breakdown"])
        return F.struct(b["spans"].alias("spans"), b["risk"].alias("risk"),
                        quasi.analyze_combinations(types).alias("quasi"))

    accepted = F.col("judged")["accepted"]
    classified = risk.classify_entities(accepted)
    # Most texts hold nothing that is accepted: they get constants, and functions over arrays run over no elements.
    nothing = F.struct(classified.alias("spans"), risk.no_risk().alias("risk"), quasi.no_combinations().alias("quasi"))
    return F.when(F.size(accepted) == 0, nothing).otherwise(let(classified, lambda spans: let(
        F.struct(spans.alias("spans"), risk.classify_document(spans).alias("risk")), assess)))


def with_risk(df: DataFrame) -> DataFrame:
    """Add ``assessed``: classified spans, document risk and combination risk."""
    return with_once(df, "assessed", _assessed())


@saved_column
def _risk_analysis() -> Column:
    base, linked = F.col("assessed")["risk"], F.col("assessed")["quasi"]
    total = quasi.adjusted_score(base["risk_score"], linked["total_correlation_score"])
    return let(total, lambda t: F.struct(
        base["absolute_risk_score"].alias("absolute_risk_score"), exact_round(t, 2).alias("risk_score"),
        risk.risk_level(t).alias("risk_level"), base["entity_count"].alias("entity_count"),
        base["entity_breakdown"].alias("entity_breakdown"),
        base["high_risk_entities"].alias("high_risk_entities"),
        F.concat(base["recommendations"], linked["recommendations"]).alias("recommendations"),
        base["risk_score"].alias("base_risk_score"),
        linked["total_correlation_score"].alias("correlation_risk"),
        linked.alias("quasi_identifier_analysis")))


def entities_report(anonymized: Column, rejected: Column) -> Column:
    """Accepted spans, then rejected ones marked as ignored."""
    def row(d: Column, value: Column, strategy: Column, level: Column, weight: Column, score: Column) -> Column:
        return F.struct(
            d["entity_type"].alias("entity_type"), d["value"].alias("original_value"),
            value.alias("anonymized_value"), strategy.alias("strategy"), d["confidence"].alias("confidence"),
            level.alias("sensitivity_level"), weight.alias("sensitivity_weight"), score.alias("effective_score"),
            d["source"].alias("source"), d["context_notes"].alias("context_notes"))

    kept = F.transform(anonymized, lambda d: row(
        d, d["anonymized_value"], d["strategy_applied"], d["sensitivity_level"], d["sensitivity_weight"],
        d["effective_score"]))
    ignored = F.transform(rejected, lambda d: row(
        d, F.lit("REJECTED/IGNORED"), F.lit("None"), F.lit("IGNORED"), F.lit(0.0), F.lit(0.0)))
    return F.concat(kept, ignored)


def detection_stats(detected: Column, accepted: Column) -> Column:
    return F.struct(
        detected["regex_count"].alias("regex"), detected["transformer_count"].alias("transformer"),
        detected["spacy_count"].alias("spacy"), F.size(detected["fused"]).alias("fused"),
        F.size(accepted).alias("after_context_validation"))


def document_type_of(df: DataFrame) -> Column:
    return F.coalesce(_column_or(df, "document_type", F.lit("txt")), F.lit("txt"))


@saved_column
def _anonymized() -> Column:
    return anonymize.anonymize_document(F.col("assessed")["spans"])


@saved_column
def _pieces() -> Column:
    return anonymize.splice_pieces(F.col("clean_text"), F.col("anonymized")["spans"])


@saved_column
def _entities() -> Column:
    return entities_report(F.col("anonymized")["spans"], F.col("judged")["rejected"])


@saved_column
def _joined() -> Column:
    return anonymize.join_pieces(F.col("pieces"))


def with_finished(df: DataFrame) -> DataFrame:
    """Add ``entities``, ``anonymized_text`` and ``token_map``.

    Plain projections, so that what a query leaves out is not made: counting entities splices no text. Each is used as an argument
    only, never inside a lambda, where the optimizer's copies would run per element.
    """
    made = df.withColumn("anonymized", _anonymized()).withColumn("pieces", _pieces())
    made = made.withColumn("entities", _entities()).withColumn("anonymized_text", _joined())
    return made.withColumn("token_map", F.col("anonymized")["token_map"]).drop("anonymized", "pieces")


def assemble_result(df: DataFrame, options: Options = Options()) -> DataFrame:
    """The final nested row per document."""
    ready = with_finished(with_once(df, "risk_analysis", _risk_analysis()))
    entities = F.col("entities")
    if not options.keep_original:
        entities = F.transform(entities, lambda e: e.dropFields("original_value"))
    text = F.col("anonymized_text")
    payload = F.lit(None).cast("struct<ciphertext:string,nonce:string,algorithm:string,key_size:int>")
    if options.encryption_key is not None:
        payload = crypto.encrypt_column(text, options.encryption_key)
    named = _column_or(df, "document_name", F.lit("inline_text"))
    metadata = _column_or(df, "metadata", F.create_map().cast("map<string,string>"))
    extra = [F.col(c) for c in ("ts", "processing_time_ms") if c in df.columns]
    return ready.select(
        F.col("doc_id").alias("document_id"), named.alias("document_name"),
        document_type_of(df).alias("document_type"), metadata.alias("metadata"), *extra,
        F.coalesce(F.length(F.col("text")), F.lit(0)).alias("input_length"),
        F.length(F.col("clean_text")).alias("cleaned_length"),
        detection_stats(F.col("detected"), F.col("assessed")["spans"]).alias("detection_stats"),
        F.col("risk_analysis"), entities.alias("entities"), text.alias("anonymized_text"),
        F.col("token_map"), payload.alias("encrypted_payload"),
        F.lit(True).alias("anonymization_applied"), F.lit(options.encryption_key is not None).alias("encrypted"))


def analyze_documents(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Analyze ``(doc_id, text)`` rows; batch or streaming, without a shuffle.

    Optional input columns: ``annotations`` (external spans), ``scores``
    (verifier scores), ``document_name``, ``document_type``, ``metadata``, ``ts``.
    """
    df = with_validation(with_detections(with_clean_text(df, options)))
    if "scores" in df.columns:
        df = with_rescored(df)
    return assemble_result(with_risk(df), options)


def analyze_stored(spark: SparkSession, stored: StoredDocuments, annotations: DataFrame | None = None, scores: DataFrame | None = None,
                   options: Options = Options()) -> DataFrame:
    """Analyze a bucketed corpus with raw ``annotations`` and verifier ``scores`` from tables; no text is shuffled."""
    normalized = None if annotations is None else read_annotations(annotations)
    return analyze_documents(stored.with_findings(spark, normalized, scores), options)


def sanitize(results: DataFrame) -> DataFrame:
    """Results without the token map (the encryption key is never a column)."""
    return results.drop("token_map", "encryption_key")


def analyze_table(df: DataFrame, key: str, options: Options = Options()) -> DataFrame:
    """Scan any relational table: every row becomes one document of ``col: val`` text."""
    text = rows_to_text(df, [c for c in df.columns if c != key])
    return analyze_documents(df.select(F.col(key).alias("doc_id"), text.alias("text"),
                                       F.lit("csv").alias("document_type")), options)


def _analyzed_files(texts: DataFrame, sheets: DataFrame, listed: DataFrame, options: Options, max_bytes: int | None) -> tuple[DataFrame, DataFrame]:
    docs = reject_blank_docs(text_docs(texts).unionByName(csv_docs(sheets)))
    routed = route_by_type(listed)
    routed = routed if max_bytes is None else size_gate(routed, max_bytes)
    undecoded = ~F.col("document_type").isin("txt", "csv")
    routed = routed.withColumn("refusal", F.coalesce(
        "refusal", F.when(undecoded, "text must be supplied as parts"), F.when(F.col("length") == 0, "empty file")))
    refused = routed.join(unreadable(texts, sheets), "path", "left").withColumn("refusal", F.coalesce("refusal", "reason")).drop("reason")
    return analyze_documents(docs, options), quarantined_files(refused)


def analyze_files(spark: SparkSession, path: str, options: Options = Options(),
                  max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Analyze the text and CSV files under ``path``; returns ``(results, refused files)``.

    Every file is in one of the two. Types whose decoding is left to other tools come back as refused; their
    pages or paragraphs enter through :func:`veilmark.sources.parts.assemble_document`.
    """
    return _analyzed_files(read_bytes(spark, path, "txt", max_bytes), read_bytes(spark, path, "csv", max_bytes), list_tree(spark, path),
                           options, max_bytes)


def analyze_contents(files: DataFrame, options: Options = Options(), max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Like :func:`analyze_files` for a table ``(path, content)``, the form for very many small files: names decide, contents are rows."""
    listed = files.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint").alias("length"))
    small = files.filter(F.octet_length("content") > 0)
    small = small if max_bytes is None else small.filter(F.octet_length("content") <= max_bytes)
    of_type = {t: small.filter(file_suffix(F.col("path")) == t).select("path", "content") for t in ("txt", "csv")}
    return _analyzed_files(of_type["txt"], of_type["csv"], listed, options, max_bytes)
