"""Context validation: rescore a span from the text around it.

Each signal is a function of plain columns, usable on a table of spans as well
as inside the per-document array. :func:`validate_context` puts them together.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .detect import looks_secret, password_secret
from .text import SPACE, contains_any, exact_round, jvm_regex, let, lookup, one_of, saved_column, slice_blocks, slice_text, strip
from .text import text_blocks, with_once, words_of


def has_structured(fused: Column) -> Column:
    return F.exists(fused, lambda d: one_of(d["entity_type"], fixed.CO_OCCURRENCE_TYPES))


def active_sources(fused: Column) -> Column:
    names = F.flatten(F.transform(fused, lambda d: F.split(d["source"], r"\+")))
    return F.array_sort(F.array_distinct(names))


def label_text(prefix: Column) -> Column:
    """The label written right before a value ("Order ID:"), null when there is none."""
    return let(written_label(prefix), long_enough)


def written_label(prefix: Column) -> Column:
    """What is written as a label at the end of ``prefix``, of any length; null where none can be."""
    raw = F.regexp_extract(prefix, jvm_regex(fixed.PRECEDING_LABEL) + r"\z", 1)
    ended = reduce(or_, [F.contains(prefix, F.lit(mark)) for mark in fixed.LABEL_ENDS])
    return F.when(ended, F.lower(strip(raw)))


def long_enough(label: Column) -> Column:
    return F.when(F.length(label) >= 2, label)


def label_kind(entity_type: Column, label: Column) -> Column:
    """'confirming', 'competing' or null for a label in front of a span."""
    keywords = lookup(fixed.POSITIVE_KEYWORDS, entity_type)
    confirms = F.coalesce(F.exists(keywords, lambda k: F.contains(label, k)), F.lit(False))
    return (F.when(label.isNull(), F.lit(None).cast("string")).when(confirms, F.lit("confirming"))
            .when(one_of(entity_type, fixed.LABEL_SENSITIVE_TYPES), F.lit("competing")))


def preceding_label(entity_type: Column, prefix: Column) -> Column:
    """``struct<kind, label>``; both null without a telling label."""
    def decide(label: Column) -> Column:
        return let(label_kind(entity_type, label), lambda kind: F.struct(
            kind.alias("kind"), F.when(kind.isNotNull(), label).alias("label")))

    return let(label_text(prefix), decide)


def keyword_hits(table: dict[str, list[str]], entity_type: Column, window: Column) -> Column:
    """Keywords of the span's type that occur anywhere in the window."""
    hits = F.filter(lookup(table, entity_type), lambda k: F.contains(window, k))
    return F.coalesce(hits, F.array().cast("array<string>"))


def positive_hits(entity_type: Column, window: Column) -> Column:
    return keyword_hits(fixed.POSITIVE_KEYWORDS, entity_type, window)


def negative_hits(entity_type: Column, window: Column) -> Column:
    return keyword_hits(fixed.NEGATIVE_KEYWORDS, entity_type, window)


def quantity_word(entity_type: Column, following: Column) -> Column:
    """A counting word right after a label-sensitive span ("followers"), else null."""
    return let(next_word(entity_type, following), lambda w: F.when(one_of(w, fixed.QUANTITY_WORDS), w))


def next_word(entity_type: Column, following: Column) -> Column:
    """The word right after a label-sensitive span, null after others."""
    first = F.regexp_extract(F.lower(following), rf"^[{SPACE}]*([^{SPACE}]+)", 1)
    bare = F.regexp_replace(first, r"[.,;:!?]+\z", "")
    return F.when(one_of(entity_type, fixed.LABEL_SENSITIVE_TYPES), bare)


def label_factor(kind: Column) -> Column:
    return (F.when(kind == "confirming", F.lit(fixed.CONFIRMING_LABEL))
            .when(kind == "competing", F.lit(fixed.COMPETING_LABEL)).otherwise(F.lit(1.0)))


def positive_factor(kind: Column, hits: Column) -> Column:
    applies = (F.size(hits) > 0) & (F.coalesce(kind, F.lit("")) != "confirming")
    return F.when(applies, F.lit(fixed.POSITIVE_CONTEXT)).otherwise(F.lit(1.0))


def negative_factor(kind: Column, hits: Column) -> Column:
    applies = (F.size(hits) > 0) & (F.coalesce(kind, F.lit("")) != "competing")
    return F.when(applies, F.lit(fixed.NEGATIVE_CONTEXT)).otherwise(F.lit(1.0))


def quantity_factor(word: Column) -> Column:
    return F.when(word.isNotNull(), F.lit(fixed.QUANTITY_FOLLOWS)).otherwise(F.lit(1.0))


def is_single_word(value: Column) -> Column:
    return F.size(words_of(value)) < 2


def is_abbreviation(value: Column) -> Column:
    return value.rlike(r"\p{Lu}") & ~value.rlike(r"[\p{Ll}\p{Lt}]") & (F.length(value) < 5)


def password_note(value: Column) -> Column:
    plain = F.lit("password_looks_like_plain_word")
    short = F.lit("password_too_short")
    known = value.rlike(jvm_regex(fixed.PASSWORD_PARTS))
    return F.when(known, let(password_secret(value), lambda s: F.when(~looks_secret(s), plain).when(
        F.length(s) < 6, short)))


def entity_note(entity_type: Column, value: Column, window: Column, before: Column, start: Column) -> Column:
    """The note of the rule that fires for the span's own type, null when none does.

    NAME has two independent rules; its second is :func:`is_abbreviation`.
    """
    def lacks(name: str) -> Column:
        return (entity_type == name) & ~contains_any(window, fixed.ENTITY_KEYWORDS[name])

    decimal = (entity_type == "PHONE") & (start >= 2) & before.rlike(jvm_regex(fixed.VERSION_PREFIX) + r"\z")
    born = (entity_type == "DATE_OF_BIRTH") & contains_any(window, fixed.ENTITY_KEYWORDS["DATE_OF_BIRTH"])
    return (F.when((entity_type == "NAME") & is_single_word(value), F.lit("single_word_name"))
            .when(lacks("PAN"), F.lit("no_pan_context"))
            .when(decimal, F.lit("version_decimal_prefix"))
            .when(lacks("BANK_ACCOUNT"), F.lit("no_financial_context"))
            .when(born, F.lit("dob_context_confirmed"))
            .when(entity_type == "PASSWORD", password_note(value))
            .when(lacks("PINCODE"), F.lit("no_address_context_for_pincode")))


ENTITY_NOTE_FACTORS = {
    "single_word_name": fixed.SINGLE_WORD_NAME, "no_pan_context": fixed.NO_PAN_CONTEXT,
    "version_decimal_prefix": fixed.DECIMAL_PREFIX, "no_financial_context": fixed.NO_FINANCE_CONTEXT,
    "dob_context_confirmed": fixed.BIRTH_CONTEXT, "password_looks_like_plain_word": fixed.PLAIN_PASSWORD,
    "password_too_short": fixed.SHORT_PASSWORD, "no_address_context_for_pincode": fixed.NO_ADDRESS_CONTEXT,
}


def entity_factor(entity_type: Column, note: Column, window: Column) -> Column:
    tech = (entity_type == "IP_ADDRESS") & contains_any(window, fixed.ENTITY_KEYWORDS["IP_ADDRESS"])
    return F.when(tech, F.lit(fixed.TECH_CONTEXT)).otherwise(
        F.coalesce(lookup(ENTITY_NOTE_FACTORS, note), F.lit(1.0)))


def abbreviation_factor(entity_type: Column, value: Column) -> Column:
    short = (entity_type == "NAME") & is_abbreviation(value)
    return F.when(short, F.lit(fixed.ABBREVIATED_NAME)).otherwise(F.lit(1.0))


def is_contextual(entity_type: Column) -> Column:
    return one_of(entity_type, fixed.CONTEXTUAL_TYPES)


def co_occurrence_factor(entity_type: Column, structured: Column) -> Column:
    alone = is_contextual(entity_type) & ~structured
    return F.when(alone, F.lit(fixed.NO_CO_OCCURRENCE)).otherwise(F.lit(1.0))


def agreement_note(entity_type: Column, source: Column, hits: Column) -> Column:
    detectors = F.size(F.split(source, r"\+"))
    return F.when(is_contextual(entity_type),
                  F.when((detectors == 1) & (F.size(hits) == 0), F.lit("single_detector_no_context"))
                  .when(detectors >= 2, F.lit("multi_detector_agreement")))


def agreement_factor(note: Column) -> Column:
    return (F.when(note == "single_detector_no_context", F.lit(fixed.SINGLE_DETECTOR))
            .when(note == "multi_detector_agreement", F.lit(fixed.AGREEING_DETECTORS)).otherwise(F.lit(1.0)))


def scaled(confidence: Column, *factors: Column) -> Column:
    """Apply factors one after the other, capping at 1.0 after each."""
    for factor in factors:
        confidence = F.least(F.lit(1.0), confidence * factor)
    return confidence


def accepts(entity_type: Column, source: Column, confidence: Column) -> Column:
    lenient = one_of(entity_type, fixed.STRUCTURED_TYPES) & F.contains(source, F.lit("regex"))
    return confidence >= F.when(lenient, F.lit(fixed.STRUCTURED_THRESHOLD)).otherwise(
        F.lit(fixed.OTHER_THRESHOLD))


def _listed(name: str, hits: Column) -> Column:
    return F.concat(F.lit(name + ":"), F.array_join(F.slice(hits, 1, 2), ","))


def signals(entity_type: Column, value: Column, start: Column, source: Column, window: Column, prefix: Column,
            following: Column, before: Column) -> Column:
    """All text signals of one span as a struct."""
    return F.struct(
        preceding_label(entity_type, prefix).alias("label"),
        positive_hits(entity_type, window).alias("positive"),
        negative_hits(entity_type, window).alias("negative"),
        quantity_word(entity_type, following).alias("quantity"),
        entity_note(entity_type, value, window, before, start).alias("entity_note"))


def confidence_of(span: Column, window: Column, s: Column, structured: Column) -> Column:
    """Unrounded confidence after all signals, in their fixed order."""
    kind, kind_of_span = s["label"]["kind"], span["entity_type"]
    agreement = agreement_note(kind_of_span, span["source"], s["positive"])
    return scaled(
        span["confidence"], label_factor(kind), positive_factor(kind, s["positive"]),
        negative_factor(kind, s["negative"]), quantity_factor(s["quantity"]),
        entity_factor(kind_of_span, s["entity_note"], window), abbreviation_factor(kind_of_span, span["value"]),
        co_occurrence_factor(kind_of_span, structured), agreement_factor(agreement))


def notes_of(span: Column, s: Column, structured: Column) -> Column:
    """Names of the signals that fired, in the order they were applied."""
    kind, kind_of_span = s["label"]["kind"], span["entity_type"]
    alone = is_contextual(kind_of_span) & ~structured
    short = (kind_of_span == "NAME") & is_abbreviation(span["value"])
    notes = F.array(
        F.when(kind.isNotNull(), F.concat(kind, F.lit("_label:"), s["label"]["label"])),
        F.when(positive_factor(kind, s["positive"]) != 1.0, _listed("positive_context", s["positive"])),
        F.when(negative_factor(kind, s["negative"]) != 1.0, _listed("negative_context", s["negative"])),
        F.concat(F.lit("quantity_follows:"), s["quantity"]),
        s["entity_note"],
        F.when(short, F.lit("likely_abbreviation")),
        F.when(alone, F.lit("no_structured_pii_cooccurrence")),
        agreement_note(kind_of_span, span["source"], s["positive"]))
    return F.filter(notes, lambda n: n.isNotNull())


def surroundings(span: Column, blocks: Column) -> Column:
    """The span with the pieces of text the rules look at, cut from :func:`text_blocks`."""
    def cut(start: Column, end: Column) -> Column:
        return slice_blocks(blocks, start, end)

    start, end = span["start"], span["end"]
    return F.struct(
        span.alias("d"), F.lower(cut(start - fixed.CONTEXT_CHARS, end + fixed.CONTEXT_CHARS)).alias("window"),
        cut(start - fixed.PREFIX_CHARS, start).alias("prefix"),
        cut(end, end + fixed.FOLLOWING_CHARS).alias("following"))


def judgement(d: Column, window: Column, s: Column, structured: Column, conf: Column, rounded: Column) -> list[Column]:
    """The fields of a validated span."""
    return [d["entity_type"].alias("entity_type"), d["value"].alias("value"), d["start"].alias("start"), d["end"].alias("end"),
            rounded.alias("confidence"), d["source"].alias("source"), d["detector_count"].alias("detector_count"),
            d["boost_factor"].alias("boost_factor"), accepts(d["entity_type"], d["source"], conf).alias("context_valid"),
            notes_of(d, s, structured).alias("context_notes"), F.left(window, F.lit(fixed.CONTEXT_CHARS)).alias("context_window")]


def validate_span(span: Column, blocks: Column, structured: Column) -> Column:
    """One fused span with its rescored confidence, verdict, notes and window."""

    def judge(c: Column) -> Column:
        d = c["d"]
        before = F.right(c["prefix"], F.lit(fixed.VERSION_PREFIX_CHARS))
        found = signals(d["entity_type"], d["value"], d["start"], d["source"], c["window"], c["prefix"],
                        c["following"], before)
        return let(found, lambda s: let(confidence_of(d, c["window"], s, structured), lambda conf: F.struct(
            *judgement(d, c["window"], s, structured, conf, exact_round(conf, 4)))))

    return let(surroundings(span, blocks), judge)


def validate_context(fused: Column, text: Column) -> Column:
    """Validate all fused spans of a document against its text."""
    bound = F.struct(fused.alias("fused"), text_blocks(text).alias("blocks"), has_structured(fused).alias("structured"))
    return let(bound, lambda b: F.transform(b["fused"], lambda d: validate_span(d, b["blocks"], b["structured"])))


FEW = 4


@saved_column
def _few_steps() -> list[list[Column]]:
    """Columns of the first spans of a document with few, step by step; each step names those before it."""
    def of(i: int) -> list[list[Column]]:
        def col(name: str) -> Column:
            return F.col(f"__{name}{i}")

        d = col("d")
        kind_of_span, start, end = d["entity_type"], d["start"], d["end"]

        def step(**columns: Column) -> list[Column]:
            return [F.when(d.isNotNull(), c).alias(f"__{name}{i}") for name, c in columns.items()]

        text = F.col("__text")
        label = F.struct(col("kind").alias("kind"), F.when(col("kind").isNotNull(), col("label")).alias("label"))
        s = col("s")
        return [
            [F.when(F.size("__fused") <= FEW, F.get("__fused", F.lit(i))).alias(f"__d{i}")],
            step(window=F.lower(slice_text(text, start - fixed.CONTEXT_CHARS, end + fixed.CONTEXT_CHARS)),
                 prefix=slice_text(text, start - fixed.PREFIX_CHARS, start), following=slice_text(text, end, end + fixed.FOLLOWING_CHARS)),
            step(raw=written_label(col("prefix")), word=next_word(kind_of_span, col("following")),
                 positive=positive_hits(kind_of_span, col("window")), negative=negative_hits(kind_of_span, col("window")),
                 note=entity_note(kind_of_span, d["value"], col("window"), F.right(col("prefix"), F.lit(fixed.VERSION_PREFIX_CHARS)), start)),
            step(label=long_enough(col("raw")), quantity=F.when(one_of(col("word"), fixed.QUANTITY_WORDS), col("word"))),
            step(kind=label_kind(kind_of_span, col("label"))),
            step(s=F.struct(label.alias("label"), col("positive").alias("positive"), col("negative").alias("negative"),
                            col("quantity").alias("quantity"), col("note").alias("entity_note"))),
            step(conf=confidence_of(d, col("window"), s, F.col("__structured"))),
            step(v=F.struct(*judgement(d, col("window"), s, F.col("__structured"), col("conf"), exact_round(col("conf"), 4, bound=True)))),
        ]

    return [sum(same, []) for same in zip(*map(of, range(FEW)))]


def with_validated(df: DataFrame, fused: Column, text: Column, name: str) -> DataFrame:
    """Add ``name``: the validated spans of a document, as :func:`validate_context` gives them.

    Functions over arrays are interpreted, node by node, while plain columns are generated code. Most documents hold few spans: those
    of up to ``FEW`` are judged in columns of their own, one set for each place, and only longer lists go through the array function.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    df = df.withColumns({"__fused": fused, "__text": text, "__structured": has_structured(fused)})
    for columns in _few_steps():
        df = df.select("*", *columns)
    few = F.array(*[F.col(f"__v{i}") for i in range(FEW)])
    judged = with_once(df.select(*kept, few.alias("__judged")), "__few", F.col("__judged"))
    many = validate_context(F.when(F.size(fused) > FEW, fused), text)
    spans = F.when(F.size(fused) > FEW, many).otherwise(F.slice(F.col("__few"), 1, F.size(fused)))
    return with_once(judged.select(*kept, "__few"), name, spans).drop("__few")


def accepted(validated: Column) -> Column:
    return F.filter(validated, lambda d: d["context_valid"])


def rejected(validated: Column) -> Column:
    return F.filter(validated, lambda d: ~d["context_valid"])
