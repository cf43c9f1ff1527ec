"""Replacement values for personal data, and putting them into the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, digits_only, first_alike, let, rank_alike, running, running_max, slice_blocks, text_blocks, words_of


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_email(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.regexp_replace(value, "(?s)^[^@]*@", "")
    return F.when(F.contains(value, F.lit("@")), F.concat(F.left(local, F.lit(1)), F.lit("***@"), domain)).otherwise(
        F.lit("***@***.***"))


def mask_phone(value: Column) -> Column:
    return let(digits_only(value), lambda d: (
        F.when(F.length(d) >= 10, F.concat(F.left(d, F.lit(2)), F.lit("****"), F.right(d, F.lit(4))))
        .when(F.length(d) >= 3, F.concat(F.lit("****"), F.right(d, F.lit(3)))).otherwise(F.lit("****"))))


def mask_name(value: Column) -> Column:
    dotted = F.transform(words_of(value), lambda w: F.concat(
        F.left(w, F.lit(1)), F.repeat(F.lit("."), F.length(w) - 1)))
    return F.array_join(dotted, " ")


def mask_ip(value: Column) -> Column:
    return let(F.split(value, r"\.", -1), lambda p: F.when(
        F.size(p) == 4, F.concat(p[0], F.lit("."), p[1], F.lit(".***. ***"))).otherwise(F.lit("***.***.***. ***")))


def mask_generic(value: Column) -> Column:
    inner = F.concat(F.left(value, F.lit(1)), _stars(F.length(value) - 2), F.right(value, F.lit(1)))
    return F.when(F.length(value) <= 2, _stars(F.length(value))).otherwise(inner)


def mask(value: Column, entity_type: Column) -> Column:
    """Hide a value but keep its shape."""
    return (F.when(entity_type == "EMAIL", mask_email(value)).when(entity_type == "PHONE", mask_phone(value))
            .when(entity_type == "NAME", mask_name(value)).when(entity_type == "IP_ADDRESS", mask_ip(value))
            .otherwise(mask_generic(value)))


def short_hash(value: Column, characters: int) -> Column:
    return F.upper(F.left(F.sha2(value, 256), F.lit(characters)))


def tokenize(value: Column, entity_type: Column, characters: int = 8) -> Column:
    """Deterministic token; reversible only through the vault table."""
    return F.concat(entity_type, F.lit("_TOKEN_"), short_hash(value, characters))


def redact(entity_type: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_REDACTED]"))


def pseudonym(value: Column, entity_type: Column, number: Column) -> Column:
    """``number`` is the value's place in its type's order of first appearance."""
    text = number.cast("string")
    return F.concat(entity_type, F.lit("_PSEUDO_"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text),
                    F.lit("_"), short_hash(value, 6))


def generalize_date(value: Column) -> Column:
    """Month and year of a three-part date."""
    return let(F.split(value, r"[/\-.]", -1), lambda p: F.when(
        F.size(p) == 3,
        F.when(F.length(p[2]) == 4, F.concat(p[1], F.lit("/"), p[2]))
        .when(F.length(p[0]) == 4, F.concat(p[0], F.lit("-"), p[1]))
        .otherwise(F.concat(F.lit("XX/"), p[1], F.lit("/"), p[2]))).otherwise(F.lit("[DATE_GENERALIZED]")))


def generalize_age(value: Column) -> Column:
    """Five-year band, of a number of any length."""
    digits = F.regexp_replace(ascii_digits(digits_only(value)), "^0+(?=[0-9])", "")

    def next_ten(tens: Column) -> Column:
        nines = F.length(F.regexp_extract(tens, "9*\\z", 0))
        raised = F.left(tens, F.length(tens) - nines)
        last = (F.right(raised, F.lit(1)).cast("int") + 1).cast("string")
        return F.concat(F.when(raised == "", F.lit("1")).otherwise(F.concat(F.left(raised, F.length(raised) - 1), last)),
                        F.repeat(F.lit("0"), nines))

    def band(d: Column) -> Column:
        tens = F.left(d, F.length(d) - 1)
        return F.when(F.right(d, F.lit(1)) < "5", F.concat(tens, F.lit("0-"), tens, F.lit("5"))).otherwise(
            F.concat(tens, F.lit("5-"), next_ten(tens), F.lit("0")))

    return let(digits, lambda d: F.when(d == "", F.lit("[AGE_RANGE]")).otherwise(band(d)))


def generalize_pincode(value: Column) -> Column:
    return let(digits_only(value), lambda d: F.when(
        F.length(d) >= 4, F.concat(F.left(d, F.lit(4)), F.lit("XX"))).otherwise(F.lit("[PIN_GENERALIZED]")))


def generalize_phone(value: Column) -> Column:
    return let(digits_only(value), lambda d: F.when(
        F.length(d) >= 10, F.concat(F.left(d, F.lit(4)), F.lit("XXXXXX"))).otherwise(F.lit("[PHONE_GENERALIZED]")))


def generalize_region(value: Column) -> Column:
    return F.concat(F.lit("[REGION_"), short_hash(value, 4), F.lit("]"))


def generalize_default(value: Column) -> Column:
    half = F.floor(F.length(value) / 2).cast("int")
    return F.when(F.length(value) > 4, F.concat(
        F.left(value, half), F.repeat(F.lit("X"), F.length(value) - half))).otherwise(F.lit("[GENERALIZED]"))


def generalize(value: Column, entity_type: Column) -> Column:
    """Less precise form of a value, by type."""
    return (F.when(entity_type.isin("DATE", "DATE_OF_BIRTH"), generalize_date(value))
            .when(entity_type == "AGE", generalize_age(value))
            .when(entity_type == "PINCODE", generalize_pincode(value))
            .when(entity_type == "PHONE", generalize_phone(value))
            .when(entity_type.isin("LOCATION", "ADDRESS"), generalize_region(value))
            .otherwise(generalize_default(value)))


def k_anonymize(value: Column, entity_type: Column) -> Column:
    """The same as :func:`generalize`: no equivalence classes are formed."""
    return generalize(value, entity_type)


def anonymized_value(value: Column, entity_type: Column, strategy: Column, pseudonym_value: Column,
                     token: Column | None = None) -> Column:
    """Replacement by strategy; null and unknown strategies mask.

    ``pseudonym_value`` and ``token`` carry vault lookups. A pseudonym needs a number
    from a vault or from its document, so there is no default; a value the vault lacks is redacted.
    """
    tokens = tokenize(value, entity_type) if token is None else token
    pseudonyms = F.coalesce(pseudonym_value, redact(entity_type))
    return (F.when(strategy == "TOKENIZE", tokens).when(strategy == "REDACT", redact(entity_type))
            .when(strategy == "PSEUDONYMIZE", pseudonyms)
            .when(strategy.isin("GENERALIZE", "K_ANONYMIZE"), generalize(value, entity_type))
            .otherwise(mask(value, entity_type)))


def _chosen(spans: Column, strategy: str) -> Column:
    """The value of each span of one strategy, null for the others."""
    return F.transform(spans, lambda d: F.when(d["anonymization_strategy"] == strategy, d["value"]))


def _has(spans: Column, strategy: str) -> Column:
    return F.exists(spans, lambda d: F.coalesce(d["anonymization_strategy"] == strategy, F.lit(False)))


def _in_document_tokens(spans: Column) -> Column:
    """``(token, is_first)`` of each span; the token is null unless the span is tokenized. The first type seen for a value wins."""
    def named(firsts: Column) -> Column:
        return F.transform(firsts, lambda first, i: F.struct(F.when(
            F.get(spans, i)["anonymization_strategy"] == "TOKENIZE", tokenize(F.get(spans, i)["value"], F.get(spans, first)["entity_type"])).alias("token"),
            (first == i).alias("is_first")))

    return F.when(_has(spans, "TOKENIZE"), let(first_alike(_chosen(spans, "TOKENIZE")), named))


def _in_document_pseudonyms(spans: Column) -> Column:
    """The pseudonym of each pseudonymized span, null for the others: values numbered within their type by first appearance."""
    def types(firsts: Column) -> Column:
        return F.zip_with(spans, F.transform(firsts, lambda first, i: first == i), lambda d, is_first: F.when(
            is_first & (d["anonymization_strategy"] == "PSEUDONYMIZE"), d["entity_type"]))

    def named(b: Column) -> Column:
        return F.zip_with(spans, b["firsts"], lambda d, first: F.when(d["anonymization_strategy"] == "PSEUDONYMIZE", pseudonym(
            d["value"], F.get(spans, first)["entity_type"], F.get(b["numbers"], first))))

    numbered = let(first_alike(_chosen(spans, "PSEUDONYMIZE")), lambda firsts: let(F.struct(
        firsts.alias("firsts"), rank_alike(types(firsts)).alias("numbers")), named))
    return F.when(_has(spans, "PSEUDONYMIZE"), numbered)


def anonymize_document(spans: Column) -> Column:
    """``struct<spans, token_map>`` of the classified spans of one document.

    Every span gets ``anonymized_value`` and ``strategy_applied``; ``token_map`` maps the tokenized values to their tokens. Tokens and
    pseudonyms are consistent within the document; corpus-wide consistency comes from the vault operators. Work grows with n log n
    of the spans.
    """
    def replaced(b: Column) -> Column:
        return F.transform(b["spans"], lambda d, i: d.withField("anonymized_value", anonymized_value(
            d["value"], d["entity_type"], d["anonymization_strategy"], F.get(b["pseudonyms"], i), F.get(b["tokens"], i)["token"])).withField(
            "strategy_applied", F.coalesce(d["anonymization_strategy"], F.lit("MASK"))))

    def mapped(b: Column) -> Column:
        pairs = F.zip_with(b["spans"], b["tokens"], lambda d, t: F.struct(d["value"].alias("value"), F.when(
            t["is_first"] & d["value"].isNotNull(), t["token"]).alias("token")))
        none = F.array().cast("array<struct<value:string,token:string>>")
        return F.map_from_entries(F.filter(F.coalesce(pairs, none), lambda p: p["token"].isNotNull()))

    def facts(all_spans: Column) -> Column:
        return F.struct(all_spans.alias("spans"), _in_document_tokens(all_spans).alias("tokens"),
                        _in_document_pseudonyms(all_spans).alias("pseudonyms"))

    def none(all_spans: Column) -> Column:
        text = F.lit(None).cast("string")  # the type of what is put in; there are no elements
        made = F.transform(all_spans, lambda d: d.withField("anonymized_value", text).withField("strategy_applied", text))
        return F.struct(made.alias("spans"), F.create_map().cast("map<string,string>").alias("token_map"))

    return F.when(F.size(spans) == 0, none(spans)).otherwise(
        let(spans, lambda s: let(facts(s), lambda b: F.struct(replaced(b).alias("spans"), mapped(b).alias("token_map")))))


def anonymize_entities(spans: Column) -> Column:
    """Each classified span with ``anonymized_value`` and ``strategy_applied``."""
    return anonymize_document(spans)["spans"]


def token_map(spans: Column) -> Column:
    """``map<value, token>`` of the spans of one document that were tokenized."""
    return anonymize_document(spans)["token_map"]


def _spliced(text: Column, spans: Column) -> Column:
    """``struct<t, over>``: replacements put into a text by starts from right to left, equal starts in given order.

    Ends point at places of the text as it was, so one that replacements before it have moved in takes what it finds there; ``over`` is the
    number of characters it takes beyond the end.
    """
    def put(state: Column, d: Column) -> Column:
        size = F.length(state["t"])
        return F.struct(F.concat(F.left(state["t"], d["start"]), d["replacement"], F.substring(
            state["t"], d["end"] + 1, F.greatest(size - d["end"], F.lit(0)))).alias("t"),
            (state["over"] + F.greatest(d["end"] - size, F.lit(0))).alias("over"))

    keyed = F.transform(spans, lambda d: F.struct((-d["start"]).alias("order"), d["i"].alias("i"), d["start"].alias("start"),
                                                  d["end"].alias("end"), d["replacement"].alias("replacement")))
    return F.aggregate(F.array_sort(keyed), F.struct(text.alias("t"), F.lit(0).alias("over")), put)


def splice_pieces(text: Column, spans: Column) -> Column:
    """The text with its replacements in, as ``array<struct<t, over>>``; see :func:`apply_to_text`.

    ``over`` tells how many characters a piece takes of those that follow it.
    """
    def outputs(b: Column) -> Column:
        """Per island the piece before it and what replaces it, with the characters it takes beyond its end."""
        def one(first: Column, j: Column) -> Column:
            last = F.coalesce(F.get(b["firsts"], j + 1), F.size(b["sorted"])) - 1
            start, end = F.get(b["sorted"], first)["start"], F.get(b["ends"], last)
            gap = slice_blocks(b["blocks"], F.coalesce(F.get(b["ends"], first - 1), F.lit(0)), start)
            own = F.transform(F.slice(b["sorted"], first + 1, last - first + 1), lambda d: F.struct(
                (d["start"] - start).alias("start"), (d["end"] - start).alias("end"), d["i"].alias("i"), d["replacement"].alias("replacement")))
            alone = F.struct(F.get(b["sorted"], first)["replacement"].alias("t"), F.lit(0).alias("over"))
            made = F.when(last == first, alone).otherwise(_spliced(slice_blocks(b["blocks"], start, end), own))
            return F.array(F.struct(gap.alias("t"), F.lit(0).alias("over")), made)

        rest = slice_blocks(b["blocks"], F.get(b["ends"], F.size(b["ends"]) - 1), F.length(text))
        return F.concat(F.flatten(F.transform(b["firsts"], one)), F.array(F.struct(rest.alias("t"), F.lit(0).alias("over"))))

    def islands(b: Column) -> Column:
        def opens(j: Column) -> Column:
            start = F.get(b["sorted"], j)["start"]
            return (j == 0) | ((start >= F.get(b["ends"], j - 1)) & (start > F.get(b["sorted"], j - 1)["start"]))

        firsts = F.filter(F.sequence(F.lit(0), F.size(b["sorted"]) - 1), opens)
        return let(F.struct(b["sorted"].alias("sorted"), b["ends"].alias("ends"), firsts.alias("firsts"), text_blocks(text).alias("blocks")),
                   outputs)

    def by_start(all_spans: Column) -> Column:
        ordered = F.array_sort(F.transform(all_spans, lambda d, i: F.struct(
            d["start"].alias("start"), i.alias("i"), d["end"].alias("end"), d["anonymized_value"].alias("replacement"))))
        return let(ordered, lambda o: let(F.struct(o.alias("sorted"), running_max(F.transform(o, lambda d: d["end"])).alias("ends")), islands))

    whole = F.array(F.struct(text.alias("t"), F.lit(0).alias("over")))
    return F.when(F.size(spans) > 0, let(spans, by_start)).otherwise(whole)


def join_pieces(pieces: Column) -> Column:
    """The text of :func:`splice_pieces`."""
    def pending(p: Column, j: Column) -> Column:
        """Characters that pieces before this one take of it and what follows: grows by what each takes, shrinks by each length, never below 0."""
        return F.when(j == 0, F.lit(0)).otherwise(
            F.get(p["sums"], j - 1) - F.least(F.get(p["lowest"], j - 1), F.lit(0)) + F.get(pieces, j - 1)["over"])

    def trimmed(p: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda piece, j: F.substring(
            piece["t"], pending(p, j) + 1, F.length(piece["t"]))), "")

    steps = F.transform(pieces, lambda piece, j: F.when(j == 0, F.lit(0)).otherwise(
        F.get(pieces, j - 1)["over"]) - F.length(piece["t"]))
    taking = let(running(steps, lambda a, b: a + b), lambda sums: let(
        F.struct(sums.alias("sums"), running(sums, F.least).alias("lowest")), trimmed))
    plain = F.array_join(F.transform(pieces, lambda piece: piece["t"]), "")
    return F.when(F.exists(pieces, lambda piece: piece["over"] > 0), taking).otherwise(plain)


def apply_to_text(text: Column, spans: Column) -> Column:
    """Splice replacements into the text from right to left by original offsets.

    Spans with equal starts keep their order. Overlapping spans are spliced in
    the same order, so an outer span replaces whatever its end now points at.
    Spans that overlap make islands; only an island with several spans is spliced
    one by one, on its own piece of the text. Where such an island takes characters
    beyond its end, they go from the pieces that follow.
    """
    return F.when(F.size(spans) > 0, let(splice_pieces(text, spans), join_pieces)).otherwise(text)
