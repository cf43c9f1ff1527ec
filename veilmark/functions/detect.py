"""Pattern detection: spans of 18 identifier types in a text column.

A span is ``struct<entity_type, value, start, end, confidence, source>`` with
code-point offsets, half-open. A document's spans live in an array on its row,
so detection is a projection: no shuffle, and empty documents keep their row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import ascii_digits, constant, contains_any, digits_only, jvm_regex, let, lookup, one_of, running, running_max

SPAN_TYPE = "struct<entity_type:string,value:string,start:int,end:int,confidence:double,source:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
_MATCHES_TYPE = "array<struct<start:int,end:int,rank:int,entity_type:string,value:string>>"
_CANDIDATE_TYPE = "struct<start:int,end:int,rank:int,entity_type:string,value:string,confidence:double>"
_CANDIDATES_TYPE = f"array<{_CANDIDATE_TYPE}>"

# What a text must contain for a pattern to have any chance. Checked once per
# text; nearly all prose fails nearly all of these, and skips the real pattern.
_GATES = {
    "at": lambda t, low: F.contains(t, F.lit("@")),
    "link": lambda t, low: F.contains(t, F.lit("http")),
    "digits4": lambda t, low: t.rlike(r"\p{Nd}{4}"),
    "pairs": lambda t, low: t.rlike(r"\p{Nd}[./\-]\p{Nd}"),
    "account": lambda t, low: contains_any(low, ["account", "acct", "a/c"]),
    "password": lambda t, low: contains_any(low, ["passw", "pwd"]),
    "login": lambda t, low: contains_any(low, ["user", "login", "log\u0131n"]),
    "bank_code": lambda t, low: F.contains(t, F.lit("0")) & t.rlike("[A-Z]{4}0"),
    "lettered": lambda t, low: t.rlike(r"[A-Z]\p{Nd}"),
    "digits13": lambda t, low: t.rlike("[0-9]{13}"),
}
_GATES_OF = {
    "EMAIL": ["at"], "UPI_ID": ["at"], "URL": ["link"], "IP_ADDRESS": ["pairs"], "DATE": ["pairs"],
    "BANK_ACCOUNT": ["account", "digits4"], "PASSWORD": ["password"], "USERNAME": ["login"],
    "IFSC_CODE": ["bank_code"], "CREDIT_CARD": ["digits4", "digits13"],
    **dict.fromkeys(["PAN", "VOTER_ID", "DRIVING_LICENSE", "PASSPORT", "GST_NUMBER"], ["digits4", "lettered"]),
}


# The first character a match can have: a one-class test that rules out nearly
# every position before the costlier word-boundary test. Changes no match.
_FIRST = {
    "PHONE": r"[+(\d]", "IP_ADDRESS": r"\d", "CREDIT_CARD": "[3-6]", "DATE": r"\d", "AADHAAR": "[2-9]",
    "PAN": "[A-Z]", "VOTER_ID": "[A-Z]", "DRIVING_LICENSE": "[A-Z]", "PASSPORT": "[A-Z]", "IFSC_CODE": "[A-Z]",
    "GST_NUMBER": r"\d", "PINCODE": "[1-9]",
}


def span_regex(name: str, pattern: str) -> str:
    ahead = f"(?={_FIRST[name]})(?:{pattern})" if name in _FIRST else pattern
    return jvm_regex(ahead)


_CUT, _LIKE_CUT = "\x01", "\x02"


def _gaps(text: Column, regex: Column) -> Column:
    """The text split at the matches, for its lengths. ``split`` compiles its pattern for every text, ``regexp_replace`` keeps a constant one.

    A text that holds the mark has another control character in its place, which is the same to every pattern.
    """
    plain = F.when(F.contains(text, F.lit(_CUT)), F.translate(text, _CUT, _LIKE_CUT)).otherwise(text)
    return F.split(F.regexp_replace(plain, regex, F.lit(_CUT)), _CUT, -1)


def locate(text: Column, values: Column, regex: Column) -> Column:
    """Positions of all matches ``values`` of ``regex``: ``array<struct<value, start, end>>``.

    Matched values and the gaps between them alternate, so running lengths give
    the offsets without leaving built-in functions.
    """
    gaps = F.slice(_gaps(text, regex), 1, F.size(values))
    widths = F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v))
    return F.zip_with(values, running(widths, lambda a, b: a + b), lambda v, end: F.struct(
        v.alias("value"), (end - F.length(v)).alias("start"), end.alias("end")))


def luhn_valid(value: Column) -> Column:
    return F.call_function("luhn_check", digits_only(value))


def ip_confidence(value: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda p: ascii_digits(p).cast("int"))
    usable = F.forall(octets, lambda o: o <= 255) & ~F.forall(octets, lambda o: one_of(o, [0, 255]))
    private = F.lit(False)
    for prefix in fixed.IP_PRIVATE_PREFIXES:
        private = private | F.startswith(value, F.lit(prefix))
    return F.when(usable, F.when(private, F.lit(fixed.IP_PRIVATE)).otherwise(F.lit(fixed.IP_PUBLIC)))


def password_secret(value: Column) -> Column:
    """The credential part of a password match, without trailing punctuation."""
    secret = F.regexp_extract(value, jvm_regex(fixed.PASSWORD_PARTS), 1)
    return F.regexp_replace(secret, rf"[{fixed.TRAILING_PUNCTUATION}]+\z", "")


def looks_secret(secret: Column) -> Column:
    return secret.rlike(r"\p{Nd}|[^a-zA-Z0-9]")


def password_confidence(value: Column) -> Column:
    return let(password_secret(value), lambda s: F.when(
        s != "", F.when(looks_secret(s), F.lit(fixed.PASSWORD_STRONG)).otherwise(F.lit(fixed.PASSWORD_PLAIN))))


def aadhaar_confidence(value: Column) -> Column:
    digits = F.regexp_replace(value, jvm_regex(r"\s"), "")
    varied = F.size(F.array_distinct(F.split(digits, ""))) > 2
    return F.when((F.length(digits) == 12) & varied, F.lit(fixed.BASE_CONFIDENCE["AADHAAR"]))


def pan_confidence(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Z]{5}[0-9]{4}[A-Z]\z"), F.lit(fixed.BASE_CONFIDENCE["PAN"]))


def phone_confidence(value: Column) -> Column:
    return F.when(F.length(digits_only(value)) >= 10, F.lit(fixed.BASE_CONFIDENCE["PHONE"]))


def card_confidence(value: Column) -> Column:
    return F.when(luhn_valid(value), F.lit(fixed.BASE_CONFIDENCE["CREDIT_CARD"]))


_VALIDATORS = {
    "PHONE": phone_confidence, "IP_ADDRESS": ip_confidence, "CREDIT_CARD": card_confidence,
    "PASSWORD": password_confidence, "AADHAAR": aadhaar_confidence, "PAN": pan_confidence,
}


def base_confidence(entity_type: Column, value: Column, types: list[str] | None = None) -> Column:
    """Confidence of a match by its type's validator; null drops the match."""
    plain = {t: c for t, c in fixed.BASE_CONFIDENCE.items() if t not in _VALIDATORS}
    confidence = F.coalesce(lookup(plain, entity_type), F.lit(fixed.DEFAULT_CONFIDENCE))
    for name, validator in _VALIDATORS.items():
        if types is None or name in types:
            confidence = F.when(entity_type == name, validator(value)).otherwise(confidence)
    return confidence


def raw_matches(text: Column, types: list[str] | None = None) -> Column:
    """Matches of the wanted patterns, unvalidated, in pattern order:
    ``array<struct<start, end, rank, entity_type, value>>``."""
    wanted = [(rank, name, span_regex(name, pattern)) for rank, (name, pattern) in enumerate(fixed.PATTERNS)
              if types is None or name in types]
    gates_of = {name: _GATES_OF.get(name, ["digits4"]) for _, name, _ in wanted}
    used = {gate for gates in gates_of.values() for gate in gates}

    def values_of(b: Column, name: str, regex: str) -> Column:
        ready = reduce(and_, [b["gates"][gate] for gate in gates_of[name]])
        return F.when(ready, F.regexp_extract_all(b["text"], F.lit(regex), F.lit(0)))

    def of_rule(b: Column, values: Column, rank: int, name: str, regex: str) -> Column:
        return F.transform(locate(b["text"], values, F.lit(regex)), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"),
            F.lit(name).alias("entity_type"), m["value"].alias("value")))

    def hits_of(b: Column, rank: int, name: str, regex: str) -> Column:
        return let(values_of(b, name, regex), lambda values: F.when(F.size(values) > 0, of_rule(b, values, rank, name, regex)))

    def collect(b: Column) -> Column:
        hits = F.filter(F.array(*[hits_of(b, *rule) for rule in wanted]), lambda h: h.isNotNull())
        found = F.flatten(hits)
        return F.when(reduce(or_, [b["gates"][gate] for gate in sorted(used)]), found).otherwise(
            F.array().cast(_MATCHES_TYPE))

    def with_gates(b: Column) -> Column:
        gates = F.struct(*[test(b["text"], b["low"]).alias(n) for n, test in _GATES.items() if n in used])
        return let(F.struct(b["text"].alias("text"), gates.alias("gates")), collect)

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), with_gates)


def candidates(text: Column, types: list[str] | None = None) -> Column:
    """Validated matches of the wanted patterns, before overlaps are suppressed."""
    judged = F.transform(raw_matches(text, types), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["rank"].alias("rank"),
        m["entity_type"].alias("entity_type"), m["value"].alias("value"),
        base_confidence(m["entity_type"], m["value"], types).alias("confidence")))
    return F.filter(judged, lambda c: c["confidence"].isNotNull())


def overlap_islands(spans: Column) -> Column:
    """Cut spans (sorted by start) into runs that overlap.

    Spans of different islands share no position, so any overlap rule can be
    decided island by island. Keeps pairwise work small in span-rich documents.
    """
    def cut(b: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(b["spans"]) - 1), lambda i: (i == 0) | (
            F.get(b["spans"], i)["start"] >= F.get(b["reach"], i - 1)))
        return let(F.concat(firsts, F.array(F.size(b["spans"]))), lambda edges: F.zip_with(
            F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1),
            lambda a, z: F.slice(b["spans"], a + 1, z - a)))

    def bind(all_spans: Column) -> Column:
        reach = running_max(F.transform(all_spans, lambda d: d["end"]))
        return let(F.struct(all_spans.alias("spans"), reach.alias("reach")), cut)

    def apart(all_spans: Column) -> Column:
        return F.forall(F.sequence(F.lit(1), F.size(all_spans) - 1), lambda i: F.get(all_spans, i)["start"] >= F.get(all_spans, i - 1)["end"])

    def by_size(all_spans: Column) -> Column:
        single = (F.size(all_spans) == 1) | ((F.size(all_spans) > 1) & apart(all_spans))
        return F.when(single, F.transform(all_spans, lambda d: F.array(d))).otherwise(bind(all_spans))

    return let(spans, by_size)


def suppress_overlaps(found: Column) -> Column:
    """Keep a candidate unless its start or end falls inside a kept, higher-priority one.

    A candidate that strictly contains a kept one stays: the test looks at the
    candidate's two ends only.
    """
    def blocked(kept: Column, c: Column) -> Column:
        return F.exists(kept, lambda k: ((k["start"] <= c["start"]) & (c["start"] < k["end"]))
                        | ((k["start"] < c["end"]) & (c["end"] <= k["end"])))

    def by_priority(island: Column) -> Column:
        keyed = F.transform(island, lambda c: F.struct(c["rank"].alias("rank"), c["start"].alias("start"),
                                                       c.alias("c")))
        return F.transform(F.array_sort(keyed), lambda k: k["c"])

    def greedy(island: Column) -> Column:
        return F.aggregate(by_priority(island), F.array().cast(_CANDIDATES_TYPE), lambda kept, c: F.when(
            blocked(kept, c), kept).otherwise(F.concat(kept, F.array(c))))

    def resolve(all_found: Column) -> Column:
        islands = overlap_islands(F.array_sort(all_found))
        kept = F.flatten(F.transform(islands, lambda i: F.when(F.size(i) > 1, greedy(i)).otherwise(i)))
        return F.when(F.size(all_found) > 1, by_priority(kept)).otherwise(all_found)

    return let(found, resolve)


def to_spans(found: Column, source: str = "regex") -> Column:
    return F.transform(found, lambda c: F.struct(
        c["entity_type"].alias("entity_type"), c["value"].alias("value"), c["start"].alias("start"),
        c["end"].alias("end"), c["confidence"].alias("confidence"), F.lit(source).alias("source")))


def regex_detect(text: Column) -> Column:
    """All pattern spans of a cleaned text, in priority order."""
    return to_spans(suppress_overlaps(candidates(text)))
