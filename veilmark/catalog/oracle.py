"""The same results in relational SQL for another engine (DuckDB dialect).

One chain of common table expressions retells every stage with joins, windows
and list folds over span rows; each check selects from the stage it needs.
"""

from __future__ import annotations

import re

from ..functions import fixed_values as fixed
from .inputs import ANNOTATION_COLUMNS, ANNOTATIONS, SCORE, TEXTS

SPACES = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_SPACES = SPACES.replace(r"\n", "", 1)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def number(value: float) -> str:
    return f"{value!r}::DOUBLE"


def rounded(column: str, places: int) -> str:
    """Half-to-even rounding on the exact binary value of a column."""
    c, tens, scale = column, f"1e{places}", f"2e{places}"
    high = f"({c} * 134217729e0 - ({c} * 134217729e0 - {c}))"
    k = f"floor({c} * {tens})"
    error = f"(({high} * {scale} - {c} * {scale}) + ({c} - {high}) * {scale})"
    excess = f"(({c} * {scale} - ({k} * 2e0 + 1e0)) + {error})"
    return (f"(({k} + CASE WHEN {excess} > 0e0 OR ({excess} = 0e0 AND {k} % 2e0 <> 0e0) THEN 1e0 ELSE 0e0 END) "
            f"/ {tens})")


def stripped(e: str) -> str:
    return rf"regexp_replace({e}, '^[{SPACES}]+|[{SPACES}]+\z', '', 'g')"


def fixed_ocr(e: str) -> str:
    for pattern, digit in ((r"(\d)[Ol](\d)", "0"), (r"(\d)[Ol](\d)", "0"), (r"(\d)I(\d)", "1"), (r"(\d)I(\d)", "1")):
        e = rf"regexp_replace({e}, '{pattern}', '\1{digit}\2', 'g')"
    return e


def spaced(e: str) -> str:
    return (rf"regexp_replace(regexp_replace({e}, '[{LINE_SPACES}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def uncontrolled(e: str) -> str:
    return rf"regexp_replace({e}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"


def cleaned(e: str) -> str:
    return f"coalesce({stripped(uncontrolled(spaced(fixed_ocr(e))))}, '')"


def window(t: str, start: str, end: str) -> str:
    """Code points [start, end) of t with both ends clamped at zero."""
    return f"substring({t}, greatest({start}, 0) + 1, greatest({end} - greatest({start}, 0), 0))"


def cases(table: dict, key: str, default: str, value=lambda v: number(v)) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {value(v)}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


def bands(column: str, floors) -> str:
    arms = " ".join(f"WHEN {column} >= {number(f)} THEN '{name}'" for name, f in floors)
    return f"CASE {arms} ELSE 'LOW' END"


def any_of(haystack: str, words) -> str:
    return f"(len(list_filter({strings(words)}, lambda w: contains({haystack}, w))) > 0)"


def luhn(d: str) -> str:
    doubled = f"(2 * cast(substr({d}, length({d}) - i, 1) AS BIGINT))"
    return (f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 1 THEN "
            f"CASE WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END "
            f"ELSE cast(substr({d}, length({d}) - i, 1) AS BIGINT) END)) % 10 = 0")


def base_confidence() -> str:
    secret = rf"regexp_replace(regexp_extract(value, '{fixed.PASSWORD_PARTS}', 1), '[:;,.!?]+\z', '')"
    octets = r"list_transform(string_split(value, '.'), lambda p: cast(p AS BIGINT))"
    digits = r"regexp_replace(value, '\D', '', 'g')"
    plain = {t: c for t, c in fixed.BASE_CONFIDENCE.items() if t not in ("PHONE", "CREDIT_CARD", "AADHAAR")}
    private = " OR ".join(f"starts_with(value, '{p}')" for p in fixed.IP_PRIVATE_PREFIXES)
    return rf"""CASE entity_type
      WHEN 'PHONE' THEN CASE WHEN length({digits}) >= 10 THEN 0.88::DOUBLE END
      WHEN 'CREDIT_CARD' THEN CASE WHEN {luhn(digits)} THEN 0.80::DOUBLE END
      WHEN 'AADHAAR' THEN CASE WHEN length({digits}) = 12
        AND len(list_distinct(string_split({digits}, ''))) > 2 THEN 0.90::DOUBLE END
      WHEN 'PASSWORD' THEN CASE WHEN {secret} = '' THEN NULL
        WHEN regexp_matches({secret}, '[^a-zA-Z]') THEN 0.95::DOUBLE ELSE 0.55::DOUBLE END
      WHEN 'IP_ADDRESS' THEN CASE WHEN len(list_filter({octets}, lambda p: p > 255)) > 0 THEN NULL
        WHEN len(list_filter({octets}, lambda p: p <> 0 AND p <> 255)) = 0 THEN NULL
        WHEN {private} THEN 0.60::DOUBLE ELSE 0.75::DOUBLE END
      ELSE {cases(plain, 'entity_type', '0.85::DOUBLE')} END"""


def _raw() -> str:
    arms = [f"SELECT doc_id, {rank} AS rank, '{name}' AS entity_type, regexp_extract_all(t, {text(p)}) AS v, "
            f"string_split_regex(t, {text(p)}) AS g FROM clean"
            for rank, (name, p) in enumerate(fixed.PATTERNS)]
    return " UNION ALL ".join(arms)


def _annotations() -> str:
    key = TEXTS["kyc"][1]
    arms = []
    for found in ANNOTATIONS:
        columns = ", ".join(f'{e} AS "{c}"' for e, c in zip(found, ANNOTATION_COLUMNS))
        arms.append(f"SELECT {key} AS doc_id, {columns} FROM customer")
    return " UNION ALL ".join(arms)


def _iou(a: str, b: str) -> str:
    shared = f"greatest(0, least({a}.e, {b}.e) - greatest({a}.s, {b}.s))"
    return (f"(CASE WHEN {shared} = 0 THEN 0e0 ELSE {shared}::DOUBLE / "
            f"(({a}.e - {a}.s) + ({b}.e - {b}.s) - {shared})::DOUBLE END)")


_TRANSFORMER = cases(fixed.TRANSFORMER_LABELS, "label", "NULL", text)
_NER = cases(fixed.NER_LABELS, "label", "NULL", text)
_RELIABILITY = cases(fixed.SOURCE_RELIABILITY, "x.source", number(fixed.OTHER_RELIABILITY))
_PRIORITY = "CASE x.source WHEN 'regex' THEN 0 WHEN 'transformer' THEN 1 WHEN 'spacy' THEN 2 ELSE 3 END"
BOOST = ("CASE WHEN detector_count >= 3 THEN "
         + cases({t: b for t, (_, b) in fixed.AGREEMENT_BOOST.items()}, "entity_type", "1.20::DOUBLE")
         + " WHEN detector_count = 2 THEN "
         + cases({t: a for t, (a, _) in fixed.AGREEMENT_BOOST.items()}, "entity_type", "1.12::DOUBLE")
         + " ELSE 1e0 END")


def _types(names) -> str:
    return "(" + ", ".join(text(n) for n in names) + ")"


def _hits(table: dict) -> str:
    return ("list_filter(" + cases(table, "entity_type", "[]::VARCHAR[]", strings)
            + ", lambda w: contains(win, w))")


_SECRET = rf"regexp_replace(regexp_extract(value, '{fixed.PASSWORD_PARTS}', 1), '[:;,.!?]+\z', '')"
ENTITY_NOTE = rf"""CASE
  WHEN entity_type = 'NAME' AND len(list_filter(regexp_split_to_array(value, '[{SPACES}]+'), lambda w: w <> '')) < 2
    THEN 'single_word_name'
  WHEN entity_type = 'PAN' AND NOT {any_of('win', fixed.ENTITY_KEYWORDS['PAN'])} THEN 'no_pan_context'
  WHEN entity_type = 'PHONE' AND s >= 2 AND regexp_matches(before, '\d\.\s*\z') THEN 'version_decimal_prefix'
  WHEN entity_type = 'BANK_ACCOUNT' AND NOT {any_of('win', fixed.ENTITY_KEYWORDS['BANK_ACCOUNT'])}
    THEN 'no_financial_context'
  WHEN entity_type = 'DATE_OF_BIRTH' AND {any_of('win', fixed.ENTITY_KEYWORDS['DATE_OF_BIRTH'])}
    THEN 'dob_context_confirmed'
  WHEN entity_type = 'PASSWORD' AND NOT regexp_matches({_SECRET}, '[^a-zA-Z]') THEN 'password_looks_like_plain_word'
  WHEN entity_type = 'PASSWORD' AND length({_SECRET}) < 6 THEN 'password_too_short'
  WHEN entity_type = 'PINCODE' AND NOT {any_of('win', fixed.ENTITY_KEYWORDS['PINCODE'])}
    THEN 'no_address_context_for_pincode' END"""
_NOTE_FACTORS = {
    "single_word_name": 0.75, "no_pan_context": 0.25, "version_decimal_prefix": 0.15, "no_financial_context": 0.40,
    "dob_context_confirmed": 1.15, "password_looks_like_plain_word": 0.25, "password_too_short": 0.50,
    "no_address_context_for_pincode": 0.30,
}
_SHORT_NAME = r"(entity_type = 'NAME' AND regexp_matches(value, '\p{Lu}') AND NOT regexp_matches(value, '[\p{Ll}\p{Lt}]') AND length(value) < 5)"
_ALONE = f"(entity_type IN {_types(fixed.CONTEXTUAL_TYPES)} AND NOT structured)"
AGREEMENT = f"""CASE WHEN entity_type IN {_types(fixed.CONTEXTUAL_TYPES)} THEN CASE
  WHEN len(string_split(source, '+')) = 1 AND len(pos) = 0 THEN 'single_detector_no_context'
  WHEN len(string_split(source, '+')) >= 2 THEN 'multi_detector_agreement' END END"""
FACTORS = [
    "CASE kind WHEN 'confirming' THEN 1.15::DOUBLE WHEN 'competing' THEN 0.20::DOUBLE ELSE 1e0 END",
    "CASE WHEN len(pos) > 0 AND coalesce(kind, '') <> 'confirming' THEN 1.10::DOUBLE ELSE 1e0 END",
    "CASE WHEN len(neg) > 0 AND coalesce(kind, '') <> 'competing' THEN 0.65::DOUBLE ELSE 1e0 END",
    "CASE WHEN quantity IS NOT NULL THEN 0.15::DOUBLE ELSE 1e0 END",
    f"CASE WHEN entity_type = 'IP_ADDRESS' THEN CASE WHEN {any_of('win', fixed.ENTITY_KEYWORDS['IP_ADDRESS'])} "
    f"THEN 1.10::DOUBLE ELSE 1e0 END ELSE {cases(_NOTE_FACTORS, 'coalesce(note, chr(0))', '1e0')} END",
    f"CASE WHEN {_SHORT_NAME} THEN 0.50::DOUBLE ELSE 1e0 END",
    f"CASE WHEN {_ALONE} THEN 0.20::DOUBLE ELSE 1e0 END",
    "CASE agreement WHEN 'single_detector_no_context' THEN 0.70::DOUBLE "
    "WHEN 'multi_detector_agreement' THEN 1.05::DOUBLE ELSE 1e0 END",
]


def _scaled() -> str:
    e = "confidence"
    for i in range(len(FACTORS)):
        e = f"least(1e0, {e} * f{i})"
    return e


NOTES = f"""list_filter([
  CASE WHEN kind IS NOT NULL THEN kind || '_label:' || label END,
  CASE WHEN f1 <> 1e0 THEN 'positive_context:' || array_to_string(pos[1:2], ',') END,
  CASE WHEN f2 <> 1e0 THEN 'negative_context:' || array_to_string(neg[1:2], ',') END,
  'quantity_follows:' || quantity, note, CASE WHEN f5 <> 1e0 THEN 'likely_abbreviation' END,
  CASE WHEN f6 <> 1e0 THEN 'no_structured_pii_cooccurrence' END, agreement], lambda n: n IS NOT NULL)"""

WEIGHT_OF = cases(
    {t: p for t, p in fixed.RISK_PROFILE.items()}, "entity_type", "0.5e0 * 100e0",
    lambda p: f"(0.3e0 * {number(p[0])} + 0.3e0 * {number(p[1])} + 0.2e0 * {number(p[2])} + 0.2e0 * {number(p[3])}) "
              "* 100e0").replace("0.5e0 * 100e0", "(0.3e0 * 0.5e0 + 0.3e0 * 0.5e0 + 0.2e0 * 0.5e0 + 0.2e0 * 0.5e0) * 100e0")

RULES = " UNION ALL ".join(
    f"SELECT {r}::BIGINT AS rule, {strings(sorted(types))} AS combo, '{level}' AS risk_level, {number(score)} AS score, "
    f"{text(description)} AS description" for r, (types, level, score, description) in enumerate(fixed.COMBINATIONS))
PAIRS = " UNION ALL ".join(f"SELECT {p} AS pair, '{a}' AS a, '{b}' AS b, {number(boost)} AS boost"
                           for p, (a, b, boost) in enumerate(fixed.PAIR_BOOSTS))


def sha(value: str, n: int) -> str:
    return f"upper(left(sha256({value}), {n}))"


DIGITS = r"regexp_replace(value, '\D', '', 'g')"
MASK_EMAIL = ("CASE WHEN contains(value, '@') THEN left(split_part(value, '@', 1), 1) || '***@' || "
              "substring(value, position('@' IN value) + 1) ELSE '***@***.***' END")
MASK_PHONE = (f"CASE WHEN length({DIGITS}) >= 10 THEN left({DIGITS}, 2) || '****' || right({DIGITS}, 4) "
              f"WHEN length({DIGITS}) >= 3 THEN '****' || right({DIGITS}, 3) ELSE '****' END")
MASK_NAME = (f"array_to_string(list_transform(list_filter(regexp_split_to_array(value, '[{SPACES}]+'), lambda w: w <> ''), "
             "lambda w: left(w, 1) || repeat('.', length(w) - 1)), ' ')")
MASK_IP = ("CASE WHEN len(string_split(value, '.')) = 4 THEN split_part(value, '.', 1) || '.' || "
           "split_part(value, '.', 2) || '.***. ***' ELSE '***.***.***. ***' END")
MASK_GENERIC = ("CASE WHEN length(value) <= 2 THEN repeat('*', length(value)) "
                "ELSE left(value, 1) || repeat('*', length(value) - 2) || right(value, 1) END")
MASK = (f"CASE entity_type WHEN 'EMAIL' THEN {MASK_EMAIL} WHEN 'PHONE' THEN {MASK_PHONE} WHEN 'NAME' THEN {MASK_NAME} "
        f"WHEN 'IP_ADDRESS' THEN {MASK_IP} ELSE {MASK_GENERIC} END")
TOKEN = f"entity_type || '_TOKEN_' || {sha('value', 8)}"
_P = r"regexp_split_to_array(value, '[/\-.]')"
GENERALIZE_DATE = (f"CASE WHEN len({_P}) <> 3 THEN '[DATE_GENERALIZED]' WHEN length({_P}[3]) = 4 "
                   f"THEN {_P}[2] || '/' || {_P}[3] WHEN length({_P}[1]) = 4 THEN {_P}[1] || '-' || {_P}[2] "
                   f"ELSE 'XX/' || {_P}[2] || '/' || {_P}[3] END")
_AGE = f"(cast({DIGITS} AS BIGINT) // 5 * 5)"
GENERALIZE_AGE = (f"CASE WHEN {DIGITS} = '' THEN '[AGE_RANGE]' ELSE "
                  f"cast({_AGE} AS VARCHAR) || '-' || cast({_AGE} + 5 AS VARCHAR) END")
GENERALIZE_PIN = f"CASE WHEN length({DIGITS}) >= 4 THEN left({DIGITS}, 4) || 'XX' ELSE '[PIN_GENERALIZED]' END"
GENERALIZE_PHONE = (f"CASE WHEN length({DIGITS}) >= 10 THEN left({DIGITS}, 4) || 'XXXXXX' "
                    "ELSE '[PHONE_GENERALIZED]' END")
GENERALIZE_REGION = f"'[REGION_' || {sha('value', 4)} || ']'"
GENERALIZE_DEFAULT = ("CASE WHEN length(value) > 4 THEN left(value, length(value) // 2) || "
                      "repeat('X', length(value) - length(value) // 2) ELSE '[GENERALIZED]' END")
GENERALIZE = (f"CASE WHEN entity_type IN ('DATE', 'DATE_OF_BIRTH') THEN {GENERALIZE_DATE} "
              f"WHEN entity_type = 'AGE' THEN {GENERALIZE_AGE} WHEN entity_type = 'PINCODE' THEN {GENERALIZE_PIN} "
              f"WHEN entity_type = 'PHONE' THEN {GENERALIZE_PHONE} "
              f"WHEN entity_type IN ('LOCATION', 'ADDRESS') THEN {GENERALIZE_REGION} ELSE {GENERALIZE_DEFAULT} END")
REDACT = "'[' || entity_type || '_REDACTED]'"

_SPAN = "struct_pack(s := s, e := e, entity_type := entity_type, value := value, confidence := confidence, source := source)"

LABEL = r"regexp_extract(prefix, '([a-zA-Z][\w\s]{0,25}?)\s*[:=–—]\s*\z', 1)"

CHAIN: dict[str, str] = {
    "docs": " UNION ALL ".join(f"SELECT {key} AS doc_id, {body} AS text FROM {source}"
                               for source, key, body in TEXTS.values()),
    "clean": f"SELECT doc_id, text, {cleaned('text')} AS t FROM docs",
    "matches": _raw(),
    "steps": "SELECT doc_id, rank, entity_type, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, "
             "unnest(range(1, len(v) + 1)) AS i FROM matches WHERE len(v) > 0",
    "placed": "SELECT *, cast(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) "
              "AS e FROM steps",
    "judged_matches": f"SELECT doc_id, rank, entity_type, value, e - length(value) AS s, e, {base_confidence()} AS confidence "
                      "FROM placed",
    "cand": "SELECT * FROM judged_matches WHERE confidence IS NOT NULL",
    "kept_lists": """SELECT doc_id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(
        list_filter(acc, lambda a: (a.s <= x[1].s AND x[1].s < a.e) OR (a.s < x[1].e AND x[1].e <= a.e))) > 0
        THEN acc ELSE list_concat(acc, x) END) AS kept
      FROM (SELECT doc_id, list(struct_pack(rank := rank, s := s, e := e, entity_type := entity_type, value := value,
        confidence := confidence) ORDER BY rank, s) AS c FROM cand GROUP BY doc_id)""",
    "kept": """SELECT doc_id, i - 1 AS ordinal, k.* FROM (SELECT doc_id, unnest(kept) AS k,
        unnest(range(1, len(kept) + 1)) AS i FROM kept_lists)""",
    "annotations": _annotations(),
    "outside": f"""SELECT doc_id, 1 AS src, {_TRANSFORMER} AS entity_type, {stripped('text')} AS value, "start" AS s,
        "end" AS e, {rounded('score', 4)} AS confidence, source FROM annotations
        WHERE source = 'transformer' AND {_TRANSFORMER} IS NOT NULL AND score >= 0.5e0
      UNION ALL SELECT doc_id, 2, {_NER}, {stripped('text')}, "start", "end", 0.78::DOUBLE, source FROM annotations
        WHERE source = 'spacy' AND {_NER} IS NOT NULL""",
    "everything": """SELECT doc_id, 0 AS src, ordinal AS o, entity_type, value, s, e, confidence, 'regex' AS source FROM kept
      UNION ALL SELECT doc_id, src, row_number() OVER (PARTITION BY doc_id, src ORDER BY s, e, entity_type) AS o,
        entity_type, value, s, e, confidence, source FROM outside""",
    "group_lists": f"""SELECT doc_id, list_reduce(list_transform(c, lambda x: [[x]]), lambda acc, x:
        CASE WHEN coalesce(list_position(list_transform(acc, lambda g: len(list_filter(g, lambda m:
            {_iou('m', 'x[1][1]')} >= 0.5e0)) > 0), true), 0) = 0 THEN list_concat(acc, x)
        ELSE list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda h: len(
            list_filter(h, lambda m: {_iou('m', 'x[1][1]')} >= 0.5e0)) > 0), true)
          THEN list_concat(g, x[1]) ELSE g END) END) AS groups
      FROM (SELECT doc_id, list({_SPAN} ORDER BY s, src, o) AS c FROM everything GROUP BY doc_id)""",
    "members": """SELECT doc_id, ordinal, x, unnest(range(1, len(members) + 1)) AS place, unnest(members) AS m FROM (
        SELECT doc_id, unnest(groups) AS members, unnest(range(0, len(groups))) AS ordinal, NULL AS x FROM group_lists)""",
    "ranked": f"""SELECT doc_id, ordinal, m AS x, {_PRIORITY.replace('x.', 'm.')} AS priority,
        place, {_RELIABILITY.replace('x.', 'm.')} AS reliability FROM members""",
    "merged": """SELECT doc_id, ordinal, first(x.entity_type ORDER BY priority, place) AS entity_type,
        first(x.value ORDER BY priority, place) AS value, min(x.s) AS s, max(x.e) AS e,
        max(x.confidence) AS highest, count(DISTINCT x.source) AS detector_count,
        string_agg(DISTINCT x.source, '+' ORDER BY x.source) AS source,
        list_reduce(list(x.confidence * reliability ORDER BY priority, place), lambda a, b: a + b)
          / list_reduce(list(reliability ORDER BY priority, place), lambda a, b: a + b) AS weighted
      FROM ranked GROUP BY doc_id, ordinal""",
    "boosted": f"""SELECT *, {BOOST} AS boost, CASE WHEN detector_count > 1 THEN greatest(weighted, highest)
        ELSE highest END AS base FROM merged""",
    "fusing": "SELECT *, least(1e0, base * boost) AS raw_confidence FROM boosted",
    "fused": f"""SELECT doc_id, ordinal, entity_type, value, s, e, {rounded('raw_confidence', 4)} AS confidence, source,
        detector_count, boost FROM fusing""",
    "flags": f"SELECT doc_id, bool_or(entity_type IN {_types(fixed.CO_OCCURRENCE_TYPES)}) AS structured FROM fused "
             "GROUP BY doc_id",
    "around": f"""SELECT f.*, structured, lower({window('t', 's - 120', 'e + 120')}) AS win,
        {window('t', 's - 50', 's')} AS prefix, {window('t', 'e', 'e + 40')} AS following,
        {window('t', 's - 5', 's')} AS before FROM fused f JOIN flags USING (doc_id) JOIN clean USING (doc_id)""",
    "labels_found": f"SELECT *, lower({stripped(LABEL)}) AS raw_label FROM around",
    "labelled": f"""SELECT * EXCLUDE (label), CASE WHEN kind IS NOT NULL THEN label END AS label FROM (
        SELECT *, CASE WHEN length(raw_label) >= 2 THEN raw_label END AS label,
          CASE WHEN length(raw_label) < 2 THEN NULL
            WHEN len(list_filter({cases(fixed.POSITIVE_KEYWORDS, 'entity_type', '[]::VARCHAR[]', strings)},
              lambda w: contains(raw_label, w))) > 0 THEN 'confirming'
            WHEN entity_type IN {_types(fixed.LABEL_SENSITIVE_TYPES)} THEN 'competing' END AS kind FROM labels_found)""",
    "signalled": rf"""SELECT *, {_hits(fixed.POSITIVE_KEYWORDS)} AS pos, {_hits(fixed.NEGATIVE_KEYWORDS)} AS neg,
        CASE WHEN entity_type IN {_types(fixed.LABEL_SENSITIVE_TYPES)} AND list_contains({strings(fixed.QUANTITY_WORDS)},
          regexp_replace(regexp_extract(lower(following), '^[{SPACES}]*([^{SPACES}]+)', 1), '[.,;:!?]+\z', ''))
          THEN regexp_replace(regexp_extract(lower(following), '^[{SPACES}]*([^{SPACES}]+)', 1), '[.,;:!?]+\z', '') END
          AS quantity, {ENTITY_NOTE} AS note FROM labelled""",
    "agreed": f"SELECT *, {AGREEMENT} AS agreement FROM signalled",
    "factored": "SELECT *, " + ", ".join(f"{f} AS f{i}" for i, f in enumerate(FACTORS)) + " FROM agreed",
    "scaled": f"SELECT *, {_scaled()} AS scaled, {NOTES} AS notes FROM factored",
    "validated": f"""SELECT * EXCLUDE (confidence), confidence AS confidence_before, {rounded('scaled', 4)} AS confidence,
        scaled >= CASE WHEN entity_type IN {_types(fixed.STRUCTURED_TYPES)} AND contains(source, 'regex') THEN 0.25::DOUBLE
          ELSE 0.30::DOUBLE END AS context_valid FROM scaled""",
    "accepted": "SELECT * FROM validated WHERE context_valid",
    "rejected": "SELECT * FROM validated WHERE NOT context_valid",
    "type_counts": "SELECT doc_id, entity_type, count(*) AS type_count FROM accepted GROUP BY doc_id, entity_type",
    "pairs": PAIRS,
    "pair_hits": """SELECT x.doc_id, p.pair, p.a, p.b, p.boost FROM pairs p JOIN type_counts x ON x.entity_type = p.a
        JOIN type_counts y ON y.entity_type = p.b AND y.doc_id = x.doc_id""",
    "boosts": """SELECT doc_id, entity_type, list_reduce(list(boost ORDER BY pair), lambda a, b: a + b) AS pair_boost FROM (
        SELECT doc_id, a AS entity_type, pair, boost FROM pair_hits UNION ALL
        SELECT doc_id, b, pair, boost FROM pair_hits) GROUP BY doc_id, entity_type""",
    "recalibrating": """SELECT a.*, coalesce(pair_boost, 0e0) AS pair_boost, type_count,
        least(1e0, least(1e0, a.confidence + coalesce(pair_boost, 0e0)) * CASE WHEN type_count > 3 THEN 1.05::DOUBLE
          ELSE 1e0 END) AS raised
      FROM accepted a JOIN type_counts USING (doc_id, entity_type) LEFT JOIN boosts USING (doc_id, entity_type)""",
    "recalibrated": f"""SELECT * EXCLUDE (confidence), {rounded('raised', 4)} AS confidence FROM recalibrating""",
    "weighed": f"SELECT *, {WEIGHT_OF} AS weight FROM recalibrated",
    "scored": "SELECT *, weight * confidence AS raw_score FROM weighed",
    "classified": f"""SELECT *, {rounded('raw_score', 2)} AS effective_score, {bands('raw_score', fixed.SENSITIVITY_FLOORS)}
        AS sensitivity_level FROM scored""",
    "planned": f"""SELECT *, CASE sensitivity_level WHEN 'LOW' THEN 'MASK' WHEN 'MEDIUM' THEN 'TOKENIZE' ELSE 'REDACT' END
        AS strategy FROM classified""",
    "sums": """SELECT doc_id, list_reduce(list(weight * confidence ORDER BY ordinal), lambda a, b: a + b) AS total,
        count(*) AS n, list_sort(list(DISTINCT entity_type)) AS types,
        list_sort(list(DISTINCT entity_type) FILTER (sensitivity_level IN ('CRITICAL', 'HIGH'))) AS serious
      FROM planned GROUP BY doc_id""",
    "doc_scores": """SELECT doc_id, coalesce(n, 0) AS n, total, coalesce(types, []::VARCHAR[]) AS types,
        coalesce(serious, []::VARCHAR[]) AS serious,
        CASE WHEN n > 0 THEN total / (n * 100)::DOUBLE * 100e0 ELSE 0e0 END AS score
      FROM docs LEFT JOIN sums USING (doc_id)""",
    "doc_risk": f"""SELECT *, {bands('score', fixed.RISK_FLOORS)} AS risk_level, {rounded('score', 2)} AS risk_score,
        {rounded('total', 2)} AS absolute_risk_score FROM doc_scores""",
    "rules": RULES,
    "fired": "SELECT d.doc_id, r.* FROM doc_risk d JOIN rules r ON len(list_filter(r.combo, lambda t: "
             "NOT list_contains(d.types, t))) = 0",
    "fired_kept": """SELECT * FROM fired f WHERE NOT EXISTS (SELECT 1 FROM fired g WHERE g.doc_id = f.doc_id
        AND len(g.combo) > len(f.combo) AND len(list_filter(f.combo, lambda t: NOT list_contains(g.combo, t))) = 0)""",
    "linked": f"""SELECT d.doc_id, coalesce(k.score, 0e0) AS correlation, coalesce(k.n, 0) AS combinations,
        {bands('coalesce(k.score, 0e0)', fixed.REID_FLOORS)} AS reid_level
      FROM docs d LEFT JOIN (SELECT doc_id, sum(score) AS score, count(*) AS n FROM fired_kept GROUP BY doc_id) k
        USING (doc_id)""",
    "adjusting": "SELECT *, least(100e0, risk_score + correlation) AS raw_final FROM doc_risk JOIN linked USING (doc_id)",
    "adjusted": f"""SELECT *, {rounded('raw_final', 2)} AS final_score, {bands('raw_final', fixed.RISK_FLOORS)} AS final_level
      FROM adjusting""",
    "replaced": f"""SELECT p.*, CASE strategy WHEN 'REDACT' THEN {REDACT} WHEN 'MASK' THEN {MASK}
        ELSE first_value(entity_type) OVER (PARTITION BY doc_id, value, strategy ORDER BY ordinal) || '_TOKEN_'
          || {sha('value', 8)} END AS replacement FROM planned p""",
    "spliced": """SELECT doc_id, CASE WHEN c IS NULL THEN t ELSE list_reduce(list_transform(c, lambda x: {'t': x.r, 's': x.s,
        'e': x.e}), lambda acc, x: {'t': left(acc.t, x.s) || x.t || substring(acc.t, x.e + 1), 's': 0::BIGINT, 'e': 0::BIGINT},
        {'t': t, 's': 0::BIGINT, 'e': 0::BIGINT}).t END AS anonymized_text
      FROM clean LEFT JOIN (SELECT doc_id, list({'r': replacement, 's': s, 'e': e} ORDER BY s DESC, ordinal) AS c
        FROM replaced GROUP BY doc_id) USING (doc_id)""",
    "scores": f"""SELECT {TEXTS['kyc'][1]} AS doc_id, 'PHONE' AS entity_type, length({TEXTS['kyc'][2]}) - 10 AS s,
        length({TEXTS['kyc'][2]}) AS e, {SCORE} AS pii_score FROM customer""",
    "rescoring": """SELECT r.*, pii_score, CASE WHEN pii_score < 0.35e0 THEN r.confidence * 0.15e0
        WHEN pii_score < 0.5e0 THEN r.confidence * 0.4e0
        WHEN pii_score >= 0.7e0 THEN least(1e0, r.confidence * (1e0 + (pii_score - 0.7e0) * 0.3e0)) END AS moved
      FROM recalibrated r LEFT JOIN scores USING (doc_id, entity_type, s, e)""",
    "rescored": f"""SELECT * EXCLUDE (confidence), CASE WHEN moved IS NULL THEN confidence ELSE {rounded('moved', 4)} END
        AS confidence FROM rescoring""",
    "report": """SELECT doc_id, entity_type, value, replacement AS anonymized_value, strategy, confidence, sensitivity_level,
        weight, effective_score, source, notes, 0 AS late, ordinal FROM replaced
      UNION ALL SELECT doc_id, entity_type, value, 'REJECTED/IGNORED', 'None', confidence, 'IGNORED', 0e0, 0e0, source,
        notes, 1, ordinal FROM rejected""",
    "entities": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY late, ordinal) - 1 AS place FROM report""",
}


def chained(select: str, docs: str = CHAIN["docs"], more: str = "", bare: bool = False) -> str:
    """``select`` on top of the chain over ``docs`` and of ``more`` expressions; stages it does not reach are not run.

    ``bare`` leaves the findings of outside models away.
    """
    reached, todo = set(), [select, more]
    chain = CHAIN | {"docs": docs} | ({"annotations": f"SELECT * FROM ({CHAIN['annotations']}) WHERE false"} if bare else {})
    names = list(chain)
    while todo:
        body = todo.pop()
        for name in names:
            if name not in reached and _mentions(body, name):
                reached.add(name)
                todo.append(chain[name])
    parts = [f"{name} AS MATERIALIZED ({chain[name]})" for name in names if name in reached]
    return "WITH " + ",\n".join([*parts, *([more] if more else [])]) + "\n" + select


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql) is not None
