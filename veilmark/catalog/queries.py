"""Registered queries: one or more per operator, each with its check in SQL.

``QUERIES[name](spark, sf_dir)`` gives the result; ``ORACLES[name]`` is the SQL
for the same rows, absent where SQL cannot say it. Arrays come out joined by
``|`` so that every column is a plain value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import anonymize, clean, context, crypto, detect, fuse, quasi, risk, verify
from ..functions import confidence as conf
from ..functions import fixed_values as fixed
from ..functions.text import exploded, let, saved_column, text_blocks, with_once
from ..operators import metrics, spans, tables, vault
from ..operators.lineage import checkpointed, shared_folder
from ..plans import analyze
from ..sources import annotations as ann
from ..sources import audit, files, parts
from ..streaming import stream
from ..streaming.daily import DailyTotals
from ..streaming.vault import StreamVault
from . import inputs, oracle
from .oracle import chained

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(spark, sf_dir)
            wide = [C(f.name).cast("bigint").alias(f.name) if f.dataType.typeName() == "integer" else C(f.name)
                    for f in result.schema.fields]
            return result.select(*wide)

        QUERIES[name] = plain
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def joined(column: Column | str) -> Column:
    return F.array_join(C(column) if isinstance(column, str) else column, "|")


def in_sql(column: str) -> str:
    return f"array_to_string({column}, '|')"


# --- sources and assembly -----------------------------------------------------

def _folder(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads back, in the cluster's shared place."""
    return f"{shared_folder(spark)}/veilmark-{uuid.uuid4().hex}"


_FIN = oracle.TEXTS["fin"]


@query("s1_read_text_docs", f"SELECT {_FIN[1]} AS doc_id, {_FIN[2]} AS text FROM supplier")
def s1(spark, sf):
    contents = inputs.texts(spark, sf, "fin").select(F.concat(F.lit("store/"), "doc_id", F.lit(".txt")).alias("path"), C("text").cast("binary").alias("content"))
    docs = files.text_docs(contents)
    return docs.select(F.regexp_replace("document_name", "[.]txt$", "").alias("doc_id"), clean.strip_text(C("text")).alias("text"))


_NOTES = ("CASE c_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a, \"quoted\" b' WHEN 2 THEN concat('two', chr(10), chr(10), '\"lines\", ', c_name) "
          "ELSE c_mktsegment END")


@query("s2_read_csv_rows", f"SELECT cast(c_custkey AS VARCHAR) AS c_custkey, c_name, {_NOTES} AS note FROM customer")
def s2(spark, sf):
    folder = _folder(spark) + "/csv"
    inputs.table(spark, sf, "customer").selectExpr("c_custkey", "c_name", f"{_NOTES} AS note").write.option("header", True).option(
        "escape", '"').csv(folder)
    return files.read_csv_rows(spark, folder)


_S3 = ("'c_custkey: ' || cast(c_custkey AS VARCHAR) || ' | c_name: ' || c_name || ' | c_nationkey: ' || "
       "cast(c_nationkey AS VARCHAR)")


@query("s3_rows_to_text", f"SELECT c_custkey, {_S3} || CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE ' | c_mktsegment: ' "
       "|| c_mktsegment END AS text FROM customer")
def s3(spark, sf):
    rows = inputs.table(spark, sf, "customer").selectExpr(
        "c_custkey", "c_name", "c_nationkey", "CASE WHEN c_nationkey % 2 = 0 THEN '  ' ELSE c_mktsegment END AS c_mktsegment")
    return rows.select("c_custkey", parts.rows_to_text(rows).alias("text"))


@query("s4_assemble_document", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations "
       "GROUP BY conv_id")
def s4(spark, sf):
    turns = inputs.table(spark, sf, "conversations").select(
        C("conv_id").alias("doc_id"), C("turn").alias("ordinal"), "text")
    return parts.assemble_document(turns).select(C("doc_id").alias("conv_id"), "text")


@query("s5_table_row_text", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE c_name || ' | ' || "
       "c_mktsegment END AS text FROM customer")
def s5(spark, sf):
    cells = F.array(C("c_name"), F.when(C("c_nationkey") % 2 == 0, F.lit(" ")).otherwise(C("c_mktsegment")), F.lit("\t"))
    return inputs.table(spark, sf, "customer").select("c_custkey", parts.table_row_text(cells).alias("text"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))


_LINES = ("SELECT doc_id, i - 1 AS ordinal, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
          "unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")


@query("s6_drop_blank_paragraphs", f"SELECT * FROM ({_LINES}) WHERE regexp_matches(text, '[^{oracle.SPACES}]')")
def s6(spark, sf):
    return parts.drop_blank_paragraphs(_lines(spark, sf))


@query("s7_document_stats", "SELECT conv_id AS doc_id, count(*) AS part_count, cast(sum(length(text)) AS BIGINT) AS "
       "char_count, max(length(text)) AS longest_part FROM conversations GROUP BY conv_id")
def s7(spark, sf):
    turns = inputs.table(spark, sf, "conversations")
    return parts.document_stats(turns.withColumnRenamed("conv_id", "doc_id"))


@query("s7_text_lengths", chained("SELECT doc_id, length(text) AS input_length, length(t) AS cleaned_length FROM clean"))
def s7_lengths(spark, sf):
    return inputs.cleaned(spark, sf).select(
        "doc_id", F.length("text").alias("input_length"), F.length("clean_text").alias("cleaned_length"))


_PATH = ("concat('in/file ', cast(doc_id AS string), CASE doc_id % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' "
         "WHEN 2 THEN '.tar.csv' WHEN 3 THEN '.Xlsx' WHEN 4 THEN '.txt' WHEN 5 THEN '.xls' WHEN 6 THEN '.exe' "
         "WHEN 7 THEN '' ELSE '.' END)")
_TYPE = r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))"


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").selectExpr(f"{_PATH} AS path", "n_chars * 4096 AS length")


for _name, _bytes, _allowed in (("s8_route_by_type", False, fixed.FILE_TYPES),
                                ("s8_route_by_type_bytes", True, fixed.FILE_TYPES + fixed.BYTES_ONLY_TYPES)):
    @query(_name, f"SELECT path, {_TYPE} AS document_type, CASE WHEN {_TYPE} NOT IN ({str(_allowed)[1:-1]}) THEN "
           f"'unsupported type' END AS refusal FROM (SELECT {_PATH} AS path FROM documents)")
    def s8(spark, sf, as_bytes=_bytes):
        return files.route_by_type(_listing(spark, sf), as_bytes).select("path", "document_type", "refusal")


@query("s9_reject_blank_docs", f"SELECT count(*) AS docs, cast(sum(length(text)) AS BIGINT) AS chars FROM ({_LINES}) "
       f"WHERE regexp_matches(text, '[^{oracle.SPACES}]')")
def s9(spark, sf):
    return files.reject_blank_docs(_lines(spark, sf)).agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


_OUTSIDE = 'SELECT doc_id, entity_type, value, s AS "start", e AS "end", confidence, source FROM outside'


@query("s10_read_annotations", chained(_OUTSIDE))
def s10(spark, sf):
    return ann.read_annotations(inputs.annotations(spark, sf))


@query("s12_size_gate", f"SELECT path, CASE WHEN {_TYPE} NOT IN ({str(fixed.FILE_TYPES)[1:-1]}) THEN 'unsupported type' "
       f"WHEN length > 10485760 THEN 'file too large' END AS refusal FROM (SELECT {_PATH} AS path, n_chars * 4096 AS length "
       "FROM documents)")
def s12(spark, sf):
    return files.size_gate(files.route_by_type(_listing(spark, sf))).select("path", "refusal")


# --- cleaning --------------------------------------------------------------------

_WIDE = "".join(chr(0xFF10 + d) for d in range(10))
# Damage to repair: letters between digits, odd spaces, blank lines, control characters.
_DIRTY = ("regexp_replace(regexp_replace(text, '([0-9])([0-9])([0-9])', '$1O$2l$3I0'), '([a-z]) ([a-z])', "
          "concat('$1 ', chr(9), chr(160), ' $2', chr(7), chr(10), chr(10), chr(10), chr(10)))")
_DIRTY_SQL = (r"regexp_replace(regexp_replace(text, '([0-9])([0-9])([0-9])', '\1O\2l\3I0', 'g'), '([a-z]) ([a-z])', "
              r"'\1 ' || chr(9) || chr(160) || ' \2' || chr(7) || chr(10) || chr(10) || chr(10) || chr(10), 'g')")


def _cleaning(name: str, apply: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    @query(name, f"SELECT doc_id, {sql('d')} AS text FROM (SELECT doc_id, {_DIRTY_SQL} AS d FROM documents)")
    def run(spark, sf):
        return inputs.table(spark, sf, "documents").select("doc_id", apply(F.expr(_DIRTY)).alias("text"))


@query("c1_nfkc", "SELECT doc_id, text FROM documents")
def c1(spark, sf):
    return inputs.table(spark, sf, "documents").select(
        "doc_id", clean.nfkc(F.translate("text", "0123456789", _WIDE)).alias("text"))


_cleaning("c2_fix_ocr", clean.fix_ocr, oracle.fixed_ocr)
_cleaning("c3_normalize_ws", clean.normalize_ws, oracle.spaced)
_cleaning("c4_collapse_ws", clean.collapse_ws, lambda e: f"regexp_replace({e}, '[{oracle.SPACES}]+', ' ', 'g')")
_cleaning("c5_strip_control", clean.strip_control, oracle.uncontrolled)
_cleaning("c6_strip", clean.strip_text, lambda e: f"coalesce({oracle.stripped(e)}, '')")
_cleaning("c7_clean_text", clean.clean_text, oracle.cleaned)


@query("c7_clean_corpus", chained("SELECT doc_id, t AS text FROM clean"))
def c7(spark, sf):
    return inputs.cleaned(spark, sf).select("doc_id", C("clean_text").alias("text"))


@query("c8_split_sentences", f"""SELECT doc_id, {in_sql('sentences')} AS sentences, len(sentences) AS n FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[{oracle.SPACES}]+', '\\1' || chr(30), 'g'),
      chr(30)), lambda x: {oracle.stripped('x')}), lambda x: x <> '') AS sentences FROM documents)""")
def c8(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", clean.split_sentences(C("text")).alias("found"))
    return docs.select("doc_id", joined("found").alias("sentences"), F.size("found").alias("n"))


@query("c9_char_window", f"SELECT doc_id, {oracle.window('text', 'n_chars // 2 - 50', 'n_chars // 2 + 50')} AS around, "
       f"{oracle.window('text', '-30', '70')} AS opening FROM documents")
def c9(spark, sf):
    middle = F.floor(C("n_chars") / 2).cast("int")
    return inputs.table(spark, sf, "documents").select(
        "doc_id", clean.char_window(C("text"), middle).alias("around"),
        clean.char_window(C("text"), F.lit(20)).alias("opening"))


# --- detection ---------------------------------------------------------------------

@saved_column
def _of_type(name: str) -> Column:
    return detect.candidates(C("clean_text"), [name])


def _detector(number: int, name: str) -> None:
    @query(f"d{number}_{name.lower()}", chained(
        f"SELECT doc_id, value, s AS \"start\", e AS \"end\", confidence FROM cand WHERE entity_type = '{name}'"))
    def run(spark, sf):
        found = exploded(inputs.cleaned(spark, sf), _of_type(name), "doc_id", element="d")
        return found.select("doc_id", "d.value", "d.start", "d.end", "d.confidence")


for _n, (_type_name, _) in enumerate(fixed.PATTERNS, start=1):
    _detector(_n, _type_name)


@query("d19_suppress_overlaps", chained(
    "SELECT doc_id, ordinal, entity_type, value, s AS \"start\", e AS \"end\", confidence FROM kept"))
def d19(spark, sf):
    found = exploded(analyze.with_regex_spans(inputs.cleaned(spark, sf)), "regex_spans", "doc_id")
    return found.select("doc_id", "ordinal", "d.entity_type", "d.value", "d.start", "d.end", "d.confidence")


@query("d20_normalize_transformer", chained(_OUTSIDE + " WHERE source = 'transformer'"))
def d20(spark, sf):
    return ann.normalize_transformer(inputs.annotations(spark, sf).filter(C("source") == "transformer"))


@query("d21_normalize_ner", chained(_OUTSIDE + " WHERE source = 'spacy'"))
def d21(spark, sf):
    return ann.normalize_ner(inputs.annotations(spark, sf).filter(C("source") == "spacy"))


_CHUNKS = f"""WITH RECURSIVE parts AS (SELECT doc_id, text, regexp_extract_all(text, '[^{oracle.SPACES}]+') AS words,
      regexp_split_to_array(text, '[^{oracle.SPACES}]+') AS gaps FROM documents WHERE length(text) > {fixed.CHUNK_CHARS}),
    placed AS (SELECT doc_id, k, words[k + 1] AS word, length(words[k + 1]) AS n,
      sum(length(words[k + 1]) + 1) OVER before AS pre, sum(length(gaps[k + 1]) + length(words[k + 1])) OVER before AS ends
      FROM parts, unnest(range(len(words))) AS t(k) WINDOW before AS (PARTITION BY doc_id ORDER BY k)),
    listed AS (SELECT doc_id, count(*) AS m, list(word ORDER BY k) AS words, list(n ORDER BY k) AS n, list(pre ORDER BY k) AS pre,
      list(ends ORDER BY k) AS ends FROM placed GROUP BY doc_id),
    cut AS (SELECT doc_id, 0::BIGINT AS ordinal, 0::BIGINT AS a, coalesce(list_filter(range(m),
        lambda k: pre[k + 1] - 1 > {fixed.CHUNK_CHARS})[1], m) AS b, m FROM listed
      UNION ALL SELECT doc_id, ordinal + 1, greatest(a, b - {fixed.CHUNK_OVERLAP_WORDS}), coalesce(list_filter(range(b + 1, l.m),
        lambda k: pre[k + 1] - 1 - coalesce(pre[greatest(a, b - {fixed.CHUNK_OVERLAP_WORDS})], 0) > {fixed.CHUNK_CHARS})[1], l.m), l.m
      FROM cut JOIN listed l USING (doc_id) WHERE b < cut.m)
    SELECT doc_id, ordinal, CASE WHEN a = b THEN 0 ELSE ends[a + 1] - n[a + 1] END::BIGINT AS "start",
      array_to_string(words[a + 1:b], ' ') AS chunk FROM cut JOIN listed USING (doc_id)
    UNION ALL SELECT doc_id, 0, 0, text FROM documents WHERE length(text) <= {fixed.CHUNK_CHARS}"""


@query("d22_chunk_text", _CHUNKS)
def d22(spark, sf):
    docs = analyze.spread(inputs.table(spark, sf, "documents").select("doc_id", "text"))
    cut = docs.select("doc_id", ann.chunk_text(C("text")).alias("chunks"))
    return exploded(cut, "chunks", "doc_id", element="c").select(
        "doc_id", "ordinal", "c.start", "c.chunk")


# --- fusion --------------------------------------------------------------------------

def _from(source: str) -> Callable[[Column], Column]:
    return lambda d: d["source"] == source


@saved_column
def _united() -> Column:
    by_source = [F.filter("annotations", _from(name)) for name in ("transformer", "spacy")]
    return fuse.union_detections(C("regex_spans"), *by_source)


@saved_column
def _grouped() -> Column:
    return fuse.group_overlaps(C("united"))


def _all_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = ann.attach_annotations(inputs.corpus(spark, sf), ann.read_annotations(inputs.annotations(spark, sf)))
    return with_once(analyze.with_regex_spans(analyze.with_clean_text(docs)), "united", _united())


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return _all_spans(spark, sf).select("doc_id", F.posexplode(_grouped()).alias("ordinal", "members"))


@query("f1_union_detections", chained("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, src, o) - 1 AS
    ordinal, entity_type, value, s AS "start", e AS "end", confidence, source FROM everything"""))
def f1(spark, sf):
    return spans.explode_spans(_all_spans(spark, sf), "united")


@query("f2_iou", chained(f"""SELECT a.doc_id, a.ordinal AS ordinal_a, b.ordinal AS ordinal_b, a.entity_type AS type_a,
    b.entity_type AS type_b, {oracle._iou('a', 'b')} AS iou
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, src, o) - 1 AS ordinal FROM everything) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, src, o) - 1 AS ordinal FROM everything) b
    ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal AND a.s < b.e AND b.s < a.e"""))
def f2(spark, sf):
    return spans.overlap_pairs(_all_spans(spark, sf), "united")


@query("f3_group_overlaps", chained("""SELECT doc_id, ordinal, place - 1 AS place, m.entity_type AS entity_type, m.s AS "start",
    m.e AS "end", m.source AS source FROM members"""))
def f3(spark, sf):
    members = _groups(spark, sf).select("doc_id", "ordinal", F.posexplode("members").alias("place", "m"))
    return members.select("doc_id", "ordinal", "place", "m.entity_type", "m.start", "m.end", "m.source")


@query("f4_weighted_confidence", chained("SELECT doc_id, ordinal, round(weighted, 9) AS weighted FROM merged"))
def f4(spark, sf):
    return _groups(spark, sf).select(
        "doc_id", "ordinal", F.round(fuse.weighted_confidence(C("members")), 9).alias("weighted"))


@query("f5_boost_factor", chained("SELECT doc_id, ordinal, entity_type, detector_count, boost FROM fused"))
def f5(spark, sf):
    return _fused_rows(spark, sf).select(
        "doc_id", "ordinal", "entity_type", "detector_count",
        fuse.boost_factor(C("entity_type"), C("detector_count")).alias("boost"))


_FUSED = 'SELECT doc_id, ordinal, entity_type, value, s AS "start", e AS "end", confidence, source, detector_count FROM fused'


@saved_column
def _merged() -> Column:
    return fuse.merge_group(C("members"))


@query("f6_merge_group", chained(_FUSED))
def f6(spark, sf):
    return _groups(spark, sf).select("doc_id", "ordinal", _merged().alias("m")).select(
        "doc_id", "ordinal", "m.*").drop("boost_factor")


def _fused_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploded(inputs.detected(spark, sf), C("detected")["fused"], "doc_id", element="d")
    return rows.select("doc_id", "ordinal", "d.*")


@query("f7_fuse", chained(_FUSED))
def f7(spark, sf):
    return _fused_rows(spark, sf).drop("boost_factor")


# --- context validation ------------------------------------------------------------------

def _around(spark: SparkSession, sf: str) -> DataFrame:
    return spans.with_surroundings(inputs.detected(spark, sf))


_ID = ["doc_id", "ordinal", "entity_type"]
_ID_SQL = "SELECT doc_id, ordinal, entity_type"


@query("v1_doc_flags", chained("""SELECT doc_id, coalesce(structured, false) AS structured, coalesce(sources, '') AS sources
    FROM docs LEFT JOIN (SELECT doc_id, bool_or(structured) AS structured, array_to_string(list_sort(list(DISTINCT part)), '|')
    AS sources FROM (SELECT doc_id, structured, unnest(string_split(source, '+')) AS part FROM fused JOIN flags USING (doc_id))
    GROUP BY doc_id) USING (doc_id)"""))
def v1(spark, sf):
    fused = C("detected")["fused"]
    return inputs.detected(spark, sf).select(
        "doc_id", context.has_structured(fused).alias("structured"), joined(context.active_sources(fused)).alias("sources"))


@query("v2_context_window", chained(_ID_SQL + ", win AS context_window, left(win, 120) AS shown FROM around"))
def v2(spark, sf):
    return _around(spark, sf).select(*_ID, C("window").alias("context_window"), F.left("window", F.lit(120)).alias("shown"))


@query("v3_preceding_label", chained(_ID_SQL + ", kind, label FROM labelled"))
def v3(spark, sf):
    return _around(spark, sf).select(*_ID, context.preceding_label(C("entity_type"), C("prefix")).alias("l")).select(
        *_ID, "l.kind", "l.label")


@query("v4_label_adjust", chained(_ID_SQL + ", round(least(1e0, confidence * f0), 9) AS adjusted FROM factored"))
def v4(spark, sf):
    kind = context.preceding_label(C("entity_type"), C("prefix"))["kind"]
    return _around(spark, sf).select(
        *_ID, F.round(context.scaled(C("confidence"), context.label_factor(kind)), 9).alias("adjusted"))


def _with_label(spark: SparkSession, sf: str) -> DataFrame:
    return _around(spark, sf).withColumn("kind", context.preceding_label(C("entity_type"), C("prefix"))["kind"])


@query("v5_positive_context", chained(_ID_SQL + f", {in_sql('pos')} AS hits, f1 AS factor FROM factored"))
def v5(spark, sf):
    hits = context.positive_hits(C("entity_type"), C("window"))
    return _with_label(spark, sf).select(*_ID, joined(hits).alias("hits"),
                                         context.positive_factor(C("kind"), hits).alias("factor"))


@query("v6_negative_context", chained(_ID_SQL + f", {in_sql('neg')} AS hits, f2 AS factor FROM factored"))
def v6(spark, sf):
    hits = context.negative_hits(C("entity_type"), C("window"))
    return _with_label(spark, sf).select(*_ID, joined(hits).alias("hits"),
                                         context.negative_factor(C("kind"), hits).alias("factor"))


@query("v7_quantity_follows", chained(_ID_SQL + ", quantity, f3 AS factor FROM factored"))
def v7(spark, sf):
    word = context.quantity_word(C("entity_type"), C("following"))
    return _around(spark, sf).select(*_ID, word.alias("quantity"), context.quantity_factor(word).alias("factor"))


def _entity_rule(key: str, entity_type: str) -> None:
    @query(key, chained("SELECT doc_id, ordinal, value, note, round(f4 * f5, 9) AS factor FROM factored "
                        f"WHERE entity_type = '{entity_type}'"))
    def run(spark, sf):
        note = context.entity_note(C("entity_type"), C("value"), C("window"), C("before"), C("start"))
        factor = context.entity_factor(C("entity_type"), note, C("window")) * context.abbreviation_factor(
            C("entity_type"), C("value"))
        rows = _around(spark, sf).filter(C("entity_type") == entity_type)
        return rows.select("doc_id", "ordinal", "value", note.alias("note"), F.round(factor, 9).alias("factor"))


for _key, _rule_type in (
        ("v8_rule_name", "NAME"), ("v9_rule_pan", "PAN"), ("v10_rule_phone", "PHONE"),
        ("v11_rule_bank_account", "BANK_ACCOUNT"), ("v12_rule_date_of_birth", "DATE_OF_BIRTH"),
        ("v13_rule_ip_address", "IP_ADDRESS"), ("v14_rule_password", "PASSWORD"), ("v15_rule_pincode", "PINCODE")):
    _entity_rule(_key, _rule_type)


@query("v16_structured_cooccurrence", chained(_ID_SQL + ", structured, f6 AS factor FROM factored"))
def v16(spark, sf):
    return _around(spark, sf).select(
        *_ID, "structured", context.co_occurrence_factor(C("entity_type"), C("structured")).alias("factor"))


@query("v17_detector_agreement", chained(_ID_SQL + ", source, agreement, f7 AS factor FROM factored"))
def v17(spark, sf):
    note = context.agreement_note(C("entity_type"), C("source"), context.positive_hits(C("entity_type"), C("window")))
    return _around(spark, sf).select(*_ID, "source", note.alias("agreement"), context.agreement_factor(note).alias("factor"))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return context.with_validated(inputs.detected(spark, sf), C("detected")["fused"], C("clean_text"), "v")


def _validated_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploded(_validated(spark, sf), "v", "doc_id", element="d")
    return rows.select("doc_id", "ordinal", "d.*")


@query("v18_threshold_gate", chained(_ID_SQL + ", source, context_valid FROM validated"))
def v18(spark, sf):
    def table_form(rows: DataFrame) -> DataFrame:
        found = context.signals(C("entity_type"), C("value"), C("start"), C("source"), C("window"), C("prefix"),
                                C("following"), C("before"))
        span = F.struct("entity_type", "value", "source", "confidence")
        signalled = rows.withColumn("s", found).withColumn("span", span)
        scored = signalled.withColumn("scaled", context.confidence_of(C("span"), C("window"), C("s"), C("structured")))
        return scored.select(*_ID, "source",
                             context.accepts(C("entity_type"), C("source"), C("scaled")).alias("context_valid"))

    return table_form(_around(spark, sf))


@query("v19_context_notes", chained(_ID_SQL + f", {in_sql('notes')} AS notes FROM validated"))
def v19(spark, sf):
    return _validated_rows(spark, sf).select(*_ID, joined("context_notes").alias("notes"))


@query("v20_split_accepted_rejected", chained("""SELECT doc_id, coalesce(a, 0) AS accepted, coalesce(r, 0) AS rejected
    FROM docs LEFT JOIN (SELECT doc_id, count(*) FILTER (context_valid) AS a, count(*) FILTER (NOT context_valid) AS r
      FROM validated GROUP BY doc_id) USING (doc_id)"""))
def v20(spark, sf):
    return _validated(spark, sf).select("doc_id", F.size(context.accepted(C("v"))).alias("accepted"),
                                        F.size(context.rejected(C("v"))).alias("rejected"))


@query("v21_validate_context", chained(_ID_SQL + f""", value, s AS "start", e AS "end", confidence, context_valid,
    {in_sql('notes')} AS notes, left(win, 120) AS context_window FROM validated"""))
def v21(spark, sf):
    return _validated_rows(spark, sf).select(*_ID, "value", "start", "end", "confidence", "context_valid",
                                             joined("context_notes").alias("notes"), "context_window")


# --- recalibration and verifier --------------------------------------------------------------

def _accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _validated_rows(spark, sf).filter("context_valid")


def _recalibrated_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploded(inputs.judged(spark, sf), C("judged")["accepted"], "doc_id", element="d")
    return rows.select("doc_id", "ordinal", "d.*")


@query("k1_cooccurrence_boost", chained("SELECT doc_id, entity_type, pair_boost FROM boosts"))
def k1(spark, sf):
    return tables.cooccurrence_boosts(_accepted_rows(spark, sf)).withColumnRenamed("boost", "pair_boost")


@query("k2_frequency_boost", chained("SELECT doc_id, entity_type, type_count, CASE WHEN type_count > 3 THEN 1.05::DOUBLE "
                                     "ELSE 1e0 END AS factor FROM type_counts"))
def k2(spark, sf):
    counts = tables.doc_types(_accepted_rows(spark, sf))
    return counts.withColumn("factor", conf.frequency_factor(C("type_count")))


_RECALIBRATED = 'SELECT doc_id, entity_type, s AS "start", e AS "end", value, confidence FROM recalibrated'


@query("k3_recalibrate", chained(_RECALIBRATED))
def k3(spark, sf):
    return _recalibrated_rows(spark, sf).select("doc_id", "entity_type", "start", "end", "value", "confidence")


@query("k3_recalibrate_tables", chained(_RECALIBRATED))
def k3_tables(spark, sf):
    # The rows meet their own aggregates: stored once instead of detected three times.
    return tables.recalibrated_spans(checkpointed(_accepted_rows(spark, sf))).select(
        "doc_id", "entity_type", "start", "end", "value", "confidence")


_SENTENCE = oracle.stripped(
    rf"regexp_extract({oracle.window('t', 's - 300', 's')}, '[^.!?\n]*\z') || substring(t, s + 1, e - s) || "
    rf"regexp_extract({oracle.window('t', 'e', 'e + 300')}, '^[^.!?\n]*[.!?\n]?')")
_SENTENCES = f'SELECT doc_id, entity_type, s AS "start", e AS "end", confidence, {_SENTENCE} AS sentence FROM recalibrated JOIN clean USING (doc_id)'


@query("n1_sentence_of", chained(f'SELECT doc_id, entity_type, s AS "start", {_SENTENCE} AS sentence FROM fused JOIN clean USING (doc_id)'))
def n1(spark, sf):
    cut = let(text_blocks(C("clean_text")), lambda blocks: F.transform(C("detected")["fused"], lambda d: F.struct(
        d["entity_type"].alias("entity_type"), d["start"].alias("start"),
        verify.sentence_of(blocks, d["start"], d["end"]).alias("sentence"))))
    return exploded(inputs.detected(spark, sf), cut, "doc_id", element="c").select("doc_id", "c.*")


@query("n2_needs_verification", chained(
    f"""SELECT *, {oracle.cases(fixed.HYPOTHESES, 'entity_type', 'NULL', oracle.text)} AS hypothesis,
    {oracle.text(fixed.COUNTER_HYPOTHESIS)} AS counter_hypothesis FROM ({_SENTENCES}) WHERE confidence < 0.98::DOUBLE
    AND length(sentence) >= 5 AND entity_type IN {oracle._types(fixed.HYPOTHESES)}"""))
def n2(spark, sf):
    return spans.verification_requests(inputs.judged(spark, sf))


_RESCORED = 'SELECT doc_id, entity_type, s AS "start", e AS "end", confidence, pii_score FROM rescored'


@query("n3_apply_verifier_scores", chained(_RESCORED))
def n3(spark, sf):
    entities = _recalibrated_rows(spark, sf).select("doc_id", "entity_type", "start", "end", "confidence")
    return spans.apply_verifier_scores(entities, inputs.scores(spark, sf)).drop("verifier_note")


@query("n4_rethreshold", chained("""SELECT doc_id, entity_type, s AS "start", confidence, confidence >= 0.25::DOUBLE AS kept
    FROM rescored"""))
def n4(spark, sf):
    docs = ann.attach_scores(inputs.judged(spark, sf), inputs.scores(spark, sf))
    def listed(side: str) -> Column:
        return F.transform(C("r")[side], lambda d: F.struct(
            d["entity_type"].alias("entity_type"), d["start"].alias("start"), d["confidence"].alias("confidence"),
            d["context_valid"].alias("was_valid"), F.lit(side == "accepted").alias("kept")))

    both = F.concat(listed("accepted"), listed("rejected"))
    scored = with_once(docs.withColumnRenamed("judged", "unscored"), "r", analyze._rescored())
    moved = exploded(scored, both, "doc_id")
    return moved.select("doc_id", "d.*").filter("was_valid").drop("was_valid")


# --- risk ----------------------------------------------------------------------------------

def _classified_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = exploded(inputs.assessed(spark, sf), C("assessed")["spans"], "doc_id", element="d")
    return rows.select("doc_id", "ordinal", "d.*")


_SPAN_ID = 'SELECT doc_id, entity_type, s AS "start"'


@query("r1_risk_weight", chained(_SPAN_ID + ", round(weight, 9) AS weight FROM weighed"))
def r1(spark, sf):
    return _recalibrated_rows(spark, sf).select(
        "doc_id", "entity_type", "start", F.round(risk.risk_weight(C("entity_type")), 9).alias("weight"))


@query("r2_effective_score", chained(_SPAN_ID + ", effective_score FROM classified"))
def r2(spark, sf):
    return tables.classified_spans(_recalibrated_rows(spark, sf)).select(
        "doc_id", "entity_type", "start", "effective_score")


@query("r3_sensitivity_level", chained(_SPAN_ID + ", sensitivity_level FROM classified"))
def r3(spark, sf):
    return _classified_rows(spark, sf).select("doc_id", "entity_type", "start", "sensitivity_level")


@query("r4_policy", chained("SELECT sensitivity_level, strategy, count(*) AS entities FROM planned GROUP BY ALL"))
def r4(spark, sf):
    rows = _classified_rows(spark, sf)
    return rows.groupBy("sensitivity_level", risk.policy(C("sensitivity_level")).alias("strategy")).agg(
        F.count("*").alias("entities"))


@query("r5_document_risk", chained("""SELECT doc_id, n AS entity_count, round(total, 4) AS absolute_risk_score,
    round(score, 4) AS risk_score FROM doc_scores"""))
def r5(spark, sf):
    scored = tables.document_risk(inputs.corpus(spark, sf), _recalibrated_rows(spark, sf))
    return scored.select("doc_id", "entity_count", F.round("absolute_risk_score", 4).alias("absolute_risk_score"),
                         F.round("risk_score", 4).alias("risk_score"))


def _document_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.assessed(spark, sf).select("doc_id", "assessed.risk.*")


@query("r6_risk_level", chained("SELECT doc_id, risk_score, risk_level FROM doc_risk"))
def r6(spark, sf):
    return _document_rows(spark, sf).select("doc_id", "risk_score", "risk_level")


@query("r7_entity_breakdown", chained("SELECT doc_id, entity_type, type_count AS entities FROM type_counts"))
def r7(spark, sf):
    return _document_rows(spark, sf).select("doc_id", F.explode_outer("entity_breakdown").alias(
        "entity_type", "entities")).filter("entity_type IS NOT NULL")


@query("r8_high_risk_entities", chained(f"SELECT doc_id, {in_sql('serious')} AS types FROM doc_risk"))
def r8(spark, sf):
    return _document_rows(spark, sf).select("doc_id", joined("high_risk_entities").alias("types"))


_ADVICE = ", ".join(f"CASE WHEN list_contains(types, '{t}') THEN {oracle.text(line)} END"
                    for t, line in fixed.TYPE_ADVICE.items())
_LEVEL_ADVICE = oracle.cases(fixed.LEVEL_ADVICE, "risk_level", "NULL", oracle.text)


@query("r9_recommendations", chained(f"""SELECT doc_id, array_to_string(CASE WHEN n = 0 THEN
    [{oracle.text(fixed.NO_PII_ADVICE)}] ELSE list_filter([{_LEVEL_ADVICE}, {_ADVICE}], lambda x: x IS NOT NULL) END, '|')
    AS advice FROM doc_risk"""))
def r9(spark, sf):
    return _document_rows(spark, sf).select("doc_id", joined("recommendations").alias("advice"))


@query("r10_empty_documents", chained(f"""SELECT doc_id, risk_score, risk_level, n AS entity_count, absolute_risk_score,
    {oracle.text(fixed.NO_PII_ADVICE)} AS advice FROM doc_risk WHERE n = 0"""))
def r10(spark, sf):
    return _document_rows(spark, sf).filter("entity_count = 0").select(
        "doc_id", "risk_score", "risk_level", "entity_count", "absolute_risk_score",
        joined("recommendations").alias("advice"))


# --- combinations ------------------------------------------------------------------------------

@query("q1_match_rules", chained("SELECT doc_id, array_to_string(combo, '+') AS combination, risk_level, score FROM fired"))
def q1(spark, sf):
    types = F.map_keys(C("assessed")["risk"]["entity_breakdown"])
    fired = exploded(inputs.assessed(spark, sf), quasi.match_rules(types), "doc_id", element="r")
    return fired.select("doc_id", F.array_join("r.combination", "+").alias("combination"), "r.risk_level",
                        C("r.correlation_score").alias("score"))


@query("q1_match_rules_tables", chained("SELECT doc_id, rule, array_to_string(combo, '+') AS combination, score FROM fired"))
def q1_tables(spark, sf):
    return tables.matched_rules(_recalibrated_rows(spark, sf)).select(
        "doc_id", "rule", F.array_join("combination", "+").alias("combination"), "score")


@query("q2_superset_dedup", chained("SELECT doc_id, rule, array_to_string(combo, '+') AS combination FROM fired_kept"))
def q2(spark, sf):
    return tables.without_subsets(checkpointed(tables.matched_rules(_recalibrated_rows(spark, sf)))).select(
        "doc_id", "rule", F.array_join("combination", "+").alias("combination"))


def _linked_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.assessed(spark, sf).select("doc_id", "assessed.quasi.*")


_LINKED = "SELECT doc_id, correlation, combinations, reid_level FROM linked"


@query("q3_correlation_score", chained("SELECT doc_id, correlation, combinations FROM linked"))
def q3(spark, sf):
    return _linked_rows(spark, sf).select("doc_id", C("total_correlation_score").alias("correlation"),
                                          C("quasi_id_combinations_found").alias("combinations"))


@query("q4_reid_level", chained(_LINKED))
def q4(spark, sf):
    kept = tables.without_subsets(checkpointed(tables.matched_rules(_recalibrated_rows(spark, sf))))
    scores = tables.correlation_scores(kept).withColumnRenamed("correlation_score", "correlation")
    every = inputs.corpus(spark, sf).select("doc_id").join(scores, "doc_id", "left")
    return every.select("doc_id", F.coalesce("correlation", F.lit(0.0)).alias("correlation"), F.coalesce(
        "combinations", F.lit(0)).cast("long").alias("combinations"), F.coalesce("reid_level", F.lit("LOW")).alias("reid_level"))


_COMBO_LINES = """coalesce((SELECT list('  → ' || array_to_string(combo, ' + ') || ': ' || description ORDER BY rule)
    FROM fired_kept k WHERE k.doc_id = l.doc_id AND k.risk_level = 'CRITICAL'), []::VARCHAR[])[1:3]"""
_PAIR_LINES = ", ".join(f"CASE WHEN list_contains(types, '{a}') AND list_contains(types, '{b}') THEN {oracle.text(line)} END"
                        for (a, b), line in fixed.REID_PAIR_ADVICE)
_REID_LINE = oracle.cases(fixed.REID_ADVICE, "reid_level", "NULL", oracle.text)


@query("q5_reid_recommendations", chained(f"""SELECT l.doc_id, array_to_string(list_filter(list_concat([{_REID_LINE}],
    {_COMBO_LINES}, [{_PAIR_LINES}]), lambda x: x IS NOT NULL), '|') AS advice
    FROM linked l JOIN doc_risk d ON d.doc_id = l.doc_id"""))
def q5(spark, sf):
    return _linked_rows(spark, sf).select("doc_id", joined("recommendations").alias("advice"))


@query("q6_adjusted_risk", chained("SELECT doc_id, risk_score AS base, correlation, final_score, final_level FROM adjusted"))
def q6(spark, sf):
    final = inputs.assessed(spark, sf).select("doc_id", analyze._risk_analysis().alias("r"))
    return final.select("doc_id", C("r.base_risk_score").alias("base"), C("r.correlation_risk").alias("correlation"),
                        C("r.risk_score").alias("final_score"), C("r.risk_level").alias("final_level"))


# --- anonymization ----------------------------------------------------------------------------

def _value_query(name: str, apply: Callable[[], Column], sql: str, where: str = "true") -> None:
    """An anonymizer over the values of all fused spans."""
    @query(name, chained(f'SELECT doc_id, ordinal, entity_type, value, {sql} AS replacement FROM fused WHERE {where}'))
    def run(spark, sf):
        return _fused_rows(spark, sf).filter(where).select(*_ID, "value", apply().alias("replacement"))


_value_query("a1_mask_email", lambda: anonymize.mask_email(C("value")), oracle.MASK_EMAIL)
_value_query("a2_mask_phone", lambda: anonymize.mask_phone(C("value")), oracle.MASK_PHONE)
_value_query("a3_mask_name", lambda: anonymize.mask_name(C("value")), oracle.MASK_NAME)
_value_query("a4_mask_ip", lambda: anonymize.mask_ip(C("value")), oracle.MASK_IP)
_value_query("a5_mask_generic", lambda: anonymize.mask_generic(C("value")), oracle.MASK_GENERIC)
_value_query("a6_mask", lambda: anonymize.mask(C("value"), C("entity_type")), oracle.MASK)
_value_query("a10_redact", lambda: anonymize.redact(C("entity_type")), oracle.REDACT)
_value_query("a18_generalize_default", lambda: anonymize.generalize_default(C("value")), oracle.GENERALIZE_DEFAULT)
_value_query("a19_generalize", lambda: anonymize.generalize(C("value"), C("entity_type")), oracle.GENERALIZE)
_value_query("a20_k_anonymize", lambda: anonymize.k_anonymize(C("value"), C("entity_type")), oracle.GENERALIZE)


def _table_query(name: str, source: str, key: str, value: str, apply: Callable[[Column], Column], sql: str) -> None:
    """An anonymizer over values written from the keys of a whole table."""
    @query(name, f"SELECT {key}, value, {sql} AS replacement FROM (SELECT {key}, {value} AS value FROM {source})")
    def run(spark, sf):
        rows = inputs.table(spark, sf, source).selectExpr(key, f"{value} AS value")
        return rows.select(key, "value", apply(C("value")).alias("replacement"))


_DATES = ("CASE o_orderkey % 4 WHEN 0 THEN concat('12/', cast(1 + o_orderkey % 12 AS string), '/2024') WHEN 1 THEN "
          "concat('2023-', lpad(cast(1 + o_orderkey % 12 AS string),2,'0'), '-05') WHEN 2 THEN "
          "concat('7.', cast(1 + o_orderkey % 12 AS string), '.99') ELSE concat('May ', cast(o_orderkey AS string)) END")
_AGES = "CASE c_custkey % 5 WHEN 0 THEN 'adult' ELSE concat(cast(c_custkey % 97 AS string), ' years') END"
_PINS = "concat('PIN ', cast(p_partkey AS string))"
_table_query("a13_generalize_date", "orders", "o_orderkey", _DATES, anonymize.generalize_date, oracle.GENERALIZE_DATE)
_table_query("a14_generalize_age", "customer", "c_custkey", _AGES, anonymize.generalize_age, oracle.GENERALIZE_AGE)
_table_query("a15_generalize_pincode", "part", "p_partkey", _PINS, anonymize.generalize_pincode, oracle.GENERALIZE_PIN)
_table_query("a16_generalize_phone", "orders", "o_orderkey", "concat('+91 ', cast(o_orderkey * 7919 AS string), '-',"
             " cast(o_orderkey AS string))", anonymize.generalize_phone, oracle.GENERALIZE_PHONE)
_table_query("a17_generalize_region", "customer", "c_custkey", "concat(c_mktsegment, ' road ', c_name)",
             anonymize.generalize_region, oracle.GENERALIZE_REGION)


# Span values for the vault: the first type of a value wins, so some values are given two types.
_VAULT_SPANS = ("SELECT doc_id, ordinal, value, CASE WHEN entity_type = 'PHONE' AND contains(value, '7') THEN 'UPI_ID' "
                "ELSE entity_type END AS entity_type FROM kept UNION ALL SELECT doc_id, ordinal + 1000, "
                "left(value, 4) AS value, entity_type FROM kept")
_FIRST = (f"SELECT value, first(entity_type ORDER BY doc_id, ordinal, entity_type) AS entity_type FROM ({_VAULT_SPANS}) "
          "GROUP BY value")


def _vault_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = exploded(analyze.with_regex_spans(inputs.cleaned(spark, sf)), "regex_spans", "doc_id").select(
        "doc_id", "ordinal", "d.value", "d.entity_type")
    retyped = F.when((C("entity_type") == "PHONE") & F.contains("value", F.lit("7")), F.lit("UPI_ID")).otherwise(
        C("entity_type"))
    both = F.array(F.struct("ordinal", "value", retyped.alias("entity_type")),
                   F.struct((C("ordinal") + 1000).alias("ordinal"), F.left("value", F.lit(4)).alias("value"),
                            "entity_type"))
    return found.select("doc_id", F.explode(both).alias("d")).select("doc_id", "d.*")


@query("a7_tokenize", chained(f"""SELECT s.doc_id, s.ordinal, s.value, f.entity_type || '_TOKEN_' || {oracle.sha('s.value', 8)}
    AS token FROM ({_VAULT_SPANS}) s JOIN ({_FIRST}) f USING (value)"""))
def a7(spark, sf):
    found = checkpointed(_vault_spans(spark, sf))
    return vault.tokenize_spans(found, vault.build_vault(found)).select("doc_id", "ordinal", "value", "token")


@query("a8_detokenize", chained(f"""SELECT token, value AS original_value FROM (SELECT value, entity_type || '_TOKEN_' ||
    {oracle.sha('value', 8)} AS token FROM ({_FIRST})) UNION ALL SELECT DISTINCT 'X_TOKEN_' || {oracle.sha('value', 8)}, NULL
    FROM ({_FIRST})"""))
def a8(spark, sf):
    known = checkpointed(vault.build_vault(checkpointed(_vault_spans(spark, sf))))
    tokens = known.select("token").unionAll(
        known.select(F.concat(F.lit("X_TOKEN_"), anonymize.short_hash(C("value"), 8)).alias("token")).distinct())
    return vault.detokenize(tokens, known)


@query("a9_token_map", chained(f"SELECT value, entity_type, entity_type || '_TOKEN_' || {oracle.sha('value', 8)} AS token "
                               f"FROM ({_FIRST})"))
def a9(spark, sf):
    return vault.token_map(vault.build_vault(checkpointed(_vault_spans(spark, sf))))


_NUMBERED = (f"""SELECT value, entity_type, row_number() OVER (PARTITION BY entity_type ORDER BY doc_id, ordinal, value) AS number
    FROM (SELECT value, first(entity_type ORDER BY doc_id, ordinal, entity_type) AS entity_type,
      first(doc_id ORDER BY doc_id, ordinal, entity_type) AS doc_id, first(ordinal ORDER BY doc_id, ordinal, entity_type)
      AS ordinal FROM ({_VAULT_SPANS}) GROUP BY value)""")
_FUSED_NUMBERED = _NUMBERED.replace(f"({_VAULT_SPANS})", "fused")
_PSEUDONYM = ("entity_type || '_PSEUDO_' || CASE WHEN number < 100 THEN lpad(cast(number AS VARCHAR), 3, '0') ELSE "
              f"cast(number AS VARCHAR) END || '_' || {oracle.sha('value', 6)}")


@query("a11_pseudonymize", chained(f"SELECT value, entity_type, number, {_PSEUDONYM} AS pseudonym FROM ({_NUMBERED})"))
def a11(spark, sf):
    return vault.pseudonym_vault(_vault_spans(spark, sf))


@query("a12_pseudonym_map", chained(f"SELECT value, {_PSEUDONYM} AS pseudonym FROM ({_NUMBERED})"))
def a12(spark, sf):
    return vault.pseudonym_map(vault.pseudonym_vault(_vault_spans(spark, sf)))


_STRATEGIES = "CASE ordinal % 7 WHEN 0 THEN 'MASK' WHEN 1 THEN 'TOKENIZE' WHEN 2 THEN 'REDACT' WHEN 3 THEN 'GENERALIZE' " \
              "WHEN 4 THEN 'K_ANONYMIZE' WHEN 5 THEN 'PSEUDONYMIZE' ELSE 'OTHER' END"


@query("a21_anonymize", chained(f"""SELECT doc_id, ordinal, strategy, CASE strategy WHEN 'TOKENIZE' THEN {oracle.TOKEN}
    WHEN 'REDACT' THEN {oracle.REDACT} WHEN 'GENERALIZE' THEN {oracle.GENERALIZE} WHEN 'K_ANONYMIZE' THEN {oracle.GENERALIZE}
    WHEN 'PSEUDONYMIZE' THEN pseudonym ELSE {oracle.MASK} END AS replacement
    FROM (SELECT *, {_STRATEGIES} AS strategy FROM fused) JOIN (SELECT value, {_PSEUDONYM} AS pseudonym FROM ({_FUSED_NUMBERED}))
    USING (value)"""))
def a21(spark, sf):
    rows = checkpointed(_fused_rows(spark, sf).withColumn("strategy", F.expr(_STRATEGIES)))
    known = vault.pseudonym_map(vault.pseudonym_vault(rows.select("doc_id", "ordinal", "value", "entity_type")))
    return rows.join(known, "value", "left").select("doc_id", "ordinal", "strategy", anonymize.anonymized_value(
        C("value"), C("entity_type"), C("strategy"), C("pseudonym")).alias("replacement"))


def _finished(spark: SparkSession, sf: str) -> DataFrame:
    return analyze.with_finished(inputs.assessed(spark, sf)).select("doc_id", "entities", "anonymized_text", "token_map")


@query("a22_apply_to_text", chained("SELECT doc_id, anonymized_text FROM spliced"))
def a22(spark, sf):
    return _finished(spark, sf).select("doc_id", "anonymized_text")


# --- encryption ------------------------------------------------------------------------------

_KEY = bytes(range(32))


@query("e1_encrypt_column", "SELECT doc_id, 16::BIGINT AS nonce_length, 4 * ((strlen(text) + 18) // 3) AS sealed_length, "
       "'AES-256-GCM' AS algorithm, 256::BIGINT AS key_size FROM documents")
def e1(spark, sf):
    sealed = inputs.table(spark, sf, "documents").select("doc_id", crypto.encrypt_column(C("text"), _KEY).alias("p"))
    return sealed.select("doc_id", F.length("p.nonce").alias("nonce_length"), F.length("p.ciphertext").alias("sealed_length"),
                         "p.algorithm", "p.key_size")


@query("e2_decrypt_column", "SELECT doc_id, text FROM documents")
def e2(spark, sf):
    sealed = inputs.table(spark, sf, "documents").select("doc_id", crypto.encrypt_column(C("text"), _KEY).alias("p"))
    return sealed.select("doc_id", crypto.decrypt_column(C("p"), _KEY).alias("text"))


@query("e3_encrypt_struct", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def e3(spark, sf):
    record = F.struct("c_custkey", "c_name", "c_mktsegment")
    sealed = inputs.table(spark, sf, "customer").select(crypto.encrypt_struct(record, _KEY).alias("p"))
    return sealed.select(crypto.decrypt_struct(
        C("p"), _KEY, "c_custkey bigint, c_name string, c_mktsegment string").alias("r")).select("r.*")


# --- results and audit -------------------------------------------------------------------------

@query("o1_detection_stats", chained("""SELECT doc_id, coalesce(r, 0) AS regex, coalesce(x, 0) AS transformer,
    coalesce(n, 0) AS spacy, coalesce(f, 0) AS fused, coalesce(a, 0) AS after_validation FROM docs
    LEFT JOIN (SELECT doc_id, count(*) FILTER (src = 0) AS r, count(*) FILTER (src = 1) AS x, count(*) FILTER (src = 2) AS n FROM everything
      GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS f, count(*) FILTER (context_valid) AS a FROM validated GROUP BY doc_id) USING (doc_id)"""))
def o1(spark, sf):
    stats = analyze.detection_stats(C("detected"), C("judged")["accepted"])
    counted = inputs.judged(spark, sf).select("doc_id", stats.alias("s"))
    return counted.select("doc_id", "s.regex", "s.transformer", "s.spacy", "s.fused",
                          C("s.after_context_validation").alias("after_validation"))


_ENTITY_COLUMNS = f"""doc_id, place AS ordinal, entity_type, value AS original_value, anonymized_value, strategy, confidence,
    sensitivity_level, round(weight, 9) AS weight, effective_score, source, {in_sql('notes')} AS notes"""


@query("o2_entities_report", chained(f"SELECT {_ENTITY_COLUMNS} FROM entities"))
def o2(spark, sf):
    rows = exploded(_finished(spark, sf), "entities", "doc_id", element="e")
    return rows.select(
        "doc_id", "ordinal", "e.entity_type", "e.original_value", "e.anonymized_value", "e.strategy", "e.confidence",
        "e.sensitivity_level", F.round("e.sensitivity_weight", 9).alias("weight"), "e.effective_score", "e.source",
        joined("e.context_notes").alias("notes"))


_KYC_NAME = "'inline_text' AS document_name, 'txt' AS document_type"
_RESULT = f"""SELECT doc_id AS document_id, {_KYC_NAME}, length(text) AS input_length, length(t) AS cleaned_length,
    n AS entity_count, risk_score AS base_risk_score, final_score AS risk_score, final_level AS risk_level, anonymized_text,
    coalesce(m, 0) AS reported FROM clean JOIN adjusted USING (doc_id) JOIN spliced USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS m FROM entities GROUP BY doc_id) USING (doc_id)"""


@query("o3_assemble_result", chained(_RESULT))
def o3(spark, sf):
    return inputs.results(spark, sf).select(
        "document_id", "document_name", "document_type", "input_length", "cleaned_length", "risk_analysis.entity_count",
        "risk_analysis.base_risk_score", "risk_analysis.risk_score", "risk_analysis.risk_level", "anonymized_text",
        F.size("entities").alias("reported"))


@query("o4_sanitize", chained("SELECT doc_id AS document_id, final_score AS risk_score, 0::BIGINT AS secrets FROM adjusted"))
def o4(spark, sf):
    shown = analyze.sanitize(inputs.results(spark, sf))
    secrets = len({"token_map", "encryption_key"} & set(shown.columns))
    return shown.select("document_id", "risk_analysis.risk_score", F.lit(secrets).alias("secrets"))


_NUMBER = "cast(regexp_extract(doc_id, '[0-9]+') AS BIGINT)"


def _dated_results(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis of all texts with a time per document."""
    return analyze.analyze_documents(inputs.dated(spark, sf), analyze.Options(keep_original=True))


# Records of all texts, for the SQL side.
_LOG = f"""(SELECT doc_id AS document_id, to_timestamp(1704067200 + {_NUMBER} * 977) AT TIME ZONE 'UTC' AS ts,
    'text ' || doc_id AS document_name, n AS entity_count, final_score AS risk_score, final_level AS risk_level,
    {_NUMBER} % 50 AS ms FROM adjusted)"""


def logged(select: str) -> str:
    return chained(select, bare=True)


def _shown_time(column: str = "timestamp") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_SHOWN = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_LOG_COLUMNS = ["document_id", "document_name", "entity_count", "risk_score", "risk_level"]


@query("o5_write_audit", logged(f"SELECT {', '.join(_LOG_COLUMNS)}, {_SHOWN} AS shown, {_SHOWN}[1:10] AS dt FROM {_LOG}"))
def o5(spark, sf):
    folder = _folder(spark) + "/audit"
    audit.write_audit(audit.to_audit_log(_dated_results(spark, sf)), folder)
    log = audit.read_audit(spark, folder)
    return log.select(*_LOG_COLUMNS, _shown_time().alias("shown"), C("dt").cast("string").alias("dt"))


@query("s11_read_audit", logged(f"SELECT document_id, risk_level, {_SHOWN} AS shown FROM {_LOG} WHERE {_SHOWN}[1:10] >= '2024-01-10'"))
def s11(spark, sf):
    folder = _folder(spark) + "/audit"
    audit.write_audit(audit.to_audit_log(_dated_results(spark, sf)), folder, "parquet")
    log = audit.read_audit(spark, folder, "parquet").filter(C("dt") >= F.lit("2024-01-10").cast("date"))
    return log.select("document_id", "risk_level", _shown_time().alias("shown"))


@query("o6_recent_audit", logged(f"SELECT {', '.join(_LOG_COLUMNS)}, {_SHOWN} AS shown FROM {_LOG} ORDER BY ts DESC, document_id LIMIT 50"))
def o6(spark, sf):
    return audit.recent_audit(audit.to_audit_log(_dated_results(spark, sf)), 50).select(
        *_LOG_COLUMNS, _shown_time().alias("shown"))


@query("o7_to_audit_log", logged(f"""SELECT l.document_id, entity_count, risk_score, ms::DOUBLE AS processing_time_ms,
    coalesce(k.n, 0) AS regex_count, coalesce(strategies, '') AS strategies FROM {_LOG} l
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) k ON k.doc_id = l.document_id
    LEFT JOIN (SELECT doc_id, array_to_string(list_sort(list(DISTINCT strategy)), '|') AS strategies FROM planned GROUP BY doc_id) p
      ON p.doc_id = l.document_id"""))
def o7(spark, sf):
    log = audit.to_audit_log(_dated_results(spark, sf))
    return log.select("document_id", "entity_count", "risk_score", "processing_time_ms", "regex_count",
                      joined("strategies_used").alias("strategies"))


@query("o8_to_detected_entities", logged(f"""SELECT doc_id AS document_id, entity_type, sensitivity_level, confidence,
    strategy AS anonymization_strategy, source AS detector_source FROM entities"""))
def o8(spark, sf):
    return audit.to_detected_entities(_dated_results(spark, sf)).drop("timestamp")


# --- corpus analytics ---------------------------------------------------------------------------

@query("m1_overview", logged(f"""SELECT count(*) AS documents, cast(coalesce(sum(m), 0) AS BIGINT) AS entities,
    round(avg(risk_score), 6) AS mean_risk, round(avg(ms), 6) AS mean_latency_ms FROM {_LOG} l
    LEFT JOIN (SELECT doc_id, count(*) AS m FROM entities GROUP BY doc_id) e ON e.doc_id = l.document_id"""))
def m1(spark, sf):
    return metrics.overview(_dated_results(spark, sf)).select(
        "documents", "entities", F.round("mean_risk", 6).alias("mean_risk"),
        F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


@query("m2_recent_analyses", logged(f"SELECT {_SHOWN} AS shown, document_id, document_name, entity_count, risk_level "
                                     f"FROM {_LOG} ORDER BY ts DESC, document_id LIMIT 8"))
def m2(spark, sf):
    newest = metrics.recent_analyses(audit.to_audit_log(_dated_results(spark, sf)))
    return newest.select(_shown_time().alias("shown"), "document_id", "document_name", "entity_count", "risk_level")


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(_finished(spark, sf), "entities", "doc_id", element="e").select("doc_id", "e.*")


@query("m3_entity_breakdown_all", chained("SELECT entity_type, n AS count, n / max(n) OVER () * 100e0 AS share FROM ("
                                          "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type)"))
def m3(spark, sf):
    return metrics.entity_breakdown_all(_reported(spark, sf))


@query("m4_daily_trend", logged(f"""SELECT {_SHOWN}[1:10] AS day, count(*) AS documents, cast(sum(entity_count) AS BIGINT)
    AS pii_detected, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk FROM {_LOG} GROUP BY 1"""))
def m4(spark, sf):
    return metrics.daily_trend(audit.to_audit_log(_dated_results(spark, sf))).withColumn("day", C("day").cast("string"))


@query("m5_entity_explorer", chained("""SELECT doc_id AS document_id, place AS ordinal, entity_type, sensitivity_level,
    cast(p AS BIGINT) AS confidence_percent, CASE WHEN p > 85 THEN 'green' WHEN p > 60 THEN 'yellow' ELSE 'red' END AS colour,
    strategy FROM (SELECT *, floor(confidence * 100e0 + 0.5e0) AS p FROM entities)"""))
def m5(spark, sf):
    return metrics.entity_explorer(_finished(spark, sf).withColumnRenamed("doc_id", "document_id"))


@query("m6_transformation_history", chained("""SELECT doc_id AS document_id, place AS ordinal, value AS original_value,
    anonymized_value, strategy FROM entities"""))
def m6(spark, sf):
    return metrics.transformation_history(_finished(spark, sf).withColumnRenamed("doc_id", "document_id"))


@query("m7_audit_feed", logged(f"""SELECT document_name || ' processed — ' || cast(coalesce(m, 0) AS VARCHAR) ||
    ' entities, risk ' || risk_level AS message, 'doc_id: ' || document_id || ' · score: ' || regexp_replace(
    cast(risk_score AS VARCHAR), '\\.0$', '') || ' · ' || cast(ms AS VARCHAR) || 'ms · encrypted: no' AS detail,
    CASE risk_level WHEN 'CRITICAL' THEN 'err' WHEN 'HIGH' THEN 'warn' ELSE 'ok' END AS status
    FROM {_LOG} l LEFT JOIN (SELECT doc_id, count(*) AS m FROM entities GROUP BY doc_id) e ON e.doc_id = l.document_id
    UNION ALL SELECT 'File analysis failed: ' || refusal, 'File: ' || path, 'err' FROM ({ORACLES['s12_size_gate']})
    WHERE refusal IS NOT NULL"""))
def m7(spark, sf):
    refused = files.quarantined_files(files.size_gate(files.route_by_type(_listing(spark, sf))))
    return metrics.audit_feed(_dated_results(spark, sf), refused)


@query("m8_confidence_by_type", chained("""SELECT entity_type, sensitivity_level, count(*) AS entities, round(avg(confidence), 6)
    AS mean_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence FROM entities GROUP BY 1, 2"""))
def m8(spark, sf):
    return metrics.confidence_by_type(_reported(spark, sf)).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("m9_audit_projection", logged(f"SELECT {', '.join(_LOG_COLUMNS)}, {_SHOWN} AS shown FROM {_LOG}"))
def m9(spark, sf):
    shown = metrics.audit_projection(audit.to_audit_log(_dated_results(spark, sf)))
    return shown.withColumn("shown", _shown_time()).drop("timestamp")


@query("m10_validated_types", chained("""SELECT doc_id AS document_id, coalesce(types, '') AS types FROM docs LEFT JOIN (
    SELECT doc_id, array_to_string(list_sort(list(DISTINCT entity_type)), '|') AS types FROM entities
    WHERE sensitivity_level <> 'IGNORED' AND confidence >= 0.25::DOUBLE GROUP BY doc_id) USING (doc_id)"""))
def m10(spark, sf):
    shown = metrics.validated_types(_finished(spark, sf).withColumnRenamed("doc_id", "document_id"))
    return shown.withColumn("types", joined("types"))


@query("m11_check_expectations", chained("""SELECT doc_id AS case_id, 'customer text' AS description,
    len(list_filter(['AADHAAR', 'PAN'], lambda t: NOT list_contains(types, t))) = 0
    AND NOT list_contains(types, 'CREDIT_CARD') AND contains(anonymized_text, '[EMAIL_REDACTED]') AS passed
    FROM doc_risk JOIN spliced USING (doc_id) WHERE starts_with(doc_id, 'kyc-')"""))
def m11(spark, sf):
    cases = inputs.texts(spark, sf, "kyc").select(
        C("doc_id").alias("case_id"), F.lit("customer text").alias("description"),
        F.array(F.lit("AADHAAR"), F.lit("PAN")).alias("should_detect"),
        F.array(F.lit("CREDIT_CARD")).alias("should_reject"),
        F.lit("[EMAIL_REDACTED]").alias("check_anonymized_contains"))
    return metrics.check_expectations(_finished(spark, sf).withColumnRenamed("doc_id", "document_id"), cases)


# --- whole analyses and streams --------------------------------------------------------------------

@query("p1_analyze_documents", chained("""SELECT cast(doc_id[5:] AS BIGINT) AS document_id, final_score AS risk_score,
    final_level AS risk_level, n AS entity_count, coalesce(reported, 0) AS reported, anonymized_text, true AS encrypted
    FROM adjusted JOIN spliced USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS reported FROM entities GROUP BY doc_id)
    USING (doc_id) WHERE starts_with(doc_id, 'doc-')"""))
def p1(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    found = analyze.analyze_documents(analyze.spread(docs), analyze.Options(encryption_key=_KEY))
    return found.select("document_id", "risk_analysis.risk_score", "risk_analysis.risk_level",
                        "risk_analysis.entity_count", F.size("entities").alias("reported"), "anonymized_text", "encrypted")


def _mixed_files(spark: SparkSession, sf: str) -> str:
    """A folder with a text for each supplier, a sheet for each nation's customers, and files of every kind that is refused."""
    folder = _folder(spark)
    inputs.texts(spark, sf, "fin").withColumn("name", C("doc_id")).select("name", "text").write.partitionBy(
        "name").text(folder + "/in/txt")
    customers = inputs.table(spark, sf, "customer").select(
        C("c_nationkey").alias("nation"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    customers.repartition("nation").sortWithinPartitions("nation", "c_custkey").write.partitionBy("nation").option(
        "header", True).csv(folder + "/in/csv")
    nations = inputs.table(spark, sf, "nation").select(C("n_nationkey").alias("name"), F.lit("  ").alias("text"))
    nations.write.partitionBy("name").text(folder + "/in/blank")
    regions = inputs.table(spark, sf, "region").select(C("r_regionkey").alias("name"), F.explode(
        F.array(F.lit("a,b"), F.concat(F.lit("1,2,"), C("r_name")))).alias("line"))
    regions.repartition("name").sortWithinPartitions("name").write.partitionBy("name").option("sep", "|").csv(folder + "/in/ragged")
    regions.repartition("name").write.partitionBy("name").parquet(folder + "/in/other")
    return folder + "/in"


def _mixed_contents(spark: SparkSession, sf: str) -> DataFrame:
    """The same sheets and a text for each supplier as rows ``(path, content)``."""
    texts = inputs.texts(spark, sf, "fin").select(F.concat(F.lit("in/name="), "doc_id", F.lit("/part.TXT")).alias("path"), "text")
    columns = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    line = F.concat_ws(",", *(C(c).cast("string") for c in columns))
    sheets = inputs.table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("lines")).select(
        F.concat(F.lit("in/nation="), C("c_nationkey").cast("string"), F.lit("/part.csv")).alias("path"),
        F.array_join(F.concat(F.array(F.lit(",".join(columns))), F.transform("lines", lambda x: x["line"])), "\r\n").alias("text"))
    return texts.unionAll(sheets).select("path", C("text").cast("binary").alias("content"))


def _found_in_files(found: DataFrame) -> DataFrame:
    source = C("metadata")["source"]
    name = F.when(C("document_type") == "csv", F.concat(F.lit("nation-"), F.regexp_extract(source, "nation=([^/]+)/", 1))).otherwise(
        F.regexp_extract(source, "name=([^/]+)/", 1))
    return found.select(name.alias("name"), "cleaned_length", "risk_analysis.entity_count", "risk_analysis.risk_level",
                        "anonymized_text")


_SHEET = " || ' | ' || ".join(f"'{c}: ' || cast({c} AS VARCHAR)" for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
_IN_FILES = """SELECT doc_id AS name, length(t) AS cleaned_length, n AS entity_count, final_level AS
    risk_level, anonymized_text FROM adjusted JOIN clean USING (doc_id) JOIN spliced USING (doc_id)"""
_SHEETS = f"SELECT 'nation-' || c_nationkey AS doc_id, string_agg({_SHEET}, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey"


_FILED = f"SELECT {_FIN[1]} AS doc_id, {_FIN[2]} AS text FROM supplier UNION ALL {_SHEETS}"


@query("p2_analyze_files", chained(_IN_FILES, _FILED))
def p2(spark, sf):
    found, _ = analyze.analyze_files(spark, _mixed_files(spark, sf))
    return _found_in_files(found)


@query("p2_analyze_contents", chained(_IN_FILES, _FILED))
def p2_contents(spark, sf):
    found, _ = analyze.analyze_contents(_mixed_contents(spark, sf))
    return _found_in_files(found)


@query("p2_refused_files", """SELECT 'csv' AS document_type, 'more fields than names' AS refusal, count(*) AS files FROM region
    UNION ALL SELECT 'parquet', 'unsupported type', count(*) FROM region UNION ALL SELECT 'txt', 'no text', count(*) FROM nation""")
def p2_refused(spark, sf):
    _, refused = analyze.analyze_files(spark, _mixed_files(spark, sf))
    return refused.groupBy("document_type", "refusal").agg(F.count("*").alias("files"))


_CUSTOMER_TEXT = " || ' | ' || ".join(
    f"'{c}: ' || cast({c} AS VARCHAR)" for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@query("p3_analyze_table", chained("""SELECT cast(doc_id AS BIGINT) AS document_id, n AS entity_count, final_score AS risk_score,
    anonymized_text FROM adjusted JOIN spliced USING (doc_id)""",
    f"SELECT cast(c_custkey AS VARCHAR) AS doc_id, {_CUSTOMER_TEXT} AS text FROM customer"))
def p3(spark, sf):
    found = analyze.analyze_table(analyze.spread(inputs.table(spark, sf, "customer")), "c_custkey")
    return found.select("document_id", "risk_analysis.entity_count", "risk_analysis.risk_score", "anonymized_text")


def _streamed(spark: SparkSession, frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table as a file stream, and the folder for the stream's own state."""
    folder = _folder(spark)
    frame.write.parquet(f"{folder}/{name}")
    source = spark.readStream.schema(frame.schema).parquet(f"{folder}/{name}")
    return source, folder


def _drained(stream_out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table and read the table."""
    writer = stream_out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer.option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return stream_out.sparkSession.read.schema(stream_out.schema).parquet(f"{folder}/out")


@query("p4_analyze_stream", chained("""SELECT doc_id AS document_id, final_score AS risk_score, anonymized_text FROM adjusted
    JOIN spliced USING (doc_id)""", bare=True))
def p4(spark, sf):
    source, folder = _streamed(spark, inputs.corpus(spark, sf), "docs")
    shown = stream.analyze_stream(source).select("document_id", "risk_analysis.risk_score", "anonymized_text")
    return _drained(shown, folder)


_ARRIVALS = 3
_ARRIVING = f"""(SELECT *, cast(ts AS DATE) AS day, max(CASE WHEN arrival = 0 THEN ts END) OVER () AS first_end, max(CASE WHEN arrival < 2 THEN ts END)
    OVER () AS second_end FROM (SELECT l.*, cast(regexp_extract(document_id, '[0-9]+') AS BIGINT) // 7 % {_ARRIVALS} AS arrival FROM {_LOG} l))"""


@query("p5_stream_audit_metrics", logged(f"""SELECT {_SHOWN}[1:10] AS day, count(*) AS documents, cast(sum(entity_count) AS BIGINT)
    AS pii_detected, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk, round(avg(risk_score), 6) AS mean_risk,
    count(*) FILTER (arrival > 0 AND cast(day AS TIMESTAMP) + INTERVAL 1 DAY <= CASE arrival WHEN 1 THEN first_end ELSE second_end END
        - INTERVAL 1 HOUR) AS late FROM {_ARRIVING} GROUP BY 1"""))
def p5(spark, sf):
    log = audit.to_audit_log(_dated_results(spark, sf)).select(
        "document_id", "timestamp", C("entity_count").cast("bigint").alias("entity_count"), "risk_score", "risk_level")
    folder = _folder(spark)
    number = F.regexp_extract("document_id", "[0-9]+", 0).cast("bigint")
    log.withColumn("arrival", F.floor(number / 7) % _ARRIVALS).drop("document_id").write.partitionBy("arrival").parquet(f"{folder}/log")
    kept = DailyTotals(f"{folder}/daily")
    for arrival in range(_ARRIVALS):  # three deliveries over the same days, so later ones bring records of closed days
        part = spark.read.parquet(f"{folder}/log").filter(C("arrival") == arrival).drop("arrival")
        part.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        source.writeStream.foreachBatch(kept.writer()).option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    late = kept.corrections(spark, _ARRIVALS).select("day", C("documents").alias("late"))
    return kept.totals(spark, _ARRIVALS).join(late, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "documents", "pii_detected", "high_risk", F.round("mean_risk", 6).alias("mean_risk"),
        F.coalesce("late", F.lit(0)).alias("late"))


@query("p6_stream_vault", chained(f"""SELECT value, entity_type, entity_type || '_TOKEN_' || {oracle.sha('value', 8)} AS token
    FROM (SELECT DISTINCT value, entity_type FROM kept)"""))
def p6(spark, sf):
    source, folder = _streamed(spark, inputs.corpus(spark, sf), "docs")
    spotted = analyze.with_regex_spans(analyze.with_clean_text(source))
    found = exploded(spotted, "regex_spans", "doc_id").select(
        "doc_id", "ordinal", "d.value", "d.entity_type")
    kept = StreamVault(f"{folder}/vault")
    found.writeStream.foreachBatch(kept.writer()).option(
        "checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return kept.read(spark, batches=1).select("value", "entity_type", "token")


_PARTS = [("documents", "pages", "talk"), ("kyc", "label"), ("version", "fin", "gov")]  # arrive one after the other
_PART = ("CASE WHEN starts_with(doc_id, 'doc-') OR starts_with(doc_id, 'page-') OR starts_with(doc_id, 'talk-') THEN 0 "
         "WHEN starts_with(doc_id, 'kyc-') OR starts_with(doc_id, 'label-') THEN 1 ELSE 2 END")
_ARRIVED = ("SELECT value, " + ", ".join(f"first({c} ORDER BY part, doc_id, ordinal, entity_type) AS {c}" for c in (
    "entity_type", "part", "doc_id", "ordinal")) + f" FROM (SELECT *, {_PART} AS part FROM kept) GROUP BY value")


@query("a11_stream_pseudonyms", chained(f"""SELECT value, entity_type, number, {_PSEUDONYM} AS pseudonym, {oracle.TOKEN} AS token,
    cast(part AS BIGINT) AS batch_id FROM (SELECT value, entity_type, part, row_number() OVER (PARTITION BY entity_type ORDER BY part, doc_id,
        ordinal, value) AS number FROM ({_ARRIVED}))"""))
def a11_stream(spark, sf):
    folder = _folder(spark)
    kept, schema = StreamVault(f"{folder}/vault"), "doc_id string, text string"
    for names in _PARTS:
        for name in names:
            inputs.texts(spark, sf, name).write.mode("append").parquet(f"{folder}/docs")
        source = spark.readStream.schema(schema).parquet(f"{folder}/docs")
        spotted = analyze.with_regex_spans(analyze.with_clean_text(source))
        found = exploded(spotted, "regex_spans", "doc_id").select("doc_id", "ordinal", "d.value", "d.entity_type")
        found.writeStream.foreachBatch(kept.writer()).option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    return kept.read(spark, len(_PARTS)).select("value", "entity_type", "number", "pseudonym", "token", "batch_id")


from . import extensions  # noqa: E402, F401  registers more queries
