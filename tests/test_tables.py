"""Sources, vault, audit log, encryption and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from veilmark.functions import crypto
from veilmark.functions.detect import locate
from veilmark.functions.text import let
from veilmark.operators import metrics, spans, vault
from veilmark.plans import analyze
from veilmark.plans.analyze import analyze_contents, analyze_documents, analyze_files, analyze_table, sanitize
from veilmark.sources import annotations as ann
from veilmark.sources import audit, files, parts
from veilmark.sources.listing import list_tree
from veilmark.streaming import stream

KEY = bytes(range(32))


def test_files_are_routed_read_and_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Call me at 9876543210\r\nbad \xff byte\rend")
    (tmp_path / "B.TXT").write_bytes(b"   ")
    (tmp_path / "c.csv").write_text('id,note\n1,"two\nlines"\n2,\n3, \n')
    (tmp_path / "d.csv").write_text("name,mail\nAnn,ann@x.org\n")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.exe").write_bytes(b"MZ")
    (tmp_path / "g.txt").write_bytes(b"")
    (tmp_path / "h.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "i.csv").write_bytes(b"a,b\n\xff,2\n")
    (tmp_path / "j.csv").write_text('a,b\n1,"2\n')
    (tmp_path / "k.csv").write_text('a,a,\n"say ""hi""",2,\n\n"",,"x, y"\n')
    texts = {r.document_name: r for r in files.read_text_docs(spark, str(tmp_path)).collect()}
    assert texts["a.txt"].text == "Call me at 9876543210\nbad � byte\nend"
    sheets = {r.document_name: r for r in files.read_csv_docs(spark, str(tmp_path)).collect()}
    assert sheets["c.csv"].text == "id: 1 | note: two\nlines\nid: 2\nid: 3"
    assert (sheets["c.csv"].metadata["row_count"], sheets["d.csv"].metadata["col_count"]) == ("3", "2")
    assert sheets["k.csv"].text == 'a: say "hi" | a.1: 2\nUnnamed: 2: x, y'
    found, refused = analyze_files(spark, str(tmp_path))
    counts = {r.document_name: r.n for r in found.select("document_name", "risk_analysis.entity_count").withColumnRenamed("entity_count", "n").collect()}
    assert counts == {"a.txt": 1, "c.csv": 0, "d.csv": 1, "k.csv": 0}
    reasons = {files_name(r.path): r.refusal for r in refused.collect()}
    assert reasons == {
        "B.TXT": "no text", "e.pdf": "text must be supplied as parts", "f.exe": "unsupported type", "g.txt": "empty file",
        "h.csv": "more fields than names", "i.csv": "not UTF-8", "j.csv": "quote without end"}
    small = files.size_gate(files.route_by_type(list_tree(spark, str(tmp_path))), max_bytes=10)
    assert {files_name(r.path) for r in files.accepted_files(small).collect()} == {
        "B.TXT", "e.pdf", "g.txt", "h.csv", "i.csv", "j.csv"}


def test_a_table_of_contents_gives_what_the_folder_gives(spark, tmp_path):
    contents = {"a.txt": b"Call me at 9876543210\r\nend", "b/B.TXT": b"   ", "b/c.csv": b'id,note\n1,"two\nlines"\n', "d.pdf": b"%PDF", "e.exe": b"MZ",
                "b/deep/f.txt": b"", "b/deep/g.csv": b"a,b\n1,2,3\n", "_hidden.txt": b"x@y.org", ".h/i.txt": b"x@y.org"}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    listed = {r.path: r.length for r in list_tree(spark, str(tmp_path)).collect()}
    shown = {n: c for n, c in contents.items() if not n.startswith(("_", "."))}
    assert listed == {f"file:{tmp_path}/{n}": len(c) for n, c in shown.items()}
    assert [r.path for r in list_tree(spark, str(tmp_path / "a.txt")).collect()] == [f"file:{tmp_path}/a.txt"]
    assert list_tree(spark, str(tmp_path / "none")).count() == 0
    table = spark.createDataFrame([(f"file:{tmp_path}/{n}", bytearray(c)) for n, c in shown.items()], "path string, content binary")
    for by_folder, by_table in zip(analyze_files(spark, str(tmp_path)), analyze_contents(table)):
        columns = [c for c in by_table.columns if c in by_folder.columns and c != "token_map"]
        assert sorted(map(str, by_folder.select(columns).collect())) == sorted(map(str, by_table.select(columns).collect()))
    found, refused = analyze_contents(table, max_bytes=20)
    assert found.count() == 0 and {r.path.rsplit("/", 1)[1]: r.refusal for r in refused.collect()}["c.csv"] == "file too large"


def test_large_files_are_read_by_default(spark, tmp_path):
    (tmp_path / "l.txt").write_text("word " * 2_300_000)
    assert files.read_text_docs(spark, str(tmp_path)).select(F.length("text").alias("n")).first().n == 11_500_000
    assert files.read_text_docs(spark, str(tmp_path), max_bytes=100).count() == 0


def files_name(path):
    return path.rsplit("/", 1)[1]


def test_csv_rows_stay_strings(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n007,"say ""hi"""\n,NA\n')
    rows = files.read_csv_rows(spark, str(tmp_path / "x.csv"))
    assert [tuple(r) for r in rows.collect()] == [("007", 'say "hi"'), ("", "NA")]
    assert [r[0] for r in rows.select(parts.rows_to_text(rows)).collect()] == ['a: 007 | b: say "hi"', "b: NA"]


def test_documents_of_many_parts(spark):
    wide = spark.range(5000).select(F.lit("big").alias("doc_id"), F.col("id").alias("ordinal"),
                                    F.col("id").cast("string").alias("text"), F.lit("paragraph").alias("kind"))
    row = spark.createDataFrame([("big", 0, "cell | cell", "table_row"), ("small", 3, "b", "paragraph"),
                                 ("small", 1, "a", "paragraph")], wide.schema)
    whole = {r.doc_id: r.text for r in parts.assemble_document(wide.union(row)).collect()}
    assert whole == {"big": "\n".join(map(str, range(5000))) + "\ncell | cell", "small": "a\nb"}


def test_vault_first_type_wins_and_collisions_widen(spark, monkeypatch):
    rows = [(2, 0, "v1", "PHONE"), (1, 5, "v1", "NAME"), (1, 9, "v2", "PHONE"), (3, 0, "v3", "PHONE")]
    table = spark.createDataFrame(rows, "doc_id int, ordinal int, value string, entity_type string")
    known = {r.value: r for r in vault.build_vault(table).collect()}
    assert known["v1"].token.startswith("NAME_TOKEN_") and known["v1"].mixed and not known["v2"].mixed
    tokens = {(r.doc_id, r.value): r.token for r in vault.tokenize_spans(table, vault.build_vault(table)).collect()}
    assert tokens[2, "v1"] == tokens[1, "v1"] == known["v1"].token
    monkeypatch.setattr(vault, "tokenize", lambda v, t, n=8: F.concat(t, F.lit("_TOKEN_"), F.lit("SAME") if n == 8 else v))
    clashing = vault.build_vault(table)
    assert {r.value: r.token for r in clashing.collect()} == {
        "v1": "NAME_TOKEN_SAME", "v2": "PHONE_TOKEN_v2", "v3": "PHONE_TOKEN_v3"}
    asked = spark.createDataFrame([("PHONE_TOKEN_v3",), ("NOPE",)], "token string")
    assert {r.token: r.original_value for r in vault.detokenize(asked, clashing).collect()} == {
        "PHONE_TOKEN_v3": "v3", "NOPE": None}


def test_pseudonyms_are_numbered_across_ranges(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"), (F.col("id") % 700).cast("string").alias("value"),
        F.when(F.col("id") % 700 < 650, "PHONE").otherwise("NAME").alias("entity_type"))
    got = vault.pseudonym_vault(rows.repartition(7)).collect()
    assert sorted(r.number for r in got if r.entity_type == "PHONE") == list(range(1, 651))
    assert all(r.number == int(r.value) + 1 for r in got if r.entity_type == "PHONE")


def test_verifier_scores_move_confidence(spark):
    rows = [("a", "PHONE", 0, 10, 0.8), ("b", "PHONE", 0, 10, 0.8), ("c", "PHONE", 0, 10, 0.8), ("d", "PHONE", 0, 10, 0.8),
            ("e", "PHONE", 0, 10, 0.8)]
    entities = spark.createDataFrame(rows, "doc_id string, entity_type string, start int, end int, confidence double")
    scores = spark.createDataFrame([("a", "PHONE", 0, 10, 0.2), ("b", "PHONE", 0, 10, 0.4), ("c", "PHONE", 0, 10, 0.6),
                                    ("d", "PHONE", 0, 10, 0.9)], "doc_id string, entity_type string, start int, end int, pii_score double")
    got = {r.doc_id: (r.confidence, r.verifier_note) for r in spans.apply_verifier_scores(entities, scores).collect()}
    assert got == {"a": (0.12, "transformer_rejects:pii=0.20"), "b": (0.32, "transformer_uncertain:pii=0.40"),
                   "c": (0.8, "transformer_neutral:pii=0.60"), "d": (0.848, "transformer_confirms:pii=0.90"), "e": (0.8, None)}


def test_scores_inside_the_analysis(spark):
    docs = spark.createDataFrame([("a", "Call me at 9876543210 now")], "doc_id string, text string")
    scores = spark.createDataFrame([("a", "PHONE", 11, 21, 0.1)], "doc_id string, entity_type string, start int, end int, pii_score double")
    row = analyze_documents(ann.attach_scores(docs, scores)).first()
    assert row.anonymized_text == "Call me at 9876543210 now" and row.risk_analysis.entity_count == 0
    assert row.entities[0].strategy == "None" and row.entities[0].context_notes[-1] == "transformer_rejects:pii=0.10"


def test_encryption(spark):
    texts = spark.createDataFrame([("a",), ("é😀",), ("",), (None,)], "t string")
    sealed = texts.select("t", crypto.encrypt_column(F.col("t"), KEY).alias("p")).cache()
    again = texts.select(crypto.encrypt_column(F.col("t"), KEY).alias("p")).collect()
    rows = sealed.select("t", "p", crypto.decrypt_column(F.col("p"), KEY).alias("back")).collect()
    assert all(r.t == r.back for r in rows)
    assert all(r.p.nonce != a.p.nonce and r.p.ciphertext != a.p.ciphertext for r, a in zip(rows, again) if r.p)
    wrong = sealed.select(crypto.decrypt_column(F.col("p"), KEY[::-1], lenient=True).alias("x")).collect()
    assert {r.x for r in wrong} == {None}
    with pytest.raises(Exception):
        sealed.select(crypto.decrypt_column(F.col("p"), KEY[::-1])).collect()
    with pytest.raises(ValueError):
        crypto.encrypt_column(F.col("t"), b"short")
    record = texts.filter("t = 'a'").select(F.struct("t", F.lit(1).alias("n")).alias("r"))
    back = record.select(crypto.decrypt_struct(crypto.encrypt_struct(F.col("r"), KEY), KEY, "t string, n int").alias("r"))
    assert tuple(back.first().r) == ("a", 1)


def dated(spark, count):
    return spark.range(count).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Call me at 9"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("text"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("id") * 40000).alias("ts"))


def test_audit_log_round_trip(spark, tmp_path):
    log = audit.to_audit_log(analyze_documents(dated(spark, 12)), with_report=True)
    for form in ("json", "parquet"):
        path = str(tmp_path / form)
        audit.write_audit(log, path, form)
        audit.write_audit(log.limit(0), path, form)
        back = audit.read_audit(spark, path, form)
        assert back.count() == 12
        newest = audit.recent_audit(back, 3).collect()
        assert [r.document_id for r in newest] == ["11", "10", "9"]
        assert newest[0].entity_breakdown == {"PHONE": 1} and newest[0].strategies_used == ["REDACT"]
        assert "token_map" not in newest[0].full_report
    days = back.filter(F.col("dt") == F.lit(datetime.date(2023, 11, 15)))
    assert "PartitionFilters: [isnotnull(dt" in days._jdf.queryExecution().executedPlan().toString()
    assert sum(r.documents for r in metrics.daily_trend(back).collect()) == 12


def test_stream_equals_batch(spark, tmp_path):
    docs = dated(spark, 30)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    wanted = ["document_id", "anonymized_text", "risk_analysis"]
    query = stream.analyze_stream(source).select(*wanted).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {r.document_id: r for r in analyze_documents(docs).select(*wanted).collect()}
    streamed = {r.document_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(streamed) == 30 and streamed == batch


def test_table_scan_and_feed(spark):
    people = spark.createDataFrame([(1, "ann@x.org", " "), (2, "", "9876543210")], "id int, mail string, phone string")
    found = analyze_table(people, "id")
    rows = {r.document_id: r for r in found.collect()}
    assert rows[1].anonymized_text == "mail: [EMAIL_REDACTED]" and rows[2].anonymized_text == "phone: [PHONE_REDACTED]"
    refused = spark.createDataFrame([("x.exe", "unsupported type")], "path string, refusal string")
    feed = metrics.audit_feed(found, refused).collect()
    assert sorted(r.status for r in feed) == ["err", "warn", "warn"]
    assert "token_map" not in sanitize(found).columns


def test_costly_columns_are_computed_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    risky = analyze_documents(docs).filter("risk_analysis.risk_score > 50").select("document_id", "risk_analysis.risk_level")
    plan = risky._jdf.queryExecution().executedPlan().toString()
    assert plan.count("okhdfcbank") == 2  # one scan pattern and its copy in the rule table
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_stages_are_projected_before_they_are_generated(spark):
    """A generator evaluates its own expressions without generated code; none has any, and no filter repeats one."""
    plan = analyze_documents(dated(spark, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(__") >= 5
    assert "Generate explode(array(" not in plan and "Filter" not in plan


def test_bound_values_are_not_copied(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("t"), F.array(F.lit(2), F.lit(3)).alias("a"))
    bound = row.select(let(F.col("t"), lambda t: F.coalesce(t, F.lit("none"))).alias("null_too"),
                       F.transform("a", lambda x: let(x * x, lambda y: let(y + x, lambda z: z * y))).alias("nested"))
    assert bound.first() == ("none", [24, 108])
    assert "transform(array(" not in bound._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_with_the_mark_keeps_its_offsets(spark):
    text = "\x01a 12\x01\x01345 \u00e9\x01 6"
    found = spark.createDataFrame([(text,)], "t string").select(
        locate(F.col("t"), F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)), F.lit("[0-9]+")).alias("m"))
    assert [(m.value, m.start, m.end) for m in found.first().m] == [("12", 3, 5), ("345", 7, 10), ("6", 14, 15)]


def test_counting_entities_splices_no_text(spark):
    results = analyze_documents(dated(spark, 3))
    pieces = [df._jdf.queryExecution().optimizedPlan().toString().count("AS pieces#") for df in (results, metrics.overview(results))]
    assert pieces == [1, 0]
    assert metrics.overview(results).first().entities == sum(len(r.entities) for r in results.collect())


def test_every_selection_of_result_columns(spark):
    """The optimizer prunes nested fields through the stages; no selection may lose one."""
    results = analyze_documents(dated(spark, 3))
    whole = results.collect()
    for columns in ([], ["risk_analysis.*"], ["entities"], ["token_map", "detection_stats"], ["risk_analysis.base_risk_score", "anonymized_text"],
                    ["risk_analysis.quasi_identifier_analysis.recommendations", "risk_analysis.entity_breakdown", "entities.confidence"],
                    [c for c in results.columns if c != "token_map"]):
        assert len(results.select("document_id", *columns).collect()) == len(whole) == 3
    assert results.filter("risk_analysis.risk_score > 1000").select("anonymized_text").count() == 0


def test_one_row_group_in_many_splits_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(60_000).select("id", F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    name, cores = "spark.sql.files.maxPartitionBytes", spark.sparkContext.defaultParallelism

    def rows(df):
        return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]

    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 17))
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= cores and rows(df) == [60_000]
        dealt = analyze.spread(df)
        assert len(rows(dealt)) >= cores and max(rows(dealt)) * cores <= 1.25 * 60_000
        assert sorted(dealt.collect()) == sorted(df.collect())
    finally:
        spark.conf.set(name, before)
    even = spark.range(0, 800, 1, 2 * cores)
    assert analyze.spread(even) is even
    empty = spark.range(0, 0, 1, cores)
    assert analyze.spread(empty).count() == 0
