"""Information-theoretic sanitisation of personal data, in built-in column functions only.

Four kinds of value are found by pattern (``KINDS``) and always go. Beyond them the corpus tells which terms reveal a protected value c: an email
address, IP address, card or phone number, or a class of such values (:func:`_entities`: domain and name of an address, block of an IP address, prefix of a
card or phone number), through which values that do not repeat are estimated. A term is a run of letters or of numbers of any length, case ignored, outside
of the values. With N documents, n(c) that hold c, n(t) that hold t and n(c, t) that hold both, a term discloses

    PMI(c; t) = log2(N n(c, t) / (n(c) n(t)))    of    IC(c) = log2(N / n(c)).

Where n(c, t) comes from at least ``SUPPORT`` different texts and PMI is at least ``DISCLOSURE`` times IC, every occurrence of t is a span of kind ``term``:
in the documents that hold c too, or in all documents (``everywhere``, as in op5 and the pipeline). Values are replaced by their kind; terms are
generalised to ``[TERM]`` or removed (``generalise=False``). A value that neither repeats nor has a class that does reveals nothing to be estimated.
A script without spaces gives terms as long as its runs of letters.

Null text counts as empty. Repeated rows are sanitised alike; exact copies raise no support. An empty table gives an empty result, other columns are left
alone. Patterns hold no nested repetition, so long texts neither overflow the stack nor take more than linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import let, running, slice_blocks, text_blocks
from veilmark.llm.common import read, stored

SUPPORT, DISCLOSURE = 3, 0.8
TERM = r"[\p{L}\p{M}]++|\p{N}++"
SALTS, BITS = 16, 1 << 20
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# kind: (pattern, what a text must hold). Written so that a match starts where a run starts, or where the last match ended.
KINDS = {
    "email": (rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@(?=[{LABEL}]++\.[{LABEL}])(?:(?!\.(?![{LABEL}]))[{LABEL}.])+", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
SPAN = "array<struct<value:string,start:int,end:int>>"


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A costly column generated in one step, as before; projected first, the check tool found more disk than the budget."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"\A(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Matches of a pattern with their offsets in code points, from the lengths of matches and of the gaps between them."""
    none = F.array().cast(SPAN)

    def place(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
        ends = running(F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v)), lambda a, b: a + b)
        spans = F.zip_with(values, ends, lambda v, e: F.struct(v.alias("value"), (e - F.length(v)).alias("start"), e.alias("end")))
        return F.when(F.size(values) > 0, spans.cast(SPAN)).otherwise(none)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)
    return found if needs is None else F.when(needs, found).otherwise(none)


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """Struct of the valid spans of each kind."""
    columns = []
    for kind, (pattern, needs) in KINDS.items():
        gate = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9][0-9\x20-]{15}")
        columns.append(_checked(kind, located(text, pattern, gate)).alias(kind))
    return F.struct(*columns)


def _entities(kind: str, value: Column) -> Column:
    """A value and its classes, which hold other values too."""
    plain = value if kind == "ip" else F.lower(value) if kind == "email" else _digits(value)
    if kind == "email":
        classes = {"domain": F.substring_index(plain, "@", -1), "name": F.regexp_extract(plain, "^[^a-z]*([a-z]+)[^@]*@", 1)}
    elif kind == "ip":
        classes = {f"block{n}": F.substring_index(plain, ".", n) for n in (1, 2, 3)}
    else:
        classes = {f"prefix{n}": F.substring(plain, 1, n) for n in ((4, 6) if kind == "card" else (4, 7))}
    named = [F.concat(F.lit(f"{kind}:"), plain), *(F.when(c != "", F.concat(F.lit(f"{kind} {k}:"), c)) for k, c in classes.items())]
    return F.array_compact(F.array(*named))


def terms_of(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _key(row: list[str]) -> Column:
    return F.xxhash64(*row)


def found(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, keep, text, _key, _base): the rows with their valid spans."""
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"), _key(["doc_id", "text"]).alias("_key"))
    return with_once(rows, "_base", base_spans(F.col("text")))


def _any(base: str = "_base") -> Column:
    return F.size(F.concat(*[F.col(f"{base}.{k}") for k in KINDS])) > 0


def holders(rows: DataFrame) -> DataFrame:
    """(_key, h, cs, terms, inside) of the rows with values: text hash, values and classes, terms outside of values, terms in values only."""
    def entities(kind: str) -> Column:
        return F.flatten(F.transform(F.col(f"_base.{kind}"), lambda s: _entities(kind, s["value"])))

    of_kind = [entities(k) for k in KINDS]
    spans = F.concat(*[F.transform(F.col(f"_base.{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("by")))
                       for k in KINDS])
    own = rows.filter(_any()).select("_key", "text", F.xxhash64("text").alias("h"), F.array_distinct(F.concat(*of_kind)).alias("cs"),
                                     F.array_sort(spans).alias("spans"))
    own = with_once(own, "terms", terms_of(replaced(F.col("text"), F.col("spans"))))
    return own.select("_key", "h", "cs", "terms", F.array_except(terms_of(F.col("text")), "terms").alias("inside"))


def disclosing(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(c, t, disclosure) of the terms to sanitise; ``held`` is stored :func:`holders`."""
    texts = stored(held.groupBy("h").agg(F.count("*").alias("n"), F.first("cs").alias("cs"), F.first("terms").alias("terms")))
    of_text = texts.select("h", "n", "terms", F.explode("cs").alias("c"))
    values = stored(of_text.groupBy("c").agg(F.sum("n").alias("n_c"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).drop("texts"))
    dealt = values.select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    of_text = of_text.withColumn("salt", F.pmod("h", F.lit(SALTS).cast("long"))).join(dealt, ["c", "salt"])
    both = of_text.select("c", "n", F.explode("terms").alias("t")).groupBy("c", "t").agg(F.sum("n").alias("n_ct"), F.count("*").alias("texts"))
    both = stored(both.filter(F.col("texts") >= SUPPORT).drop("texts").join(values, "c"))
    each = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("t"), F.lit(1).alias("n"))
    n_t = each.union(held.select(F.explode("inside"), F.lit(-1))).groupBy("t").agg(F.sum("n").alias("n_t"))
    total = docs.count()
    pmi = F.log2(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    ic = F.log2(F.lit(float(total)) / F.col("n_c"))
    both = both.join(n_t, "t")
    return both.filter((ic > 0) & (pmi >= DISCLOSURE * ic)).select("c", "t", (pmi / ic).alias("disclosure"))


def _able(values: DataFrame):
    """A test that all ``values`` (one column) pass and few others do: one of ``BITS`` bits by hash. Only the bits reach the driver."""
    place = lambda v: F.pmod(F.xxhash64(v), F.lit(BITS)).cast("int")
    bits = values.select(place(F.col(values.columns[0])).alias("p")).select(F.expr("p div 32").alias("w"), F.expr("shiftleft(1L, p % 32)").alias("b"))
    words = ["0"] * (BITS // 32)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r.w] = str(r.b)
    table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")
    return lambda v: F.getbit(F.get(table, F.floor(place(v) / 32).cast("int")), place(v) % 32) == 1


def annotate(docs: DataFrame, keep: list[str] | None = None, everywhere: bool = False) -> DataFrame:
    """(doc_id, keep, text, _key, _base, _terms): valid spans of each kind, and the spans of disclosing terms."""
    rows = found(docs, keep or [])
    held = stored(holders(rows))
    revealing = stored(disclosing(docs.select("text"), held).select("c", "t"))
    if everywhere:
        terms = stored(revealing.select("t").distinct())
        plain = docs.select(_key(["doc_id", "text"]).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
        of_doc = plain.select("_key", F.explode(F.filter(terms_of(F.col("text")), _able(terms))).alias("t")).join(terms, "t")
    else:
        of_doc = held.select("_key", F.explode("cs").alias("c"), "terms").select("_key", "c", F.explode("terms").alias("t")).join(revealing, ["c", "t"])
    of_doc = stored(of_doc.groupBy("_key").agg(F.collect_set("t").alias("_reveal")))
    holds = _able(of_doc.select("_key"))(F.col("_key"))
    plain = rows.filter(~holds).withColumn("_reveal", F.lit(None).cast("array<string>"))
    rows = plain.unionByName(rows.filter(holds).join(of_doc, "_key", "left"))
    base = F.concat(*[F.col(f"_base.{k}") for k in KINDS])
    terms = F.filter(located(F.col("text"), TERM, F.col("_reveal").isNotNull()), lambda s: F.array_contains("_reveal", F.lower(s["value"])))
    terms = F.filter(terms, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return with_once(rows, "_terms", terms).drop("_reveal")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digest(rows: DataFrame) -> DataFrame:
    base = [_named(k, F.col(f"_base.{k}")) for k in KINDS]
    return rows.select(
        "doc_id", *[F.size(f"_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.size("_terms").cast("long").alias("n_term"),
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, _named("term", F.col("_terms"))), ",").alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """Text with each island of overlapping spans (start, end, by), sorted by start, replaced by what its first span says."""
    def cut(blocks: Column, s: Column, reach: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["by"].alias("by"), i.alias("i"), (
            (i == 0) | (x["start"] >= F.get(reach, i - 1))).alias("new"))), lambda x: x["new"])
        return let(heads, lambda h: F.concat(F.array_join(F.transform(h, lambda x, j: F.concat(
            slice_blocks(blocks, F.when(j == 0, F.lit(0)).otherwise(F.get(reach, x["i"] - 1)), x["start"]), x["by"])), ""),
            slice_blocks(blocks, F.element_at(reach, -1), F.length(text))))

    changed = let(text_blocks(text), lambda b: let(spans, lambda s: let(
        running(F.transform(s, lambda x: x["end"]), F.greatest), lambda reach: cut(b, s, reach))))
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def sanitized(rows: DataFrame, generalise: bool = True) -> Column:
    """Text of :func:`annotate`'s rows with values replaced and terms generalised or removed."""
    def tagged(spans: Column, by: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(by).alias("by")))

    spans = F.concat(*[tagged(F.col(f"_base.{k}"), f"[{k.upper()}]") for k in KINDS],
                     tagged(F.col("_terms"), "[TERM]" if generalise else ""))
    return replaced(F.col("text"), F.array_sort(spans))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(annotate(read(spark, sf_dir, "documents").select("doc_id", "text"), everywhere=True))


def sanitize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with sanitised texts; ``n_chars``, where it is a column, is counted anew."""
    rest = {c: f"_rest{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = annotate(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(x) for c, x in rest.items()]), list(rest.values()), True)
    rows = with_once(rows, "_clean", sanitized(rows))
    columns = {c: F.col(x) for c, x in rest.items()} | {"doc_id": F.col("doc_id"), "text": F.col("_clean")}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("_clean").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in docs.columns])
