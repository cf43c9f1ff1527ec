"""Text functions against plain Python on awkward and random strings."""

import random
import re
import sys
import time
import unicodedata
from itertools import accumulate

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmark.functions import clean, detect, verify
from veilmark.functions import fixed_values as fixed
from veilmark.functions.text import SPACE, ascii_digits, exact_round, running, running_max, slice_blocks, slice_text, text_blocks
from veilmark.sources.annotations import chunk_text

ODD = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\x00\x07\x7f") + [chr(c) for c in (
    0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFF11, 0x0663, 0x00E9, 0x0301, 0x1F600, 0xFB01, 0x00B2, 0x0915, 0x093E)]


def random_texts(count, alphabet, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)]


def run(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    return [r[1] for r in sorted(rows.select("i", column).collect())]


def test_cleaning_matches_python(spark):
    texts = random_texts(3000, ODD + list("aO0l1I2.") * 3, 1) + ["", "clean text", " lead", "trail\n", "a\n\n\n\nb"]

    def plain(text):
        text = unicodedata.normalize("NFKC", text)
        text = re.sub(r"(?<=\d)I(?=\d)", "1", re.sub(r"(?<=\d)[Ol](?=\d)", "0", text))
        text = re.sub(r"\n\n\n+", "\n\n", re.sub(r"(?:(?!\n)\s)+", " ", text))
        return "".join(c for c in text if c in "\t\n\r" or not (c < " " or c == "\x7f")).strip()

    assert run(spark, texts, clean.clean_text(F.col("text"))) == [plain(t) for t in texts]


def test_flat_cleaning_matches_python(spark):
    texts = random_texts(1000, [c for c in ODD if c not in "\x00\x07\x7f"] + list("ab.") * 5, 2)
    plain = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip() for t in texts]
    assert run(spark, texts, clean.clean_text(F.col("text"), preserve_structure=False)) == plain


def test_nfkc_leaves_no_character_behind(spark):
    every = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = ["".join(every[i:i + 40]) for i in range(0, len(every), 40)] + every[:0x3000] + ["e" + m for m in every[:0x2000]]
    assert run(spark, texts, clean.nfkc(F.col("text"))) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_foreign_digits(spark):
    assert run(spark, ["٣4५", "x²"], ascii_digits(F.col("text"))) == ["345", "x²"]


def test_spans_obey_the_rules(spark):
    pieces = ["9876543210", "+91-9876543210", "(415) 555-2671", "10.0.0.255", "1.2.3.4", "4532015112830366", "2345 6789 0123",
              "ABCDE1234F", "ABC1234567", "KA01 12345678901", "A1234567", "HDFC0123456", "joe@okaxis", "a.b@c.co", "560001",
              "29ABCDE1234F1Z5", "https://x.com/a?b=1@2", "password: Se1!", "pwd=::;", "user = bob", "login:x", "acct no. 123456789",
              "account number is 123456789012", "12/05/2024", "2024-01-15", "1.2.2024", "٣٤٥٦٧٨٩٠", "é", "का9876543210",
              "Ab12", "0.0.0.0", "999.1.1.1", "١٢٣.١.١.١"]
    rng = random.Random(7)
    glue = [" ", "", ",", "\n", ": ", "-", ".", "_", "x", "é", "ा", "😀", "²"]
    texts = ["".join(rng.choice(pieces) + rng.choice(glue) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    spans = F.transform(detect.regex_detect(F.col("text")), lambda d: F.struct(
        d["entity_type"], d["value"], d["start"], d["end"]))
    got = [[tuple(s) for s in row] for row in run(spark, texts, spans)]
    order = [name for name, _ in fixed.PATTERNS]
    unchecked = {"EMAIL", "URL", "DATE", "UPI_ID", "IFSC_CODE", "GST_NUMBER", "VOTER_ID", "PASSPORT", "PINCODE", "USERNAME"}
    for text, found in zip(texts, got):
        matches = {(n, m.group(), m.start(), m.end()) for n, p in fixed.PATTERNS for m in re.finditer(p, text)}
        assert set(found) <= matches and [order.index(f[0]) for f in found] == sorted(order.index(f[0]) for f in found)
        touches = lambda m, others: any(s <= m[2] < e or s < m[3] <= e for _, _, s, e in others)
        for i, kept in enumerate(found):
            assert not touches(kept, found[:i]), text
        for gone in matches - set(found):
            if gone[0] in unchecked:
                assert touches(gone, [f for f in found if order.index(f[0]) <= order.index(gone[0])]), (text, gone)


def test_spans_by_hand(spark):
    texts = {"mail a.b@c.co, ring 9876543210": [("EMAIL", 5, 13), ("PHONE", 20, 30)], "at 10.0.0.255": [("IP_ADDRESS", 3, 13)],
             "at 0.0.0.0 or 999.1.1.1": [], "4532015112830366": [("CREDIT_CARD", 0, 16)], "4532015112830367 x": [],
             "2345 6789 0123": [("AADHAAR", 0, 14)], "pwd=::;": []}
    spans = F.transform(detect.regex_detect(F.col("text")), lambda d: F.struct(d["entity_type"], d["start"], d["end"]))
    got = [[tuple(s) for s in row] for row in run(spark, list(texts), spans)]
    assert got == list(texts.values())


def test_many_spans_in_one_document(spark):
    text = " ".join(f"call 9{i:09d} or u{i}@x.org" for i in range(3000))
    (found,) = run(spark, [text], detect.regex_detect(F.col("text")))
    assert len(found) == 6000
    assert all(text[s.start:s.end] == s.value for s in found)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=200, max_size=200))
def test_round_is_exact(spark, values):
    values = values + [k / 20000 for k in range(1, 400)] + [0.15125, 2.675, 0.00005, 75.735]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double").coalesce(1)
    got = {r.i: (r.four, r.two) for r in rows.select(
        "i", exact_round(F.col("v"), 4).alias("four"), exact_round(F.col("v"), 2).alias("two")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (round(v, 4), round(v, 2)), v


def test_sentence_of(spark):
    texts = ["One. Two 9876543210 here! Three", "no end 9876543210", "x" * 400 + "9876543210" + "y" * 400, "a\n9876543210\nb"]
    at = F.locate("9876543210", F.col("text")) - 1
    assert run(spark, texts, verify.sentence_of(text_blocks(F.col("text")), at, at + 10)) == [
        "Two 9876543210 here!", "no end 9876543210", "x" * 300 + "9876543210" + "y" * 300, "9876543210"]


def test_chunks_cover_the_text_and_overlap(spark):
    rng = random.Random(3)
    texts = ["short text"] + ["  ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(50, 400))) for _ in range(40)]

    assert run(spark, ["short text"], chunk_text(F.col("text")))[0][0].chunk == "short text"
    for text, chunks in zip(texts[1:], run(spark, texts[1:], chunk_text(F.col("text")))):
        covered = 0
        for i, chunk in enumerate(chunks):
            words = chunk.chunk.split(" ")
            assert text[chunk.start:].split()[:len(words)] == words
            assert len(" ".join(words[:-1])) + 1 + len(words[-1]) <= fixed.CHUNK_CHARS + 1
            before = len(text[:chunk.start].split())
            assert before == (covered - fixed.CHUNK_OVERLAP_WORDS if i else 0)
            covered = before + len(words)
            following = text.split()[covered:covered + 1]
            assert not following or len(chunk.chunk) + 1 + len(following[0]) > fixed.CHUNK_CHARS
        assert covered == len(text.split())


def test_cuts_of_long_texts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab😀é\n", k=n)) for n in (0, 1, 4095, 4096, 4097, 9000, 20000)]
    for start, end in ((0, 10), (4090, 4100), (-5, 5), (4096, 8192), (100, 12400), (8999, 9200), (5, 3), (30000, 30010)):
        got = run(spark, texts, slice_blocks(text_blocks(F.col("text")), F.lit(start), F.lit(end)))
        assert got == [t[max(start, 0):max(end, 0)] for t in texts]
        assert got == run(spark, texts, slice_text(F.col("text"), F.lit(start), F.lit(end)))


def test_running_values(spark):
    rng = random.Random(4)
    lists = [[rng.randint(0, 99) for _ in range(n)] for n in (0, 1, 255, 256, 257, 3000)]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, x array<int>")
    got = rows.select("i", running(F.col("x"), lambda a, b: a + b).alias("s"), running(F.col("x"), F.greatest).alias("m"))
    for r in got.collect():
        assert r.s == list(accumulate(lists[r.i])) and r.m == list(accumulate(lists[r.i], max))


def test_running_maximum_and_islands_of_any_order(spark):
    rows = [(1, []), (2, [5]), (3, [1, 4, 4, 9]), (4, [3, 9, 2, 8, 12]), (5, [7, 1])]
    got = spark.createDataFrame(rows, "id int, xs array<int>").select("id", running_max(F.col("xs")).alias("m")).collect()
    assert {r.id: r.m for r in got} == {i: [max(xs[:j + 1]) for j in range(len(xs))] for i, xs in rows}
    spans = [(1, [(0, 9), (2, 3), (4, 6), (9, 11), (20, 22)]), (2, [(0, 2), (2, 5), (7, 8)]), (3, [(4, 6)]), (4, [(0, 5), (1, 6)])]
    cut = spark.createDataFrame(spans, "id int, d array<struct<start:int,end:int>>").select("id", detect.overlap_islands(F.col("d")).alias("i"))
    assert {r.id: [[(x.start, x.end) for x in island] for island in r.i] for r in cut.collect()} == {
        1: [[(0, 9), (2, 3), (4, 6)], [(9, 11)], [(20, 22)]], 2: [[(0, 2)], [(2, 5)], [(7, 8)]], 3: [[(4, 6)]], 4: [[(0, 5), (1, 6)]]}


def test_places_of_matches_in_a_text_with_control_characters(spark):
    shown = "x\x01 a@example.com \x01\x01 b@example.com"
    docs = spark.createDataFrame([(shown,), (shown.replace("\x01", ""),)], "t string")
    got = docs.select("t", detect.raw_matches(F.col("t"), ["EMAIL"]).alias("m")).collect()
    assert [[(m.value, r.t[m.start:m.end]) for m in r.m] for r in got] == [[("a@example.com",) * 2, ("b@example.com",) * 2]] * 2


def test_chunks_of_odd_texts(spark):
    """Against a plain walk over the words: any space, words over the limit, texts of space only, null."""
    rng, spaces = random.Random(5), [c for c in map(chr, range(sys.maxunicode + 1)) if re.match("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", SPACE) + "]", c)]
    assert spaces == [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]

    def gap():
        return "".join(rng.choices(spaces, k=rng.choice([1, 1, 1, 2, 5])))

    texts = [None, " " * 500, "", " " * 450, "x" * 451, "x" * 900 + " y", "é" * 440 + "  b ccccccccc d", "\U0001f600 " * 300]
    texts += [rng.choice(["", gap()]) + "".join("wé"[rng.random() < 0.1] * rng.choice([1, 4, 9, 60, 449, 451]) + gap() for _ in range(rng.randint(60, 200)))
              for _ in range(30)]

    def plain(text):
        if text is None or len(text) <= fixed.CHUNK_CHARS:
            return None if text is None else [(text, 0)]
        done, words, length = [], [], 0
        for m in re.finditer(r"\S+", text):
            if length + len(m[0]) > fixed.CHUNK_CHARS:
                done.append(words)
                words = words[-fixed.CHUNK_OVERLAP_WORDS:]
                length = sum(len(w) + 1 for w, _ in words)
            words = [*words, (m[0], m.start())]
            length += len(m[0]) + 1
        return [(" ".join(w for w, _ in c), c[0][1] if c else 0) for c in [*done, words]]

    got = run(spark, texts, chunk_text(F.col("text")))
    assert [c and [(x.chunk, x.start) for x in c] for c in got] == [plain(t) for t in texts]


def test_chunks_take_time_in_proportion_to_the_words(spark):
    """40 texts of 20,000 words: 143 s on 8 cores when the words were folded one by one."""
    texts = [" ".join("w" * (1 + (i * k) % 9) for i in range(20_000)) for k in range(1, 41)]
    run(spark, texts[:1], chunk_text(F.col("text")))
    begun = time.perf_counter()
    chunks = run(spark, texts, F.size(chunk_text(F.col("text"))))
    assert time.perf_counter() - begun < 15 and min(chunks) > 50
