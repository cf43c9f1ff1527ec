"""Language ID, quality rules, sanitisation, packing, repeats and near-duplicates against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilmark.llm import hashing, langid, neardup, packing, quality, repeats, sanitize
from veilmark.llm.common import arrow_batches, arrow_rows, stored

WORD = r"[^\x20\x09-\x0D]+"


def frame(spark, texts):
    return stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


# --- language ID

def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = langid.op1(spark, sf_dir).join(docs, "doc_id")
    assert got.count() == docs.count()
    assert got.filter("held_out").selectExpr("avg(cast(lang_pred = lang AS int))").first()[0] > 0.97
    assert got.filter("held_out != (crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2)").count() == 0
    assert got.filter("score not between 0 and 1").count() == 0


def test_kernel_counts_shared_grams():
    texts = ["the cat sat", "the dog sat on it", "le chat", "ab"]
    sets = [langid.grams(t) for t in texts]
    plain = [{f" {t} "[i:i + n] for n in range(1, 5) for i in range(len(t) + 3 - n)} for t in texts]
    model = langid.Model(sets, np.eye(4, dtype=np.float32), list("abcd"))
    for i, j in itertools.product(range(4), repeat=2):
        want = len(plain[i] & plain[j]) / (len(plain[i]) * len(plain[j])) ** 0.5
        assert model.kernel(sets)[i, j] == pytest.approx(want, abs=1e-6)
    assert langid.grams(None) is None and langid.grams("12 !?") is None
    assert langid.grams("A  b").tolist() == langid.grams("a 1 B").tolist()


def test_language_of_odd_rows(odd):
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(odd, langid.train(odd)).collect()}
    assert {(3, "und"), (4, "und"), (6, "und"), (5, "de")} <= got
    assert langid.train(odd.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


# --- quality rules

def plain_quality(text):
    words = re.findall(WORD, text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed)


def test_quality_counts(spark, odd):
    rng = random.Random(2)
    parts = ["a", "bé", "c#", "\n", " ", "\t", "\x1c", " ", "dup\n", "|", "a b c d e f ", "\r"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [None, ""]
    rows = frame(spark, texts).select("doc_id", quality.judged(F.col("text"), quality.without_labels()).alias("j")).select("doc_id", "j.*")
    for r in rows.collect():
        assert tuple(r)[1:7] == plain_quality(texts[r.doc_id])
        assert r.kept == (not r.base_failed)
    staged = odd.select(quality.judged(F.col("text"), quality.without_labels()).alias("j"))
    assert staged.count() == 9


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(4)
    for _ in range(40):
        scores, field = rng.normal(size=(6, 2)), quality.Field(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))

        def value(y, scores=scores, field=field):
            return field.first[y[0]] + scores[range(6), y].sum() + sum(field.transition[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=6), key=value)
        assert value(quality.viterbi(scores, field)) == pytest.approx(value(best))


def test_field_learns_the_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op3(spark, sf_dir).join(labels, "doc_id").filter("not base_failed")
    assert got.filter("quality = 1").selectExpr("avg(cast(kept AS int))").first()[0] > 0.97
    assert got.filter("quality = 0").selectExpr("avg(cast(kept AS int))").first()[0] < 0.2
    assert quality.train_field(docs, labels.limit(0)).emission[0].tolist() == [0.0, 1.0]
    assert quality.quality_stage(spark, docs, sf_dir).columns == docs.columns


# --- sanitisation

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and doubled % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def plain_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if plain_valid(k, m.group()))


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(6)
    parts = ["a", "b.", "@", "x@y.zz", ".", "-", "%", "1", "25", "0.", "255.1.", "4111 1111 1111 1111", "4111-1111-1111-1111 ", " ", "+1 ", "+",
             "(415) ", "555-0100", "é", "😀", "00012", "\n", "__", "9" * 17]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    texts += ["a" * 60000, "1" * 60000, "1." * 30000, "a@" + "b." * 20000 + "c", "+1" + "(" * 50000, "a@b" * 9000, "1 " * 30000, None, ""]
    rows = sanitize.digest(sanitize.annotate(frame(spark, texts)))
    for r in rows.collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id][:200]
        assert r.spans.startswith(want) and r.n_email == want.count("email:")


def test_terms_that_reveal_a_value(spark):
    rng = random.Random(8)
    common = [" ".join(rng.choice(["plain", "words", "here", "again", "other"]) for _ in range(12)) for _ in range(60)]
    secret = [f"{common[i]} Zaphod said: write to zb@heart.example.com, {i} times Zaphod" for i in range(4)]
    texts = common + secret + [f"{secret[0]} more", "nothing but Zaphod"]
    rows = sanitize.annotate(frame(spark, texts))
    got = {r.doc_id: r for r in sanitize.digest(rows).collect()}
    for i in range(60, 64):
        own = texts[i]
        names = [m.span() for m in re.finditer("Zaphod", own)]
        assert all(f"term:{a}:{b}" in got[i].spans for a, b in names)
        assert not any(f"term:{m.start()}:" in got[i].spans for m in re.finditer("plain|words", own))
    assert got[65].spans == "" and got[0].n_term == 0
    clean = {r.doc_id: r.t for r in rows.select("doc_id", sanitize.sanitized(rows).alias("t")).collect()}
    assert "zb@" not in clean[60] and "Zaphod" not in clean[60] and "[EMAIL]" in clean[60] and "[TERM]" in clean[60]
    assert clean[0] == texts[0]
    removed = rows.select("doc_id", sanitize.sanitized(rows, generalise=False).alias("t")).filter("doc_id = 60").first().t
    assert "TERM" not in removed and "Zaphod" not in removed


def test_terms_of_values_that_do_not_repeat(spark):
    rng = random.Random(18)
    common = [" ".join(rng.choice(["plain", "words", "here", "again", "other"]) for _ in range(40)) for _ in range(80)]
    far = "Li 7741 " + common[0]  # a short name and a number, far from the value
    texts = common + [f"{far} {common[i]} p{i}x@clinic.example.org" for i in range(4)] + [f"{common[5]} Li {common[6]}"]
    texts += [f"Ana {common[i]} {common[i + 1]} card 4111 11{i}" for i in range(3)]
    rows = sanitize.annotate(frame(spark, texts), everywhere=True)
    got = {r.doc_id: r.spans for r in sanitize.digest(rows).collect()}
    for i in range(80, 84):
        assert got[i].endswith("term:0:2,term:3:7")
    assert got[84] == f"term:{len(common[5]) + 1}:{len(common[5]) + 3}"
    assert all(got[i] == "" for i in [*range(80), 85, 86, 87])
    clean = {r.doc_id: r.t for r in rows.select("doc_id", sanitize.sanitized(rows).alias("t")).collect()}
    assert "Li" not in clean[84] and clean[80].startswith("[TERM] [TERM] ") and clean[0] == texts[0]


def test_replacing_islands(spark):
    text = "0123456789" * 900
    spans = [(2, 5, "[A]"), (4, 8, "[B]"), (8, 9, "[C]"), (4000, 8500, "[D]"), (8999, 9000, "[E]")]
    table = spark.createDataFrame([(text, spans), (text, [])], "text string, s array<struct<start:int,end:int,by:string>>")
    got = [r[0] for r in table.select(sanitize.replaced(F.col("text"), F.col("s"))).collect()]
    assert got == [text[:2] + "[A][C]" + text[9:4000] + "[D]" + text[8500:8999] + "[E]", text]


def test_sanitise_stage_of_odd_rows(spark, odd):
    got = sanitize.sanitize_stage(spark, odd, "")
    assert got.columns == odd.columns and got.count() == 9
    row = got.filter("doc_id = 2").first()
    assert "[PHONE]" in row.text and "[EMAIL]" in row.text and row.n_chars == len(row.text) and row.src == "clash"
    assert sanitize.sanitize_stage(spark, stored(odd.limit(0)), "").count() == 0


# --- packing

def test_tokens_are_the_tokenizers(spark):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "'s", "!", "　", "<|endoftext|>", "\x1c", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", " ", "  "]
    tokens = packing.Tokens(packing.vocabulary())
    assert tokens.ids(texts) == [tokens.encode([t or ""])[0] + bytes(4) for t in texts]


def test_tokens_are_those_of_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "é", "1", "'s", "<|endoftext|>", " <|endoftext|> ", "<|endof", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + ["x<|endoftext|>y", "<|endoftext|>", None]
    fresh = Tokenizer.from_file(packing.vocabulary())
    want = [np.asarray(fresh.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() + bytes(4) for t in texts]
    assert packing.Tokens(packing.vocabulary()).ids(texts) == want and np.uint32(50256).tobytes() in want[-2]


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2048): rng.randint(1, 60) for _ in range(rng.randint(1, 60))}
    runs, placed, inside = packing.plan(counts), Counter(), defaultdict(list)
    for x, rank, n, first, each, offset in runs.out:
        assert rank == placed[x]
        placed[x] += n
        for q in range(n):
            inside[first + q // each].append((offset + q % each * x, x))
    assert {x: n for x, n in placed.items() if n} == counts and len(inside) == runs.sequences
    for own in inside.values():
        at = 0
        for offset, x in sorted(own):
            assert offset == at
            at += x
        assert at <= 2048
    total = sum(x * n for x, n in counts.items())
    assert runs.sequences <= 1.25 * total / 2048 + 12


def test_packing_round_trip(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    cut = stored(packing.pieces(docs, keep_ids=True))
    got = packing.pack(cut).toPandas()
    tokens = packing.Tokens(packing.vocabulary())
    assert sum(got["piece"] == 0) == docs.count()
    for r in got.itertuples():
        assert r.length == len(r.ids) <= 2048 and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
    whole = {r.doc_id: tokens.ids([r.text])[0] for r in docs.filter("doc_id > 10").collect()}
    for doc, own in got[got["doc_id"] > 10].groupby("doc_id"):
        own = own.sort_values("piece")
        assert b"".join(np.asarray(i, "<u4").tobytes() for i in own["ids"]) == whole[doc]
        assert list(own["start"]) == [0, *own["length"].cumsum()[:-1]] and (own["length"][1:] == 2048).all()
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert list(own["offset"]) == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.1 * got["length"].sum() / 2048 + 8
    assert packing.packing_stage(spark, stored(odd.limit(0)), "").count() == 0


# --- long repeats

def plain_repeats(texts, length=400):
    seen = Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                gone[s] += 1
                gone[min(len(t), s + length)] -= 1
        mask = np.cumsum(gone)[:len(t)] > 0
        edges = int(np.sum(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out.append((len(t), int(mask.sum()), edges, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    shared = noise(1500)
    texts = [noise(rng.randint(0, 900)) + shared[(a := rng.randint(0, 900)):a + rng.randint(380, 620)] + noise(rng.randint(0, 500)) for _ in range(60)]
    texts += ["z" * 1000, "y" * 401, "xy" * 450, shared[:399], shared[:400], shared, shared, "", noise(3000)]
    texts += [noise(30) + shared[100:520] + noise(30) for _ in range(40)]
    want = plain_repeats([t.encode() for t in texts])
    for together in (repeats.TOGETHER, 5):  # small: most anchor strings take the counting way
        monkeypatch.setattr(repeats, "TOGETHER", together)
        rows = repeats.without_repeats(frame(spark, [*texts, None])).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            got = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
            assert got == (want[r.doc_id] if r.doc_id < len(texts) else (0, 0, 0, hashlib.sha256(b"").hexdigest()))


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 9000, dtype=np.uint8).tobytes()
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "PART", 1000)
    parts = repeats.anchors(text)
    windows = lambda a: {(p, w) for p, f, l in zip(*a[:3]) for w in range(f, l + 1)}
    assert windows(whole) == windows(parts) and {w for _, w in windows(whole)} == set(range(9000 - 399))


def test_family_of_suffix_arrays_matches_brute_force(monkeypatch):
    rng = random.Random(15)
    pool = [bytes(rng.randrange(97, 100) for _ in range(430)) for _ in range(7)]
    cells = [rng.choice(pool)[(a := rng.randint(0, 15)):a + rng.randint(400, 415)] for _ in range(40)]
    built, plain = [], repeats.Level.__init__
    monkeypatch.setattr(repeats.Level, "__init__", lambda self, *a: (plain(self, *a), built.append(self.batches))[0])
    found = repeats.repeated_windows(cells, [i % 8 for i in range(40)])
    windows = [c[s:s + 400] for c in cells for s in range(len(c) - 399)]
    seen = Counter(windows)
    assert found.tolist() == [seen[w] > 1 for w in windows]
    assert built == [1, 1, 2, 1, 1, 2, 4, 1, 1, 2, 1, 1, 2, 4, 8]


def test_repeats_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_bytes): r for r in repeats.without_repeats(odd).collect()}
    assert all(r.text.encode() == r.kept for r in rows.values())
    assert rows[7, 5000].spans[0].end == 5000 and rows[3, 0].kept == b"" and repeats.without_repeats(odd.limit(0)).count() == 0


# --- near-duplicates

def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def plain_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 85 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]

    def edited(words, rate):
        return " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in words)

    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        texts += [edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.04])) for _ in range(12)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(3, 40))]) for _ in range(60)]
    texts += ["a b", "A  b", "a b c d e", None, "", " \n", texts[0].upper(), texts[0], "b a"]
    want = plain_components(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in range(len(texts)))


def test_blocks_of_large_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    test_near_duplicates_match_brute_force(spark)


def test_every_close_pair_shares_an_entry():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype("<u2")
    two = one.copy()
    for row in two:
        row[rng.choice(neardup.SYMBOLS, neardup.DIFFER, replace=False)] ^= 1
    assert (neardup.entries(one) == neardup.entries(two)).any(1).all()


def test_components_of_a_long_chain(spark):
    links = spark.range(70).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 102), (102, 101)], "a long, b long"))
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(71)} | {100: 100, 101: 100, 102: 100}


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.neardup_stage(spark, odd, "")
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "6", "7", "None"]
    assert neardup.neardup_stage(spark, stored(odd.limit(0)), "").count() == 0


def test_stage_links_from_four_fifths_on(spark):
    rng = random.Random(23)
    words = [f"w{i}" for i in range(500)]
    one = [rng.choice(words) for _ in range(204)]
    texts = [" ".join(one), " ".join([*one[:-20], *(f"x{i}" for i in range(20))])]  # 180 shingles of 220: 0.82
    docs = frame(spark, texts)
    assert [neardup.near_duplicates(docs, law).filter("kept").count() for law in (neardup.OP10, neardup.STAGE)] == [2, 1]
    assert neardup.neardup_stage(spark, docs, "").count() == 1
    signs = np.random.default_rng(5).integers(0, 1 << 16, (300, neardup.SYMBOLS)).astype("<u2")
    other, law = signs.copy(), neardup.STAGE
    for row in other:
        row[np.random.default_rng(int(row[0])).choice(neardup.SYMBOLS, law.differ, replace=False)] ^= 1
    assert (neardup.entries(signs, law.chunks) == neardup.entries(other, law.chunks)).any(1).all()


def test_near_copies_with_null_or_shared_ids(spark):
    rng = random.Random(21)
    one, two = ([f"w{rng.randint(0, 999)}" for _ in range(150)] for _ in range(2))
    rows = [(None, " ".join(one)), (4, " ".join([*one[:-1], "end"])), (7, " ".join(two)), (7, "another text of the same id"),
            (8, " ".join([*two[:-1], "end"]))]
    got = neardup.near_duplicates(stored(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("4", 146, 4), ("7", 2, 7), ("7", 146, 7), ("8", 146, 7), ("None", 146, 4)]


def test_word_hashes_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 91}\t" for i in range(4000)).encode()
    whole = hashing.word_hashes(text)
    monkeypatch.setattr(hashing, "PART", 512)
    assert (hashing.word_hashes(text) == whole).all() and len(set(whole.tolist())) == 91


def test_a_cut_through_a_character_leaves_valid_text(spark):
    same = "q" * 399 + "\u00e9"  # the last byte of the repeated string is half of a character
    got = repeats.without_repeats(frame(spark, [same + "one", "q" * 399 + "\u00ea" + "two"])).collect()
    assert all(r.kept[0] >= 0x80 and r.text in ("one", "two") for r in got)


def chained_text(rng, good, bad):
    """Lines with their labels: a boilerplate head and foot around sentences, or the other way round."""
    def menu():
        return " | ".join(f"{rng.choice(['Home', 'Login', 'Cart', 'Help'])}{rng.randint(0, 999)}" for _ in range(4)) + " >>>"

    def plain():
        return " ".join("".join(rng.choices("aeinorst", k=rng.randint(3, 8))) for _ in range(rng.randint(9, 16))) + "."

    head = [(menu(), 0) for _ in range(bad)]
    return [*head, *((plain(), 1) for _ in range(good)), *((menu(), 0) for _ in range(bad))]


def test_heads_and_feet_are_told_from_the_lines_between(spark):
    """The field is fitted on one label a document, yet labels change inside a text."""
    rng = random.Random(12)
    texts, labels, truth = [], [], []
    for i in range(240):
        fine = i % 3 > 0
        lines = chained_text(rng, 14 if fine else 2, 2 if fine else 9)
        texts.append("\n".join(t for t, _ in lines))
        truth.append([y for _, y in lines])
        labels.append((i, int(fine)))
    docs = frame(spark, texts)
    field = quality.train_field(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    right = total = 0
    for i in range(0, 240, 7):
        got = quality.read_text(texts[i].encode())
        if got.base_failed:
            continue
        found = quality.viterbi(np.asarray(got.features) @ field.emission, field)
        right += sum(a == b for a, b in zip(found, truth[i]))
        total += len(truth[i])
        share = quality.content_share(got, field)
        assert 0 < share < 1 and (share >= 0.5) == bool(labels[i][1])
    assert total > 300 and right / total > 0.97


def test_field_maximises_the_likelihood():
    """Against the likelihood by enumeration of all labellings of short chains."""
    rng = np.random.default_rng(3)
    chains = [rng.random((n, quality.FEATURES)) for n in (1, 2, 3, 4, 4, 3)]
    labels = [rng.integers(0, 2, len(c)) for c in chains]
    field = quality.fit_field(chains, labels)

    def loss(emission, transition, first):
        total, lines = 0.0, sum(len(c) for c in chains)
        for c, y in zip(chains, labels):
            def score(path, c=c):
                return first[path[0]] + sum((c[i] @ emission)[k] for i, k in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))
            every = [score(p) for p in itertools.product((0, 1), repeat=len(c))]
            total += np.logaddexp.reduce(every) - score(tuple(y))
        return total / lines + quality.RIDGE / 2 * (np.sum(emission ** 2) + np.sum(transition ** 2) + np.sum(first ** 2))

    best = loss(field.emission, field.transition, field.first)
    for _ in range(40):
        e, t, f = (0.05 * rng.normal(size=a.shape) for a in (field.emission, field.transition, field.first))
        assert loss(field.emission + e, field.transition + t, field.first + f) > best - 1e-3


def test_large_sets_just_below_the_border_are_not_linked():
    """A million shingles: on 32 bits chance matches would lift the pair over the border."""
    rng = np.random.default_rng(2)
    n, shared = 1_000_000, 918_700  # 918700 / 1081300 = 0.8496
    pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
    rng.shuffle(pool)
    one, two = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n:2 * n - shared]]))
    assert not neardup.similar(n, n, one.astype("<u8").tobytes(), two.astype("<u8").tobytes())
    more = np.sort(np.concatenate([pool[:919_000], pool[n:2 * n - 919_000]]))
    assert neardup.similar(n, n, one.astype("<u8").tobytes(), more.astype("<u8").tobytes())


def test_quality_of_odd_rows_and_empty_tables(spark, odd):
    field = quality.without_labels()
    assert odd.limit(0).select(quality.judged(F.col("text"), field).alias("j")).count() == 0
    judged = odd.select("doc_id", quality.judged(F.col("text"), field).alias("j")).collect()
    assert len(judged) == odd.count() and not any(r.j.kept for r in judged if r.doc_id in (3, 4, 6))


def test_words_encoded_together_have_their_own_tokens():
    encoder = packing.Tokens(packing.vocabulary())
    words = ["plain", "don't", "a\tb", "x\n\ny", "é中文", "Ġ", "\x01", "12-34", "--"] * 40 + [f"w{i}" for i in range(300)]
    assert encoder.encode_words(words) == encoder.encode([" " + w for w in words])
    assert encoder.encode_words([]) == []


def test_texts_reach_the_tokenizer_in_small_batches(spark, monkeypatch):
    """Whole batches of 10,000 long texts on either side of Python were too much for an executor."""
    def sizes(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    docs = stored(spark.range(3000).selectExpr("id AS doc_id", "'a text' AS text").coalesce(1))
    monkeypatch.setattr(packing, "pieces", lambda d: arrow_rows(d, sizes, "n long"))
    monkeypatch.setattr(packing, "pack", lambda cut: cut)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r.n for r in packing.packing_stage(spark, docs, "").collect()]
    assert sum(got) == 3000 and max(got) <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    with pytest.raises(ValueError), arrow_batches(spark, 7):
        raise ValueError
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
