"""Operators of reelshelf.llm against plain versions, on small inputs with all odd cases."""

import collections
import functools
import hashlib
import os
import random
import re

import brute
import pytest
from pyspark.sql import functions as F
from reelshelf.llm import bpe, chat, components, htmltext, jaccard, langid, mixing, quality, sharding, suffixes, syncmers

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have them, too.
EXTRA = ("id", "key", "at", "kind", "runs", "ids", "line", "token", "part", "host", "m", "size", "draw")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéoß") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [None, "", " \n\t", "x", "a b c", "no letters 123", "12 !?", *base, base[0], base[0].upper(), "\n".join([base[1]] * 3)]
    for _ in range(12):
        words = rng.choice(base).split(" ")
        words[rng.randrange(60)] = word()
        texts.append(" ".join(words))
    texts += [base[2] + "\n" + base[3], " ".join(word() for _ in range(9000)), "w" * 5000, "é" * 333, "ab" * 400]
    rows = [(i * 7 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[8], rows[8], (None, base[3] + " more words", "en", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(odd_rows(), SCHEMA)
    return plain.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(EXTRA)]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is not None, row[0] or 0, *map(str, row[1:]))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


# --- 1
@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def library(text):
    t = tokenizer()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tokens_equal_the_library(docs, empty):
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids, decoded = library(text)
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    got = rows_of(bpe.token_digests(docs, WORDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(expected, key=key)
    assert bpe.token_digests(empty, WORDS).count() == 0


def test_tokens_of_random_pieces():
    rng = random.Random(2)
    pieces = ["a", "the", "ing", "İ", "Σ", "ς", "é", "é", " ", "\n", "\x1c", "\x85", "<|endoftext|>", "'s", "'LL", "1", "!!", "😀", "한", " ", "\x00", "<|", "x" * 50]
    digests = bpe.Digests(bpe.vocabulary(WORDS))
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        ids, decoded = library(text)
        assert digests.of(text, block=rng.choice((3, 10, 1 << 18))) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_transducer_holds_a_window_only():
    v = bpe.vocabulary(WORDS)
    t = bpe.Transducer(v)
    word = ("abchtinger" * 3000).encode()
    held, got, read = 0, [], 0

    def symbols():
        nonlocal read
        for i, b in enumerate(word):
            read += 1
            yield b + (256 if i == len(word) - 1 else 0)

    done = 0
    for out in t.stream(symbols()):
        got += out
        done += sum(v.width[x] for x in out)
        held = max(held, read - done)
    assert held <= 3 * (v.lookahead + v.longest) and got == library(word.decode())[0]


def test_long_words_take_little_memory():
    """A word of 2 MB, with all that is made of it, within some copies of it."""
    import tracemalloc

    digests = bpe.Digests(bpe.vocabulary(WORDS))
    word = "".join(random.Random(1).choice("abchtinger") for _ in range(50_000)) * 40
    digests.of("warm up the tables " + word[:10_000])
    tracemalloc.start()
    n, *_ = digests.of(word.encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 8 * len(word)


def test_long_pieces_equal_the_library():
    rng = random.Random(8)
    digests = bpe.Digests(bpe.vocabulary(WORDS))
    for pieces in (["ab", "the", "ing"], ["ab", "!", "7"], ["É", "ß", "ing", "<|endoftext|>"]):
        text = "".join(rng.choice(pieces) for _ in range(9000))
        text = f"{text} and  {text[:5000]}\x0b{text[:100]}"
        ids, decoded = library(text)
        assert digests.of(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
        assert list(bpe.Encoder(bpe.vocabulary(WORDS)).encode(text)) == ids


def test_plain_round_trip(spark):
    texts = ["the cat sat", "", None, "naïve 😀 text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    back = bpe.decode_documents(bpe.encode_documents(df, WORDS).drop("text"), WORDS).orderBy("doc_id").collect()
    assert [r.text.strip() for r in back] == ["the cat sat", "", "", "naïve 😀 text"]
    machine = bpe.Decoder(bpe.vocabulary(WORDS), plain=True)
    halves = [i for i, span in bpe.vocabulary(WORDS).spans.items() if span == (0xC3,)]
    assert machine.feed(halves) == "" and machine.end() == "�"


# --- 2
def test_languages(spark, docs, empty):
    rng = random.Random(4)
    sounds = {"aa": ["tion", "ing", "the", "er"], "bb": ["sch", "keit", "ung", "ei"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        rows.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40))), lang))
    rows += [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "жжж", None), (None, "tioning the", None)]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r for r in got}
    import zlib

    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows[:300])
    assert (by_id[1000].lang_pred, by_id[1001].lang_pred, by_id[None].lang_pred) == ("und", "und", "aa")
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict_languages(docs).count() == docs.count()
    assert langid.predict_languages(empty).count() == 0
    nothing = langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_accuracy_on_held_out_rows(spark):
    """0.995 of the labelled rows that were not learned from, at the time of writing."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict_languages(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    right, rows = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert rows > 100 and right >= 0.98 * rows


def test_phrases_are_longest_matches():
    rng = random.Random(7)
    train = "".join(rng.choice("abc ") for _ in range(80))
    model = langid.Model({"x": [train], "y": ["".join(rng.choice("abd ") for _ in range(80))]})
    for n in (0, 1, 30, 200):
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, n))) for _ in range(40)]
        coded = [model._codes_of(t) for t in texts]
        known = f" {' '.join(langid.words_of(train))} "
        for codes, (x, _) in zip(coded, model._phrases(coded)):
            letters = {v: k for k, v in model.code.items()} | {0: "?"}
            text = "".join(letters[c] for c in codes)
            count, at = 0, 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in known:
                    size += 1
                if text[at] not in known:
                    size = 1
                at, count = at + size, count + 1
            assert x == count


def test_sample_is_bounded_where_an_id_repeats(spark):
    import zlib

    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(free[0], f"text of number {i}", "aa") for i in range(3 * langid.ROWS)] + [(i, "another one", "bb") for i in free[:3]] + [(None, "none", "bb")]
    found = langid.training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert (len(found["aa"]), len(set(found["aa"])), found["bb"]) == (langid.ROWS, langid.ROWS, ["another one"] * 3)


def test_languages_with_many_letters():
    """More letters than a table has columns: Han and Hangul are told apart, and an unlearned script matches none."""
    rng = random.Random(6)
    han, hangul, latin = ([chr(a + 7 * i) for i in range(n)] for a, n in ((0x4E00, 900), (0xAC00, 900), (0xC0, 20)))
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(3)) for _ in range(n))
    kinds = {"ja": han[:500], "ko": hangul, "xx": latin, "zh": han[400:]}
    train = {lang: [text(letters, 2000)] for lang, letters in kinds.items()}
    model = langid.Model(train)
    texts = [(lang, text(letters, 40)) for lang, letters in kinds.items() for _ in range(8)]
    assert [p for p, _ in model.predict([t for _, t in texts])] == [lang for lang, _ in texts]
    assert [model.predict([t])[0][0] for _, t in texts] == [lang for lang, _ in texts]  # the way of few texts
    known = {lang: f" {' '.join(langid.words_of(t[0]))} " for lang, t in train.items()}
    some = [*(t for _, t in texts), text([chr(0x1200 + i) for i in range(60)], 10)]
    for t, counts in zip(some, model._phrases([model._codes_of(t) for t in some])):
        plain = "".join(f" {w}" for w in langid.words_of(t))
        for lang, found in zip(model.automata, counts):
            at = count = 0
            while at < len(plain):
                size = 1
                while at + size < len(plain) and plain[at : at + size + 1] in known[lang]:
                    size += 1
                at, count = at + size, count + 1
            assert found == count


# --- 3
def test_suffixes(docs, empty):
    expected = brute.suffix_digests({(r[0], r[1]) for r in odd_rows()})
    expected += [e for e in expected if e[0] == odd_rows()[8][0]] * 2
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(suffixes.suffix_digests(docs), *columns) == sorted(expected, key=key)
    assert suffixes.suffix_digests(empty).count() == 0
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_suffixes_of_edited_passages(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 700))) for _ in range(8)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(1, 3)):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, 4) if b else 0):
                b[rng.randrange(len(b))] = rng.choice("XYZ ")
            at = rng.randint(0, len(b))
            text += "".join(rng.choice((b, b[at:], b[:at])))
        rows.append((i, text))
    got = rows_of(suffixes.suffix_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), "*")
    assert got == sorted(brute.suffix_digests(rows), key=key)


def test_texts_longer_than_a_chunk_lose_no_window(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "CHUNK", 700)
    texts = ["".join(random.Random(i).choice("abcd") for _ in range(n)) for i, n in enumerate((0, 99, 100, 5000, 650, 1400))]
    seen = collections.Counter()
    for data, ends, rows, places in suffixes._chunks(pa.record_batch({"text": pa.array(texts)})):
        for begin, end, row, place in zip(np.concatenate([[0], ends[:-1]]), ends, rows, places):
            assert bytes(data[begin:end]).decode() == texts[row][place : place + end - begin]
            seen.update((int(row), int(place) + k) for k in range(end - begin - suffixes.WIDTH + 1))
    assert seen == collections.Counter((i, k) for i, t in enumerate(texts) for k in range(len(t) - 99))


# --- 4
def test_quality(spark, docs, empty):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    rows = [(i, f"Line {i} about it here\nSee also OUR terms {i}, please do read them all\n" + "own words " * 2 + f"w{i}", "h") for i in range(8)]
    rows += [(100 + i, t, s) for i, (t, s) in enumerate([("a # b $ c % d <e> f g h i j", None), ("see also our terms 5, please do read them all", "g"), (rows[0][1], "h")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit, least in ((3, 70), (3, 20), (100, 50)):
        assert rows_of(quality.quality_rules(df, limit, least), *columns) == sorted(brute.quality(rows, limit, least), key=key)
    plain = [(r[0], r[1], r[3]) for r in odd_rows() if len(r[1] or "") < 20_000]
    small = docs.filter("text IS NULL OR length(text) < 20000")
    assert rows_of(quality.quality_rules(small, 2, 50), *columns) == sorted(brute.quality(plain, 2, 50), key=key)
    assert quality.quality_rules(empty).count() == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == quality.quality_rules(docs).filter("kept").count()


def test_lines_count_by_true_documents(spark):
    """Templated hosts: whichever line has the least digest, shared lines are held by all pages; copies count once."""
    rows, frequent = [], {}
    for h in range(8):
        shared = [f"template {'abcdefgh'[h]} {'klmnop'[k]} of every page" for k in range(6)]
        pages, copies = (6, 5) if h % 2 else (5, 6)
        for i in range(pages):
            text = "\n".join([*shared, f"own line {'qrstuvwxyz'[i]}"])
            rows += [(len(rows) + c, text if c % 2 else text.upper() + "  ", f"h{h}") for c in range(copies)]
        frequent[f"h{h}"] = pages > 5
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), 5, 20).collect()
    by_id = {r.doc_id: r for r in got}
    for doc_id, _, source in rows:
        assert by_id[doc_id].removed_words == (36 if frequent[source] else 0), source
        assert by_id[doc_id].kept == (not frequent[source] and not by_id[doc_id].base_failed)
    # counting documents by the least digest among their lines would give other removed words here
    expected = {r[0]: r[7] for r in brute.quality(rows, 5, 20)}
    assert {r.doc_id: r.removed_words for r in got} == expected
    least = collections.defaultdict(set)
    for _, text, source in rows:
        norm = [x.strip().lower() for x in text.split("\n")]
        for x in norm:
            least[source, x].add(min(hashlib.md5(y.encode()).hexdigest() for y in norm))
    assert any(len(least[s, t.split("\n")[0].strip().lower()]) <= 5 for _, t, s in rows if frequent[s])


# --- 5
def test_turns_come_back(spark):
    rng = random.Random(9)
    pieces = ["\\", "###", "### ", "</turn>", " </turn>\n", "\n", ":", ": ", "a", "-", "h", "t", "c", "é", "😀", "#"]
    text = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randint(0, n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b"]), rng.choice([None, text(12)])) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (1, 0, "user", "again")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    turns = collections.defaultdict(list)
    for c, t, role, said in rows:
        turns[c].append((t is not None, t or 0, role or "user", said or ""))
    assert set(got) == set(turns)
    for c, found in turns.items():
        found.sort()
        learnt = "".join(x[3] for x in found if x[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(found), sha("".join(f"{x[2]}\n{x[3]}\n" for x in found)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))


def test_layouts(spark):
    kind = "id int, layout string, rec struct<prompt:string,completion:string,instruction:string,input:string,output:string,conversations:array<struct<from:string,value:string>>>"
    rows = [
        (1, "x", ("p", "c", None, None, None, None)), (2, "x", (None, None, "i", None, "o", None)), (3, "x", (None, None, "i", "n", "o", [])),
        (4, "x", (None, None, None, None, None, [("human", "q"), None, ("gpt", None)])), (5, "x", ("p", None, None, None, None, None)), (6, "x", None),
    ]
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in chat.format_records(spark.createDataFrame(rows, kind), "rec").collect()}
    assert got == {
        1: [("user", "p"), ("assistant", "c")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "i"), ("user", "n"), ("assistant", "o")],
        4: [("user", "q"), ("assistant", "")], 5: None, 6: None,
    }
    unknown = chat.unknown_layouts(spark.createDataFrame(rows, kind), "rec").collect()
    assert sorted(r.rows for r in unknown) == [1, 1]
    empty = spark.createDataFrame([], kind)
    assert chat.format_records(empty, "rec").count() == chat.unknown_layouts(empty, "rec").count() == 0


def test_nested_layouts(spark):
    """Paths into structs, parts of a message's content, and fields that no mapping names."""
    kind = "id int, rec struct<id:string,meta:struct<prompt:string>,data:struct<prompt:string,completion:string>>"
    rows = [(1, ("x7", ("not this",), ("p", "c"))), (2, ("x8", None, None)), (3, None)]
    found = chat.format_records(spark.createDataFrame(rows, kind), "rec").collect()
    assert {r.id: r.turns and [tuple(t) for t in r.turns] for r in found} == {1: [("user", "p"), ("assistant", "c")], 2: None, 3: None}
    kind = "id int, turns string, rec struct<id:string,messages:array<struct<role:string,content:array<struct<type:string,text:string>>>>>"
    rows = [(1, "x", ("x7", [("user", [("text", "a"), ("image", None), ("text", "b")]), None, ("gpt", None), (None, [])])), (2, "x", ("x8", None))]
    found = chat.format_records(spark.createDataFrame(rows, kind), "rec").collect()
    assert {r.id: r.turns and [tuple(t) for t in r.turns] for r in found} == {1: [("user", "ab"), ("assistant", ""), ("user", "")], 2: None}
    kind = "id int, rec struct<id:string,prompt:string,completion:string,input:string>"
    found = chat.format_records(spark.createDataFrame([(1, ("x", "p", "c", "more"))], kind), "rec").first()
    assert [tuple(t) for t in found.turns] == [("user", "p"), ("assistant", "c")]
    # a mapping of one's own, on fields two levels down
    mine = [[("a.b.who", "a.b.q")]]
    deep = spark.sql("SELECT named_struct('a', named_struct('b', named_struct('q', 'hello', 'who', 'human'))) AS rec")
    assert [tuple(t) for t in chat.canonical_turns(deep, "rec", mine).first().turns] == [("user", "hello")]


def test_digests_of_odd_conversations(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    clash = rows.select("*", *[F.lit("x").alias(c) for c in ("m", "record", "layout", "turns", "d", "f")])
    got = chat.chat_digests(clash).collect()
    assert [(r.n_turns, r.turns_sha256) for r in got] == [(3, sha("user\n\nuser\na\nuser\na\n"))]
    assert chat.chat_digests(rows.limit(0)).count() == 0


# --- 6
def test_mix(spark, docs, empty):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == docs.count() and all(r.taken == r.size * r.copies and r.taken <= 2 * r.size for r in plan)
    sizes = {r.target: r.source_size for r in plan}
    total = sum(sizes.values())
    assert abs(sum(sizes) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s for t, s in sizes.items())
    assert rows_of(mixing.mix_plan(docs.repartition(7)), "*") == sorted(map(tuple, plan), key=key)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_targets_near(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}") for i in range(20_000)]
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) < 0.03 * r.target


# --- 7
def test_pages(spark):
    import pyarrow.parquet as pq

    if os.path.isdir(DATA):
        model = htmltext.Model()
        for page in pq.read_table(f"{DATA}/pages.parquet").to_pylist():
            article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
            assert model.text(page["html"]) == brute.main_text(article)
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain &lt;b&gt; text"), (4, "u", "<div"), (4, "u", "<div"), (5, "u", "<p>" + "long text, with words. " * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = rows_of(htmltext.extract_texts(df), "page_id", "text", "n_chars")
    assert [r[:2] for r in got][:5] == [(None, "plain <b> text"), (1, ""), (2, ""), (4, ""), (4, "")]
    assert got[5][2] == len(("long text, with words. " * 9000).strip())
    assert htmltext.extract_texts(df.limit(0)).count() == 0


def test_open_unseen_elements():
    model = htmltext.Model()
    body = "<article><h1>Of rivers</h1><p>Rivers run to the sea, and this is a long line about that, with many words in it.</p></article>"
    text = brute.main_text(body)
    for page in (
        f"<html><head><title>T</title><body>{body}", f"<head><title>T</title><meta charset=utf-8>{body}", f"<head><title>T{body}",
        f"<head><style>p {{ }}<body>{body}", f"<head><noscript><link rel=x></noscript><script>var a = '<p>';</script></head><body>{body}</body>",
        f"<body><svg><path d='M0'>{body}", f"<body><div><select><option>a<option>b</div>{body}<select><option>c</select></body>",
        f"<body><svg><path d='M0'>{body}<svg></svg></body>", f"<title>T{body}<svg><title>x</title></svg>",
        f"<body><svg><foreignObject><div>no</div></foreignObject></svg>{body}</body>", f"<body><div><audio><p>None</p></div>{body}", f"<body><div><script>var a = 1;</div>{body}", f"<body><svg><g/><svg></svg>no</svg>{body}</body>",
        f"<body><template><p>no</p><div>no</div></template>{body}<noscript><p>no</noscript></body>", f"<body><a href=x><svg><a>no</a></svg></a>{body}",
    ):
        assert model.text(page) == text, page
    formula = "<math><mrow><msup><mi>x</mi><mn>2</mn></msup></mrow><annotation encoding=tex>x^2</annotation></math>"
    assert model.text(f"<body>{body.replace('sea,', f'sea {formula},')}</body>") == text.replace("sea,", "sea x2,")


def test_marginals_are_exact():
    """Against summing over all labellings of a small tree."""
    import itertools
    import math

    model = htmltext.Model()
    page = htmltext.Page('<body><div class="ad"><p>Some text here.</p></div><article><h1>T</h1><p>Text of it, and more.</p></article></body>')
    n = len(page.parent)
    total, content = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i, y in enumerate(labels):
            if y and not page.wrapper(i, model.known):
                p *= math.exp(sum(model.weight.get(f, 0.0) for f in page.features[i]))
            if i:
                p *= model.edge[model._kind(page, i)][labels[page.parent[i]]][y]
        total += p
        content = [c + p * y for c, y in zip(content, labels)]
    for odds, c in zip(model.marginals(page), content):
        assert abs(1 / (1 + math.exp(-odds)) - c / total) < 1e-9


def test_names_are_learnt_not_listed():
    """Names that say what the main part is beside don't hide it; names in other languages count; unknown ones speak for nothing."""
    model = htmltext.Model()
    prose = "Quite some prose is in this line, with commas, with detail, and with an end. More of it follows here, at length."
    for names in ("content with-sidebar", "post no-sidebar", "entry-content share-enabled", "article-body has-comments", "post tag-search", "x9f3 content with-widget"):
        page = f'<html><body><nav><a href=x>Home</a></nav><div class="{names}"><h1>Title</h1><p>{prose}</p></div><footer>foot</footer></body></html>'
        assert model.text(page) == f"Title {prose}", names
    assert model.text(f'<body><article class="search-result-article"><h1>Title</h1><p>{prose}</p></article></body>') == f"Title {prose}"
    for names in ("werbung", "kommentare", "reklama", "publicidad", "comment-section", "newsletter-form"):
        assert model.text(f'<body><article><h1>T</h1><p>{prose}</p></article><div class="{names}"><p>{prose}</p></div></body>') == f"T {prose}", names
    # pieces of a block in named elements keep their place, and no space comes between them
    assert model.text(f'<article><p>{prose} re<span class="hl">mark</span>able.</p></article>') == f"{prose} remarkable."


def test_names_without_training():
    """Pages that the model isn't trained on: 28 of 30 at the time of writing. A first version's failures (it had 20) were looked at
    when layouts and features were chosen, so this guards what is reached; it is no estimate for other pages (see the README)."""
    model = htmltext.Model()
    prose, line = "Quite some prose is in this line, with commas, with detail, and with an end. More of it follows here, at length.", "A line of prose, not long."
    links = "".join(f'<li><a href="/{i}">Go {i}</a></li>' for i in range(5))
    main = "content with-widget,post has-sidebar,entry-content ads-enabled,article-body no-footer,post tag-comments,main-content,single-post-content,blog-post,news-article,td-post-content"
    other = (
        "comment-section,kommentar,kommentarbereich,ads,werbung,anzeigen,reklama,publicidad,commentaires,komentarze,comentarios,footer-bottom,stopka,pied,"
        "cookie-banner,newsletter-form,share-links,sidebar-left,seitenleiste,navigation-bar"
    )
    pages = [
        f'<body><div class="site-header"><a href=/>S</a></div><div class="{n}"><h1>T</h1><p>{prose}</p><p>{line}</p></div><div class="sidebar"><ul>{links}</ul></div><div class="footer">{line}</div></body>'
        for n in main.split(",")
    ]
    pages += [f'<body><article><h1>T</h1><p>{prose}</p><p>{line}</p></article><div class="{n}"><p>{prose}</p></div></body>' for n in other.split(",")]
    right = sum(model.text(page) == f"T {prose} {line}" for page in pages)
    assert right >= 27


def test_time_is_linear_in_open_elements():
    import time

    model = htmltext.Model()
    began = time.thread_time()
    page = "<body>" + "<b>x" * 100_000 + "</i>" * 100_000
    assert len(model.text(page)) == 100_000
    model.text("<body>" + "<b>x" * 50_000 + "<p>a</p>" * 50_000)
    assert time.thread_time() - began < 10


# --- 8
def test_similar_groups(spark, docs, empty):
    rows = {(r[0], r[1]) for r in odd_rows()}
    plain = brute.similar_groups([(-1 if d is None else d, t) for d, t in rows])
    expected = [(None if d == -1 else d, n, None if c == -1 else c) for d, n, c in plain]
    expected += [e for e in expected if e[0] == odd_rows()[8][0]] * 2
    assert rows_of(jaccard.similar_groups(docs), "doc_id", "n_shingles", "component_id") == sorted(expected, key=key)
    assert jaccard.similar_groups(empty).count() == 0
    left = jaccard.one_of_each_group(docs)
    assert left.columns == docs.columns and left.count() == len({c for _, _, c in expected})


def test_one_id_with_two_texts(spark):
    """A text that equals another id's doesn't take the links of its id's other text along."""
    rng = random.Random(3)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)) for _ in "ab")
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (12, "alone with these words of it"), (12, "alone with these words of it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_groups(df).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}
    left = [tuple(r) for r in jaccard.one_of_each_group(df).collect()]
    assert sorted(left) == [(1, a), (12, rows[-1][1])]
    twice = jaccard.one_of_each_group(df.filter("doc_id = 5")).collect()
    assert len(twice) == 1 and jaccard.one_of_each_group(df.limit(0)).count() == 0


def test_blocks_are_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)
    test_near_copies_of_all_degrees(spark)


def test_near_copies_of_all_degrees(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for f in range(6):
        base = [word() for _ in range(rng.choice((8, 40, 120)))] + (passage if f % 2 else [])
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words[rng.randint(0, 3) :])))
    rng.shuffle(rows)
    got = rows_of(jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "*")
    assert got == [tuple(e) for e in brute.similar_groups(rows)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- 9
def test_shards(docs, empty, tmp_path):
    limit = 3000
    table = sharding.shard_table(docs, limit).collect()
    assert len(table) == docs.count()
    by_shard = collections.defaultdict(list)
    for r in table:
        by_shard[r.shard].append(r)
        assert len(r.shard) == r.depth
    names = sorted(by_shard)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for shard, found in by_shard.items():
        size = sum(r.n_bytes for r in found)
        assert {(r.shard_bytes, r.shard_docs) for r in found} == {(size, len(found))}
        assert size <= limit or len({r.doc_id for r in found}) == 1
        # no bucket is split that fits: the parent of each shard is too large
        assert not shard or sum(r.n_bytes for r in table if r.shard.startswith(shard[:-1])) > limit
    assert sharding.shard_table(empty, limit).count() == 0
    sharding.write_shards(docs, str(tmp_path / "shards"), limit)
    assert len(list((tmp_path / "shards").glob("shard=*"))) == len(by_shard)


def test_merged_and_split_shards(spark):
    """Sizes all over: buckets that merge far above the expected depth, some that split far below, rows that can't be split."""
    rng = random.Random(2)
    for limit in (1, 40, 1000, 10**9):
        sizes = [(rng.randrange(1 << 60) >> rng.choice((0, 0, 0, 20)), rng.choice((0, 1, 30, 300))) for _ in range(300)] + [(5 << 50, 700)] * 3
        df = spark.createDataFrame(sizes, "h long, bytes long")
        table = {}
        for r in sharding.directory(df, limit).collect():
            for h, _ in sizes:
                if h >> (60 - r.leaf_depth) == r.leaf:
                    assert table.setdefault(h, (r.depth, r.bucket, r.shard_bytes, r.shard_docs)) == (r.depth, r.bucket, r.shard_bytes, r.shard_docs)
        assert set(table) == {h for h, _ in sizes}
        for h, got in table.items():
            for depth in range(61):
                inside = [(x, b) for x, b in sizes if x >> (60 - depth) == h >> (60 - depth)]
                if sum(b for _, b in inside) <= limit or len({x for x, _ in inside}) == 1 or depth == 60:
                    assert got == (depth, h >> (60 - depth), sum(b for _, b in inside), len(inside)), limit
                    break


# --- 10
def test_fingerprints(docs, empty):
    rows = sorted(((r[0], r[1] or "") for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(map(tuple, syncmers.fingerprint_table(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[6]))
    assert [(g[0], g[1]) for g in got] == [(d, len(t)) for d, t in rows]
    expected = []
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        expected.append((d, sha(t[: len(t) - m] + after[:m])))
    assert sorted((g[0] or 0, g[2]) for g in got) == sorted((d or 0, h) for d, h in expected)
    prints = {}
    for (d, t), g in zip(rows, got):
        assert prints.setdefault(t, g[3]) == g[3] and 0 <= g[5] <= 1 and 0 <= g[6] <= 1
        assert len(t) < 300 or len(set(t.split())) < 5 or g[5] > 0.3
    assert syncmers.fingerprint_table(empty).count() == 0


def plain_anchors(data, k, s):
    """(place, hash) of the closed syncmers by their definition; hashes as the operator has them."""
    import numpy as np
    from reelshelf.llm.shingles import followed

    def digest(part):
        x = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
        while len(x) > 1:
            x = followed(x[::2], x[1::2])
        return int(x[0])

    found = []
    for at in range(len(data) - k + 1):
        inner = [digest(data[at + i : at + i + s]) for i in range(k - s + 1)]
        if inner.index(min(inner)) in (0, k - s):
            found.append((at, int(followed(np.uint64(inner[0]) + np.uint64(k), np.uint64(inner[-1])))))
    return found


def plain_likeness(a, b, k, s):
    """Of the least anchors of both together, the share that both have at one distance. Anchors that repeat count by their number."""
    import numpy as np
    from reelshelf.llm.shingles import mixed

    def least(data):
        times, found = collections.Counter(), {}
        for at, full in plain_anchors(data, k, s):
            short = int(mixed(np.uint64((full + times[full]) % (1 << 64)).reshape(1))[0]) >> 32
            times[full] += 1
            found.setdefault(short, at)
        return dict(sorted(found.items())[: syncmers.ANCHORS])

    x, y = least(a), least(b)
    if x == y:
        return float(bool(x))
    union = sorted(x.keys() | y.keys())[: syncmers.ANCHORS]
    away = [x[h] - y[h] for h in union if h in x and h in y]
    return max((sum(0 <= z - w <= syncmers.TOLERANCE for z in away) for w in away), default=0) / max(1, len(union))


@pytest.mark.filterwarnings("ignore:overflow")
def test_fingerprints_by_definition():
    import pyarrow as pa

    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefg é") for _ in range(n)).encode()[:n]
    plain = lambda x: x.decode("utf-8", "ignore")
    for n in (3, 10, 40, 126, 130, 400, 511, 512, 900):
        a = plain(text(n)).encode()
        b = a[: 3 * len(a) // 4] + text(len(a) // 4 + 2)
        c = plain(text(2) + a).encode()
        for other in (plain(b).encode(), c, plain(text(n)).encode(), a * 2):
            x, y = syncmers.fingerprints(pa.array([a.decode(), other.decode()]))
            short = max(len(a), len(other)) < syncmers.BOTH
            if min(len(a), len(other)) > 24:
                k, s = syncmers.SHORT_SCALE if short else syncmers.SCALE
                assert syncmers.likeness(x, y) == pytest.approx(plain_likeness(a, other, k, s)), (n, other)


def test_no_length_is_a_border():
    import pyarrow as pa

    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij ") for _ in range(1100))
    for n in (125, 126, 127, 128, 129, 500, 509, 511, 512, 515):
        x, y = syncmers.fingerprints(pa.array([base[:n], base[: n + 3]]))
        assert syncmers.likeness(x, y) > 0.8, n


def test_ranges_are_even(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"))
    ordered = syncmers._in_order(rows)
    sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


# --- the pipeline
def test_stages_of_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, repeated rows, clashing names, no rows: every stage gives its rows, all but the last with the columns of the table."""
    import corpus_pipeline

    for i, table in enumerate((docs, empty)):
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, table, DATA)
            assert name == corpus_pipeline.STAGES[-1][0] or left.columns == table.columns
            left.write.parquet(str(tmp_path / f"{i}-{name}"))
            table = spark.read.parquet(str(tmp_path / f"{i}-{name}"))
        assert (table.count() > 0) == (i == 0)


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randint(4, 90))) + (" " + passage if i % 4 == 0 else "") for i in range(40)]
    texts += [texts[3], texts[5] + " end", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r[0] for r in brute.quality([(r[0], r[1], r[3]) for r in rows], 50, 20) if r[-1]}
    rows = [r for r in rows if r[0] in kept]
    first = {c for _, _, c in brute.similar_groups([(r[0], r[1]) for r in rows])}
    rows = [r for r in rows if r[0] in first]
    seen, left = set(), []
    for r in rows:
        data, gone = r[1].encode(), set()
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone.update(range(s, s + 100))
            seen.add(data[s : s + 100])
        left.append((r[0], bytes(b for i, b in enumerate(data) if i not in gone).decode(), r[2], r[3], 0))
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(left, SCHEMA)).collect()}
    expected = []
    for doc_id, text, *_ in left:
        ids, decoded = library(text)
        expected += [(doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded))] * plan[doc_id]
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)), "*") == sorted(expected, key=key)
