"""Operators of the training-data pipeline against brute force, libraries and round trips, on small fixtures."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import bpe, decontaminate, fingerprint, html_text, jaccard_join, language, pretokens, range_coder, token_counts, token_output, toxicity, warc
from tabloom.llm.queries import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RND = random.Random(5)
WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "ré", "sö") for b in ("na", "li", "do", "per", "st", "ü")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", ".", " \n"]) for _ in range(n))


#: Null and empty texts, blanks, one word, repeated rows, extra columns with names that operators use themselves.
BASE = [prose(60) for _ in range(12)]
TEXTS = [None, "", "  \n ", "Word", "!!!", *BASE, BASE[0], BASE[1] + " tail", BASE[2].upper(), " ".join(BASE) * 3, "Ⅷ ½ 123 naïve　x\x85y"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "x", "y", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, _id string, component_id string, digest int").repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# ---- decontamination --------------------------------------------------------------------------


def brute_contamination(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, found = words(text), set(), set()
    for ident, item in items:
        x = words(item)
        n = min(13, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == x[k:k + n]:
                    hit.update(range(i, i + n))
                    found.add("null" if ident is None else str(ident))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [20, 100_000])
def test_contamination_against_brute_force(spark, docs, block_words):
    items = [(1, " ".join(BASE[3].split()[5:40])), (10, "Word"), (2, None), (3, ""), (2, " ".join(BASE[4].split()[:14])), (None, " ".join(BASE[4].split()[1:15])), (7, BASE[5] + BASE[5])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, benchmark, block_words=block_words))
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_contamination(t, items), (i, t)
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, benchmark, block_words=block_words).collect()}
    assert kept == {i for i in got if not got[i]["contaminated"]}
    assert decontaminate.clean_documents(docs, benchmark).columns == docs.columns


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.n_hit or r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_spans_are_removed(spark):
    item = " ".join(f"w{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"Alpha, {item}! omega"), (2, "clean text")], "doc_id long, text string")
    got = by_id(decontaminate.remove_spans(df, spark.createDataFrame([(1, item)], "item_id long, text string")))
    assert got[1]["text"] == "Alpha, ! omega" and got[1]["n_removed"] == 15 and got[2]["text"] == "clean text"


def test_automaton_against_brute_force():
    rnd = random.Random(2)
    for _ in range(60):
        items = [(str(i), [rnd.choice([b"a", b"b"]) for _ in range(rnd.randint(0, 9))]) for i in range(4)]
        text = [rnd.choice([b"a", b"b", b"c"]) for _ in range(30)]
        spans, found, _ = decontaminate.Automaton(items, 4).scan(text)
        hit, want = set(), set()
        for ident, x in items:
            n = min(4, len(x))
            for k in range(len(x) - n + 1 if n else 0):
                for i in range(len(text) - n + 1):
                    if text[i:i + n] == x[k:k + n]:
                        hit.update(range(i, i + n))
                        want.add(ident)
        assert {i for a, b in zip(spans[::2], spans[1::2]) for i in range(a, b)} == hit and found == want


# ---- language ---------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(df.where(language.fold("doc_id", 4) != 2))
    held = df.where(language.fold("doc_id", 4) == 2)
    got = language.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, docs):
    model = language.train(docs)
    got = by_id(language.predict(docs, model))
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 4)} == {"und"} and got[5]["lang_pred"] == "en"
    assert {r.doc_id for r in language.keep_identified(docs, model).collect()} == {i for i in got if got[i]["lang_pred"] != "und"}
    untrained = language.train(docs.where("lang = 'none'"))
    assert {r.lang_pred for r in language.predict(docs, untrained).collect()} == {"und"}


# ---- pages ------------------------------------------------------------------------------------

LONG = "The river rose over night and nobody in the village crossed it before noon on that day."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
    (f"<body><header><p>Site name</p></header><article><h1>A &amp; B</h1><p>{LONG}<p>Second&nbsp;one <b>is\n bold</b>.</article><footer>end</footer>", f"A & B\n\n{LONG}\n\nSecond one is bold."),
    (f"<article><p>{LONG}</p><div class='ad-slot'>Buy now</div><aside>More</aside><p>{LONG}</p><form>Mail <input></form></article><div id=comments><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<div><a href=a>One</a><a href=b>Two</a></div><div><p>{LONG}</p><ul><li>first {LONG}<li>second</ul></div><div><a href=c>Three</a></div>", f"{LONG}\n\nfirst {LONG}\n\nsecond"),
    (f"<p>{LONG}</p><script>var a='<p>no</p>';</script><!-- <p>no</p> --><style>p{{}}</style><p>{LONG} 1 &lt; 2</p>", f"{LONG}\n\n{LONG} 1 < 2"),
    (f"<main><p>{LONG}</p></main><div class='sidebar'><p>{LONG}</p></div><div class=cookie-notice>We use cookies</div>", LONG),
])
def test_main_text(page, text):
    assert html_text.extract(page, html_text.default_weights()) == text


def test_main_text_of_a_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("text", F.lit("x"))
    got = html_text.main_text(pages, html_text.train(pages)).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)
    assert html_text.main_text(pages.limit(0), html_text.default_weights()).count() == 0


# ---- tokens -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary("byte_bpe_50k.tiktoken").splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary("byte_bpe_50k.json").decode())


def odd_texts(n):
    rnd = random.Random(1)
    pool = [*"aB1é ß\n\t\x1c\x85 'stmd!½ー😀", "<|endoftext|>", "'ll", "  ", " hello", "aaaaaaaa", "\x00"]
    return ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 999, None]


def test_bpe_like_the_library(tiktoken_encoding):
    import public_tokenizers as P

    merges = bpe.Merges(bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), P.PATTERN)
    for remembered in (50, 100_000):
        known = pretokens.Remembered(merges.encode_units, remembered)
        for lo in range(0, 3000, 500):
            texts = odd_texts(3000)[lo:lo + 500]
            for t, ids in zip(texts, bpe.encode_texts(texts, known), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(t or "")
                assert merges.decode(np.frombuffer(ids, "<u4")) == (t or "").encode()


def test_remembered_units_are_bounded_by_their_length():
    asked = []
    known = pretokens.Remembered(lambda new: asked.extend(new) or [len(u) for u in new], 2)
    known.learn([["a" * 100]])
    known.learn([["b" * 40, "b" * 40]])  # 140 characters are more than 2 * 64: begun anew
    assert dict(known) == {"b" * 40: 40} and known.chars == 40
    known.learn([["b" * 40, "c"]])
    assert asked == ["a" * 100, "b" * 40, "c"] and known.chars == 41


def test_bpe_tables(docs, tiktoken_encoding):
    import public_tokenizers as P

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    got = by_id(bpe.digests(docs, ranks, P.PATTERN))
    for i, t in enumerate(TEXTS):
        ids = np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i] == {"doc_id": i, "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256((t or "").encode()).hexdigest()}
    encoded = bpe.encode(docs, ranks, P.PATTERN)
    assert {k: v["text"] for k, v in by_id(bpe.decode(encoded, ranks, P.PATTERN)).items()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert all(r.decodes for r in bpe.encode_checked(docs, ranks, P.PATTERN).collect())


def test_counts_like_the_library(spark, library):
    texts = odd_texts(2000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(token_counts.token_counts(df, vocabulary("byte_bpe_50k.json").decode(), limit=10))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 10)
    other = by_id(token_counts.token_counts(df.limit(50), vocabulary("word_bpe_49k.json").decode()))
    from tokenizers import Tokenizer

    words = Tokenizer.from_str(vocabulary("word_bpe_49k.json").decode())
    assert all(other[i]["n_tokens"] == len(words.encode(texts[i] or "", add_special_tokens=False).ids) for i in other)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 500, 9000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), rng.zipf(1.3, n) % 50_000, np.full(n, 65535), np.arange(n) % 3):
        for block in (7, 4096):
            packed = range_coder.encode(ids.astype(np.uint32), block)
            assert (range_coder.decode(packed, n, block) == ids).all()
            if packed:  # a block is coded alone
                assert range_coder.encode(ids[:block].astype(np.uint32), block)[0] == packed[0]
    with pytest.raises(ValueError):
        range_coder.encode(np.array([70_000]))


@pytest.mark.parametrize("range_chars", [500, 10**9])
def test_token_files(docs, library, range_chars):
    rows = sorted([*enumerate(TEXTS), (6, TEXTS[6]), (6, TEXTS[6])], key=lambda r: (r[0], r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    definition = vocabulary("byte_bpe_50k.json").decode()
    got = token_output.round_trip(docs, definition, range_chars=range_chars).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_output.round_trip(docs.limit(0), definition).count() == 0


def test_damaged_token_file(tmp_path):
    path = str(tmp_path / "a.tids")
    w = token_output.Writer(path)
    w.add(None, np.arange(100, dtype=np.uint16))
    w.close()
    assert [(d, s, ids.tolist()) for d, s, ids in token_output.read_file(path)] == [(None, 0, list(range(100)))]
    data = bytearray((tmp_path / "a.tids").read_bytes())
    data[30] ^= 1
    (tmp_path / "a.tids").write_bytes(bytes(data))
    with pytest.raises(ValueError):
        list(token_output.read_file(path))


# ---- archives ---------------------------------------------------------------------------------


def test_archives(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", other), (9, "u", big), (None, "u", big), (8, "u", other), (8, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("x")).repartition(3)
    got = sorted(map(tuple, warc.round_trip(spark, pages, archive_bytes=300).collect()), key=str)
    top = {big: 9, other: 8}
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        head = top.get(html)
        refers = head if head is not None and page != head else None
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://x/" + "y" * 2_000_000, "<p>text</p>")], "page_id long, url string, html string")
    assert [r.payload_bytes for r in warc.round_trip(spark, long).collect()] == [11]
    manifest = warc.write_archives(pages, archive_bytes=300)
    assert manifest.count() > 3  # as many tasks read as there are archives, however small their list is
    assert warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count()


def test_archive_reader_checks(tmp_path):
    path = tmp_path / "a.warc.gz"
    good = warc.pack(warc.record_bytes(1, "u", b"payload" * 500)) + warc.pack(warc.record_bytes(2, "u", b""))
    path.write_bytes(good)
    with warc.open_file(str(path), "r") as f:
        records = list(warc.read_records(f, keep_payload=True))
    assert [r["payload"] for r in records] == [b"payload" * 500, b""]
    bad = warc.pack(warc.record_bytes(1, "u", b"payload").replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"))
    for data in (good[:-20], good[:40], bad):
        path.write_bytes(data)
        with pytest.raises((ValueError, zlib.error)), warc.open_file(str(path), "r") as f:
            list(warc.read_records(f))


# ---- toxicity ---------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(rnd.randint(3, 60))]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["vilest", "vileness", "scumbag"]))
        rows.append((i, " ".join(words), rnd.choice(["en", "de", None])))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None), (1001, "", "en"), (1002, "x", "en")]
    labels += [(3, None), (4, 7), (None, 1), (3, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(documents, known.where("doc_id < 400 OR doc_id IS NULL"))
    got = by_id(toxicity.score(documents, model))
    right = sum(got[i]["predicted"] == int(i % 3 == 0) for i in range(400, 600))
    assert right >= 185 and len(got) == 603 and got[1000]["score"] == got[1001]["score"] < 0.5
    assert {r.doc_id for r in toxicity.keep_harmless(documents, model).collect()} == {i for i in got if got[i]["score"] < 0.5}
    assert {r.score for r in toxicity.score(documents, toxicity.train(documents, known.limit(0))).collect()} == {0.0}
    # the score of a text does not depend on what is scored beside it
    alone = toxicity.score_texts([rows[0][1]], model)[0]
    assert alone == pytest.approx(got[0]["score"], abs=1e-6)


def test_toxicity_joins_labels_alike_at_every_size(spark, monkeypatch):
    """The text join does not turn from sent ids to shuffled texts as the labels grow; null, unknown and other labels take no part."""
    plans, plain = [], toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, label))
    documents = spark.createDataFrame([(i, f"text {i}", "de") for i in range(40)] + [(None, "none", "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 30)] + [(3, 0), (4, 1), (None, 1), (39, 2), (99, 1)], "doc_id long, toxic int")
    rows, shards = toxicity.labelled_rows(documents, labels, 1, "doc_id", "text", "lang", "toxic")
    assert "SortMergeJoin" in plans[0] and shards == 1
    assert sorted((r._text, r._label) for r in rows.collect()) == sorted((f"text {i}", 1 if i == 4 else i % 2) for i in range(30))


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 9))) + (" vilest" if i % 4 == 0 else ""), "en") for i in range(700)]
    documents = spark.createDataFrame([*rows, (None, "no id", "en"), (rows[8][0], "said twice", "en")], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 700, 2)] + [(9999, 1), (None, 0), (7, None)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)  # several shards, whose weights are averaged
    labelled, shards = toxicity.labelled_rows(documents, known, 1, "doc_id", "text", "lang", "toxic")
    want = sorted([(r[1], int(r[0] % 4 == 0)) for r in rows if r[0] % 2 == 0] + [("said twice", 1)])
    assert shards == 6 and sorted((r["_text"], r["_label"]) for r in labelled.collect()) == want
    counts = {r["bucket"]: (r["clean"], r["toxic"]) for r in toxicity.text_counts(labelled, 16).collect()}
    words = toxicity.word_buckets([b"vilest"], 16)[0][0, 0]
    assert counts[words] == (0, sum("vilest" in text for text, _ in want))
    got = by_id(toxicity.score(documents.where("doc_id IS NOT NULL AND text <> 'said twice'"), toxicity.train(documents, known, bits=16)))
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in range(700)) >= 690


# ---- near duplicates --------------------------------------------------------------------------


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 85 * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def family_rows():
    rnd = random.Random(8)
    rows = list(enumerate(TEXTS))
    for length, copies in ((40, 30), (200, 25), (9, 8)):
        base = [rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, length // 30))):
                words[rnd.randrange(length)] = rnd.choice(WORDS) + "x"
            rows.append((len(rows), " ".join(words)))
    chain = [rnd.choice(WORDS) + rnd.choice(WORDS) + str(k) for k in range(150)]
    rows += [(len(rows) + k, " ".join(chain[6 * k:6 * k + 100])) for k in range(9)]
    return rows


def test_components_against_brute_force(spark):
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == want
    kept = jaccard_join.keep_one(df.unionAll(df.where("doc_id = 6")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i][1] == i) and kept.columns == df.columns


def test_components_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "A b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, jaccard_join.near_duplicates(df).collect())) == sorted(map(str, [
        F and r for r in spark.createDataFrame([(None, 2, 3), (3, 2, 3), (None, 0, None)], "doc_id long, n_shingles long, component_id long").collect()]))
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.cid: r.label for r in jaccard_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- fingerprints -----------------------------------------------------------------------------


@pytest.mark.parametrize("range_chars", [300, 10**9])
def test_edited_fingerprints(docs, range_chars):
    one = docs.dropDuplicates(["doc_id"])
    got = by_id(fingerprint.edited_fingerprints(one, range_chars=range_chars))
    order = sorted(range(len(TEXTS)), reverse=True)

    def exact(a, b):
        x, y = shingles(a, 5), shingles(b, 5)
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, i in enumerate(order):
        t, after = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(exact(t, edited), abs=0.15) and r["near_next"] == pytest.approx(exact(t, after), abs=0.15)
    assert got[5]["fingerprint"] == got[17]["fingerprint"] and got[0]["fingerprint"] == ""
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.edited_fingerprints(docs).count() == len(TEXTS) + 2


def test_sketch_estimates(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]).encode(), " ".join(words[1000:6000]).encode()
    x, y = fingerprint.sketches([a, b])
    assert fingerprint.resemblance(x, y) == pytest.approx(0.5, abs=0.13)
    assert fingerprint.containment(x, y) == pytest.approx(0.75, abs=0.2)
    assert fingerprint.distinct_shingles(x) == pytest.approx(3996, rel=0.3)
    assert (fingerprint.from_text(fingerprint.to_text(x)) == x).all()
    df = spark.createDataFrame([(1, a.decode()), (1, b.decode()), (2, "p q")], "doc_id long, text string").repartition(3)
    merged = by_id(fingerprint.merge_fingerprints(fingerprint.fingerprints(df), "doc_id"))
    assert merged[1]["fingerprint"] == fingerprint.to_text(fingerprint.merge([x, y]))
