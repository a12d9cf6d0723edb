"""Line dedup against brute force, with both ways of finding suspects."""

import hashlib
import random

import numpy as np
import pytest

from tabloom.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, digest int, row string, doc int, drops string, n_lines int"
RND = random.Random(4)


def line():
    return "".join(RND.choice(["ab", "Ñö ", "x y", "ЖЖ", "\t", "0", "ß"]) for _ in range(RND.randint(0, 9)))


POOL = [line() for _ in range(25)] + ["exactly 10", "only nine", "öööööööööö", "ööööööööö", "  \x0b padded line\r", "PADDED LINE", "\x85 not stripped", "A long line " * 400]


def text():
    return "\n".join(RND.choice(POOL) if RND.random() < 0.5 else line() for _ in range(RND.randint(1, 12)))


BASE = [(i * 3 - 20, text()) for i in range(60)]
ROWS = [*BASE, (500, None), (501, ""), (502, "\n\n"), (503, "\n".join(["hot line of all"] * 5)), *[(600 + i, "hot line of all") for i in range(40)],
        (None, "only without id, twice"), (None, "only without id, twice"), (None, "hot line of all\nown line of it"),
        BASE[3], BASE[3], (BASE[4][0], "same id, other text\n" + BASE[5][1]), (700, "twice in one document\nTWICE IN ONE DOCUMENT")]


def key(s):
    return s.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows):
    last = float("inf")
    holders = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            holders.setdefault(key(s), set()).add(last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or len(holders[key(s)]) < 2 or min(holders[key(s)]) == (last if i is None else i)]
        out.append((-99 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def made(df, **kw):
    return sorted((-99 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(df, **kw).collect())


@pytest.mark.parametrize("most_bits", [line_dedup.MOST_BITS, 512, 1])
@pytest.mark.parametrize("parts", [1, 7])
def test_lines_equal_brute_force(spark, parts, most_bits):
    df = spark.createDataFrame([(*r, "x", 1, "a", 2, "b", 3) for r in ROWS], SCHEMA).repartition(parts)
    got = made(df, most_bits=most_bits)
    assert got == brute(ROWS) and sum(r[2] for r in got) > 60
    assert line_dedup.drop_repeated_lines(df).columns == ["doc_id", "n_lines", "n_dropped", "text"]


def test_other_least_length_and_types(spark):
    rows = [(1, "abc\nlonger line"), (2, "ABC \nlonger line"), (3, "ab")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert made(df, min_chars=3) == [(1, 2, 0, "abc\nlonger line"), (2, 2, 2, ""), (3, 1, 0, "ab")]
    assert line_dedup.drop_repeated_lines(df).schema["doc_id"].dataType.simpleString() == "int"


def test_nothing(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []
    assert made(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")) == [(-99, 1, 0, ""), (1, 1, 0, "")]


def test_very_long_text(spark):
    big = "\n".join(f"line number {i} of a long text" for i in range(60_000))
    got = made(spark.createDataFrame([(2, big), (1, "LINE NUMBER 59999 OF A LONG TEXT  "), (3, "x" * 3_000_000)], "doc_id long, text string"))
    assert [r[:3] for r in got] == [(1, 1, 0), (2, 60_000, 1), (3, 1, 0)]
    assert got[1][3] == big.rpartition("\n")[0]


def test_second_filter_misses_no_repeat(spark):
    """Every key of two documents is suspected; of the others few are, since the filters grow with the lines."""
    docs = [(i, "\n".join([f"own line {i} {j} of its own" for j in range(50)] + [f"shared line {i // 2}"])) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    twice = line_dedup.twice_filter(df, "text", 10, line_dedup.MOST_BITS)
    shared = line_dedup.short_hashes([line_dedup.key_digests(f"shared line {i}")[0] for i in range(1000)])
    own = line_dedup.short_hashes([k for _, t in docs[:400] for k in line_dedup.key_digests(t)[:-1]])
    assert line_dedup.suspected(shared, twice).all()
    assert np.mean(line_dedup.suspected(own, twice)) < 0.08


def test_query_digest(spark, tmp_path):
    from tabloom.llm.queries import QUERIES

    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-99 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op12_line_dedup"](spark, str(tmp_path)).collect())
    assert got == sorted((*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(ROWS))
