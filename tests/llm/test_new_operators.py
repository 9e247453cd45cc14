"""Importance resampling, fill-in-the-middle and byte-level BPE against plain loops and the library."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm import byte_bpe, fill_middle, queries, resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", "  \n\t", "Hello", "one TWO two", "Élan élan 日本語 テキスト 𝄞 x", "word " * 3000, "x" * 5000, "a " + "y" * 200 + " b " + "y" * 200, "a <P> b", "<S>", "<M", "ab <P", "x<", "a\x00b\x1cc",
    "The quick brown fox doesn't jump over 12345 lazy dogs, does it?  \n\n  It's 3.14!", "no\xa0break    space", "<|endoftext|> a <s> b", "😀😀😀 é", "tab\tnew\nline\r\nend ", "one two three four five " * 6, "quick brown fox " * 10,
]
TARGET = ["the quick brown fox", None, "", "One two; three!", "日本語 x"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "n", 1) for i, t in enumerate(TEXTS)] + [(3, "Hello", 0, "again", 2), (None, "the quick brown fox " * 6, 1, "x", 3), (50, TEXTS[20], 0, "tie", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, form string, score int")


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")


def plain_features(text):
    w = WORD.findall((text or "").translate(LOW))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in set(s)}
    out = []
    for i, x in rows:
        w, f = plain_features(x)
        weight = sum(gain[bucket(v)] for v in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def got(df):
    return order(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resample_equals_plain_loops(spark, docs, target):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(resample.importance_resample(docs, target)) == order(brute_resample(rows, TARGET))
    for percent in (50, 100):
        assert got(resample.importance_resample(docs, target, percent=percent)) == order(brute_resample(rows, TARGET, percent))
    kept = resample.draw(docs, target, percent=50)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute_resample(rows, TARGET, 50) if r[4]} - {None}


def test_resample_of_the_smallest_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    aim = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(queries.op11_importance_resample(spark, sf)) == order(brute_resample(rows, aim))


def test_resample_of_empty_tables(docs, target):
    none = docs.where("false")
    assert resample.importance_resample(none, target).count() == 0
    assert got(resample.importance_resample(docs, target.where("false"))) == order(brute_resample([(r.doc_id, r.text) for r in docs.collect()], []))


def test_ranks_without_gaps_over_many_partitions(spark):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score")).repartition(9)
    ranks = {r.doc_id: r["rank"] for r in resample.ranked(scored, 4000, "doc_id").collect()}
    expected = sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert ranks == {i: k + 1 if k < 4000 else None for k, i in enumerate(expected)}


def test_a_scan_without_dictionary_and_in_pieces():
    text = " ".join(f"w{i % 37}{'z' * (i % 150)}" for i in range(4000)).encode()
    whole = [zlib.crc32(f.encode()) % 10_000 for f in plain_features(text.decode())[1]]
    for words in ([], [b"w1z", b"w3zzz"], [f"w{i}{'z' * i}".encode() for i in range(37)]):
        scan = resample.FeatureScan(words)
        for texts in ([text], [b"", text[:0], text]):
            found = Counter(int(b) for group in scan.groups(texts) for _, bs in group for b in bs)
            assert found == Counter(whole)
        cut = [(0, p, n) for p, n in resample.pieces(text, 300)]
        assert len(cut) > 100
        found = Counter(int(b) for piece in cut for _, bs in scan.features([piece]) for b in bs)
        assert found == Counter(whole)


def test_frequent_words_keep_their_bound(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), i) for i in range(1, 300)], "word binary, n long")
    words = resample.frequent_words(counts, 50)
    assert 0 < len(words) <= 50 and sorted(words) == sorted(f"w{i}".encode() for i in range(300 - len(words), 300))
    assert len(resample.frequent_words(counts)) == 298
    assert resample.frequent_words(counts.where("n = 1")) == resample.frequent_words(counts.withColumn("n", F.lit(5)), 50) == []


def test_crc_shift_at_any_length():
    n = np.array([0, 1, 2, 63, 64, 65, 1000, 70_000, 1 << 21])
    moved = resample.CrcShift()(np.full(len(n), zlib.crc32(b"head"), np.uint32), n)
    for k, x in zip(n.tolist(), moved.tolist()):
        tail = b"t" * k
        assert x ^ zlib.crc32(tail) == zlib.crc32(b"head" + tail)


def brute_middle(i, text):
    x, d = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(x)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, x
    p, m, s = x[:a], x[a:b], x[b:]
    return (i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_plain_loops(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(600)] + [(5, "twice é"), (5, "twice é"), (None, "no id 日")]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], "doc_id long, text string, output string, h0 int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = Counter((r.doc_id, r.back) for r in back)
    assert order(tuple(r)[:6] for r in back) == order(brute_middle(*r) for r in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert texts == Counter((i, x or "") for i, x in rows)
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize(("unit", "starts"), [("line", "\n"), ("word", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")])
def test_cuts_fall_before_other_units(spark, unit, starts):
    texts = ["a b\nc  d\n\ne é ", "no", "", "\n\n x"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fill_middle.fill_in_middle(docs, unit=unit, rate=100, spm_rate=0).collect():
        t = texts[r.doc_id]
        assert r.n == sum(c in starts for c in t)
        if r.form == "psm":
            p, rest = r.output[3:].split("<S>")
            s, m = rest.split("<M>")
            assert p + m + s == t
            assert all(x == "" or x[0] in starts for x in (m, s) if x and not (m == "" and p == "") and p + m != "" and (x is s or p != ""))
            assert sum(c in starts for c in p) == r.prefix_chars and sum(c in starts for c in m) == r.middle_chars


def test_fill_in_middle_sql(spark, sf):
    expected = {r[0]: r for r in duckdb.sql(f"WITH documents AS (FROM '{sf}/documents.parquet') " + queries.OP12_SQL.strip().replace("WITH t AS", ", t AS", 1)).fetchall()}
    rows = queries.op12_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(expected)
    assert all(tuple(r) == expected[r.doc_id] for r in rows)


def test_rank_by_wavelet_matrix():
    rng = np.random.default_rng(7)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size, dtype=np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for c in range(8):
            assert (matrix.rank(c, at) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


def library():
    return byte_bpe.coder(RANKS, PATTERN).encoding


def test_encoding_equals_the_library_and_decodes(spark, docs):
    done = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    source = Counter((r.doc_id, r.text or "") for r in docs.collect())
    rows = done.collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in rows) == source
    ids = {(i, x): library().encode_ordinary(x) for i, x in source}
    assert all(r["ids"] == ids[r.doc_id, bytes(r.decoded).decode()] for r in rows)
    assert byte_bpe.encode(docs.where("false"), RANKS, PATTERN).count() == 0
    clash = spark.createDataFrame([(1, [10, 20], "a"), (2, None, "b"), (3, [], "c")], "doc_id int, ids array<int>, decoded string")
    back = {r.doc_id: r.decoded for r in byte_bpe.decode(clash, RANKS, PATTERN).collect()}
    assert (bytes(back[1]), back[2], bytes(back[3])) == (library().decode_bytes([10, 20]), None, b"")


def test_query_digests(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op13_byte_bpe(spark, sf).collect():
        ids = library().encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), texts[r.doc_id])))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab s'tré1٣́ 日\t\n\r\x0b\x1c\xa0 .,'’😀_")))
def test_cut_texts_have_the_ids_of_whole_ones(text):
    own = byte_bpe.coder(RANKS, PATTERN, 3)
    assert "".join(own.pieces(text)) == text
    assert own.encode(text).tolist() == library().encode_ordinary(text)


def test_long_runs_without_a_boundary():
    own = byte_bpe.coder(RANKS, PATTERN)
    for text in (" " * 300_000 + "x", "日本" * 100_000, "!" * 200_000, "a" * 200_000 + " b", "\n" * 150_000):
        ids = own.encode(text)
        assert own.decode(ids).decode() == text
    assert own.encode("ab, " * 60_000).tolist() == library().encode_ordinary("ab, " * 60_000)
