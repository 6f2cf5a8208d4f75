"""Repeated windows of words and bytes against a listing of all windows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import substring_dedup, suffix_dedup, windows
from larkspur.llm.hashing import FIRST, byte_units, word_units
from tests.llm import fixtures as X


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


PAIRS = [(r[0], r[1]) for r in X.rows()]


@pytest.mark.parametrize("width", [6, 50])
def test_words(spark, width):
    got = rows_of(substring_dedup.remove_repeats(X.documents(spark), width, digest=True))
    assert got == X.repeated_windows(PAIRS, width)


@pytest.mark.parametrize("width", [8, 400])
def test_bytes(spark, width):
    got = rows_of(suffix_dedup.remove_repeats(X.documents(spark), width, digest=True))
    assert got == X.repeated_bytes(PAIRS, width)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(substring_dedup.remove_repeats(docs, digest=True)) == X.repeated_windows(pairs)
    assert rows_of(suffix_dedup.remove_repeats(docs, digest=True)) == X.repeated_bytes(pairs)


def test_texts_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c d y"), (None, "a b c d")], "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(docs, 4)) == {1: (5, 0, "a b c d e"), 2: (6, 4, "x y"), None: (4, 4, "")}
    assert rows_of(suffix_dedup.remove_repeats(docs, 7)) == {1: (9, 8, 1, b"e"), 2: (11, 8, 1, b"x y"), None: (7, 7, 1, b"")}


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "q r s t")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs, 3).collect()] == [0, 0, 0]
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs, 5).collect()) == [0, 7, 7]
    assert substring_dedup.remove_repeats(X.empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(X.empty(spark)).count() == 0


def parts_of(n, step, width):
    """Sizes and own units of the pieces that a text of n units is cut into."""
    out = []
    for a in range(0, max(1, n), step):
        last = n - a < step + width
        out.append((n - a, n - a) if last else (step + width - 1, step))
        if last:
            return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=5), st.integers(1, 12), st.integers(1, 12), st.integers(0, 9))
def test_starts_cover_every_window_once(lengths, a, b, more):
    width, length = max(a, b), min(a, b)
    seen, want = [], []
    for n in lengths:
        at = 0
        for size, own in parts_of(n, width + more, width):
            mask = windows.starts_in(np.array([size]), np.array([own]), width, width)
            seen.append([at + int(s) for s in np.flatnonzero(mask)])
            short = windows.starts_in(np.array([size]), np.array([own]), width, length)
            assert set(np.flatnonzero(short)) == {s + d for s in np.flatnonzero(mask) for d in range(width - length + 1)}
            at += own
        want.append(list(range(max(0, n - width + 1))))
        assert sum(seen, []) == want.pop()
        seen = []


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=90), st.integers(1, 20), st.integers(1, 4))
def test_names_tell_windows_apart(data, width, digits):
    data = bytes(x % 3 for x in data)
    method = suffix_dedup.Radix(width)
    units, at = byte_units(np.frombuffer(data, np.uint8)), np.arange(max(0, len(data) - width + 1))
    names = method.names(method.passes - 1, units, at, FIRST).tolist()
    strings = [data[i : i + width] for i in at]
    assert len(set(zip(names, strings))) == len(set(names)) == len(set(strings))
    some = at[::2]  # the same names one by one
    assert method.names(method.passes - 1, units, some, FIRST).tolist() == names[::2]


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=50))
def test_packed_names_come_back(values):
    for kind, bits in ((np.uint64, 64), (np.uint32, 32)):
        some = np.unique(np.array([v >> (64 - bits) for v in values], kind))
        assert windows.unpack_sorted(windows.pack_sorted(some), kind).tolist() == some.tolist()


def test_levels_double():
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(6) == [6] and substring_dedup.levels(1) == [1]
    assert suffix_dedup.Radix(400).cuts == (0, 200, 400) and suffix_dedup.Radix(400).stretch == 100


@pytest.mark.parametrize("size", [40, 300])
def test_pieces_of_long_texts_do_not_change_the_result(spark, size):
    words, octets = substring_dedup.Doubling(12), suffix_dedup.Radix(30)
    words.chunk = octets.chunk = size
    got = windows.remove(X.documents(spark), "doc_id", "text", words, "test", bytes.decode, "string")
    assert {r.id: (r.n, r.n_gone, X.sha(r.kept)) for r in got.collect()} == X.repeated_windows(PAIRS, 12)
    got = windows.remove(X.documents(spark), "doc_id", "text", octets, "test", bytes, "binary")
    assert {r.id: (r.n, r.n_gone, r.spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()} == X.repeated_bytes(PAIRS, 30)


def test_very_long_text(spark):
    import random

    rng = random.Random(5)
    base = " ".join(f"{rng.randrange(10**9)}" for _ in range(1_000_000))  # 10 MB: more than a chunk
    docs = spark.createDataFrame([(1, base[2_000_000:2_004_000]), (2, base), (3, base[-5000:] + " end")], "doc_id long, text string")
    words = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, digest=True).collect()}
    assert words[1] == 0 and 350 < words[2] < 410 and 480 < words[3] < 510
    octets = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs, digest=True).collect()}
    assert octets == {1: (4000, 1), 2: (9000, 2), 3: (5000, 1)}


def test_passages_twice_in_one_document_and_cut_at_odd_places(spark):
    import random

    rng = random.Random(3)
    words = [f"v{i}" for i in range(90)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages).split()
            i = rng.randrange(0, 6)
            parts.append(" ".join(p[i : len(p) - rng.randrange(0, 6)]))
            parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))))
        docs.append((d, " ".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for width in (5, 20):
        assert rows_of(substring_dedup.remove_repeats(frame, width, digest=True)) == X.repeated_windows(docs, width)
    for width in (30, 200):
        assert rows_of(suffix_dedup.remove_repeats(frame, width, digest=True)) == X.repeated_bytes(docs, width)


def test_words_split_at_six_blanks_only():
    assert len(word_units("a b\x1cc\x85d e f\x0bg".encode())) == 3
