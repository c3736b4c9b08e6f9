from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from skumetry.llm import suffix_dedup

LAST = suffix_dedup._LAST_ID
suffix_dedup_stored = suffix_dedup.stored


def brute(rows):
    docs = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    owner = {}
    for doc, text in docs:
        for k in range(len(text) - 49):
            owner[text[k: k + 50]] = min(owner.get(text[k: k + 50], doc), doc)
    out = []
    for (doc_id, _), (doc, text) in zip(rows, docs):
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 49):
            if owner[text[k: k + 50]] < doc:
                gone[k: k + 50] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(20), prose(9), "ab" * 60, "x" * 200]
    rows = []
    for i in rng.sample(range(1000), 50):
        parts = [rng.choice([prose(rng.randint(0, 40)), rng.choice(shared), rng.choice(shared)[3:60], "\0" * rng.randint(0, 70)]) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, shared[3]), (2004, "x" * 50), (2005, "x" * 49), (None, shared[0]), (None, shared[0]), rows[3]]
    rows += [(3000, rows[5][1]), (3001, rows[5][1][1:])]
    return rows


@pytest.mark.parametrize("seed, part_bytes, slice_bytes", [(1, 8 << 20, 2 << 20), (2, 400, 1000)])
def test_equals_brute_force(spark, monkeypatch, seed, part_bytes, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
    monkeypatch.setattr(suffix_dedup.textbytes, "SLICE_BYTES", slice_bytes)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "d", 7) for i, t in rows], "doc_id long, text string, doc string, n_bytes int").repartition(3)
    got = suffix_dedup.remove_repeats(docs)
    assert got.columns == ["doc_id", "doc", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = got.collect()
    assert sorted(((r.doc_id, *r[3:]) for r in found), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_many_buckets_and_slices(spark, monkeypatch):
    for name, value in (("PART_BYTES", 100), ("MESSAGE_BYTES", 40)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(suffix_dedup.textbytes, "SLICE_BYTES", 400)
    rows = corpus(3)
    deal = suffix_dedup._Deal.of(sum(len((t or "").encode()) for _, t in rows))
    assert deal.bits > 2 and deal.more > 2 and deal.block_bytes() > 400
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), keep_bytes=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_messages_grow_with_the_input(spark, monkeypatch):
    """Blocks and buckets exchange messages for one another; four times the input gives about four times as many."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup.textbytes, "SLICE_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "MESSAGE_BYTES", 1000, raising=False)
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(200)]
    sent = []
    for number in (100, 400):
        given = []
        with monkeypatch.context() as patch:
            patch.setattr(suffix_dedup, "stored", lambda df, to=given: to.append(suffix_dedup_stored(df)) or to[-1])
            docs = spark.createDataFrame([(i, " ".join(rng.choice(lines) for _ in range(10))) for i in range(number)], "doc_id long, text string")
            suffix_dedup.remove_repeats(docs.coalesce(1), keep_bytes=False).count()
        sent.append(given[1].count())
    assert sent[1] < 6 * sent[0]


def test_no_documents(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals_are_groups_of_equal_strings():
    rng = np.random.default_rng(3)
    for size, alphabet, length in [(1, 2, 3), (2, 1, 3), (300, 2, 6), (500, 3, 20), (400, 1, 50), (0, 2, 5)]:
        symbols = rng.integers(1, alphabet + 1, size).astype(np.uint16)
        order, interval = suffix_dedup.intervals(symbols, length)
        strings = [tuple(symbols[i: i + length]) for i in order]
        assert strings == sorted(strings)
        for k in range(1, size):
            whole = len(strings[k]) == len(strings[k - 1]) == length
            assert (interval[k] != interval[k - 1]) == (strings[k] != strings[k - 1]) or not whole


class Counted:
    """numpy, with the calls of one function counted."""

    def __init__(self, name):
        self.name, self.calls = name, 0

    def __getattr__(self, name):
        self.calls += name == self.name
        return getattr(np, name)


def test_intervals_take_few_passes(monkeypatch):
    """Each pass over the rows doubles the length of the strings, so 50 symbols take six passes, not fifty."""
    rng = np.random.default_rng(5)
    passage = rng.integers(1, 257, 300)
    symbols = np.concatenate([np.r_[rng.integers(1, 257, 40), passage[rng.integers(200):], 0] for _ in range(40)]).astype(np.uint16)
    counted = Counted("cumsum")
    monkeypatch.setattr(suffix_dedup, "np", counted)
    order, interval = suffix_dedup.intervals(symbols, 50)
    assert counted.calls <= 20
    strings = [tuple(symbols[i: i + 50]) for i in order]
    whole = [len(s) == 50 for s in strings]
    assert all((interval[k] != interval[k - 1]) == (strings[k] != strings[k - 1]) for k in range(1, len(order)) if whole[k] and whole[k - 1])


def test_suffixes_of_repeated_texts_are_sorted():
    """Suffixes that later rounds still tell apart, among many that the first round does."""
    rng = np.random.default_rng(6)
    for passage in (rng.integers(1, 3, 90), np.ones(120, np.int64), rng.integers(1, 257, 100)):
        symbols = np.concatenate([np.r_[rng.integers(1, 257, 60), passage[k:], 0] for k in range(0, 60, 7)]).astype(np.uint16)
        padded = np.r_[symbols, np.zeros(50, np.uint16)]
        order = suffix_dedup.suffix_array(symbols, 50)
        strings = [tuple(padded[i: i + 50]) for i in order]
        assert sorted(order.tolist()) == list(range(len(symbols))) and strings == sorted(strings)


def test_gram_hashes_are_range_hashes():
    for size in (0, 15, 16, 17, 5000):
        data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
        at = np.arange(max(0, size - 15))
        grams = suffix_dedup.textbytes.gram_hashes(suffix_dedup.textbytes.running_sum(data), 16)
        assert np.array_equal(grams, suffix_dedup.textbytes.range_hashes(data, at, at + 16))
