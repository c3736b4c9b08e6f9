from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skumetry.llm import parity_join
from skumetry.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:]))


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([3, 5, 20, 60, 150, 400]))]
        for copy in range(rng.choice([1, 2, 4, 30])):
            own = list(text)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                at = rng.randrange(len(own))
                own[at: at + rng.choice([0, 1])] = [rng.choice(words)]
            rows.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in own))
    rows += ["", None, " \t ", "one", "One", "two words", "two  WORDS", "É a b", "é a b", "x y z", "x y z", "a " * 3000]
    rows.append(" ".join(rng.choice(words) for _ in range(9000)))
    rows.append(rows[-1] + " tail of it")
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, rows[4]), (None, "nowhere else at all")]


@pytest.mark.parametrize("leaders, nearest, block", [(1, 1, 256), (0, 0, 4), (0, 1, 4)])
def test_components_equal_brute_force(spark, monkeypatch, leaders, nearest, block):
    monkeypatch.setattr(parity_join, "LEADER_ROUNDS", leaders)
    monkeypatch.setattr(parity_join, "NEAREST_ROUNDS", nearest)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n_shingles int")
    got = sorted(map(tuple, parity_join.link_components(docs).collect()), key=str)
    assert got == brute(rows)


def test_few_texts_are_shuffled_that_nobody_asks_for(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i if i % 7 else None, " ".join(str(rng.random()) for _ in range(20))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = parity_join.stored(parity_join.signatures(docs))
    nodes = parity_join.stored(signed.orderBy("text_hash").limit(20).select("node"))
    given = []
    pack = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a: given.append(pack(*a)) or given[-1])
    texts = parity_join._texts(docs, signed, nodes)
    assert sorted(r.node for r in texts.collect()) == sorted(r.node for r in nodes.collect())
    assert 20 <= given[0].count() < 150


def test_texts_are_shuffled_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3, "some words of a text") for i in range(9)], "doc_id long, text string")
    signed = parity_join.stored(parity_join.signatures(docs))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = parity_join._texts(docs, signed, signed.select("node").distinct())
        assert texts.count() == 1
        plan = texts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 2


def test_a_class_sends_its_keys_once_a_task(spark, monkeypatch):
    monkeypatch.setattr(parity_join.textbytes, "SLICE_BYTES", 100)
    docs = spark.createDataFrame([(i, "the same words in all of these texts " * 3) for i in range(50)], "doc_id long, text string").coalesce(1)
    entries = parity_join._entries(docs, parity_join.CONTRACT)
    assert entries.count() == entries.distinct().count()


def test_no_documents(spark):
    assert parity_join.link_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_agree_in_a_part():
    rng = np.random.default_rng(2)
    for size in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = rng.integers(0, size // 10 + 1)
            b = np.r_[a[gone:], rng.integers(0, 1 << 63, rng.integers(0, size // 10 + 1), dtype=np.uint64)]
            both = size - gone
            if not len(b) or 100 * both < 90 * (len(a) + len(b) - both):
                continue
            shared = set(parity_join.groups_of(len(a))) & set(parity_join.groups_of(len(b)))
            assert any(np.intersect1d(parity_join.part_keys(a, g), parity_join.part_keys(b, g)).size for g in shared)
            for g in shared:
                p, q = (parity_join.compact_sketch(x, g).view(np.uint64) for x in (a, b))
                assert 19 * int(np.bitwise_count(p ^ q).sum()) <= len(a) + len(b)


def test_shingle_sets_of_a_sliced_column():
    column = pa.array(["drop", "A b c d", None, "a B c d"]).slice(1)
    a, none, b = parity_join.shingle_sets(column)
    assert len(none) == 0 and a.tolist() == b.tolist() and len(a) == 2


def test_components_of_a_long_chain(spark):
    rng = random.Random(4)
    ids = list(range(300))
    rng.shuffle(ids)
    links = list(zip(ids, ids[1:])) + [(1000, 1001), (1001, 1002)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {i: 1000 for i in (1000, 1001, 1002)}


def shingles_of(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


def brute_stage(rows):
    """The ids that stay: of texts linked by five words and 0.8 the smallest, and texts without words."""
    sets = [shingles_of(text, 5) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return sorted(min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows)) if root(i) == i)


def test_stage_equals_brute_force_on_five_words(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(f"common{i}" for i in range(12))
    texts = []
    for base in range(25):
        own = [rng.choice(words) for _ in range(rng.choice([4, 8, 60, 130, 500]))] + ([line] if base % 2 else [])
        texts.append(" ".join(own))
        texts.append(" ".join(own + [rng.choice(words) for _ in range(len(own) * rng.choice([12, 16, 22, 26]) // 100)]))
        edited = list(own)
        for at in rng.sample(range(len(own)), max(1, len(own) * rng.choice([1, 2, 3]) // 100)):
            edited[at] = rng.choice(words)
        texts.append(" ".join(edited))
    appended = " ".join(f"x{i}" for i in range(500))
    texts += [appended, appended + " " + " ".join(f"y{i}" for i in range(80)), "", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_stage(rows)
    assert sorted(r.doc_id for r in parity_join.one_of_each_group(docs).collect()) == expected
    narrow = [r.doc_id for r in parity_join.one_of_each_group(docs, parity_join.CONTRACT).collect()]
    assert len(narrow) > len(expected)


def test_linked_sets_share_a_first_element():
    rng = np.random.default_rng(3)
    rule = parity_join.NEAR_COPIES
    for size in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = rng.integers(0, size // 5 + 1)
            b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 63, rng.integers(0, size // 5 + 1), dtype=np.uint64)])
            both = size - gone
            if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
                continue
            frequent = np.sort(rng.permutation(a)[: size // 2])
            shared = set(parity_join.groups_of(len(a), rule)) & set(parity_join.groups_of(len(b), rule))
            assert any(np.intersect1d(*(parity_join.first_keys(x, g, rule, frequent) for x in (a, b))).size for g in shared)
            for g in shared:
                p, q = (parity_join.compact_sketch(x, g, rule).view(np.uint64) for x in (a, b))
                assert int(np.bitwise_count(p ^ q).sum()) <= rule.allowed(len(a) + len(b))


def test_a_large_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    """Many texts a few edits away from one: pairs that leave the tasks do not grow with their square."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 2, 4])):
            own[at] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    given = []
    near = parity_join._near_pairs
    monkeypatch.setattr(parity_join, "_near_pairs", lambda *a, **k: given.append(parity_join.stored(near(*a, **k))) or given[-1])
    got = sorted(map(tuple, parity_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert sum(g.count() for g in given) < 5 * len(rows)


def test_one_key_stays_for_each_group(spark):
    rows = [(k, n, g) for k, members in ((1, "ab"), (2, "ba"), (3, "abc"), (4, "ab"), (5, "cd"), (6, "cd")) for n, g in ((ord(m), k == 4) for m in members)]
    got = parity_join._different_groups(spark.createDataFrame(rows, "key long, node long, guest boolean"))
    assert sorted(r.key for r in got.collect()) == [1, 3, 4, 5]
