from __future__ import annotations

import math
import random
import re
from collections import Counter

import compare
import numpy as np
import pytest

from skumetry.llm import lexical, queries

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in counted if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c in counted:
            if doc is None or not c:
                continue
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["Ünter", "X9", "Ⅷ", "日本"]
    text = lambda n: " ".join(rng.choice([" ", "-", ", "]).join([rng.choice(vocabulary)]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(250)]
    docs += [(i, docs[3][1].upper()) for i in range(250, 340)]
    docs += [docs[4], docs[4], (400, None), (401, ""), (402, "\x00 .,;"), (None, docs[5][1]), (403, text(60_000))]
    items = [(i, text(rng.randint(1, 30))) for i in range(30)]
    items += [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere?"), (54, docs[7][1]), (54, docs[8][1]), (54, docs[8][1]), (None, docs[9][1])]
    return docs, items


def ranked(spark, docs, items):
    found = lexical.rank_documents(
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    )
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("settings", [{}, {"BLOCK_TERMS": 150, "TILE_ITEMS": 3, "TILE_TERMS": 50, "TILE_DOCS": 16, "STRIP": 7, "PART_DOCS": 30}])
def test_equals_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    assert ranked(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a"), (0, "A a")], [(3, "a")])])
def test_small_tables(spark, docs, items):
    assert ranked(spark, docs, items) == brute(docs, items)


def test_tiles_hold_every_item_once():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 20_000, n)) for n in [3, 2000, 2000, 2000, 9000, 5] + [40] * 200]
    tiles = lexical.item_tiles(own)
    assert np.concatenate([i for i, _ in tiles]).tolist() == list(range(len(own)))
    for items, vocabulary in tiles:
        assert len(items) <= lexical.TILE_ITEMS and (len(items) == 1 or len(vocabulary) <= lexical.TILE_TERMS)
        assert all(np.isin(own[i], vocabulary).all() for i in items)


def test_query_matches_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    assert compare.differences(queries.queries()["op12_lexical_search"](spark, folder), duck, lexical.ORACLE_SQL) == []
