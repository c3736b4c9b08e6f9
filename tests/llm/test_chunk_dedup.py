from __future__ import annotations

import hashlib
import random

import numpy as np

from skumetry.llm import chunk_dedup


def cut_plainly(text):
    """Byte after byte, from the definition of the gear hash."""
    cuts, start, h = [0], 0, 0
    for i, byte in enumerate(text):
        h = (2 * h + int(chunk_dedup._GEAR[byte])) & 0xFFFFFFFF
        whole = i + 1 == len(text) or text[i + 1] & 0xC0 != 0x80
        size = i + 1 - start
        if whole and (i + 1 == len(text) or size >= chunk_dedup.LEAST and h >> 27 == 0 or size >= chunk_dedup.MOST):
            cuts.append(i + 1)
            start = i + 1
    return cuts


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(80)
    rows = [(i, f"{prose(rng.randint(0, 60))} {shared if i % 3 == 0 else ''} {prose(30)}") for i in range(40)]
    rows += [(50, rows[7][1]), (51, "x" * 5000), (52, "é" * 4000), (53, ""), (54, None), (7, rows[7][1]), (None, rows[8][1]), (55, prose(40) * 4)]
    return rows


def brute(rows):
    key = lambda i: chunk_dedup._LAST_ID if i is None else i
    texts = [(key(i), (t or "").encode()) for i, t in rows]
    owner = {}
    for doc, text in texts:
        cuts = cut_plainly(text)
        for a, b in zip(cuts, cuts[1:]):
            owner[text[a:b]] = min(owner.get(text[a:b], doc), doc)
    out = []
    for (doc_id, _), (doc, text) in zip(rows, texts):
        cuts, seen, kept, gone = cut_plainly(text), set(), b"", []
        for a, b in zip(cuts, cuts[1:]):
            repeated = owner[text[a:b]] != doc or text[a:b] in seen
            seen.add(text[a:b])
            gone.append(repeated)
            kept += b"" if repeated else text[a:b]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(text), len(cuts) - 1, len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_equals_plain_chunking(spark):
    docs = spark.createDataFrame([(i, t, 0, "d") for i, t in corpus()], "doc_id long, text string, n_bytes int, doc string")
    got = chunk_dedup.remove_repeats(docs)
    assert got.columns == ["doc_id", "doc", "text", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256"]
    rows = got.collect()
    assert sorted(((r.doc_id, *r[3:]) for r in rows), key=str) == brute(corpus())
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    caught = {r.doc_id for r in rows if r.n_removed}
    assert {i for i in range(3, 40, 3)} <= caught and not caught & {0, 1, 2, 4, 5, 7, 53, 54}
    assert chunk_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_cuts_are_found_again_after_an_insertion():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))

    def chunks(t):
        cuts = chunk_dedup.cut(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        return {t[a:b] for a, b in zip(cuts, cuts[1:])}

    assert len(chunks(text) & chunks(text[:5000] + b"new" + text[5000:])) > 0.97 * len(chunks(text))
