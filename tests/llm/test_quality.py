from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from skumetry.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def brute_model(docs):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    grams = Counter()
    for lang, text in docs:
        padded = b"\0" * (quality.ORDER - 1) + (text or "").encode()
        for i in range(quality.ORDER - 1, len(padded)):
            grams[lang or "", padded[i - quality.ORDER + 1: i + 1]] += 1
    orders = {quality.ORDER: grams}
    for k in range(quality.ORDER - 1, 0, -1):
        orders[k] = Counter((lang, g[1:]) for lang, g in orders[k + 1])
    p = {}
    for k in range(1, quality.ORDER + 1):
        of = Counter(orders[k].values())
        n1, n2, n3, n4 = (max(1, of[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = {i: min(max(x, 0.1), i) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))}
        total, held = Counter(), Counter()
        for (lang, g), n in orders[k].items():
            total[lang, g[:-1]] += n
            held[lang, g[:-1]] += d[min(n, 3)]
        new = {}
        for (lang, g), n in orders[k].items():
            c = (lang, g[:-1])
            new[lang, g] = (n - d[min(n, 3)]) / total[c] + held[c] / total[c] * (p[lang, g[1:]] if k > 1 else 1 / 256)
        p = new
    return p


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "ände", "stone", "river", "of", "light", "to", "go"]
    out = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        if i % 4:
            text = re.sub(r"(\S+ \S+) \S+", lambda m: f"{m[1]} {rng.choice('abcdefgh') * 2}{rng.randint(0, 99)}", " ".join(words))
        else:
            text = "\n".join(" ".join(words[k: k + 8]) for k in range(0, len(words), 8))
        out.append((i, ["en", "de", None][i % 3], text))
    out += [(100, "en", None), (101, "de", ""), (102, None, " \t\n"), (103, "en", "a b c a b c a b c"), (103, "en", "a b c a b c a b c")]
    return out


def test_statistics_scores_and_both_look_ups(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = brute_model([(lang, text) for _, lang, text in rows])
    expected = []
    for doc_id, lang, text in rows:
        padded = b"\0" * (quality.ORDER - 1) + (text or "").encode()
        logs = [math.log(model[lang or "", padded[i - quality.ORDER + 1: i + 1]]) for i in range(quality.ORDER - 1, len(padded))]
        expected.append((doc_id, *brute_statistics(text), round(-sum(logs) / len(logs), 4) if logs else 0.0))
    for limit in (quality.MODEL_ROWS, 0):
        got = quality.score_documents(docs, limit).collect()
        assert sorted((r.doc_id, *(r[s] for s in quality.STATISTICS), round(r.log_perplexity, 4)) for r in got) == sorted(expected)


def test_verdicts(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, kept string, n_words int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert len(got) == len({r[0] for r in rows})
    assert got[100].base_failed and got[101].base_failed and got[103].base_failed


def test_band_rejects_a_text_unlike_its_language(spark):
    rng = random.Random(3)
    syllables = ["aab", "abb", "bab"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    rows = [(i, "en", " ".join(word() for _ in range(150))) for i in range(60)]
    rows.append((99, "en", " ".join("".join(rng.choice("ab") for _ in range(9)) for _ in range(150))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_verdicts(docs).collect()}
    assert got == {i: (False, i != 99) for i, _, _ in rows}


def both_ways(docs, **band):
    return [{r.doc_id: r for r in quality.quality_verdicts(docs, limit, **band).collect()} for limit in (quality.MODEL_ROWS, 0)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 3000])
def test_both_look_ups_agree_to_the_last_bit(spark, rows, monkeypatch, block_bytes):
    """Also where a blank in ``lang`` makes two (language, text) pairs read alike, and with texts of several blocks."""
    monkeypatch.setattr(quality._block_costs, "__defaults__", (block_bytes,))
    # Bands as narrow as this have texts at and beyond their edges.
    given = rows[:60] + [(300, "a", "b c " + rows[1][2]), (301, "a b", "c " + rows[1][2]), (302, "a", rows[2][2]), (303, "en", None), (304, "", "x")]
    docs = spark.createDataFrame(given, "doc_id long, lang string, text string")
    small, large = both_ways(docs, below=0.5, above=0.5)
    assert small == large and len({r.kept for r in small.values()}) == 2
    assert small[300].log_perplexity != small[301].log_perplexity


def test_texts_longer_than_a_slice(spark, rows):
    long = " ".join(r[2] for r in rows[:60]) * 60
    assert len(long) > 1 << 20
    docs = spark.createDataFrame([(1, "en", long), (2, "en", rows[0][2]), (3, "en", long)], "doc_id long, lang string, text string")
    small, large = both_ways(docs)
    assert small == large
    for doc_id, text in ((1, long), (2, rows[0][2])):
        assert tuple(small[doc_id][s] for s in quality.STATISTICS) == brute_statistics(text)
    assert small[1][1:] == small[3][1:]


def test_columns_of_any_name_are_kept(spark, rows):
    extra = ("lowest", "highest", "_lang", "_salt", "text_key", "cost", "row", "key", "block", "kind", "sum_logp", "a.b")
    docs = spark.createDataFrame([(*r, *map(str, range(len(extra)))) for r in rows[:20]],
                                 "doc_id long, lang string, text string, " + ", ".join(f"`{c}` string" for c in extra))
    for limit in (quality.MODEL_ROWS, 0):
        got = quality.quality_verdicts(docs, limit)
        assert got.columns[: 2 + len(extra)] == ["doc_id", "lang", *extra]
        assert all(tuple(r)[2: 2 + len(extra)] == tuple(map(str, range(len(extra)))) for r in got.collect())


def test_a_text_at_the_edge_of_its_band_is_kept(spark):
    scored = spark.createDataFrame([("x", 60, 0, v) for v in (1.0, 1.0, 1.0)], "lang string, n_words long, n_repeat_words long, log_perplexity double")
    band = quality.perplexity_bands(scored, 0.0, 0.0).first()
    assert band.lowest == band.highest == 1.0


def test_no_documents(spark):
    assert quality.quality_verdicts(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
