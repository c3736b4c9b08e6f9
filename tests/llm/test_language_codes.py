from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skumetry.llm import language_codes, queries

WORDS = {
    "en": "the and with from thing shall over under water because house through".split(),
    "de": "der und mit von schön über Straße weil durch können Häuser nicht".split(),
    "es": "el y con niño sobre porque agua corazón mañana mujer ningún señor".split(),
    "fr": "le et avec être sur parce eau cœur demain femme aucun maison".split(),
    "pl": "nie jest się dziękuję proszę woda dom przez słońce człowiek ręka".split(),
    "fi": "ja ei ole hyvää päivää vesi talo kautta aurinko ihminen käsi minä".split(),
    "tr": "ve değil günaydın su ev üzerinden güneş insan çünkü şimdi ağaç".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def labelled(spark, langs, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(i, text(rng, lang, rng.choice([3, 8, 60])), lang) for i in range(n) for lang in [langs[0] if i % 3 == 0 else rng.choice(langs)]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("count", range(2, 40, 3))
def test_codewords(count):
    code = language_codes.codewords(count)
    assert len({tuple(c) for c in code.tolist()}) == count
    assert (np.abs(code.sum(axis=0)) < count).all()
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (2 ** (count - 2) if count <= 5 else code.shape[1] // 5)


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "es", "fr"], list(WORDS)])
def test_unseen_texts(spark, langs):
    model = language_codes.learn(labelled(spark, langs), F.col("lang"))
    assert model.languages == sorted(langs) and model.weights.mean() == pytest.approx(1)
    got = language_codes.identify(labelled(spark, langs, 200, seed=2), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_a_wrong_bit_is_corrected_and_a_tie_is_flagged():
    model = language_codes.Model(list("abcd"), language_codes.codewords(4), np.zeros((1, 7), np.int32), np.ones(7))
    for language, word in enumerate(model.code):
        for bit in range(7):
            margins = 5.0 * word[None, :]
            margins[0, bit] *= -1
            assert model.losses(margins).argmin() == language
    between = model.losses(2.5 * (model.code[0] + model.code[1]).astype(float)[None, :])[0]
    assert between[0] == pytest.approx(between[1]) and sorted(between)[2] > between[0] + language_codes.MARGIN


def test_n_grams_match_a_plain_version():
    texts = ["Das Öl, 9 kg!", None, "", " a ", "日本", "ÑÑ x\ny"]
    expected = []
    for place, order in enumerate(language_codes.ORDERS):
        for i, t in enumerate(texts):
            clean = b" " + bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in (t or "").lower().encode()) + b" "
            for at in range(len(clean) - order + 1):
                gram = clean[at: at + order]
                if gram.strip(b" "):
                    code = (int.from_bytes(gram, "big") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48
                    expected.append((code % language_codes.BUCKETS + place * language_codes.BUCKETS, i))
    for held in (pa.array(texts), pa.array(["cut off", *texts])[1:]):
        buckets, owners = language_codes.n_grams(held)
        assert list(zip(buckets.tolist(), owners.tolist())) == expected


def test_results_do_not_depend_on_partitions(spark, monkeypatch):
    docs = labelled(spark, list(WORDS)[:4])
    one = language_codes.learn(docs.coalesce(1), F.col("lang"))
    monkeypatch.setattr(language_codes, "HELD_LANGUAGES", 1)
    monkeypatch.setattr(language_codes, "PIECE", 5)
    many = language_codes.learn(docs.repartition(7), F.col("lang"))
    assert (one.odds == many.odds).all() and (one.weights == many.weights).all()
    found = [sorted(map(tuple, language_codes.identify(docs.repartition(n), one).collect())) for n in (1, 5)]
    assert found[0] == found[1]


def test_edge_cases(spark):
    model = language_codes.learn(labelled(spark, ["en", "de"]), F.col("lang"))
    rng = random.Random(3)
    rows = [(1, None, "x", 7), (2, "", "x", 7), (3, "12 -- !?", "x", 7), (4, text(rng, "de", 200_000), None, None), (None, text(rng, "en", 9), "x", 7), (5, "Ⅷ", "x", 7)]
    rows += [(6, "the", "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string, score int")
    got = {r.doc_id: r for r in language_codes.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5)] == ["und"] * 4 and got[1].score == 0.0
    assert got[4].lang_pred == "de" and got[None].lang_pred == "en" and got[6].lang_pred == "en"
    assert language_codes.identify(df.limit(0), model).count() == 0
    assert language_codes.identify(df, model).columns == ["doc_id", "text", "lang_pred", "score", "ambiguous", "bits"]


def test_nothing_and_one_language_learned(spark):
    docs = labelled(spark, ["en"], 9)
    none = language_codes.learn(docs.where("lang = 'xx'"), F.col("lang"))
    assert {(r.lang_pred, r.score) for r in language_codes.identify(docs, none).collect()} == {("und", 0.0)}
    one = language_codes.learn(docs, F.col("lang"))
    assert {(r.lang_pred, r.score) for r in language_codes.identify(docs, one).collect()} == {("en", 1.0)}


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.queries()["op11_language_codes"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and np.mean([truth[r.doc_id].lang == r.lang_pred for r in held]) >= 0.99
