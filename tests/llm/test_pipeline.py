from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark import cloudpickle

from skumetry.llm import byte_bpe, queries
from test_mixing import mixing
from test_parity_join import shingles_of
from test_pii import PLAIN, pii
from test_pii import brute as brute_entities
from test_quality import brute_statistics

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus():
    rng = random.Random(12)
    syllables = ["ba", "do", "ki", "lu", "men", "so", "ta", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randint(55, 120))]
        if i % 10 == 3:
            text = rows[i - 3][1].split(" ")
            text[rng.randrange(len(text))] = word()
        if i % 7 == 2:
            text[9] = "+1 (743) 555-3824 or me@example.org"
        rows.append((i, " ".join(text), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", None]), 1, "k"))
    rows += [(200, None, "en", "src1", None, None), (201, "", "en", "src1", 0, "k"), (202, "too short", "en", "src1", 9, "k"), (203, "a b c " * 60, "en", "src1", 9, "k")]
    return rows + [rows[5], rows[6], (None, " ".join(word() for _ in range(70)), "en", "src2", 5, "k")]


@pytest.fixture(scope="module")
def staged(spark):
    docs = [spark.createDataFrame(corpus(), SCHEMA)]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.stored(stage(spark, docs[-1], "nowhere")))
    return docs


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality_keeps_what_the_rules_keep(staged):
    assert staged[1].columns == staged[0].columns
    good = [r for r in corpus() if (s := brute_statistics(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    kept = rows_of(staged[1])
    assert not Counter(kept) - Counter(good) and len(kept) >= 0.95 * len(good)


def test_one_of_each_group_stays(staged):
    """Of texts linked by five words and 0.8 the least id stays; rows without an id come last."""
    before, after = rows_of(staged[1]), rows_of(staged[2])
    sets = [shingles_of(r[1], 5) for r in before]
    group = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    expected = [min((before[i] for i in range(len(before)) if group[i] == g), key=lambda r: (r[0] is None, r[0])) for g in set(group)]
    assert Counter(after) == Counter(expected) and len(after) < len(before)


def test_base_entities_are_masked(staged):
    before = {r[0]: r for r in rows_of(staged[2])}
    for row in rows_of(staged[3]):
        old = before[row[0]]
        assert row[2:4] == old[2:4] and row[4] == len(row[1])
        assert not any(p.search(row[1]) for k, p in PLAIN.items() if k != "card")
        if not brute_entities(old[1]) and "[" not in row[1]:
            assert row[1] == old[1]
    assert any(f"[{k.upper()}]" in r[1] for r in rows_of(staged[3]) for k in pii.KINDS)


def test_mix_repeats_and_drops_whole_rows(staged):
    before, after = Counter(rows_of(staged[3])), Counter(rows_of(staged[4]))
    assert set(after) <= set(before) and max(after.values()) <= mixing.MAX_EPOCHS
    words = lambda c: sum(n * len(re.findall(r"\S+", r[1])) for r, n in c.items())
    assert 0.9 * words(before) <= words(after) <= 1.2 * words(before)


def test_encoding(staged):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.rank_lines()), special_tokens={})
    expected = []
    for doc_id, text, *others in rows_of(staged[4]):
        ids = library.encode_ordinary(text)
        expected.append((doc_id, *others, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert rows_of(staged[5]) == sorted(expected, key=str)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_of_long_texts_are_bounded(spark):
    """A stage's Python workers get texts in batches of bounded bytes, not 10,000 at a time."""
    setting, bound = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
    spark.conf.unset(setting)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    docs = spark.createDataFrame([(i, f"{i} " * 2000, "en") for i in range(600)], "doc_id long, text string, lang string").coalesce(1)
    for stage in (corpus_pipeline.keep_good_documents, corpus_pipeline.drop_near_duplicates, corpus_pipeline.encode_bytes):
        stage(spark, docs.limit(0), "nowhere")
        assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 2 * bound
        spark.conf.unset(setting)
    spark.conf.set(setting, "3000000")
    corpus_pipeline.encode_bytes(spark, docs, "nowhere")
    assert spark.conf.get(setting) == "3000000"
    spark.conf.unset(setting)


def test_workers_drop_their_encoder(spark, monkeypatch):
    """What the encoding remembers does not stay beside the tasks that a worker runs next."""
    docs = spark.createDataFrame(corpus()[:8], SCHEMA)
    batch = pa.RecordBatch.from_pylist([{**{c: None for c in docs.columns}, "text": "some text"}]).select([*(c for c in docs.columns if c != "text"), "text"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: cloudpickle.loads(cloudpickle.dumps(function)))
    task = byte_bpe.token_digests(docs, queries.rank_lines(), public_tokenizers.PATTERN)
    assert next(task(iter([batch]))).num_rows == 1 and byte_bpe._STATE
    assert [b.num_rows for b in corpus_pipeline.encode_bytes(spark, docs, "nowhere")(iter([batch]))] == [1]
    assert not byte_bpe._STATE
