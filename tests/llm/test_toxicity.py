from __future__ import annotations

import itertools
import random
import zlib

import pyarrow as pa

from skumetry.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.01"


def random_clause(rng, most=7):
    return [(x, float(rng.randint(1, 5)) if x in "IW" else 0.0) for x in rng.choices(toxicity.SYMBOLS, [3, 3, 2, 1, 1, 6], k=rng.randint(0, most))]


def brute_weight(clause):
    """Every choice of words taken in full; a choice counts if each has a partner near enough."""
    heavy = [i for i, (x, _) in enumerate(clause) if x in "IW"]
    best = 0.0
    for full in itertools.product((0, 1), repeat=len(heavy)):
        taken = {i for i, f in zip(heavy, full) if f}
        total = 0.0
        for i in heavy:
            x, weight = clause[i]
            partners = [j for j, (y, _) in enumerate(clause) if j != i and y in ("TI" if x == "I" else "T")]
            if i in taken and not any(i - 4 <= j <= i + 3 for j in partners):
                total = None
                break
            said, names = (any(y == k for y, _ in clause[:i]) for k in "RT")
            denied = any(y == "N" for y, _ in clause[max(i - 3, 0):i])
            total += weight * (1.0 if i in taken else toxicity.LONE) * (0.4 if said else 1.0) * (0.5 if denied else 1.0) * (1.5 if names else 1.0)
        best = max(best, total or 0.0)
    return best


def test_clause_weight_equals_every_choice_of_phrases():
    rng = random.Random(6)
    for _ in range(3_000):
        clause = random_clause(rng, 9)
        assert abs(toxicity.clause_weight(clause) - brute_weight(clause)) < 1e-9, clause


def paths(transducer, symbols):
    ahead = {(0, ()): 1.0}
    for x in symbols:
        ahead = {(to, (*written, y)): w * v for (s, written), w in ahead.items() for y, v, to in transducer.arcs[s, x]}
    return sorted(w for (s, _), w in ahead.items() if s in transducer.finals)


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(6)
    both = toxicity.compose(toxicity.NEGATED, toxicity.REPORTED)
    for _ in range(100):
        s = t = st = 0
        for x in rng.choices(toxicity.SYMBOLS, k=12):
            ((y, w, s),) = toxicity.NEGATED.arcs[s, x]
            ((z, v, t),) = toxicity.REPORTED.arcs[t, y]
            ((out, weight, st),) = both.arcs[st, x]
            assert (out, weight) == (z, w * v)
    assert paths(toxicity.INSULT, "OI") == [toxicity.LONE] and paths(toxicity.INSULT, "TI")[-1] == 1.0


def test_clauses_are_scored_not_words():
    lexicon = toxicity.Lexicon({b"idiot": 4.0, b"kill": 4.0}, {b"lowei": 5.0})
    of = lambda text: toxicity.evidence(text.encode(), lexicon)
    assert of("you are an idiot") == 6.0
    assert of("an idiot") == 1.0 and of("to kill time") == 1.0
    assert of("kill you") == 4.0 and of("idiot you are") == 4.0 and of("kill the idiot") == 2.0
    assert of("an idiot and idiot") == 8.0
    assert of("you are not an idiot") == 3.0
    assert of("they said an idiot") < of("they are an idiot")
    assert of("you, an idiot") == 1.0
    assert of("loweient") == 1.25 and of("lowe") == 0.0 and of("") == 0.0
    texts = pa.array(["You are an IDIOT", None, "", "nothing", "Loweiä, idiots"])
    assert toxicity.batch_evidence(texts, lexicon, lexicon.hashes()) == [6.0, 0.0, 0.0, 0.0, 1.25]


def corpus():
    rng = random.Random(4)
    words = ["ba", "do", "ki", "lu", "men", "so", "you", "not"]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(30)]
        toxic = int(i % 5 == 0)
        if toxic:
            text[rng.randrange(30)] = rng.choice(["blarg", "gronk" + rng.choice(["a", "e", "ii"])])
        docs.append((i, " ".join(text), 1))
        labels.append((i, toxic))
    docs += [(None, "you blarg", 1), (2000, None, 1), (2001, "", 1), (5, docs[5][1], 1)]
    return docs, labels + [(None, 1), (3000, None), labels[5]]


def test_learned_scores(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score_texts(d, toxicity.training_rows(d, known))
    rows = scored.collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    truth = {i: t for i, t in labels if t is not None}
    assert all(r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth)
    assert [r.predicted for r in rows if r.doc_id in (2000, 2001)] == [0, 0]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_texts(d, toxicity.training_rows(d, empty)).count() == len(docs)
    assert toxicity.score_texts(d.limit(0), toxicity.training_rows(d.limit(0), known)).count() == 0


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    d = spark.createDataFrame([(i, f"word{i} zzz") for i in range(400)], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    assert toxicity.training_rows(d, known).count() == 0


def test_held_out_accuracy_on_the_test_tables(spark):
    scored = queries.op5_toxicity_grammar(spark, SF_DIR)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = toxicity.held_out_accuracy(scored, spark.read.parquet(f"{SF_DIR}/labels.parquet")).first()
    assert got.texts > 80 and got.right >= 0.9 * got.texts and got.caught >= 0.6 * got.toxic
