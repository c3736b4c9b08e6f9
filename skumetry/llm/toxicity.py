"""Toxicity by a weighted grammar of finite-state transducers (operator 5).

A lexicon of words and word beginnings with weights turns the words of a clause into symbols:
insult, threat, target, negation, reporting verb or other. Five small transducers read these
symbols. The insult transducer accepts an insult near a target or near another insult, the
threat transducer a threat near a target; what belongs to no such phrase is a lone word and
keeps a quarter of its weight. The others weaken what reported speech governs, weaken what
follows a negation closely, and strengthen what has a target before it in the clause. Their
composition is one transducer, and a clause weighs what its heaviest accepted path weighs. A
document's evidence is its strongest clause and a part of the others; a logistic curve turns
evidence into a score.

Weights and curve are learned from labels. Words come from a bounded sample of labelled rows
(``TRAIN_ROWS``, those with the smallest hashes) as log odds; the curve is fitted on counts by
evidence over the same rows. Held-out rows, and language, source and id, never enter.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skumetry.llm import textbytes

#: The bound on labelled rows from which weights are learned.
TRAIN_ROWS = 20_000
#: A word or beginning is learned if so many toxic texts have it, at this log odds or more.
LEAST_TEXTS, LEAST_ODDS = 4, 3.0
#: Lengths, in bytes, of word beginnings.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7

# Function words and seeds in the four languages.
TARGETS = frozenset("you your you're u he she they them him her du dich dir ihr euch sie er tu te toi vous il elle eux usted ustedes tú ti él ella ellos".split())
NEGATIONS = frozenset("not no never neither isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás".split())
REPORTS = frozenset("said says claimed claims reported quoted wrote called sagte sagt behauptet schrieb dit disait écrit dijo dice escribió".split())
THREATS = {w: 3.0 for w in "kill murder hurt destroy shoot stab strangle töten umbringen vernichten tuer détruire matar destruir".split()}
INSULTS = {w: 3.0 for w in "idiot idiots moron stupid loser scum trash worthless pathetic disgusting dumpfbacke trottel imbécile crétin imbécil idiota".split()}
# End of fixed values.

#: What a state and a symbol lead to: any number of (symbol written, factor, next state).
Arcs = dict[tuple[int, str], tuple[tuple[str, float, int], ...]]
SYMBOLS = "IWTNRO"
#: What a word outside every phrase keeps of its weight.
LONE = 0.25


@dataclass(frozen=True)
class Transducer:
    """Arcs from state 0 on, and the states in which a clause may end."""

    arcs: Arcs
    finals: frozenset[int]


def _plain(states: int, special: dict[tuple[int, str], tuple[str, float, int]]) -> Transducer:
    """All symbols pass unchanged, but for the arcs in ``special``; a clause may end anywhere."""
    arcs = {(s, x): (x, 1.0, s) for s in range(states) for x in SYMBOLS} | special
    return Transducer({k: (arc,) for k, arc in arcs.items()}, frozenset(range(states)))


def _phrase(word: str, partners: str, before: int, after: int) -> Transducer:
    """Accepts ``word`` in full at most ``before`` symbols behind or ``after`` symbols ahead of a partner.

    State 0 has no partner near. States 1 to ``before`` count the symbols for which the last partner
    stays near. In the states above, a word taken in full still waits for its partner, and no
    clause may end there.
    """
    arcs = {}
    for state in range(before + after + 1):
        waits = state > before
        further = state - 1 if state != before + 1 else None
        for symbol in SYMBOLS:
            to = before if symbol in partners else further
            out = [(symbol, LONE if symbol == word else 1.0, to)]
            if symbol == word:
                # Near a partner, or waiting as the word before does, whose partner is near both.
                out += [(symbol, 1.0, to)] if state else []
                out += [] if waits else [(symbol, 1.0, before + after)]
            arcs[state, symbol] = tuple((y, w, max(to, 0)) for y, w, to in out if to is not None)
    return Transducer(arcs, frozenset(range(before + 1)))


#: An insult up to four words behind, or three ahead of, a target or another insult.
INSULT = _phrase("I", "TI", 4, 3)
#: A threat up to four words behind, or three ahead of, a target.
THREAT = _phrase("W", "T", 4, 3)
#: Behind a reporting verb insults and threats count little.
REPORTED = _plain(2, {(s, "R"): ("R", 1.0, 1) for s in (0, 1)} | {(1, x): (x, 0.4, 1) for x in "IW"})
#: Within three words of a negation they count half.
NEGATED = _plain(4, {(s, x): (x, 0.5 if s and x in "IW" else 1.0, max(s - 1, 0)) for s in range(4) for x in SYMBOLS} | {(s, "N"): ("N", 1.0, 3) for s in range(4)})
#: With a target before them in the clause they count more.
TARGETED = _plain(2, {(s, "T"): ("T", 1.0, 1) for s in (0, 1)} | {(1, x): (x, 1.5, 1) for x in "IW"})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what ``first`` reads and writes what ``second`` makes of it."""
    seconds = 1 + max(s for s, _ in second.arcs)
    arcs = {
        (s * seconds + t, x): tuple((z, w * v, s2 * seconds + t2) for y, w, s2 in out for z, v, t2 in second.arcs[t, y])
        for (s, x), out in first.arcs.items()
        for t in range(seconds)
    }
    return Transducer(arcs, frozenset(s * seconds + t for s in first.finals for t in second.finals))


GRAMMAR = functools.reduce(compose, [REPORTED, NEGATED, TARGETED, INSULT, THREAT])


def clause_weight(symbols: list[tuple[str, float]]) -> float:
    """The weight of a clause: what its insults and threats weigh on the heaviest accepted path."""
    if not any(weight for _, weight in symbols):
        return 0.0
    best = {0: 0.0}
    for symbol, weight in symbols:
        ahead: dict[int, float] = {}
        for state, total in best.items():
            for _, factor, to in GRAMMAR.arcs[state, symbol]:
                value = total + weight * factor
                if value > ahead.get(to, -1.0):
                    ahead[to] = value
        best = ahead
    return max(value for state, value in best.items() if state in GRAMMAR.finals)


_PARTS = np.zeros(256, bool)
_PARTS[[*b"'", *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
_CLAUSE = re.compile(rb"[.,;:!?\n|()\"]+")
_WORD = re.compile(rb"[A-Za-z'\x80-\xff]+")


class Lexicon:
    """Weighted words and word beginnings; the most specific entry counts."""

    def __init__(self, words: dict[bytes, float], beginnings: dict[bytes, float]):
        self.words, self.beginnings = words, beginnings
        self.threats = {w.encode() for w in THREATS}

    def hashes(self) -> list[np.ndarray]:
        """Sorted hashes of the whole words and of the beginnings of each length."""
        of = [list(self.words), *([b for b in self.beginnings if len(b) == n] for n in BEGINNINGS)]
        out = []
        for entries in of:
            sizes = np.cumsum([0, *map(len, entries)])
            data = np.frombuffer(b"".join(entries), np.uint8)
            out.append(np.sort(textbytes.range_hashes(data, sizes[:-1], sizes[1:])))
        return out

    def symbol(self, word: bytes) -> tuple[str, float]:
        weight = self.words.get(word)
        for n in reversed(BEGINNINGS) if weight is None else ():
            weight = self.beginnings.get(word[:n]) if len(word) >= n else None
            if weight is not None:
                break
        if weight is not None:
            return ("W" if word in self.threats else "I"), weight
        text = word.decode()
        return ("T" if text in TARGETS else "N" if text in NEGATIONS else "R" if text in REPORTS else "O"), 0.0


def evidence(text: bytes, lexicon: Lexicon) -> float:
    """The strongest clause and a quarter of all others; ``text`` is in lower case."""
    weights = [clause_weight([lexicon.symbol(w) for w in _WORD.findall(c)]) for c in _CLAUSE.split(text)]
    best = max(weights, default=0.0)
    return best + 0.25 * (sum(weights) - best)


def _has(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(wanted), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)] == wanted


def batch_evidence(column: pa.Array, lexicon: Lexicon, entries: list[np.ndarray]) -> list[float]:
    """The evidence of each text. Only texts with an entry of the lexicon are read word by word."""
    data, offsets = textbytes.flatten(column, lower=True)
    starts, ends, firsts = textbytes.words(data, offsets, _PARTS)
    hit = _has(entries[0], textbytes.range_hashes(data, starts, ends))
    for n, own in zip(BEGINNINGS, entries[1:]):
        hit |= (ends - starts >= n) & _has(own, textbytes.range_hashes(data, starts, np.minimum(starts + n, ends)))
    upto = np.r_[0, np.cumsum(hit)]
    any_hit = upto[firsts[1:]] > upto[firsts[:-1]]
    return [evidence(data[a:b].tobytes(), lexicon) if h else 0.0 for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), any_hit.tolist())]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``text`` and ``toxic`` of at most ``limit`` labelled documents that are not held out.

    Ids whose labels differ are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def learn_lexicon(training: DataFrame) -> Lexicon:
    """Words and beginnings whose log odds speak for toxic texts; seeds without counter-evidence stay."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = {w for w in _WORD.findall(textbytes._LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes())}
                texts[toxic] += 1
                counts.update((w, 0, toxic) for w in own)
                for n in BEGINNINGS:
                    counts.update((w, n, toxic) for w in {w[:n] for w in own if len(w) > n})
        rows = [(w, n, t, c) for (w, n, t), c in counts.items()] + [(b"", -1, t, c) for t, c in texts.items()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["entry", "length", "toxic", "texts"])

    counted = training.mapInArrow(count, "entry binary, length long, toxic long, texts long").groupBy("entry", "length").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("texts"))).alias("clean")
    )
    total = counted.where("length = -1").first()
    toxic, clean = (total.toxic, total.clean) if total else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = counted.where("length >= 0").withColumn("odds", odds).where((F.col("toxic") >= LEAST_TEXTS) & (F.col("odds") >= LEAST_ODDS)).collect()
    beginnings = {bytes(r.entry): r.odds for r in rows if r.length}
    # A longer beginning, or a word, is only of use if no shorter one stands for it.
    beginnings = {b: w for b, w in beginnings.items() if not any(b[:n] in beginnings for n in BEGINNINGS if n < len(b))}
    words = {w.encode(): v for w, v in (INSULTS | THREATS).items()}
    words |= {bytes(r.entry): r.odds for r in rows if not r.length and not any(bytes(r.entry)[:n] in beginnings for n in BEGINNINGS)}
    return Lexicon(words, beginnings)


def fit_curve(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts of (evidence, toxic, clean), by Newton's method."""
    x, t, c = (np.array(v, np.float64) for v in zip(*counts)) if counts else (np.zeros(1),) * 3
    slope, offset = 1.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        n = t + c
        gradient = np.array([((t - n * p) * x).sum() - 0.01 * slope, (t - n * p).sum() - 0.01 * offset])
        w = n * p * (1 - p)
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope + float(np.clip(step[0], -1, 1)), offset + float(np.clip(step[1], -1, 1))
    return max(slope, 0.0), offset


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``evidence``, ``score`` and ``predicted``.

    Null and empty texts have no evidence and the score of texts without any. Without training
    rows the seeds and a fixed curve decide. Columns of ``docs`` that bear a result's name are
    replaced, others are kept; repeated rows get the same score.
    """
    keep = [c for c in docs.columns if c not in ("text", "evidence", "score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    lexicon = learn_lexicon(training)
    entries = lexicon.hashes()

    def weigh(fields):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in textbytes.slices(batches):
                found = pa.array(batch_evidence(batch.column("text"), lexicon, entries), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), found], [*fields, "evidence"])
        return run

    steps = training.select("toxic", "text").mapInArrow(weigh(["toxic"]), T.StructType([training.schema["toxic"], T.StructField("evidence", T.DoubleType())]))
    # At most 1,601 steps of evidence.
    counts = steps.groupBy(F.least(F.round(F.col("evidence") * 16), F.lit(1600.0)).alias("step")).agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"), F.count(F.lit(1)).alias("n"))
    slope, offset = fit_curve([(r.step / 16, r.t, r.n - r.t) for r in counts.collect()])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("evidence", T.DoubleType())])
    score = 1 / (1 + F.exp(-F.least(F.greatest(slope * F.least("evidence", F.lit(100.0)) + offset, F.lit(-30.0)), F.lit(30.0))))
    scored = docs.mapInArrow(weigh(keep), schema).withColumn("score", score)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def held_out_accuracy(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts``, ``right``, ``toxic`` and ``caught`` over the held-out labelled rows of ``scored``."""
    rows = scored.where(is_held_out(F.col("doc_id"))).join(labels.select("doc_id", "toxic"), "doc_id")
    return rows.agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("predicted") == F.col("toxic")).alias("right"),
        F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("toxic") == 1) & (F.col("predicted") == 1)).alias("caught"),
    )
