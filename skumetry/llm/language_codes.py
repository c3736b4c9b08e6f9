"""Language identification with error-correcting output codes (operator 11).

Every language gets a codeword. For each bit of the codewords a binary classifier over byte
n-grams says whether a text's language has that bit set: it sums log odds of the text's n-grams
under the languages with the bit against those without it, every language counting alike. A
text gets the language whose codeword has the least loss; a bit's loss is logistic in the
classifier's margin and weighted by how well the classifier does on labelled texts. A
few bits may be wrong before the nearest codeword changes. Texts that two codewords fit almost
alike are flagged as ambiguous.

Codes of up to five languages are exhaustive (every split of the languages is a bit); more
languages get random dense codes of ``10 log2`` bits, the best of some draws by the least
distance between two codewords.

N-grams are counted over all labelled documents by Spark. The model has a whole number for each
bucket and bit, so its size depends on the number of languages alone, and sums are exact:
results do not depend on how rows are dealt.

Defined results. A text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learned. Rows without text or label teach nothing. With one language every other
text is of it, with score 1. Repeated rows are learned from as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skumetry.llm.shared import stored
from skumetry.llm.textbytes import flatten, slices

UNKNOWN = "und"
#: Lengths of n-grams in bytes; the buckets that n-grams of one length are hashed to.
ORDERS, BUCKETS = (2, 4), 1 << 16
#: Log odds are kept as whole numbers of 1/256; an n-gram counts as seen half a time more often.
UNIT, SMOOTHING = 256, 0.5
#: N-grams whose weights are summed at once.
PIECE = 1 << 16
#: Two codewords whose losses differ by less leave a text ambiguous.
MARGIN = 1.0
#: Languages counted at once by a task.
HELD_LANGUAGES = 64

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def n_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram of lower-cased texts; runs of other bytes than letters are not read.

    ASCII bytes other than letters become blanks, and a blank stands before and behind a text.
    N-grams of blanks alone are left out. They come text by text for each order.
    """
    data, offsets = flatten(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    rows = len(offsets) - 1
    sizes = np.diff(offsets)
    # One blank before each text and one behind the last.
    text = np.full(len(data) + rows + 1, 0x20, np.uint8)
    owner = np.repeat(np.arange(rows), sizes)
    text[np.arange(len(data)) + owner + 1] = np.where(_NO_LETTER[data], np.uint8(0x20), data)
    starts = offsets[:-1] + np.arange(rows)
    of_place = np.repeat(np.arange(rows), sizes + 1)
    room = (starts + sizes + 2)[of_place] - np.arange(len(of_place))
    blank = text == 0x20
    buckets, owners = [], []
    for place, order in enumerate(ORDERS):
        at = np.flatnonzero(room >= order)
        code = np.zeros(len(at), np.uint64)
        empty = np.ones(len(at), bool)
        for i in range(order):
            code = (code << np.uint64(8)) | text[at + i]
            empty &= blank[at + i]
        at, code = at[~empty], code[~empty]
        spread = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        buckets.append((spread % np.uint64(BUCKETS)).astype(np.int32) + place * BUCKETS)
        owners.append(of_place[at])
    return np.concatenate(buckets), np.concatenate(owners)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language. No two rows are alike and no column is constant."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= 5:
        bits = np.arange(1, 1 << (languages - 1))
        lines = [(bits >> i) & 1 for i in range(languages - 1)] + [np.zeros(len(bits), int)]
        return (2 * np.array(lines) - 1).astype(np.int8)
    length = math.ceil(10 * math.log2(languages))
    draws = np.random.default_rng(20261202)
    best, widest = None, -1
    for _ in range(32):
        code = draws.choice(np.array([-1, 1], np.int8), (languages, length))
        code[1] = -code[0]  # no column is constant
        product = code.astype(np.float32) @ code.T.astype(np.float32) - 2 * length * np.eye(languages, dtype=np.float32)
        apart = (length - product.max()) / 2
        if apart > widest:
            best, widest = code, apart
    return best


@dataclass
class Model:
    """Languages, their codewords, whole-number log odds per bucket and bit, and the bits' weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """For each text and bit the evidence that the bit is set: log odds over the root of the n-grams."""
        buckets, owners = n_grams(column)
        totals = np.zeros((len(column), self.odds.shape[1]), np.int64)
        by_order = np.flatnonzero(np.diff(owners) < 0) + 1
        for start, stop in zip([0, *by_order.tolist()], [*by_order.tolist(), len(owners)]):
            for i in range(start, stop, PIECE):
                own = owners[i: min(i + PIECE, stop)]
                firsts = np.r_[0, np.flatnonzero(np.diff(own)) + 1] if len(own) else np.zeros(0, int)
                if len(own):
                    totals[own[firsts]] += np.add.reduceat(self.odds[buckets[i: i + len(own)]], firsts, axis=0, dtype=np.int64)
        seen = np.bincount(owners, minlength=len(column))
        return totals / UNIT / np.sqrt(np.maximum(seen, 1))[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """For each text and language the weighted loss of its codeword."""
        # log(1 + exp(x)) without overflow, for a bit that agrees and one that does not.
        agree, differ = np.logaddexp(0, -margins) * self.weights, np.logaddexp(0, margins) * self.weights
        bits = (self.code > 0).T.astype(np.float64)
        return agree @ bits + differ @ (1 - bits)


def _counts(docs: DataFrame, label: Column) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over the rows with a text and a label; many rows of one key, to be added."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, seen in held.items():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(seen[at])], ["lang", "bucket", "n"])
            held.clear()

        for piece in slices(batches):
            buckets, owners = n_grams(piece.column("text"))
            langs = piece.column("lang").dictionary_encode()
            own = langs.indices.to_numpy()[owners]
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                if lang not in held:
                    if len(held) == HELD_LANGUAGES:
                        yield from flush()
                    held[lang] = np.zeros(BUCKETS * len(ORDERS), np.int64)
                held[lang] += np.bincount(buckets[own == number], minlength=BUCKETS * len(ORDERS))
        yield from flush()

    rows = docs.select("text", label.alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, label: Column) -> Model:
    """A model from ``text`` and ``label`` of all rows that have both."""
    counts = stored(_counts(docs, label))
    order = F.floor(F.col("bucket") / BUCKETS).cast("int")
    totals = counts.groupBy("lang", order.alias("order")).agg(F.sum("n").alias("total"))
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return Model(languages, code, np.zeros((BUCKETS * len(ORDERS), 0), np.int32), np.zeros(0))
    session = docs.sparkSession
    words = session.createDataFrame(pa.table({"lang": pa.array(languages, pa.string()), "word": pa.array([c.tolist() for c in code], pa.list_(pa.int32()))}))
    # Shares as whole numbers of 2^-44, so that their sums are exact. An unseen n-gram's share is
    # that of half an occurrence; what a language misses is added on the driver.
    share = F.floor(F.col("n") / F.col("total") * float(1 << 44)).cast("long")
    shares = counts.withColumn("order", order).join(totals, ["lang", "order"]).join(words, "lang").select("bucket", "word", share.alias("share"))
    per_bucket = shares.groupBy("bucket").agg(*[
        F.sum(F.when(F.col("word")[b] == side, F.col("share")).otherwise(0)).alias(f"{name}{b}")
        for b in range(bits) for name, side in (("set", 1), ("clear", -1))
    ])
    # A row for each bucket at most.
    sums = per_bucket.toArrow()
    at = sums.column("bucket").to_numpy()
    half = np.zeros((len(languages), len(ORDERS)))
    for row in totals.collect():
        half[languages.index(row.lang), row.order] = SMOOTHING / row.total
    odds = np.zeros((BUCKETS * len(ORDERS), bits), np.int32)
    for b in range(bits):
        sides = []
        for name, side in (("set", 1), ("clear", -1)):
            given = np.zeros(BUCKETS * len(ORDERS))
            given[at] = sums.column(f"{name}{b}").to_numpy() / float(1 << 44)
            own = code[:, b] == side
            unseen = np.repeat(half[own].sum(axis=0), BUCKETS)
            sides.append((given + np.maximum(unseen, 1e-12)) / own.sum())
        odds[:, b] = np.rint(np.log(sides[0] / sides[1]) * UNIT)
    seen = np.zeros(BUCKETS * len(ORDERS), bool)
    seen[at] = True
    odds[~seen] = 0
    model = Model(languages, code, odds, np.ones(bits))
    model.weights = _bit_weights(docs, label, model)
    return model


def _bit_weights(docs: DataFrame, label: Column, model: Model) -> np.ndarray:
    """Half the log odds that a bit's classifier is right on a labelled text, 1 on average."""
    bits, known = model.code.shape[1], {lang: i for i, lang in enumerate(model.languages)}

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, seen = np.zeros(bits, np.int64), 0
        for piece in slices(batches):
            lines = model.code[[known[lang] for lang in piece.column("lang").to_pylist()]]
            wrong += (model.margins(piece.column("text")) * lines <= 0).sum(axis=0)
            seen += piece.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([wrong.tolist()], pa.list_(pa.int64()))], ["seen", "wrong"])

    rows = docs.select("text", label.alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    tested = rows.mapInArrow(test, "seen long, wrong array<long>")
    sums = tested.agg(F.sum("seen"), *[F.sum(F.col("wrong")[b]) for b in range(bits)]).first()
    rate = (np.array(sums[1:], np.float64) + 1) / (sums[0] + 2)
    weights = np.maximum(0.5 * np.log((1 - rate) / rate), 0.01)
    return weights / weights.mean()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` and ``bits``, the classifiers' signs.

    Columns of these names are replaced. ``score`` is the predicted codeword's share of ``exp(-loss)``.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous", "bits", "_letters")]
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = given.drop("_letters").schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean").add("bits", "string")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            rows = piece.num_rows
            readable = piece.column("_letters").to_numpy(zero_copy_only=False) & bool(model.languages)
            margins = model.margins(piece.column("text"))
            losses = model.losses(margins) if model.languages else np.zeros((rows, 1))
            best = losses.argmin(axis=1)
            least = losses[np.arange(rows), best]
            score = np.where(readable, 1 / np.exp(least[:, None] - losses).sum(axis=1), 0.0)
            near = (losses - least[:, None] < MARGIN).sum(axis=1) > 1
            found = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), readable.tolist())]
            signs = ["".join("1" if b else "0" for b in line) for line in (margins > 0).tolist()]
            yield pa.RecordBatch.from_arrays([
                *[piece.column(c) for c in names], pa.array(found, pa.string()), pa.array(score), pa.array(near & readable), pa.array(signs, pa.string()),
            ], schema.names)

    return given.mapInArrow(predict, schema)
