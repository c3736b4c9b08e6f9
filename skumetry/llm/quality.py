"""Quality rules with an n-gram perplexity band per language (operator 4).

The language model is a modified Kneser-Ney model over the bytes of the texts, one per value of
``lang``. Spark counts the n-grams of all documents and derives the continuation counts, the
discounts and the interpolated probabilities as grouped aggregates and joins. Because every
n-gram of a text was counted, the table of the highest order alone scores any document, without
back-off at scoring time.

That table is kept as sorted hash arrays: ascending 64-bit keys (24 bits of the language's
CRC-32, 40 bits of the five bytes) beside their costs, negative log probabilities in whole units
of 2^-20. It is sent to the tasks only if a count shows that it has at most ``model_rows``
entries of 12 bytes. A larger one stays where it is: texts are dealt to blocks, a block asks for
its different n-grams once, and its task looks its texts up in a sorted hash array of the answers.
Costs are whole numbers, so both ways give the same bits.

A document's statistic is its mean negative log probability a byte (the logarithm of its
perplexity). Each language's band is the median plus and minus multiples of the median absolute
deviation, over its documents that pass the base rules, taken from exact counts of finely
rounded values. Documents outside the band are rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skumetry.llm import textbytes
from skumetry.llm.shared import stored

ORDER = 5
GRAM_BITS = 8 * ORDER
#: Entries of the model that may be broadcast: 96 MB.
MODEL_ROWS = 8_000_000
#: Costs are whole multiples of one part of this many.
COST_UNIT = 1 << 20
#: Different texts of a block, for models that are not broadcast; tasks that hold blocks.
BLOCK_BYTES = 16 << 20
MOST_TASKS = 20_000
#: Counts that a task gathers before it hands them on, and that it hands on at a time.
TASK_GRAMS, SENT_GRAMS = 750_000, 50_000
#: The band: so many scaled median absolute deviations below and above the median.
BELOW, ABOVE = 6.0, 4.0
#: The least scale, so that a language of very regular texts keeps a band of some width.
LEAST_SCALE = 0.02
#: Values are rounded to this step before they are counted for the medians.
STEP = 0.001

#: Languages up to which their bands (under 100 bytes a row) are broadcast; more are joined with salt.
BROADCAST_LANGUAGES = 50_000
SALTS = 64

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _lang_code(lang: str | None) -> int:
    return zlib.crc32((lang or "").encode()) & 0xFFFFFF


def gram_keys(data: np.ndarray, offsets: np.ndarray, langs: list[str | None]) -> np.ndarray:
    """The key of each byte: its language and the five bytes that end there.

    Four zero bytes stand before each text.
    """
    codes = np.array([_lang_code(x) for x in langs], np.uint64) << np.uint64(GRAM_BITS)
    sizes = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    keys = np.repeat(codes, sizes) + data
    for back in range(1, ORDER):
        earlier = np.zeros(len(data), np.uint64)
        earlier[back:] = data[:-back] if back < len(data) else 0
        keys += np.where(at >= back, earlier, np.uint64(0)) << np.uint64(8 * back)
    return keys


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each five-byte gram of each language occurs: ``lang24``, ``gram``, ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out():
            k, n = _summed(np.concatenate(keys), np.concatenate(counts))
            for at in range(0, len(k), SENT_GRAMS):
                key, number = k[at: at + SENT_GRAMS], n[at: at + SENT_GRAMS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key >> np.uint64(GRAM_BITS)).astype(np.int64)), pa.array((key & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64)), pa.array(number)],
                    ["lang24", "gram", "n"],
                )

        for batch in textbytes.slices(batches):
            data, offsets = textbytes.flatten(batch.column("text"))
            sorted_keys = np.sort(gram_keys(data, offsets, batch.column("lang").to_pylist()))
            first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])[: len(sorted_keys)]
            keys.append(sorted_keys[first])
            counts.append(np.diff(np.r_[first, len(sorted_keys)]).astype(np.int64))
            held += len(first)
            if held > TASK_GRAMS:
                merged = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                if held > TASK_GRAMS // 2:
                    yield from out()
                    keys, counts, held = [], [], 0
        if keys:
            yield from out()

    partial = docs.select("text", "lang").mapInArrow(count, "lang24 long, gram long, n long")
    return partial.groupBy("lang24", "gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order, from how many grams occur once to four times."""
    of = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (max(1, x) for x in grams.agg(*of).first())
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.1), float(i)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """``lang24``, ``gram``, ``logp``: interpolated modified Kneser-Ney of the highest order.

    Lower orders count in how many ways a gram is continued to the left. The discounts of an
    order are shared by all languages, the counts are not.
    """
    orders = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders[k] = stored(orders[k + 1].groupBy("lang24", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(orders[k])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftright("gram", 8).alias("context")
        counted = orders[k].select("lang24", "gram", "n", context)
        # Whole counts times discounts: the same bits in whatever order partial sums were merged.
        held_back = sum((F.count_if(found) * d for found, d in ((F.col("n") == 1, d1), (F.col("n") == 2, d2), (F.col("n") > 2, d3))), F.lit(0.0))
        totals = counted.groupBy("lang24", "context").agg(F.sum("n").alias("total"), held_back.alias("held_back"))
        p = counted.join(totals, ["lang24", "context"]).select(
            "lang24", "gram", ((F.col("n") - discount) / F.col("total")).alias("own"), (F.col("held_back") / F.col("total")).alias("rest")
        )
        if lower is None:
            p = p.select("lang24", "gram", (F.col("own") + F.col("rest") / 256).alias("p"))
        else:
            tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            p = p.withColumn("tail", tail).join(
                lower.select("lang24", F.col("gram").alias("tail"), F.col("p").alias("lower")), ["lang24", "tail"]
            ).select("lang24", "gram", (F.col("own") + F.col("rest") * F.col("lower")).alias("p"))
        lower = p
    return lower.select("lang24", "gram", F.log("p").alias("logp"))


def text_statistics(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> dict[str, list[int]]:
    """The base statistics of each text."""
    starts, ends, firsts = textbytes.words(data, offsets)
    hashes = textbytes.range_hashes(data, starts, ends)
    triples = textbytes.join_hashes(hashes[:-2], hashes[1:-1], hashes[2:]) if len(hashes) > 2 else hashes[:0]
    # A code point begins at every byte that does not continue one.
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    in_words = np.r_[0, np.cumsum(points[ends] - points[starts])]
    out = {name: [] for name in STATISTICS}
    for row, text in enumerate(texts):
        a, b = int(firsts[row]), int(firsts[row + 1])
        out["n_words"].append(b - a)
        out["word_chars"].append(int(in_words[b] - in_words[a]))
        out["n_symbols"].append(int(symbols[offsets[row + 1]] - symbols[offsets[row]]))
        lines = [x for x in (text or "").split("\n") if _WORD.search(x)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        repeated = 0
        if b - a > 3:
            own = triples[a: b - 2]
            order = np.argsort(own)
            same = own[order][1:] == own[order][:-1]
            if same.any():
                found = np.zeros(b - a, bool)
                at = np.unique(np.r_[order[1:][same], order[:-1][same]])
                found[at] = found[at + 1] = found[at + 2] = True
                repeated = int(found.sum())
        out["n_repeat_words"].append(repeated)
    return out


def _statistics(docs: DataFrame, model=None) -> DataFrame:
    """``row``, ``lang``, ``text_key`` (if there), the statistics and, with a model, ``cost`` of each text."""
    keep = [c for c in docs.columns if c != "text"]
    schema = docs.select(*keep).schema
    for name in (*STATISTICS, "n_bytes", "cost"):
        schema = schema.add(name, "long")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.slices(batches):
            column = batch.column("text")
            data, offsets = textbytes.flatten(column)
            stats = text_statistics(column.to_pylist(), data, offsets)
            costs = text_costs(data, offsets, batch.column("lang").to_pylist(), *model.value) if model else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(stats[s], pa.int64()) for s in STATISTICS]
                + [pa.array(np.diff(offsets)), pa.array(costs)], schema.names,
            )

    return docs.mapInArrow(score, schema)


def text_costs(data: np.ndarray, offsets: np.ndarray, langs: list[str | None], keys: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The sum of the costs of each text's bytes, whole numbers, from sorted ``keys`` and their ``costs``."""
    own = gram_keys(data, offsets, langs)
    if not len(own):
        return np.zeros(len(offsets) - 1, np.int64)
    order = np.argsort(own)  # sorted look-ups walk through the array once
    found = np.empty(len(own), np.int64)
    found[order] = costs[np.searchsorted(keys, own[order])]
    running = np.r_[0, np.cumsum(found)]
    return running[offsets[1:]] - running[offsets[:-1]]


def _sorted_arrays(keys: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], costs[order].astype(np.int32)


def _block_costs(docs: DataFrame, model: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``text_key`` and ``cost`` of each different (language, text), for a model of any size.

    Different texts are dealt to blocks of about ``block_bytes``. A block asks for its different
    grams once; the answers and its texts meet in one task, which holds one block at a time.
    """
    full = docs.where(F.octet_length("text") > 0).select("text_key", "lang", "text")
    size = full.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = size // block_bytes + 1
    tasks = min(blocks, MOST_TASKS)
    block = F.pmod(F.xxhash64("text_key"), F.lit(blocks)).alias("block")
    texts = stored(full.select(block, "*").repartition(tasks, "block").dropDuplicates(["block", "text_key"]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = {}, 0

        def out():
            for number, keys in held.items():
                keys = np.unique(np.concatenate(keys)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int64)), pa.array(keys)], ["block", "key"])

        for batch in textbytes.slices(batches):
            data, offsets = textbytes.flatten(batch.column("text"))
            keys = gram_keys(data, offsets, batch.column("lang").to_pylist())
            owners = np.repeat(batch.column("block").to_numpy(), np.diff(offsets))
            for number in np.unique(owners).tolist():
                own = np.unique(keys[owners == number])
                held.setdefault(number, []).append(own)
                count += len(own)
            if count > TASK_GRAMS:
                yield from out()
                held, count = {}, 0
        yield from out()

    asked = texts.mapInArrow(ask, "block long, key long")
    answers = asked.join(model, "key").select(
        "block", F.lit(0).alias("kind"), "key", "cost", F.lit(None).cast("string").alias("text_key"), F.lit(None).cast("string").alias("lang"),
        F.lit(None).cast("string").alias("text"),
    )
    asking = texts.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("cost"), "text_key", "lang", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, costs, arrays = None, [], [], None
        for batch in textbytes.slices(batches):
            owners, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((owners[1:] != owners[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                part = batch.slice(start, stop - start)
                if owners[start] != number:
                    number, keys, costs, arrays = owners[start], [], [], None
                if kinds[start] == 0:
                    keys.append(part.column("key").to_numpy())
                    costs.append(part.column("cost").to_numpy())
                    continue
                if arrays is None:  # all answers of a block come before its texts
                    arrays = _sorted_arrays(np.concatenate(keys), np.concatenate(costs))
                    keys, costs = [], []
                data, offsets = textbytes.flatten(part.column("text"))
                sums = text_costs(data, offsets, part.column("lang").to_pylist(), *arrays)
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array(sums)], ["text_key", "cost"])

    together = answers.unionByName(asking).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(score, "text_key string, cost long")


def _score(docs: DataFrame, model_rows: int) -> DataFrame:
    """``row``, ``lang``, the statistics, ``n_bytes`` and ``log_perplexity`` of ``row, lang, text``."""
    logs = stored(kneser_ney(stored(count_grams(docs))))
    model = logs.select(F.shiftleft("lang24", GRAM_BITS).bitwiseOR(F.col("gram")).alias("key"), F.round(F.col("logp") * -COST_UNIT).cast("int").alias("cost"))
    if logs.count() <= model_rows:
        rows = model.toArrow()  # at most ``model_rows``
        arrays = _sorted_arrays(rows.column("key").to_numpy(), rows.column("cost").to_numpy())
        scored = _statistics(docs, docs.sparkSession.sparkContext.broadcast(arrays))
    else:
        # The language's length keeps ("a", "b c") and ("a b", "c") apart.
        lang = F.coalesce("lang", F.lit(""))
        keyed = docs.withColumn("text_key", F.sha2(F.concat(F.octet_length(lang).cast("string"), F.lit(":"), lang, F.coalesce("text", F.lit(""))), 256))
        costs = stored(_block_costs(keyed, model))
        scored = _statistics(keyed).drop("cost").join(costs, "text_key", "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast("long")))
    log_perplexity = F.when(F.col("n_bytes") > 0, F.col("cost") / (F.col("n_bytes") * COST_UNIT)).otherwise(0.0)
    return scored.select("row", "lang", *STATISTICS, "n_bytes", log_perplexity.alias("log_perplexity"))


def _with_row(docs: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` as ``row, lang, text``, and the columns that a result with ``added`` takes from ``row``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in added], F.lit(0).alias("text")).alias("row")
    return docs.select(row, "lang", "text"), [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text" and c not in added]


def score_documents(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` without its text, with the base statistics, ``n_bytes`` and ``log_perplexity``.

    Null and empty texts count as texts without words; their log perplexity is 0. A null
    language counts as the empty one. Columns of ``docs`` that bear the name of a result column
    are replaced, other columns are kept. Results are the same, to the last bit, on either side
    of ``model_rows``.
    """
    added = (*STATISTICS, "n_bytes", "log_perplexity")
    rows, kept = _with_row(docs, added)
    return _score(rows, model_rows).select(*kept, *added)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _median(values: DataFrame, value: str) -> DataFrame:
    """The lower median of ``value`` (whole steps) for each language, from counts of its values."""
    counts = values.groupBy("lang", value).agg(F.count(F.lit(1)).alias("rows"))
    order = W.partitionBy("lang").orderBy(value)
    up_to = counts.withColumn("up_to", F.sum("rows").over(order)).withColumn("all", F.sum("rows").over(W.partitionBy("lang")))
    return up_to.filter(2 * F.col("up_to") >= F.col("all")).groupBy("lang").agg(F.min(value).alias("median"))


def perplexity_bands(scored: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """``lang``, ``lowest`` and ``highest`` log perplexity that a document may have.

    Fitted on the documents that pass the base rules. A language without one has no band.
    """
    steps = scored.filter(~base_failed()).select(F.coalesce("lang", F.lit("")).alias("lang"), F.round(F.col("log_perplexity") / STEP).cast("long").alias("step"))
    middle = _median(steps, "step")
    away = steps.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("rows")).join(middle, "lang")
    away = away.select("lang", "median", F.abs(F.col("step") - F.col("median")).alias("away"), "rows")
    order = W.partitionBy("lang").orderBy("away")
    spread = (
        away.withColumn("up_to", F.sum("rows").over(order))
        .withColumn("all", F.sum("rows").over(W.partitionBy("lang")))
        .filter(2 * F.col("up_to") >= F.col("all"))
        .groupBy("lang", "median").agg(F.min("away").alias("spread"))
    )
    scale = F.greatest(1.4826 * STEP * F.col("spread"), F.lit(LEAST_SCALE))
    return spread.select("lang", (STEP * F.col("median") - below * scale).alias("lowest"), (STEP * F.col("median") + above * scale).alias("highest"))


def quality_verdicts(docs: DataFrame, model_rows: int = MODEL_ROWS, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """``docs`` without its text, with the base statistics, ``base_failed``, ``log_perplexity`` and ``kept``.

    ``kept`` is false where the base rules fail or the log perplexity lies outside the band of
    the document's language. An empty table gives an empty result.
    """
    added = (*STATISTICS, "n_bytes", "log_perplexity", "base_failed", "kept")
    rows, kept = _with_row(docs, added)
    scored = stored(_score(rows, model_rows))
    bands = perplexity_bands(scored, below, above).withColumnRenamed("lang", "_lang")
    inside = F.col("log_perplexity").between(F.col("lowest"), F.col("highest"))
    rows = scored.withColumn("_lang", F.coalesce("lang", F.lit(""))).withColumn("_salt", F.pmod(F.hash("n_bytes", "log_perplexity"), F.lit(SALTS)))
    bands = stored(bands)
    if bands.count() <= BROADCAST_LANGUAGES:
        banded = rows.join(F.broadcast(bands), "_lang", "left")
    else:
        banded = rows.join(bands.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_lang", "_salt"], "left")
    banded = banded.withColumn("base_failed", base_failed())
    return banded.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select(*kept, *added)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "text")
    return quality_verdicts(rows).where("kept").select("row.*")
