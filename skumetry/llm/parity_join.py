"""N-gram Jaccard join with parity sketches (operator 7).

Two documents link when their sets of shingles have a Jaccard similarity of at least t; a ``Rule``
names t and the words of a shingle. Operator 7 owes three words and 0.9 (``CONTRACT``), the
pipeline's stage five words and 0.8 (``NEAR_COPIES``). Of linked sets with a and b elements at
most (a + b) (1 - t) / (1 + t) elements are in only one; for 0.9 these are (a + b) / 19.

Each shingle is hashed to one bit of a sketch, and the bits of a set are combined by exclusive
or. The Hamming distance of two sketches never exceeds the number of elements that only one set
has. Sets are grouped by size bands, and a band's sketches are cut into one part more than two
linked sets can differ in elements, so linked sets agree in at least one whole part
(pigeonhole). Agreeing parts give the candidates, a second, compact sketch rejects most of those
that are no links, and the rest is verified on the sets themselves.

Equal sets are one class from the start. A part that many classes share never gives all their
pairs: first every class is compared with one class of its part only; then a spanning forest of the
components in a part, nearest sketches first, is verified; what links is united, and just the
pairs of components that are still apart remain. Large parts are cut into blocks and handled
block against block; sketches are compared inside the tasks and only pairs close enough leave
them. This finds every component exactly.

Below ``LEAST_FOR_PARTS`` parts get so many that each holds few elements, and unrelated sets agree
in some part by chance. There the keys are a set's first elements in one order of all shingles,
one more than a linked set can lack: of two linked sets these have an element in common (prefix
filter). Shingles that are frequent in a sample come last in the order; any order is exact.

Shingles and sets are told apart by 64-bit hashes; with n different sets the chance that any
two are confused is about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skumetry.llm import textbytes
from skumetry.llm.graph import components
from skumetry.llm.shared import discard, stored

#: Rounds in which each class meets one other class of each part it shares, and then rounds in
#: which a spanning forest of each part's components is verified.
LEADER_ROUNDS, NEAREST_ROUNDS = 1, 1
#: Classes of one part that a task compares at a time.
BLOCK = 2048
#: Bits of a compact sketch for each element that may differ. Sketches travel with every key of a
#: class, so they are kept short; what passes them is verified on the sets.
SKETCH_BITS = 8
#: Classes whose numbers are sent to all tasks at most, to pick out their texts before a shuffle.
MOST_SENT = 1_000_000
#: Classes that a task remembers at most, not to send their keys again.
MOST_DONE = 100_000
#: Bits for each text that is asked for, and at most, in the filter that is sent to all tasks before
#: texts are shuffled: 8 MB.
FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 26
#: The least similarity, in hundredths, for which parts of sketches are the keys.
LEAST_FOR_PARTS = 90
#: Texts in the sample that tells frequent shingles, the share of them that makes a shingle
#: frequent, and how many frequent shingles are sent to every task.
SAMPLED, FREQUENT, MOST_FREQUENT = 2000, 0.01, 50_000


class Rule(NamedTuple):
    """What links two texts: words of a shingle, and the least similarity in hundredths."""

    words: int
    percent: int

    def allowed(self, sizes: int) -> int:
        """How many elements only one of two linked sets can have, by the sum of their sizes."""
        return sizes * (100 - self.percent) // (100 + self.percent)


CONTRACT, NEAR_COPIES = Rule(3, 90), Rule(5, 80)


def _bands() -> np.ndarray:
    """Lower ends of the size bands, each about 1.6 times the one before."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, lows[-1] * 8 // 5))
    return np.array(lows)


LOWS = _bands()


def band_of(size: int) -> int:
    return int(np.searchsorted(LOWS, size, "right")) - 1


def largest_guest(band: int, rule: Rule = CONTRACT) -> int:
    """The largest set that can link with one of the band below."""
    return 100 * (int(LOWS[band]) - 1) // rule.percent


def differing(band: int, rule: Rule = CONTRACT) -> int:
    """How many elements two linked sets of a band can differ in; the larger may be a guest."""
    return rule.allowed(int(LOWS[band + 1]) - 1 + largest_guest(band + 1, rule))


def groups_of(size: int, rule: Rule = CONTRACT) -> list[int]:
    """The bands in which a set takes part: its own, and the one below if it can link there."""
    own = band_of(size)
    return [own, own - 1] if own and size <= largest_guest(own, rule) else [own]


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which bits of a sketch are set by an odd number of elements."""
    return (np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def part_keys(hashes: np.ndarray, band: int, rule: Rule = CONTRACT) -> np.ndarray:
    """One key for each part of the band's sketch: parts of 64 bits, one more than can differ."""
    parts = differing(band, rule) + 1
    words = np.packbits(parity(textbytes.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), 64 * parts)).view(np.uint64)
    where = (np.arange(parts) + (band << 40)).astype(np.uint64)
    return textbytes.join_hashes(words, where)


def first_keys(hashes: np.ndarray, band: int, rule: Rule, frequent: np.ndarray) -> np.ndarray:
    """One key for each of a set's first elements: one more than a linked set can lack.

    Linked sets share at least ``percent`` hundredths of either. ``hashes`` and ``frequent`` are
    sorted; frequent elements come last.
    """
    count = len(hashes) - -(-rule.percent * len(hashes) // 100) + 1
    last = np.isin(hashes, frequent, assume_unique=True)
    first = np.r_[hashes[~last], hashes[last]][:count]
    return textbytes.join_hashes(first, np.full(count, band, np.uint64))


def compact_sketch(hashes: np.ndarray, band: int, rule: Rule = CONTRACT) -> np.ndarray:
    """A sketch of ``SKETCH_BITS`` for each element that may differ, as 64-bit words."""
    words = differing(band, rule) * SKETCH_BITS // 64 + 1
    return np.packbits(parity(textbytes.mix(hashes ^ np.uint64(0x14057B7EF767814F)), 64 * words)).view(np.int64)


def shingle_sets(texts: pa.Array, n: int = CONTRACT.words) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles of ``n`` words; a shorter text is one."""
    data, offsets = textbytes.flatten(texts, lower=True)
    starts, ends, firsts = textbytes.words(data, offsets)
    h = textbytes.range_hashes(data, starts, ends)
    runs = textbytes.join_hashes(*(h[i: len(h) - n + 1 + i] for i in range(n))) if len(h) >= n else h[:0]
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a: b - n + 1]))
        else:
            out.append(textbytes.join_hashes(*(h[i: i + 1] for i in range(a, b))) if b > a else h[:0])
    return out


SIGNATURES = "doc_id long, text_hash long, n_shingles long, node long, sketch array<long>, guest_sketch array<long>"


def frequent_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """The sorted hashes of shingles that many texts of a sample have, the most frequent at most."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.slices(batches):
            own = shingle_sets(batch.column("text"), rule.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["shingle"])

    rows = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(rows // SAMPLED + 1)) == 0).select("text")
    counts = sample.mapInArrow(sets, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    many = counts.where(F.col("n") >= max(2, int(FREQUENT * min(rows, SAMPLED)))).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT)
    return np.sort(np.array([r.shingle for r in many.collect()], np.int64).view(np.uint64))


def _node(own: np.ndarray) -> int:
    """The class of a set that is not empty."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def signatures(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Set size, class (``node``) and compact sketches of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textbytes.slices(batches):
            sizes, nodes, sketches = [], [], ([], [])
            for own in shingle_sets(batch.column("text"), rule.words):
                sizes.append(len(own))
                nodes.append(_node(own) if len(own) else None)
                groups = groups_of(len(own), rule) if len(own) else []
                for i in (0, 1):
                    sketches[i].append(compact_sketch(own, groups[i], rule) if i < len(groups) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 *(pa.array(k, pa.list_(pa.int64())) for k in sketches)],
                ["doc_id", "text_hash", "n_shingles", "node", "sketch", "guest_sketch"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, SIGNATURES)


def _entries(docs: DataFrame, rule: Rule) -> DataFrame:
    """``key``, ``node``, ``guest``: the keys of each class, by its own band and by the one it is a guest in.

    Keys are many times a text's class number, so they are made where they are sent from and never written
    to a table. A class may come several times, about once for each task that has it.
    """
    by_parts = rule.percent >= LEAST_FOR_PARTS
    frequent = None if by_parts else frequent_shingles(docs, rule)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in textbytes.slices(batches):
            if len(done) > MOST_DONE:
                done.clear()
            keys, nodes, guests = [], [], []
            for own in shingle_sets(batch.column("text"), rule.words):
                node = _node(own) if len(own) else None
                if node is None or node in done:
                    continue
                done.add(node)
                for guest, band in enumerate(groups_of(len(own), rule)):
                    found = part_keys(own, band, rule) if by_parts else first_keys(own, band, rule, frequent)
                    keys.append(found.view(np.int64))
                    nodes.append(np.full(len(found), node, np.int64))
                    guests.append(np.full(len(found), bool(guest)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, nodes, guests)], ["key", "node", "guest"])

    return docs.select("text").mapInArrow(give, "key long, node long, guest boolean")


def _texts(docs: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """One compressed text of each class in ``nodes``.

    A bitmap of the texts asked for goes to all tasks, so that few others are packed and shuffled.
    """
    wanted = stored(
        signed.where("node is not null").groupBy("node")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_hash")).alias("of"))
        .join(nodes, "node").select("node", "of.*")
    )
    bits = min(MOST_FILTER_BITS, 64 * (wanted.count() * FILTER_BITS // 64 + 1))
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits)).alias("slot")
    marks = F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("marks")
    words = wanted.select(slot).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(marks).toArrow()  # at most ``bits`` / 64
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("marks").to_numpy()
    asked = signed.sparkSession.sparkContext.broadcast(bitmap)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, marked = zstandard.ZstdCompressor(level=1), asked.value
        for batch in textbytes.slices(batches):
            at = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((marked[at >> 6] >> (at & 63)) & 1 == 1))
            packed = [compressor.compress(t.encode()) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["doc_id", "text_hash", "packed"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    packed = keyed.select("doc_id", "text_hash", "text", slot).mapInArrow(pack, "doc_id long, text_hash long, packed binary")
    # Rows of one id and text are of one class, so one shuffle serves to drop repeated rows and to join.
    return packed.dropDuplicates(["doc_id", "text_hash"]).join(wanted, ["doc_id", "text_hash"]).select("node", "packed")


@lru_cache(maxsize=256)
def _set_of(packed: bytes, n: int) -> np.ndarray:
    return shingle_sets(pa.array([zstandard.decompress(packed).decode()]), n)[0]


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of classes ``a``, ``b`` whose sets are as similar as ``rule`` asks."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for tx, ty in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
                p, q = _set_of(tx, rule.words), _set_of(ty, rule.words)
                if rule.percent * (len(p) + len(q)) <= (100 + rule.percent) * min(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    links.append(100 * both >= rule.percent * (len(p) + len(q) - both))
                else:
                    links.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m := pa.array(links)), batch.column(1).filter(m)], ["a", "b"])

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    if asked.count() <= MOST_SENT:
        texts = texts.join(F.broadcast(asked), "node", "left_semi")
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("of_a")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b")), "b")
    return rows.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sketches(signed: DataFrame) -> DataFrame:
    """``node``, ``guest``, ``n`` and ``sketch`` of each class, in each of its bands."""
    one = signed.where("node is not null").select("node", "n_shingles", "sketch", "guest_sketch").dropDuplicates(["node"])
    both = F.array(F.struct(F.lit(False).alias("guest"), F.col("sketch").alias("sketch")), F.struct(F.lit(True).alias("guest"), F.col("guest_sketch").alias("sketch")))
    return one.select("node", F.col("n_shingles").alias("n"), F.explode(both).alias("of")).select("node", "n", "of.guest", "of.sketch").where("sketch is not null")


def _close(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a``, ``b`` of one part whose compact sketches allow a link.

    ``guest_a`` and ``guest_b`` tell which of a class's sketches belongs to the part.
    """
    for side in "ab":
        own = sketches.select(F.col("node").alias(side), F.col("guest").alias(f"guest_{side}"), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own, [side, f"guest_{side}"])
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return pairs.where((100 + rule.percent) * apart <= (100 - rule.percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def _near_pairs(mixed: DataFrame, sketches: DataFrame, nearest: bool, rule: Rule) -> DataFrame:
    """Pairs of different components that share a part and whose compact sketches are near enough.

    With ``nearest`` a block gives a spanning forest of its components only, nearest pairs first.
    """
    sizes = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
    rows = (
        mixed.join(sizes.withColumn("blocks", blocks), "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", "node", "component", "guest", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    rows = rows.join(sketches, ["node", "guest"]).select("key", "low", "high", "block", "node", "component", "n", "sketch")

    def forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Which of the pairs of components, nearest first, unite two that are not united yet."""
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        kept = []
        for i in np.argsort(apart, kind="stable").tolist():
            p, q = root(int(a[i])), root(int(b[i]))
            if p != q:
                parent[p] = q
                kept.append(i)
        return np.array(kept, np.int64)

    def near(held: list[pa.RecordBatch]) -> tuple[list, list]:
        table = pa.Table.from_batches(held).to_pydict()
        nodes, comps, n = (np.array(table[c], np.int64) for c in ("node", "component", "n"))
        block = np.array(table["block"])
        words = np.array(table["sketch"], np.int64).view(np.uint64)
        one_block = table["low"][0] == table["high"][0]
        a, b, far = [], [], []
        for i in range(len(nodes)):
            j = slice(i + 1, None)
            apart = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
            hit = ((100 + rule.percent) * apart <= (100 - rule.percent) * (n[j] + n[i])) & (comps[j] != comps[i]) & (one_block | (block[j] != block[i]))
            at = np.flatnonzero(hit)
            if nearest and len(at) > 1:
                at = at[np.lexsort((apart[at], comps[i + 1:][at]))]
                at = at[np.r_[True, comps[i + 1:][at][1:] != comps[i + 1:][at][:-1]]]
            far.append(apart[at])
            a.append(np.full(len(at), i))
            b.append(at + i + 1)
        a, b, far = (np.concatenate(x) for x in (a, b, far))
        if nearest:
            kept = forest(comps[a], comps[b], far)
            a, b = a[kept], b[kept]
        return nodes[a].tolist(), nodes[b].tolist()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            a, b = [], []
            for start, stop in zip(cuts, cuts[1:]):
                group = tuple(ids[:, start].tolist())
                if group != of and held:
                    more = near(held)
                    a, b, held = a + more[0], b + more[1], []
                of = group
                held.append(batch.slice(start, stop - start))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = near(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(compare, "a long, b long").select(*_ordered("a", "b")).distinct()


def _different_groups(shared: DataFrame) -> DataFrame:
    """One ``key`` for each different group of classes that share a key; other keys of a group give the same pairs.

    Groups are told apart by their size and 128 bits, combined from their members in any order.
    """
    bits = [F.bit_xor(F.xxhash64("node", "guest", F.lit(i))).alias(f"bits{i}") for i in (0, 1)]
    groups = shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *bits)
    return groups.groupBy("rows", "bits0", "bits1").agg(F.min("key").alias("key")).select("key")


def _class_links(docs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Links ``a``, ``b`` between classes, enough to connect every component."""
    entries = _entries(docs, rule)
    # One shuffle of the entries: which classes a key has is seen where its rows stand.
    same = Window.partitionBy("key")
    several = entries.withColumns({"low": F.min("node").over(same), "high": F.max("node").over(same)}).where("low <> high")
    shared = stored(several.select("key", "node", "guest").distinct().withColumn("component", F.col("node")))
    mixed = stored(shared.join(_different_groups(shared), "key", "left_semi"))
    discard(shared)
    texts = stored(_texts(docs, signed, mixed.select("node").distinct()))
    sketches = stored(_sketches(signed))
    found = None
    last = LEADER_ROUNDS + NEAREST_ROUNDS
    for turn in range(last + 1):
        if mixed.isEmpty():
            break
        if turn < LEADER_ROUNDS:
            leader = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("component").alias("of"), F.col("guest").alias("guest_b"))).alias("l")
            met = mixed.join(mixed.groupBy("key").agg(leader).select("key", "l.*"), "key").where("component <> of")
            pairs = _close(met.select(F.col("node").alias("a"), F.col("guest").alias("guest_a"), "b", "guest_b").distinct(), sketches, rule)
        else:
            pairs = _near_pairs(mixed, sketches, nearest=turn < last, rule=rule)
        pairs = stored(pairs)
        links = _verified(pairs, texts, rule)
        former, found = found, stored(links if found is None else found.unionByName(links))
        discard(pairs, *([former] if former is not None else []))
        if turn < last:
            labels = components(found)
            united = mixed.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            united = united.select("key", "node", "guest", "component")
            apart = united.withColumns({"low": F.min("component").over(same), "high": F.max("component").over(same)}).where("low <> high")
            former, mixed = mixed, stored(apart.drop("low", "high"))
            discard(former, labels)
    discard(mixed, texts, sketches)
    return found if found is not None else signed.sparkSession.createDataFrame([], "a long, b long")


def _components(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``component`` (null without shingles) of each row."""
    signed = stored(signatures(docs, rule))
    labels = components(_class_links(docs, signed, rule))
    rows = signed.select("doc_id", "text_hash", "n_shingles", "node").join(labels, "node", "left")
    return stored(rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component")))


def link_components(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included. Texts
    without words, and null texts, have no shingles and link with nothing. Repeated rows are
    kept and link with each other; a null ``doc_id`` takes part, but names no component unless
    nothing else does. Only ``doc_id`` and ``text`` of ``docs`` are read.
    """
    rows = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule)
    first = stored(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return rows.join(first, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, rule: Rule = NEAR_COPIES) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of linked texts the one of smallest ``doc_id`` stays.

    Repeated rows count as copies, a null ``doc_id`` comes last. Texts without words all stay.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), F.xxhash64("text").alias("_hash")]
    rows = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule).withColumnRenamed("text_hash", "_hash")
    rows = rows.withColumn("_doc", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct("_doc", "_hash")).alias("f")).select("f.*")
    stay = stored(first.union(rows.where("component is null").select("_doc", "_hash")).distinct())
    # Texts without words are not to be united, so they get a number of their own.
    apart = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.lit(0)).otherwise(F.monotonically_increasing_id())
    left = docs.withColumns({"_doc": key[0], "_hash": key[1], "_apart": apart}).join(stay, ["_doc", "_hash"], "left_semi")
    return left.dropDuplicates(["_doc", "_hash", "_apart"]).select(*[F.col(f"`{c}`") for c in docs.columns])
