"""Operator 8: benchmark passages in documents by SimHash of item-sized windows, multi-index Hamming search and exact
weighted-shingle similarity.

Items and texts become words (runs of letters, digits and underscores, A-Z lower-cased) and 5-word shingles. A shingle weighs
log(1 + items / items that hold it), counted over the whole benchmark; one that no item holds weighs nothing. For each size of an
item, windows of as many words slide over a text by single words. A window whose different shingles reach 0.8 of the lightest item
of its size gets a fingerprint: a SimHash of BITS bits of its different shingles, as each item has. The multi-index holds the
fingerprints' blocks of 16 bits: of two within RADIUS bits, one block at least differs in REACH + NEAR = 3 bits or fewer; items stand in
the buckets within NEAR of their own, windows ask the buckets within REACH, so all fingerprints within the radius are found.
What is found, of the window's size and within the radius, is verified: the weight of the item's shingles that stand in the
window, over the item's whole weight, is at least 0.8.

A window that holds exactly 0.8 of an item and no other item's shingles differs in 38 of 256 bits on average (5.7 the standard
deviation), so about 5 of a million are outside the radius. Where the rest of the window is another item's, it differs in
52 (6.5) and about 5 of 100 are lost; from 0.85 on 1 of 1,000. Exact copies differ in none.

Items are broadcast in blocks of about ITEMS; a shingle's weight is the whole benchmark's in each block. Defined cases: null and
short texts, and empty tables, hold nothing; very long texts are worked on in stretches, whole; a text shorter than an item is one
window; items of fewer than five words take no part; repeated rows give repeated results; rows with a null doc_id or item_id are
passed over; other columns are ignored. Equal best windows: the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, checkpoint, mix, read, shingle_hashes, slices, tidy, word_hashes

WORDS, SIMILAR = 5, 0.8
#: Bits of a fingerprint, in blocks of 16; bits of a block that a window's lookup and an item's entries reach.
BITS, REACH, NEAR = 256, 1, 2
BLOCKS = BITS // 16
RADIUS = BLOCKS * (REACH + NEAR + 1) - 1
#: Steps of a unit of weight: sums are whole numbers, so that equal windows are equal.
STEPS = 1 << 10
#: Items of a block; shingles of items in a text's stretch, and windows, that are worked on at once.
ITEMS, STRETCH, TOGETHER = 4096, 1 << 13, 256


def within(bits: int) -> np.ndarray:
    """The 16-bit numbers with at most so many bits."""
    return np.array([sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(16), n)], np.uint16)


def signs(shingles: np.ndarray) -> np.ndarray:
    """-1 or 1 for each shingle and bit."""
    lanes = [mix(shingles ^ seed) for seed in np.random.default_rng(8).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)]
    bits = np.unpackbits(np.stack(lanes, 1).astype("<u8").view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as rows of 16-bit blocks, of rows of weighted sums of signs."""
    return np.packbits(sums > 0, axis=1).view("<u2").reshape(len(sums), BLOCKS)


class Items:
    """A block of items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str], total: int, shared: dict[str, np.ndarray] | None = None):
        """total: items of the whole benchmark; shared: `shingle` and `n` of the block's shingles that several of these hold
        (all others are held once), None if the block is the benchmark."""
        words, rows, _, _, _ = word_hashes(pa.array(texts, pa.string()), NON_WORD)
        got, of, _ = shingle_hashes(words, rows, WORDS, whole=False)
        self.ids = ids
        pairs = np.unique(np.stack([got, of.astype(np.uint64)], 1), axis=0)
        self.known, counts = np.unique(pairs[:, 0], return_counts=True)
        if shared is not None:
            counts = np.ones(len(self.known), np.int64)
            counts[np.searchsorted(self.known, shared["shingle"])] = shared["n"]
        self.idf = np.log(1 + total / counts)
        self.steps = np.round(self.idf * STEPS).astype(np.int64)
        self.signs = signs(self.known)
        own = pairs[:, 1].astype(np.int64)
        of_item = np.searchsorted(self.known, pairs[:, 0])
        order = np.lexsort((of_item, own))
        cuts = np.searchsorted(own[order], np.arange(len(ids) + 1))
        self.sets = [of_item[order[a:z]] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        self.sizes = np.bincount(rows, minlength=len(ids)) - WORDS + 1
        real = [i for i, s in enumerate(self.sets) if len(s)]
        self.need: dict[int, int] = {}  # the least weight that can be 0.8 of an item of this size, but for rounding
        prints = np.zeros((len(ids), BLOCKS), np.uint16)
        for i in real:
            s = self.sets[i]
            prints[i] = fingerprints((self.signs[s] * self.steps[s, None]).sum(0)[None])[0]
            least = int(SIMILAR * self.steps[s].sum()) - len(s)
            self.need[int(self.sizes[i])] = min(self.need.get(int(self.sizes[i]), least), least)
        self.prints = np.ascontiguousarray(prints).view(np.uint64).reshape(len(ids), BLOCKS // 4)
        # buckets: block and its 16 bits, to the items that are near
        near = within(NEAR)
        codes = np.arange(BLOCKS)[None, :, None] * 65536 + (prints[real][:, :, None] ^ near).astype(np.int64)
        holder = np.broadcast_to(np.array(real, np.int64)[:, None, None], codes.shape).ravel()
        order = np.argsort(codes.ravel(), kind="stable")
        self.held = holder[order].astype(np.int32)
        self.head = np.searchsorted(codes.ravel()[order], np.arange(BLOCKS * 65536 + 1)).astype(np.int32)
        self.masks = within(REACH)
        # windows of one size meet items of that size only
        self.size_of = self.sizes.astype(np.int32)

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Each shingle's place among the items' shingles, -1 for others."""
        if not len(self.known):
            return np.full(len(shingles), -1)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, at, -1)

    def retrieve(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's number, item's number) of the items of the window's size whose fingerprint is within RADIUS of its."""
        found = []
        for low in range(0, len(prints), TOGETHER):
            part = prints[low : low + TOGETHER]
            bucket = (np.arange(BLOCKS)[:, None] * 65536 + (part[:, :, None] ^ self.masks)).ravel()
            begin = self.head[bucket]
            count = self.head[bucket + 1] - begin
            ends = np.cumsum(count, dtype=np.int64)
            item = self.held[np.repeat(begin - ends + count, count) + np.arange(int(ends[-1]))]
            row = np.repeat(np.repeat(np.arange(len(part)), BLOCKS * len(self.masks)), count)
            fit = np.flatnonzero(self.size_of[item] == sizes[low + row])
            both = np.unique(row[fit] * len(self.ids) + item[fit])
            row, item = both // len(self.ids), both % len(self.ids)
            words = np.ascontiguousarray(part).view(np.uint64).reshape(len(part), BLOCKS // 4)
            fit = np.bitwise_count(words[row] ^ self.prints[item]).sum(1) <= RADIUS
            found.append((low + row[fit], item[fit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def windows(self, spots: np.ndarray, places: np.ndarray, n: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, fingerprints) of the windows with enough weight that start in first..last - 1, one for each run of
        starts whose windows hold the same items' shingles; spots: where the text of n shingles holds these, places: which."""
        order = np.lexsort((spots, places))
        at, which = spots[order], places[order]
        before = np.full(len(at), -1)
        same = which[1:] == which[:-1]
        before[1:][same] = at[:-1][same]
        new = np.flatnonzero(np.concatenate([[True], ~same])) if len(at) else at
        whole = int(self.steps[which[new]].sum())
        for size, need in self.need.items():
            if whole < need:
                continue
            width = min(size, n)
            # a shingle counts once: in windows from behind its last place, if that is in reach, to this place
            start = np.maximum(np.maximum(before + 1, at - width + 1), first)
            end = np.minimum(at, min(n - width, last - 1)) + 1
            real = np.flatnonzero(start < end)
            if not len(real):
                continue
            edges, where = np.unique(np.concatenate([start[real], end[real]]), return_inverse=True)
            worth = self.steps[which[real]]
            gain = np.zeros(len(edges), np.int64)
            np.add.at(gain, where, np.concatenate([worth, -worth]))
            rich = np.flatnonzero(np.cumsum(gain) >= max(need, 1))
            if len(rich):
                signed = self.signs[which[real]] * worth.astype(np.int32)[:, None]
                by = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[by], np.arange(len(edges)))
                sums = np.cumsum(np.add.reduceat(np.concatenate([signed, -signed])[by], cuts, axis=0), 0)
                yield size, edges[rich], fingerprints(sums[rich])

    def stretches(self, spots: np.ndarray, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(first spot, end spot, first, last): the spots that windows starting in first..last - 1 can hold."""
        reach = max(self.need)
        a, first = 0, 0
        while a < len(spots):
            z = min(len(spots), a + STRETCH)
            last = n if z == len(spots) else max(int(spots[z]) - reach + 1, first + 1)
            end = z if z == len(spots) else int(np.searchsorted(spots, last + reach))
            yield a, end, first, last
            if z == len(spots):
                return
            a, first = int(np.searchsorted(spots, last)), last

    def search(self, places: np.ndarray) -> list[tuple[int, float, int]]:
        """(item's number, similarity, first word) of the best window found of each item."""
        n = len(places)
        spots = np.flatnonzero(places >= 0)
        best: dict[int, tuple[float, int]] = {}
        if not self.need:
            return []
        for a, z, first, last in self.stretches(spots, n):
            got = list(self.windows(spots[a:z], places[spots[a:z]], n, first, last))
            if not got:
                continue
            sizes = np.concatenate([np.full(len(s), size) for size, s, _ in got])
            starts = np.concatenate([s for _, s, _ in got])
            for w, i in zip(*(x.tolist() for x in self.retrieve(np.concatenate([p for _, _, p in got]), sizes)), strict=True):
                own, at = self.sets[i], int(starts[w])
                weights = self.idf[own]
                similar = float(weights[np.isin(own, places[at : at + int(sizes[w])])].sum() / weights.sum())
                if similar >= SIMILAR - 1e-9 and (i not in best or (round(similar, 12), -at) > (round(best[i][0], 12), -best[i][1])):
                    best[i] = (similar, at)
        return [(i, s, at) for i, (s, at) in sorted(best.items())]


_prepared: dict[int, Items] = {}


def prepared(ids: list[int], texts: list[str], total: int, shared: dict[str, np.ndarray] | None) -> Items:
    """The block, made once for a worker's tasks."""
    key = hash((tuple(ids), tuple(texts), total, None if shared is None else (shared["shingle"].tobytes(), shared["n"].tobytes())))
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Items(ids, texts, total, shared)
    return _prepared[key]


def shared_shingles(items: DataFrame) -> DataFrame:
    """(block, shingle, n): the shingles that n > 1 rows of items hold, for each block of such a row; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, rows, _, _, _ = word_hashes(part.column("text"), NON_WORD)
                got, of, _ = shingle_hashes(words, rows, WORDS, whole=False)
                pairs = np.unique(np.stack([of.astype(np.uint64), got], 1), axis=0)
                yield pa.RecordBatch.from_arrays([part.column("block").take(pa.array(pairs[:, 0].astype(np.int64))), pa.array(pairs[:, 1].view(np.int64) if len(pairs) else [], pa.int64())], ["block", "shingle"])

    held = items.select("block", "text").mapInArrow(tidy(run), "block int, shingle long")
    counted = held.groupBy("shingle").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks")).filter("n > 1")
    return checkpoint(counted.select(F.explode("blocks").alias("block"), "shingle", "n"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the items that a document holds, with the best window's first word."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("item_id is not null and text is not null")
    total = items.count()
    blocks = max(1, -(-total // ITEMS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    several = shared_shingles(items) if blocks > 1 else None
    texts = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("__text")).filter("__id is not null and __text is not null")
    out = None
    for b in range(blocks):
        rows = items.filter(F.col("block") == b).orderBy("item_id", "text").collect()  # about ITEMS rows
        held = None
        if several is not None:
            found = several.filter(F.col("block") == b).select("shingle", "n").toArrow()  # of these rows only
            held = {"shingle": found.column("shingle").to_numpy().view(np.uint64), "n": found.column("n").to_numpy()}
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], total, held))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = prepared(*shared.value)
            for batch in batches:
                for part in slices(batch, "__text"):
                    words, rows, _, _, _ = word_hashes(part.column("__text"), NON_WORD)
                    got, of, _ = shingle_hashes(words, rows, WORDS, whole=False)
                    places = own.places(got)
                    ids = part.column("__id")
                    out = []
                    for row in np.unique(of[places >= 0]).tolist():
                        a, z = np.searchsorted(of, [row, row + 1])
                        out += [(ids[row].as_py(), own.ids[i], s, at) for i, s, at in own.search(places[a:z])]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "first_word"])

        found = texts.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, first_word long")
        out = found if out is None else out.union(found)
    return out


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable] = {"op8_benchmark_decontamination": op8_benchmark_decontamination}
