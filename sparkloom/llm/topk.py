"""Operator 7: exact top-k by inner product with no-random-access aggregation over sorted component lists.

Each component of a block of candidates is a sorted list; a query reads a list from the end where its own component gains
most. After reading to a common depth, a candidate's bounds follow from what was read: unread components count between the
list's far end (lower) and the value at the frontier (upper). The bar is the k-th best score of earlier blocks or the k-th best
lower bound. No candidate's upper bound is below the frontiers' own sum, so a query first reads to the depth where that sum falls
under its bar, then on step by step; candidates whose upper bound is below the bar are outsiders, each query's by themselves. It
stops when all but SPARE * k are outsiders, or at the lists' ends, and the scores of the others are resolved. Queries and candidates are worked on
as matrices: an upper bound is q+ . max(x, frontier) + q- . min(x, frontier), a lower one likewise. How deep lists must be read is up to
the vectors: far less than half if few components carry the scores, nearly all if they are spread evenly (README).

Queries and candidates are dealt to blocks and tiles by a shuffle, nothing comes to the driver: each task holds the queries of a block (up
to about ASKED), streams a tile of candidates by CANDIDATES, and returns k a query; a window with a partial limit takes the best.

Defined cases: components become floor(64 * x) exactly, whatever their size; scores are exact integers, those beyond a long's
range are cut to its ends and rank so. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
with a null vec_id. Candidates of another length than the query's have no score. Rows with a query's own vec_id are never its
candidates; of repeated rows with a query's id the least vector is the query. Other repeated rows are candidates each. Ties: smaller
vec_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, tidy

SCALE = 64
#: Rows of a block of queries, of a tile of candidates, of candidates with lists of their own, and of queries worked on at once.
ASKED, TILE, CANDIDATES, TOGETHER = 8192, 1 << 17, 8192, 256
#: Depths that lists are read to, as shares of their length, before they are read to their ends; candidates whose lists are read
#: whole, if none are known before, so that the others meet a bar.
DEPTHS, FIRST = (1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 7 / 8), 256
#: Reading stops when all but so many candidates for each one wanted are outsiders that can't qualify; their scores are resolved.
SPARE = 3
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def exact(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers."""
    whole = lambda v: int(v) * SCALE if abs(v) > 1 << 60 else math.floor(v * SCALE)
    return np.array([[whole(v) for v in row] for row in values.tolist()], object).reshape(values.shape)


def scaled(queries: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of both, in the narrowest type in which every inner product and its partial sums are exact."""
    most = SCALE**2 * float(np.abs(queries).max(initial=0) + 1) * float(np.abs(items).max(initial=0) + 1) * items.shape[1]
    if not most < 1 << 52:
        return exact(queries), exact(items)
    kind = np.float32 if most < 1 << 23 else np.float64
    return tuple(np.floor(x * SCALE).astype(kind) for x in (queries, items))


def cut(scores: np.ndarray) -> np.ndarray:
    """Scores within a long's range; only exact integers can be beyond it."""
    return np.minimum(np.maximum(scores, LEAST), MOST) if scores.dtype == object else scores


def kth(scores: np.ndarray, k: int):
    """The k-th highest."""
    at = len(scores) - k
    return sorted(scores.tolist())[at] if scores.dtype == object else np.partition(scores, at)[at]


def aggregate(queries: np.ndarray, items: np.ndarray, lists: np.ndarray, want: np.ndarray, bar: np.ndarray, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the items that are left for some query, all queries' scores of these, for which query each is left, and the share
    of the lists that each query has read.

    lists: each component of the items in ascending order; want: how many items each query wants; bar: a score that as many others are known to reach, -inf if there are none.
    """
    gain, loss = np.maximum(queries, 0), np.minimum(queries, 0)
    n = len(items)
    marks = [max(1, int(n * d)) for d in depths]  # entries read of each list
    sums = [gain @ lists[n - r] + loss @ lists[r - 1] for r in marks]
    bar = bar.astype(object if items.dtype == object else float)
    alive = np.arange(n)
    left = np.ones((len(queries), n), bool)
    depth = np.ones(len(queries))
    open_ = np.ones(len(queries), bool)
    for g, read in enumerate(marks):
        known = bar > -math.inf
        ask = np.flatnonzero(open_ & (~known | (cut(sums[g]) < bar).astype(bool)))
        if not len(ask):
            continue
        top, bottom = lists[n - read], lists[read - 1]
        x = items[alive]
        lower = cut(gain[ask] @ np.where(x >= top, x, lists[0]).T + loss[ask] @ np.where(x <= bottom, x, lists[-1]).T)
        for i, q in enumerate(ask.tolist()):
            if len(alive) >= want[q]:
                bar[q] = max(bar[q], kth(lower[i], want[q]))
        upper = cut(gain[ask] @ np.maximum(x, top).T + loss[ask] @ np.minimum(x, bottom).T)
        left[np.ix_(ask, alive)] &= (upper >= bar[ask, None]).astype(bool)
        done = ask[left[ask].sum(1) <= SPARE * want[ask]]
        depth[done] = read / n
        open_[done] = False
        alive = np.flatnonzero(left.any(0))
        if not open_.any():
            break
    return alive, cut(queries @ items[alive].T), left[:, alive], depth


class Search:
    """A block of queries of one length, and the best candidates so far of each."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.order = np.argsort(ids)
        self.best = np.full((len(ids), k), -1)
        self.scores = np.full((len(ids), k), LEAST, object)
        self.count = np.zeros(len(ids), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.read: list[np.ndarray] = []

    def add(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.held.append((ids, values))
        self.size += len(ids)
        if self.size >= CANDIDATES:
            self.work()

    def work(self) -> None:
        if not self.held:
            return
        own, values = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        cut = FIRST if len(own) > 4 * FIRST and (self.count < self.k).any() else 0
        if cut:
            self.block(own[:cut], values[:cut])
        self.block(own[cut:], values[cut:])

    def block(self, own: np.ndarray, values: np.ndarray) -> None:
        """Searches candidates with lists of their own."""
        order = np.argsort(own, kind="stable")
        own, values = own[order], values[order]
        k = self.k
        every, items = scaled(self.values, values)
        lists = np.sort(items, 0)
        for a in range(0, len(self.ids), TOGETHER):
            at = self.order[a : a + TOGETHER]
            ids, queries = self.ids[at], every[at]
            # a query's own rows are among the candidates until they are taken out
            want = k + np.searchsorted(own, ids, "right") - np.searchsorted(own, ids)
            bar = np.array([s[k - 1] if c >= k else -math.inf for s, c in zip(self.scores[at], self.count[at], strict=True)], object)
            alive, scores, left, depth = aggregate(queries, items, lists, want, bar)
            self.read.append(depth)
            others = own[alive]
            for i, q in enumerate(at.tolist()):
                fair = np.flatnonzero(left[i] & (others != ids[i]))
                c_ids, c = others[fair], scores[i, fair]
                if len(c) > k:
                    bound = kth(c, k)
                    c_ids, c = c_ids[c >= bound], c[c >= bound]
                c_ids = np.concatenate([self.best[q, : self.count[q]], c_ids]).tolist()
                c = [int(x) for x in [*self.scores[q, : self.count[q]], *c.tolist()]]
                best = sorted(zip((-x for x in c), c_ids, strict=True))[:k]
                self.count[q] = len(best)
                self.best[q, : len(best)], self.scores[q, : len(best)] = [x for _, x in best], [-x for x, _ in best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.work()
        for a in range(0, len(self.ids), 2048):
            real = np.arange(self.k) < self.count[a : a + 2048, None]
            ids = np.broadcast_to(self.ids[a : a + 2048, None], real.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x[real].astype(np.int64)) for x in (ids, self.best[a : a + 2048], self.scores[a : a + 2048])], ["query_id", "vec_id", "score"])


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each vector length: the rows' numbers and their vectors as a matrix."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores; queries are the vec_ids divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_items, n_asked = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks = max(1, -(-n_asked // ASKED))
    tiles = max(1, -(-n_items // TILE), min(-(-n_items // 1024), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    tile = F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int")  # not by id, which may repeat
    queries = asked.select(block.alias("block"), F.lit(0).alias("side"), "vec_id", "v").withColumn("tile", numbers(tiles))
    items = rows.select(tile.alias("tile"), F.lit(1).alias("side"), "vec_id", "v").withColumn("block", numbers(blocks))
    dealt = queries.unionByName(items).select("tile", "block", "side", "vec_id", "v").repartition("tile", "block").sortWithinPartitions("tile", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, asked = None, {}, []

        def start() -> dict[int, Search]:
            """By length, the searches of the queries gathered."""
            out = {}
            for ids, values in asked:
                out.setdefault(values.shape[1], []).append((ids, values))
            asked.clear()
            return {n: Search(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) for n, parts in out.items()}

        for batch in batches:
            tiles, blocks, sides, ids = (batch.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1
            for a, z in zip([0, *new.tolist()], [*new.tolist(), len(ids)], strict=True):
                if a == z:
                    continue
                if (tiles[a], blocks[a]) != key:
                    for search in sets.values():
                        yield from search.rows()
                    key, sets = (tiles[a], blocks[a]), {}
                    asked.clear()
                for at, values in by_length(batch.column(4).slice(a, z - a)):
                    if sides[a] == 0:
                        asked.append((ids[a:z][at], values))
                    else:
                        if asked:
                            sets = start()
                        if values.shape[1] in sets:
                            sets[values.shape[1]].add(ids[a:z][at], values)
        for search in sets.values():
            yield from search.rows()

    found = dealt.mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable] = {"op7_exact_topk": op7_exact_topk}
