"""Shared pieces: shared-folder checkpoints, batch slicing and vectorised word hashing.

The kernels work on the raw UTF-8 buffers of Arrow columns, so a word costs a few numpy passes and no Python object.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by a kernel; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
#: A table of at most so many narrow rows (ids and a few numbers) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes that Spark hands to Python at once (texts may be long, so far fewer than by default), and rows that it
#: reads of a file at once: their texts stand in one array, which doubles as it grows.
BATCH_ROWS, BATCH_BYTES, FILE_ROWS = 2000, SLICE_BYTES, 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(FILE_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts df's lineage: writes it as a table in the folder that the cluster names in spark.checkpoint.dir and reads that.

    A folder of our own only where none is set and Spark is local: on a cluster it must be one that all machines share. Unlike DataFrame.checkpoint, whose size estimate is its plan's (a product
    over joins, which explodes in a loop), the table's size is known, so Spark can choose joins by it. The tables go when
    this Python ends, or earlier by drop(). Shuffle files go as soon as the table is written: else they stay until the
    driver happens to collect its garbage, and a stage's shuffles add up on disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    top = f"{sc._jsc.sc().getCheckpointDir().get()}/tables"
    if top not in _tops:
        _tops.add(top)
        atexit.register(_remove, sc, top)
    path = f"{top}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._checkpoint = path
    return out


def drop(df: DataFrame) -> None:
    """Removes the files of a table that checkpoint() returned and that nothing reads any more."""
    _remove(df.sparkSession.sparkContext, df._checkpoint)


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tops: set[str] = set()


def _remove(sc, top: str) -> None:
    if sc._jsc is not None:
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed narrow table, marked for broadcast only if its counted size is within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def blocks(df: DataFrame, key: str, rows: int = BROADCAST_ROWS, most: int = 16) -> Iterator[DataFrame]:
    """A checkpointed narrow table with one row a key, in blocks that may be broadcast one after another; whole and without a
    hint where these would be more than `most`."""
    parts = max(1, -(-df.count() // rows))
    if parts > most:
        yield df
    else:
        yield from (F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p) if parts > 1 else df) for p in range(parts))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take at most `most` bytes together (one row at least)."""
    texts = batch.column(column)
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives back freed memory when its task ends: workers are used again by later stages."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII that is neither a letter, a digit nor an underscore; other code points count as letters.
NON_WORD = np.array([c < 128 and not (chr(c).isalnum() or c == 95) for c in range(256)])


def runs(outside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't `outside`; a run never crosses rows."""
    if not len(outside):
        return (np.empty(0, np.int64),) * 3
    inside = ~outside
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    after[:-1], after[-1] = inside[1:], False
    cuts = offsets[(offsets > 0) & (offsets < len(outside))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes with A-Z in lower case, and masks of a lane's first 0 to 8 bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class SpanHasher:
    """64-bit hashes of byte spans, ASCII letters lower-cased. seed picks the family.

    A span is read in lanes of 8 bytes. Each lane is tagged with its place and goes through a mix that isn't linear, before the
    lanes are added; so patterns that cancel out in sums of powers don't. Unequal spans agree by chance only, 1 in 2^64.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.tag, self.factor, self.size = (np.uint64(int(x) | 1) for x in rng.integers(1 << 40, 1 << 63, 3))

    def _lanes(self, values: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        place = np.atleast_1d(np.asarray(number, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + self.tag
        return mix((values ^ mix(place)) * self.factor)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Spans must be sorted and must not overlap. Works through pieces of about 64 K bytes."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 16), "right")))
            a, b = int(starts[i]), max(int(ends[j - 1]), int(starts[i]))
            part = np.zeros(b - a + 9, np.uint8)
            part[: b - a] = LOWER[data[a:b]]
            lanes = np.ndarray((b - a + 1,), "<u8", part, 0, (1,))  # the 8 bytes from each byte on
            s, length = starts[i:j] - a, np.maximum(ends[i:j] - starts[i:j], 0)
            sums = self._lanes(lanes[np.minimum(s, b - a)] & MASK[np.minimum(length, 8)], 0)
            more = np.flatnonzero(length > 8)
            if len(more):
                extra = (length[more] - 1) // 8
                first = np.cumsum(extra) - extra
                number = np.arange(int(extra.sum())) - np.repeat(first, extra) + 1
                of = np.repeat(more, extra)
                tail = self._lanes(lanes[s[of] + 8 * number] & MASK[np.minimum(length[of] - 8 * number, 8)], number)
                sums[more] += np.add.reduceat(tail, first)
            out[i:j] = mix(sums + length.astype(np.uint64) * self.size)
            i = j
        return out


_hashers: dict[int, SpanHasher] = {}


def hasher(seed: int = 1) -> SpanHasher:
    if seed not in _hashers:
        _hashers[seed] = SpanHasher(seed)
    return _hashers[seed]


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each k words in a row on end, the row, and the first word's index.

    whole: a row with 1 to k-1 words gives its whole sequence as one shingle.
    """
    factor = _odd(k, 77)
    n = len(words)
    if n >= k:
        at = np.flatnonzero(rows[k - 1 :] == rows[: n - k + 1])
        total = np.zeros(len(at), np.uint64)
        for i in range(k):
            total += words[at + i] * factor[i]
        got, of = mix(total), rows[at]
    else:
        at, got, of = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if whole and n:
        ids, first, counts = np.unique(rows, return_index=True, return_counts=True)
        short = counts < k
        if short.any():
            sums = np.zeros(short.sum(), np.uint64)
            f, c = first[short], counts[short]
            for i in range(k - 1):
                has = c > i
                sums[has] += words[f[has] + i] * factor[i]
            extra = mix(sums + c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            got, of, at = np.concatenate([got, extra]), np.concatenate([of, ids[short]]), np.concatenate([at, f])
            order = np.argsort(at, kind="stable")
            got, of, at = got[order], of[order], at[order]
    return got, of, at


def word_hashes(texts: pa.Array, outside: np.ndarray = WHITE, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each word, its byte span in the buffer, and the row offsets."""
    data, offsets = buffers(texts)
    starts, ends, rows = runs(outside[data], offsets)
    return hasher(seed)(data, starts, ends), rows, starts, ends, offsets
