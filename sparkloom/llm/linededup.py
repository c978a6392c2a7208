"""Operator 4: lines that many documents share stay in one of them, found through two Bloom filters.

Every task puts its line keys (once a document) into a filter of keys seen once and one of keys seen twice. The pairs are
merged by segment: bits that two tasks both hold in their once-filters are set in the merged twice-filter, which so covers
every key of two documents or more. Only lines whose bits all stand in it are suspects; these alone are shuffled, as a 128-bit
cryptographic digest of the key itself (its identity) and the document, and counted exactly. The filters grow with the
text up to FILTER_BITS; beyond that load more suspects are shuffled, and the result is the same.

Null and empty texts are one empty line and never change; an empty table gives no rows. Rows without a doc_id are no documents:
they count for no line and keep their text. Repeated rows of a doc_id count as one document and lose the same lines; of
documents that hold a line, the largest doc_id keeps it, in all its places, so ties don't arise. Very long texts are worked
on alone, whole. Extra columns pass; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, buffers, checkpoint, hasher, read, slices, small, tidy

LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3
#: Bits of a filter at most, bits for each 64 bytes of text, and bits that a key sets.
FILTER_BITS, BITS_EACH, HASHES = 1 << 28, 8, 3
SEGMENTS = 64
#: Dropped lines (document and hash) that are broadcast at most; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def lines(texts: pa.Array, least: int) -> dict[str, np.ndarray]:
    """Start, end and row of each line, and for keys of `least` code points or more two hashes; `long` tells which."""
    data, offsets = buffers(texts)
    breaks = np.flatnonzero(data == 10)
    counts = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    total = int(counts.sum())
    starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
    is_first[first], is_last[last] = True, True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    solid = np.flatnonzero(~WHITE[data])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    filled = b > a
    begin, end = starts.copy(), starts.copy()
    begin[filled], end[filled] = solid[a[filled]], solid[b[filled] - 1] + 1
    long = filled & (points[end] - points[begin] >= least)
    begin, end = begin[long], end[long]
    return {"rows": np.repeat(np.arange(len(counts)), counts), "starts": starts, "ends": ends, "counts": counts, "long": long, "begin": begin, "end": end, "h1": hasher(1)(data, begin, end), "h2": hasher(2)(data, begin, end), "data": data}


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit digests of the keys in these spans, as two columns of long."""
    raw = [hashlib.blake2b(data[a:b].tobytes().lower(), digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)


def _once_each(rows: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Indices of one line for each row and key."""
    order = np.lexsort((h1, rows))
    r, h = rows[order], h1[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return order[new]


def places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(h1 + np.uint64(i) * (h2 | np.uint64(1))) & np.uint64(bits - 1) for i in range(HASHES)], 1).astype(np.int64)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def among(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all places of a row are set."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def twice_filter(docs: DataFrame, least: int, bits: int) -> bytes:
    """The merged filter of keys that may stand in two documents or more, as packed bits."""
    step = bits // SEGMENTS // 8

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for part in slices(batch, "__text"):
                got = lines(part.column("__text"), least)
                rows = got["rows"][got["long"]]
                own = _once_each(rows, got["h1"])
                own = own[part.column("__id").is_valid().to_numpy(zero_copy_only=False)[rows[own]]]
                h1, h2 = got["h1"][own], got["h2"][own]
                if not len(h1):
                    continue
                at = places(h1, h2, bits)
                _, back, counts = np.unique(h1, return_inverse=True, return_counts=True)
                again = (counts[back] > 1) | among(once, at)
                put(twice, at[again].ravel())
                put(once, at.ravel())
        rows = [(s, *(zlib.compress(f[s * step : (s + 1) * step].tobytes(), 1) for f in (once, twice))) for s in range(SEGMENTS) if once[s * step : (s + 1) * step].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for s, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if s in held:
                    once, twice = held[s]
                    held[s] = (once | o, twice | t | (once & o))
                else:
                    held[s] = (o, t)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for _, t in held.values()], pa.binary())], ["segment", "twice"])

    parts = docs.mapInArrow(tidy(gather), "segment int, once binary, twice binary").repartition(SEGMENTS, "segment").mapInArrow(tidy(merge), "segment int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for s, t in parts.collect():  # at most FILTER_BITS / 8 bytes
        out[s * step : (s + 1) * step] = np.frombuffer(zlib.decompress(t), np.uint8)
    return out.tobytes()


def shared_lines(docs: DataFrame, least: int, documents: int, filter_bits: int) -> DataFrame:
    """(doc_id, h1, d1, d2): a hash and the digest of the lines that a document loses; checkpointed."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    bits = min(filter_bits, max(1 << 16, 1 << (BITS_EACH * total // 64).bit_length()))
    twice = spark.sparkContext.broadcast(twice_filter(docs, least, bits))  # FILTER_BITS / 8 bytes at most

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            for part in slices(batch, "__text"):
                got = lines(part.column("__text"), least)
                rows = got["rows"][got["long"]]
                own = _once_each(rows, got["h1"])
                at = places(got["h1"][own], got["h2"][own], bits)
                own = own[among(packed, at)]
                ids = part.column("__id").take(pa.array(rows[own]))
                d = digests(got["data"], got["begin"][own], got["end"][own])
                yield pa.RecordBatch.from_arrays([ids, pa.array(got["h1"][own].view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["doc_id", "h1", "d1", "d2"])

    found = docs.filter("__id is not null").mapInArrow(tidy(suspects), "doc_id long, h1 long, d1 long, d2 long")
    found = checkpoint(found.distinct())
    common = checkpoint(found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= documents).select("d1", "d2", "holder"))
    return checkpoint(found.join(small(common), ["d1", "d2"]).filter("doc_id <> holder").select("doc_id", "h1", "d1", "d2"))


def dedup_lines(docs: DataFrame, least: int = LEAST_LENGTH, documents: int = LEAST_DOCUMENTS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with the lines dropped that are kept elsewhere, n_lines (before) and n_dropped (long).

    A key is a line stripped of ASCII white space, A-Z in lower case. Keys of `least` code points or more that stand in
    `documents` documents or more stay in the largest doc_id that holds them.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    plain = docs.select(*[docs[f"`{c}`"] for c in keep])
    lost = shared_lines(plain.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")), least, documents, filter_bits)
    each = lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "d1", "d2")).alias("__lost")).withColumnRenamed("doc_id", "__of")
    if lost.count() <= BROADCAST_LINES:
        each = F.broadcast(each)
    joined = plain.join(each, F.col("doc_id") == F.col("__of"), "left").drop("__of")
    kept = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                gone = part.column("__lost")
                hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
                data, offsets = buffers(texts)
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                n_lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
                dropped = np.zeros(len(n_lines), np.int64)
                if len(hit):
                    changed = dict.fromkeys(hit.tolist())
                    got = lines(texts.take(pa.array(hit)), least)
                    hashes = np.zeros(len(got["rows"]), np.int64)
                    hashes[got["long"]] = got["h1"].view(np.int64)
                    spot_key = np.cumsum(got["long"]) - 1
                    cuts = np.concatenate([[0], np.cumsum(got["counts"])])
                    raw = got["data"].tobytes()
                    for i, row in enumerate(hit.tolist()):
                        at = slice(cuts[i], cuts[i + 1])
                        lost = gone[row].values
                        lose = got["long"][at] & np.isin(hashes[at], lost.field("h1").to_numpy())
                        spots = np.flatnonzero(lose)
                        key = spot_key[at][spots]
                        keys = set(zip(lost.field("d1").to_pylist(), lost.field("d2").to_pylist(), strict=True))
                        lose[spots] = [tuple(d) in keys for d in digests(got["data"], got["begin"][key], got["end"][key]).tolist()]
                        dropped[row] = lose.sum()
                        spans = zip(got["starts"][at][~lose].tolist(), got["ends"][at][~lose].tolist(), strict=True)
                        changed[row] = b"\n".join([raw[a:b] for a, b in spans]).decode()
                    texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*[texts if c == "text" else part.column(c) for c in keep], pa.array(n_lines.astype(np.int64)), pa.array(dropped)], [*keep, "n_lines", "n_dropped"])

    return joined.mapInArrow(tidy(run), f"{kept}, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable] = {"op4_line_dedup": op4_line_dedup}
