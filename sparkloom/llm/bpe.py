"""Operator 1: byte-level BPE encoding and decoding with rank files.

Each pre-token is merged by a segment tree over its byte positions. A leaf holds rank * size + position of the pair that
starts there (a constant above all others where none does), so the root is the leftmost pair of least rank; a merge
changes three leaves (the merged position, its right neighbour, its left live neighbour) and their ancestors only. Trees of
equal size are worked on side by side as rows of one matrix.

Nulls and empty texts give no tokens, an empty table gives no rows. Repeated rows are encoded each by itself; pairs of equal rank are merged
from the left. Very long texts are encoded whole, some of their pre-tokens at a time, and a very long pre-token has a tree of its own. Other columns pass if kept;
those named as the results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections import ChainMap
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices, tidy

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens, and characters of them and their ids, that each of a worker's two generations of memory holds; the older goes when
#: the younger is full. Longer pre-tokens than MEMO_LENGTH aren't remembered.
MEMO, MEMO_CHARACTERS, MEMO_LENGTH = 200_000, 8 << 20, 256
#: Characters of a text whose pieces are listed at once; a longer one's are encoded by so many pieces.
LONG, GROUP = 1 << 20, 1 << 16
#: Elements of the tree matrices that are worked on at once: what a core's cache holds.
MATRIX = 1 << 16


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class BpeCodec:
    """encode() and decode() of single texts, encode_pieces() of many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # \s as Unicode's White_Space, which the rank file's own library means by it
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.find = self.pattern.findall
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = max(ranks.values()) + 2
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.text_of = {str(v): k for k, v in ranks.items()}
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merged token, -1 if there is none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def _merge(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Pieces of 2 to `size` bytes; size is a power of two."""
        n, none = len(pieces), np.int64(1) << 62
        length = np.array([len(p) for p in pieces])
        spot = np.arange(size)
        real = spot < length[:, None]
        ids = np.zeros((n, size + 1), np.int64)
        ids[:, :size][real] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
        tree = np.full((n, 2 * size), none)
        rank = self.pair_ranks(ids[:, : size - 1], ids[:, 1:size])
        rank[~real[:, 1:]] = -1
        tree[:, size : 2 * size - 1] = np.where(rank >= 0, rank * size + spot[:-1], none)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.arange(n)

        def leaf(r: np.ndarray, left: np.ndarray) -> np.ndarray:
            """Value of the leaf at `left`, whose right neighbour is taken from `after`."""
            right = after[r, left]
            found = self.pair_ranks(ids[r, left], ids[r, np.minimum(right, size)])
            return np.where((right < length[r]) & (found >= 0), found * size + left, none)

        while True:
            root = tree[row, 1]
            live = root < none
            row, root = row[live], root[live]
            if not len(row):
                break
            at = root % size
            gone = after[row, at]
            ids[row, at] = root // size
            nxt = after[row, gone]
            after[row, at] = nxt
            inside = nxt <= size
            before[row[inside], nxt[inside]] = at[inside]
            ids[row, gone] = -1
            tree[row, size + gone] = none
            tree[row, size + at] = leaf(row, at)
            prev = before[row, at]
            has = prev >= 0
            tree[row[has], size + prev[has]] = leaf(row[has], prev[has])
            rows3 = np.concatenate([row, row, row[has]])
            up = np.concatenate([at, gone, prev[has]]) + size
            while up[0] > 1:
                up >>= 1
                tree[rows3, up] = np.minimum(tree[rows3, 2 * up], tree[rows3, 2 * up + 1])
        out = []
        for i in range(n):
            got = ids[i, : length[i]]
            out.append(tuple(got[got >= 0].tolist()))
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece, on plain lists."""
        size = 1 << (len(piece) - 1).bit_length()
        n, none = len(piece), 1 << 62
        ids = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.pair_ranks(ids[:-1], ids[1:])
        tree = np.full(2 * size, none, np.int64)
        tree[size : size + n - 1] = np.where(rank >= 0, rank * size + np.arange(n - 1), none)
        level = size
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree, ids = tree.tolist(), ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.table()

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    return
                tree[at] = low
                at >>= 1

        def leaf(at: int) -> int:
            right = after[at]
            found = table.get(ids[at] * self.width + ids[right], -1) if right < n else -1
            return found * size + at if found >= 0 else none

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return tuple(x for x in ids if x >= 0)

    def table(self) -> dict[int, int]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        return self._table

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """A piece that is itself a token is that token; any other is merged from its bytes."""
        out: list[tuple[int, ...] | None] = []
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            out.append(None if rank is None else (rank,))
            if rank is None:
                classes.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for size, members in classes.items():
            step = max(1, MATRIX // size)
            if size > 2048:
                for i in members:
                    out[i] = self._merge_long(pieces[i])
                continue
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for i, got in zip(part, self._merge([pieces[i] for i in part], size), strict=True):
                    out[i] = got
        return out

    def learn(self, pieces: set[str]) -> dict[str, str]:
        """The pieces' ids, as text; remembers those of pieces of up to MEMO_LENGTH."""
        if len(self.memo) > MEMO or self.held > MEMO_CHARACTERS:
            self.older, self.memo, self.held = self.memo, {}, 0
        memo, older = self.memo, self.older
        new, long = [], []
        for p in pieces.difference(memo):
            if (got := older.pop(p, None)) is not None:
                memo[p] = got
                self.held += len(p) + len(got)
            else:
                (new if len(p) <= MEMO_LENGTH else long).append(p)
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            memo[p] = got = ",".join(map(str, ids))
            self.held += len(p) + len(got)
        if not long:
            return memo
        return ChainMap(memo, dict(zip(long, (",".join(map(str, ids)) for ids in self.encode_pieces([p.encode() for p in long])), strict=True)))

    def groups(self, text: str) -> Iterator[tuple[list[str], dict[str, str]]]:
        """The pieces of a very long text, GROUP at a time, and their ids."""
        found = self.pattern.finditer(text)
        while group := [m[0] for m in islice(found, GROUP)]:
            yield group, self.learn(set(group))

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        ids = self.learn(set(pieces))
        return [int(x) for p in pieces for x in ids[p].split(",")]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


_codecs: dict[tuple[int, str], BpeCodec] = {}


def codec(raw: bytes, pattern: str) -> BpeCodec:
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs[key] = BpeCodec(parse_ranks(raw), pattern)
    return _codecs[key]


def tokenizer(rank_file: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes, read by the driver, and the pattern; by default those of the public tokenizer."""
    import public_tokenizers

    with open(rank_file or public_tokenizers.path(RANK_FILE), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, keep: list[str], rank_file: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """Rows of docs: the columns `keep`, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids.

    The digests are of the decimal ids joined by commas and of the bytes that the ids decode to. A null text is empty.
    The result keeps every row, whatever its other columns hold.
    """
    raw, pattern = tokenizer(rank_file, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(raw)  # the rank file, under 1 MB
    keep = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids)]
    kept = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)
    schema = f"{kept}n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                found = [own.find(t) if len(t) <= LONG else [] for t in texts]
                memo = own.learn(set(chain.from_iterable(found)))
                counts, digests, decoded, ids = [], [], [], []
                for text, pieces in zip(texts, found, strict=True):
                    digest, back, count, own_ids = hashlib.sha256(), hashlib.sha256(), 0, []
                    for group, known in [(pieces, memo)] if len(text) <= LONG else own.groups(text):
                        joined = ",".join(map(known.__getitem__, group))
                        each = joined.split(",") if joined else []
                        digest.update((("," if count else "") + joined).encode())
                        back.update(b"".join(map(own.text_of.__getitem__, each)))
                        count += len(each)
                        if with_ids:
                            own_ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.empty(0, np.int32))
                    counts.append(count)
                    digests.append(digest.hexdigest())
                    decoded.append(back.hexdigest())
                    ids += own_ids
                columns = [part.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("__text")).mapInArrow(tidy(run), schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ["doc_id"], path, with_ids=False)


QUERIES: dict[str, Callable] = {"op1_byte_bpe": op1_byte_bpe}
