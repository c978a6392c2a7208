"""Operator 10: token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A huge text is cut into chunks that overlap. Each is encoded with offsets. A left chunk that begins at a true boundary of
pre-tokens has true boundaries up to a margin before its own end, as the splitting pattern only looks ahead a few
characters. Where the next chunk has a boundary at one of these, before an ASCII character (which never joins what
precedes it when the text is normalised), it goes on as the whole text would: the splitter keeps no state across a
boundary. Counts are spliced there. Where no boundary agrees, the overlap is doubled, up to the whole left chunk, and
then the chunk itself is.

Shorter texts are the sums of their words, where a word is what stands between spaces and line feeds; a worker remembers
words' counts and encodes new ones together, a mark between them. Nothing crosses a space: normalising composes no character with
it, no pattern of the splitter and no special token holds one, and neither looks ahead or back. A vocabulary with another splitter
than SPLITTER has its texts encoded as they are.

Null and empty texts have 0 bytes and 0 tokens, an empty table gives no rows; very long texts are counted whole. Repeated rows are
counted each by itself. Other columns pass if kept; those named as the results are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices, tidy

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Characters of a chunk and of the overlap of two; texts of up to one chunk are encoded as they are.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Boundaries this close to a chunk's end aren't trusted: the longest special token has 15 characters.
MARGIN = 32
#: Words whose counts a worker remembers at most, characters of such a word, and words that the library encodes at once.
MEMO, MEMO_LENGTH, TOGETHER = 1 << 19, 32, 4096
# The vocabulary's splitting pattern, and a character that is a token by itself.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = "\0"


class Counter:
    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(raw)
        self.tok.no_truncation()
        self.tok.no_padding()
        words = self.tok.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        first = ((json.loads(raw).get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and (first.get("pattern") or {}).get("Regex") == SPLITTER else None
        self.memo: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> None:
        """Learns the words' counts. Those that hold a mark are encoded alone."""
        alone = [w for w in words if MARK in w]
        self.memo.update(zip(alone, self.encoded(alone), strict=True))
        plain = [w for w in words if MARK not in w]
        for a in range(0, len(plain), TOGETHER):
            part = plain[a : a + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.concatenate([[-1], np.flatnonzero(ids == self.mark), [len(ids)]])
            self.memo.update(zip(part, (np.diff(cuts) - 1).tolist(), strict=True))

    def plain(self, texts: list[str]) -> list[int]:
        if self.mark is None:
            return self.encoded(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        words = set().union(*split)
        new = list(words.difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(words)
        self.words(new)
        out = [sum(map(self.memo.__getitem__, own)) for own in split]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del self.memo[w]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return out

    def chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Stable-looking boundaries, as positions in the text, and the number of the chunk's tokens before each."""
        got = self.tok.encode(text[start:end], add_special_tokens=False)
        closes = np.flatnonzero(self.ends[np.array(got.ids, np.int64)]) if got.ids else np.empty(0, np.int64)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
        at = offsets[closes, 1] + start
        sound = np.array([p < len(text) and text[p] < "\x80" for p in at.tolist()], bool)
        self.total = len(got.ids)
        return at[sound], closes[sound] + 1

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        n, start, end = len(text), 0, min(chunk, len(text))
        at, before = self.chunk(text, 0, end)
        total, done, own = 0, 0, self.total
        while end < n:
            lap, size = overlap, chunk
            while True:
                begin = max(start, end - lap)
                until = min(n, max(end, begin + size))
                if begin == start:  # the overlap is the whole left chunk: one longer chunk in its place
                    until = min(n, end + size)
                    at, before = self.chunk(text, start, until)
                    done, own, end = 0, self.total, until  # `start` is a boundary, and all before it is counted
                    break
                new_at, new_before = self.chunk(text, begin, until)
                common, i, j = np.intersect1d(at, new_at, return_indices=True)
                fit = np.flatnonzero((common > begin) & (common <= end - MARGIN) & (before[i] >= done))
                if len(fit):
                    k = fit[-1]
                    total += int(before[i[k]]) - done
                    done, own = int(new_before[j[k]]), self.total
                    at, before, start, end = new_at[j[k] :], new_before[j[k] :], int(common[k]), until
                    # counts of the new chunk start at its own first token, so `done` of them lie before the splice
                    break
                lap, size = lap * 2, size * 2
        return total + own - done


_counters: dict[int, Counter] = {}


def counter(raw: bytes) -> Counter:
    if hash(raw) not in _counters:
        _counters[hash(raw)] = Counter(raw)
    return _counters[hash(raw)]


def count_tokens(docs: DataFrame, keep: list[str], path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows of docs: the columns `keep`, n_bytes (UTF-8), n_tokens, over_limit. A null text is empty."""
    import public_tokenizers

    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary, under 2 MB
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = counter(shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                short = [i for i, t in enumerate(texts) if len(t) <= chunk]
                counts = np.zeros(len(texts), np.int64)
                counts[short] = own.plain([texts[i] for i in short])
                for i, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i] = own.count(t, chunk, overlap)
                n_bytes = pc.fill_null(pc.binary_length(part.column("__text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], n_bytes, pa.array(counts), pa.array(counts > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("__text")).mapInArrow(tidy(run), f"{kept}n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), ["doc_id"], path)


QUERIES: dict[str, Callable] = {"op10_token_counts": op10_token_counts}
