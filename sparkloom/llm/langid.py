"""Operator 6: language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a document's bytes (A-Z lower-cased) from both ends of windows: WINDOW bytes are labelled, every one of them, letters,
spaces and punctuation alike, and up to CONTEXT bytes on either side within the document are read before. Windows follow each
other without gaps, so every byte of a document gets one probability for each language. A document's probability
is the mean over all its bytes; its score is the largest. Training is backpropagation through time by the driver, on a sample
of labelled documents: of the TRAIN_DOCS of each language with the least hash of their id, the windows of least hash, TRAIN_WINDOWS in
all (LEAST_WINDOWS of a language at least); these bounds are parameters. Every label that occurs is learned.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when no labelled document can be
learned from. An empty table gives no rows. Rows without doc_id or lang are not learned from, and are predicted like all others;
held_out is then false for a null doc_id. Equal probabilities: the language first in alphabetical order. Very long texts are read whole.
Repeated rows are predicted each by itself. Other columns pass if kept; those named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, checkpoint, mix, read, slices, tidy

#: Bytes of a window that are labelled and that are read before, units in each direction.
WINDOW, CONTEXT, HIDDEN = 64, 16, 12
#: Sampled documents of a language, windows learned from in all and of a language at least, passes over them.
TRAIN_DOCS, TRAIN_WINDOWS, LEAST_WINDOWS, PASSES = 256, 8192, 64, 3
BATCH, STEP = 64, 0.01
#: Windows that are labelled at once.
TOGETHER = 1024
#: Bytes of letters for sure: ASCII letters. Texts without any are looked at as characters.
LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters of two directions (input table of 256 bytes, recurrent matrices) and of the labelling layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.languages, self.hidden = languages, hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": draw(256, 3 * hidden), f"g{d}": draw(hidden, 2 * hidden), f"c{d}": draw(hidden, hidden)}
        self.p |= {"out": draw(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}

    def _run(self, d: str, data: np.ndarray, mask: np.ndarray, keep: list | None) -> list[np.ndarray]:
        """States after each step; data and mask are steps x pieces, in the direction's own order."""
        h, own = self.hidden, self.p
        state = np.zeros((data.shape[1], h), np.float32)
        out = []
        for t in range(len(data)):
            x = own[f"x{d}"][data[t]]
            gates = sigmoid(x[:, : 2 * h] + state @ own[f"g{d}"])
            z, r = gates[:, :h], gates[:, h:]
            cand = np.tanh(x[:, 2 * h :] + (r * state) @ own[f"c{d}"])
            new = state + mask[t][:, None] * z * (cand - state)
            if keep is not None:
                keep.append((state, z, r, cand))
            state = new
            out.append(state)
        return out

    def label(self, data: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, steps x pieces x languages, and the mask of real positions; data: pieces x steps."""
        steps = data.shape[1]
        data = data.T
        mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        kept_f, kept_b = ([], []) if keep is not None else (None, None)
        forward = np.array(self._run("f", data, mask, kept_f))
        backward = np.array(self._run("b", data[::-1], mask[::-1], kept_b))[::-1]
        both = np.concatenate([forward, backward], 2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(2, keepdims=True)
        if keep is not None:
            keep.update(f=kept_f, b=kept_b, both=both, data=data, mask=mask)
        return prob, mask

    def gradient(self, data: np.ndarray, lengths: np.ndarray, truth: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy of all positions; truth: each piece's language."""
        keep: dict = {}
        prob, mask = self.label(data, lengths, keep)
        total = mask.sum()
        target = np.zeros((len(truth), len(self.languages)), np.float32)
        target[np.arange(len(truth)), truth] = 1
        loss = -(np.log(prob[:, np.arange(len(truth)), truth] + 1e-9) * mask).sum() / total
        error = (prob - target) * (mask / total)[:, :, None]
        h, own = self.hidden, self.p
        grad = {k: np.zeros_like(v) for k, v in own.items()}
        grad["out"] = np.einsum("tnh,tnl->hl", keep["both"], error)
        grad["bias"] = error.sum((0, 1))
        into = error @ own["out"].T
        for d in "fb":
            order = range(len(mask)) if d == "f" else range(len(mask) - 1, -1, -1)
            side = slice(0, h) if d == "f" else slice(h, 2 * h)
            back = np.zeros((data.shape[0], h), np.float32)
            for i, t in reversed(list(enumerate(order))):
                state, z, r, cand = keep[d][i]
                back = back + into[t][:, side]
                m = mask[t][:, None]
                d_cand = back * m * z * (1 - cand**2)
                d_z = back * m * (cand - state) * z * (1 - z)
                through = d_cand @ own[f"c{d}"].T
                d_r = through * state * r * (1 - r)
                gates = np.concatenate([d_z, d_r], 1)
                grad[f"g{d}"] += state.T @ gates
                grad[f"c{d}"] += (r * state).T @ d_cand
                np.add.at(grad[f"x{d}"], keep["data"][t], np.concatenate([gates, d_cand], 1))
                back = back * (1 - m * z) + through * r + gates @ own[f"g{d}"].T
        return grad, float(loss)

    def train(self, data: np.ndarray, lengths: np.ndarray, truth: np.ndarray, passes: int = PASSES, seed: int = 3) -> float:
        """Adam over shuffled batches of pieces of like lengths; returns the last pass's mean loss."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step, losses = 0, []
        for _ in range(passes):
            order = np.lexsort((rng.random(len(lengths)), lengths))
            batches = [order[a : a + BATCH] for a in range(0, len(order), BATCH)]
            losses = []
            for b in rng.permutation(len(batches)).tolist():
                at = batches[b]
                grad, loss = self.gradient(data[at, : lengths[at].max()], lengths[at], truth[at])
                losses.append(loss)
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(losses)) if losses else 0.0

    def totals(self, data: np.ndarray, low: np.ndarray, start: np.ndarray, end: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of the bytes start..end - 1 of each window, read from low to high; data is lower-cased."""
        out = np.zeros((len(start), len(self.languages)))
        order = np.argsort(end - start, kind="stable")
        h, own = self.hidden, {k: np.ascontiguousarray(v.T) for k, v in self.p.items() if k in ("out", "bias")}
        for d in "fb":
            x, g = self.p[f"x{d}"], self.p[f"g{d}"]
            # a sigmoid is 1 / (1 + exp(-x)), a hyperbolic tangent 1 - 2 / (1 + exp(2 * x)): sign and factor are in the tables
            tables = -x[:, :h], -x[:, h : 2 * h], 2 * x[:, 2 * h :], -g[:, :h], -g[:, h:], 2 * self.p[f"c{d}"]
            own[d] = [np.ascontiguousarray(v) for v in tables]
        for a in range(0, len(order), TOGETHER):
            at = order[a : a + TOGETHER]
            s, e, steps = start[at], end[at], int((end[at] - start[at]).max())
            with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
                f = self._states("f", own, data, s - CONTEXT, 1, low[at], e, steps)
                b = self._states("b", own, data, s + steps + CONTEXT - 1, -1, s, high[at], steps)
            sums = np.zeros((len(self.languages), len(at)), np.float32)
            for t in range(steps):
                prob = own["out"][:, :h] @ f[t].T + own["out"][:, h:] @ b[steps - 1 - t].T + own["bias"][:, None]
                prob -= prob.max(0)
                np.exp(prob, out=prob)
                prob /= prob.sum(0)
                prob *= s + t < e
                sums += prob
            out[at] = sums.T
        return out

    def _states(self, d: str, own: dict, data: np.ndarray, first: np.ndarray, way: int, low: np.ndarray, high: np.ndarray, steps: int) -> list[np.ndarray]:
        """States (windows x units) after each of the last `steps` steps of a direction; places outside low..high - 1 change nothing."""
        xz, xr, xc, gz, gr, c = own[d]
        shape = (len(first), self.hidden)
        state = np.zeros(shape, np.float32)
        z, r, cand, read = (np.empty(shape, np.float32) for _ in range(4))
        out = []
        for t in range(CONTEXT + steps):
            place = first + way * t
            inside = (place >= low) & (place < high)
            byte = data[np.where(inside, place, 0)].astype(np.intp)
            for gate, table, weights in ((z, xz, gz), (r, xr, gr)):
                np.matmul(state, weights, out=gate)
                gate += np.take(table, byte, axis=0, out=read, mode="clip")  # bytes are never outside: not looked at twice
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            r *= state
            np.matmul(r, c, out=cand)
            cand += np.take(xc, byte, axis=0, out=read, mode="clip")
            np.exp(cand, out=cand)
            cand += 1
            np.divide(-2, cand, out=cand)
            cand += 1
            cand -= state
            cand *= z
            if not inside.all():
                cand *= inside[:, None]
            state = state + cand
            if t >= CONTEXT:
                out.append(state)
        return out


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the windows of texts."""
    parts = -(-np.diff(offsets) // WINDOW)
    rows = np.repeat(np.arange(len(parts)), parts)
    start = offsets[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
    return start, np.minimum(start + WINDOW, offsets[rows + 1]), rows


def predict(network: Network | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    names, scores = ["und"] * n, np.zeros(n)
    if network is None or not n:
        return names, scores
    data, offsets = buffers(texts)
    start, end, rows = windows(offsets)
    if not len(start):
        return names, scores
    sums = network.totals(LOWER[data], np.maximum(start - CONTEXT, offsets[rows]), start, end, np.minimum(end + CONTEXT, offsets[rows + 1]))
    size = np.diff(offsets)
    mean = np.stack([np.bincount(rows, x, n) for x in sums.T], 1) / np.maximum(size, 1)[:, None]
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    ascii_letter = letters[offsets[1:]] > letters[offsets[:-1]]
    best = mean.argmax(1)
    for i in np.flatnonzero(size > 0).tolist():
        if ascii_letter[i] or any(map(str.isalpha, texts[i].as_py())):
            names[i], scores[i] = network.languages[best[i]], min(1.0, max(0.0, float(mean[i, best[i]])))
    return names, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(usable: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """(id, lang, text): of each language in `counts` (its number of rows) the `most` rows of least hash; checkpointed.

    One pass: a bound on the hash, from the counts, lets about twice as many rows through as are wanted, and what passes is
    cut to `most` in each task before it is shuffled. Where ids repeat so that too few pass, all rows compete.
    """
    low, width = -(1 << 63), 1 << 64
    order = Window.partitionBy("lang").orderBy("h", "id", "text")
    ranked = usable.withColumn("h", F.xxhash64("id"))
    for wide in (False, True):
        bounds = {x: low + width * min(n, n if wide else 2 * most + 64) // n - 1 for x, n in counts.items()}
        each = usable.sparkSession.createDataFrame(list(bounds.items()), "of string, bound long")  # a row for each language
        near = ranked.join(F.broadcast(each), F.col("lang") == F.col("of")).filter(F.col("h") <= F.col("bound")).drop("of", "bound")
        out = checkpoint(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n"))
        if out.count() == sum(min(n, most) for n in counts.values()):
            break
    return out


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS, passes: int = PASSES) -> Network | None:
    """A network learned from text and lang of a bounded sample of the documents that aren't held out."""
    usable = docs.select(docs["doc_id"].cast("long").alias("id"), docs["lang"].alias("lang"), docs["text"].alias("text")).filter("id is not null and lang is not null and text is not null").filter(~held_out(F.col("id")))
    found = usable.groupBy("lang").count().collect()  # a row for each language
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    most = max(LEAST_WINDOWS, train_windows // len(languages))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the `most` windows of least hash."""
        for batch in batches:
            for part in slices(batch):
                data, offsets = buffers(part.column("text"))
                start, end, rows = windows(offsets)
                seed = part.column("h").to_numpy().view(np.uint64)[rows]
                order = mix(mix(seed) + (start - offsets[rows]).astype(np.uint64)).view(np.int64)
                by = np.lexsort((order, rows))
                nth = np.arange(len(by)) - np.searchsorted(rows[by], rows[by])
                pick = by[nth < most]
                cuts = zip(start[pick].tolist(), end[pick].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(rows[pick])), pa.array(order[pick]), pa.array([data[x:y].tobytes() for x, y in cuts], pa.binary())], ["lang", "order", "bytes"])

    chosen = sample(usable, {r["lang"]: r["count"] for r in found}, train_docs)
    drawn = chosen.select("lang", "h", "text").mapInArrow(tidy(draw), "lang string, order long, bytes binary")
    ranked = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("order", "bytes"))).filter(F.col("n") <= most)
    rows = ranked.select("lang", "order", "bytes").orderBy("lang", "order", "bytes").collect()  # at most `most` windows of each language
    if not rows:
        return None
    lengths = np.array([len(r["bytes"]) for r in rows])
    data = LOWER[np.frombuffer(b"".join(bytes(r["bytes"]).ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)]
    truth = np.searchsorted(languages, [r["lang"] for r in rows])
    network = Network(languages)
    network.train(data, lengths, truth, passes)
    return network


def identify(docs: DataFrame, network: Network | None, keep: list[str]) -> DataFrame:
    """Rows of docs: the columns `keep`, lang_pred and score."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kept = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                names, scores = predict(network, part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("__text")).mapInArrow(tidy(run), f"{kept}lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op6_language_id": op6_language_id}
