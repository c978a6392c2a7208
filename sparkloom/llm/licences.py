"""Operator 9: licence texts and notices by MinHash bands over overlapping windows, verified by exact shingle containment.

Templates and texts become words and 5-word shingles. Templates are the notices below and the whole texts in TEXTS. One of up to m
shingles (m a power of two) is looked for in windows of 2 m shingles at steps of m, counted from the beginning of each
document, so every run of m shingles lies in one window and no other document has a say. BANDS bands of one minimum each retrieve a
template when any minimum agrees. A window that holds 0.8 of a template of s > m / 2 different shingles has a resemblance of at least
0.8 s / (2 m + 0.2 s) > 0.19, so one of 48 bands agrees with a probability of 1 - 0.81 ** 48 = 0.99996 at least. What is retrieved is
verified on a sliding run: the share of the template's shingles in the best run of m shingles of the window is at least 0.8.

Defined cases: null and short texts and empty tables hold nothing; very long texts are worked on in overlapping stretches, whole;
repeated rows give repeated results; rows without a doc_id are passed over; other columns are ignored; templates of fewer than
five words take no part. The best run counts, the first of equals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import NON_WORD, _odd, read, shingle_hashes, slices, tidy, word_hashes

WORDS, CONTAINED, BANDS = 5, 0.8, 48
FACTORS = _odd(BANDS, 9)
#: Shingles that are hashed at once, at least; a document's stretches of so many overlap by its widest window.
STRETCH = 1 << 15
#: Whole texts of common licences, one file each, named by its licence. Read by the driver.
TEXTS = Path(__file__).with_name("licence_texts")

# Notices of public licences.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def templates(folder: Path | str = TEXTS) -> dict[str, str]:
    """The notices, and the texts of a folder's .txt files as <name>-text."""
    return NOTICES | {f"{f.stem}-text": f.read_text() for f in sorted(Path(folder).glob("*.txt"))}


def values(shingles: np.ndarray, band: int) -> np.ndarray:
    """The numbers whose minimum is a band's."""
    return ((shingles * FACTORS[band]) >> np.uint64(32)).astype(np.uint32)


def best_run(places: np.ndarray, length: int, width: int) -> tuple[int, int]:
    """The most different elements in `width` places in a row, and the first such run's start; places: each element's place
    in the template, -1 for others."""
    spots = np.flatnonzero(places >= 0)
    order = spots[np.argsort(places[spots], kind="stable")]
    before = np.full(len(order), -1)
    same = places[order[1:]] == places[order[:-1]]
    before[1:][same] = order[:-1][same]
    # an element counts for the runs that begin behind its last place, if that is in reach, and hold this one
    start = np.maximum(before + 1, order - width + 1).clip(0)
    end = np.minimum(order, max(0, length - width)) + 1
    real = start < end
    gain = np.zeros(length + 2, np.int64)
    np.add.at(gain, start[real], 1)
    np.add.at(gain, end[real], -1)
    sums = np.cumsum(gain)
    first = int(sums.argmax())
    return int(sums[first]), first


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        words, rows, _, _, _ = word_hashes(pa.array(list(texts.values()), pa.string()), NON_WORD)
        got, of, _ = shingle_hashes(words, rows, WORDS, whole=False)
        self.sets = [np.unique(got[of == i]) for i in range(len(self.names))]
        self.classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                self.classes.setdefault(1 << (int((of == i).sum()) - 1).bit_length(), []).append(i)
        self.marks = {i: [values(s, b).min() for b in range(BANDS)] for i, s in enumerate(self.sets) if len(s)}

    def verify(self, shingles: np.ndarray, i: int, width: int) -> tuple[float, int]:
        own = self.sets[i]
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        most, first = best_run(np.where(own[at] == shingles, at, -1), len(shingles), width)
        return most / len(own), first

    def stretches(self, rows: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """Groups of (first, end, row): documents, long ones in overlapping parts, that are worked on together."""
        if not self.classes:
            return
        lap = 2 * max(self.classes)
        step = max(STRETCH, lap)  # a multiple of every class
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]).tolist()
        group, size = [], 0
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            for low in range(a, z, step):
                group.append((low, min(z, low + step + lap), int(rows[low])))
                size += group[-1][1] - low
                if size >= STRETCH:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def search(self, shingles: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """For each (row, template) found: containment and the index of the first shingle of its best run."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for group in self.stretches(rows):
            part = np.concatenate([shingles[a:z] for a, z, _ in group])
            sizes = np.array([z - a for a, z, _ in group])
            # for each class, finer ones first: blocks of m shingles by blocks of the class before, and whether the next is the same piece's
            levels, finer, counts = [], 1, sizes
            for m in sorted(self.classes):
                first = np.cumsum(counts) - counts
                counts = -(-sizes // m)
                of = np.repeat(np.arange(len(group)), counts)
                number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                levels.append((m, first[of] + number * (m // finer) if m > 1 else None, of[1:] != of[:-1], of, number))
                finer = m
            hits = {i: np.zeros(len(of), bool) for m, _, _, of, _ in levels for i in self.classes[m]}
            for band in range(BANDS):
                blocks = values(part, band)
                for m, cuts, ends, _, _ in levels:
                    if cuts is not None:
                        blocks = np.minimum.reduceat(blocks, cuts)
                    windows = blocks.copy()
                    np.minimum(blocks[:-1], np.where(ends, blocks[:-1], blocks[1:]), out=windows[:-1])
                    for i in self.classes[m]:
                        hits[i] |= windows == self.marks[i][band]
            for m, _, _, of, number in levels:
                for i in self.classes[m]:
                    for j in np.flatnonzero(hits[i]).tolist():
                        a, z, row = group[of[j]]
                        begin = a + int(number[j]) * m
                        share, at = self.verify(shingles[begin : min(begin + 2 * m, z)], i, m)
                        at += begin
                        if share >= CONTAINED and ((row, i) not in best or (share, -at) > (best[row, i][0], -best[row, i][1])):
                            best[row, i] = (share, at)
        return best


def find_licences(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licence, containment, first_word): the templates that a document holds."""
    rows = docs.select(docs["doc_id"].cast("long").alias("__id"), docs["text"].alias("__text")).filter("__id is not null and __text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(templates() if texts is None else texts)  # a folder of licences: about 130 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(shared.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                words, rows, _, _, _ = word_hashes(part.column("__text"), NON_WORD)
                got, of, at = shingle_hashes(words, rows, WORDS, whole=False)
                first = np.searchsorted(rows, np.arange(part.num_rows))
                ids = part.column("__id").to_pylist()
                out = [(ids[row], own.names[i], share, int(at[spot] - first[row])) for (row, i), (share, spot) in sorted(own.search(got, of).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64()))], ["doc_id", "licence", "containment", "first_word"])

    return rows.mapInArrow(tidy(run), "doc_id long, licence string, containment double, first_word long")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op9_licence_scan": op9_licence_scan}
