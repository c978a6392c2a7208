"""Operator 8 where items share passages: weights of the whole benchmark in every block, near copies against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from sparkloom.llm import benchmark


def shingles(text):
    w = re.findall(r"\w+", text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    own = {i: (len(shingles(t)), set(shingles(t))) for i, t in items}
    held = collections.Counter(s for _, x in own.values() for s in x)
    weight = {s: np.log(1 + len(items) / n) for s, n in held.items()}
    out = {}
    for d, t in docs:
        sh = shingles(t)
        for i, (size, s) in own.items():
            shares = [sum(weight[x] for x in s & set(sh[a : a + size])) / sum(weight[x] for x in s) for a in range(max(1, len(sh) - size + 1))]
            if max(shares) >= 0.8 - 1e-9:
                out[d, i] = (round(max(shares), 9), int(np.argmax(np.round(shares, 9))))
    return out


def cases(n, common, seed=5):
    """Items of a passage that `common` items share and words of their own; documents with near copies of them."""
    rng = random.Random(seed)
    draw = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passages = [draw(17) for _ in range(-(-n // common))]
    items = [(i, " ".join(passages[i // common] + draw(17))) for i in range(n)]
    docs = []
    for i, t in items:
        w = t.split()
        cut = rng.randrange(1, 9)
        docs.append((1000 + i, " ".join(draw(9) + (w[cut:] if i % 2 else w[:-cut]) + draw(12))))
    return docs, items


def found(spark, docs, items):
    rows = benchmark.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["first_word"]) for r in rows}


def test_blocks_weigh_alike(spark, monkeypatch):
    docs, items = cases(60, 6)
    whole = found(spark, docs, items)
    monkeypatch.setattr(benchmark, "ITEMS", 13)
    assert found(spark, docs, items) == whole and 10 < len(whole) < 60


def test_near_copies_of_repeated_items(spark):
    """Exactly 0.8 of items that 50 of 100 repeat, beside words that no item holds."""
    rng = random.Random(7)
    draw = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passages = [draw(34), draw(34)]
    items = [(i, " ".join(passages[i % 2])) for i in range(100)]
    docs = [(1000 + i, " ".join(draw(9) + passages[i % 2][6:] + draw(12))) for i in range(40)]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and len(got) == 40 * 50


def test_search():
    """Texts of few different words, so that shingles repeat, against brute force."""
    rng = random.Random(9)
    words = lambda a, b: " ".join(rng.choice("abc") for _ in range(rng.randrange(a, b)))
    items = [(i, words(5, 30)) for i in range(30)]
    docs = [(i, words(3, 120)) for i in range(80)]
    own = benchmark.Items([i for i, _ in items], [t for _, t in items], len(items))
    got = {}
    for d, t in docs:
        hashes, rows, *_ = benchmark.word_hashes(pa.array([t], pa.string()), benchmark.NON_WORD)
        places = own.places(benchmark.shingle_hashes(hashes, rows, benchmark.WORDS, whole=False)[0])
        got |= {(d, i): (round(s, 9), at) for i, s, at in own.search(places)}
    assert got == brute(docs, items) and len(got) > 20
