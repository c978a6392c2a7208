"""All distances of a test row, met in one task: the same as all pairs by a join, and nothing as large as the pairs is shuffled."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import catalogue
from sparkloom.operators import knn
from sparkloom.sources import sinks

SCHEMA = "txn_id long, type string, amount double, nameOrig string, isFraud int"
ODD = [float("inf"), float("-inf"), float("nan"), None, 0.0, -0.0, 0.1, 0.2, 0.3, 1.1, 2.1, 1e9]


def rows(seed, n, first, ids=None):
    rng = random.Random(seed)
    amount = lambda: rng.choice(ODD) if rng.random() < 0.2 else round(rng.uniform(0, 12), rng.choice([0, 1, 2]))
    return [(first + (i if ids is None else i % ids), rng.choice(["a", "b", "c", None]), amount(), rng.choice(["x", "y", "z", "only", None, "1004"]), rng.choice([0, 1, 2, None])) for i in range(n)]


def key(rows):
    return sorted(repr(tuple(r)) for r in rows)  # nan is nan here


@pytest.mark.parametrize("seed, n, ids, asked", [(1, 150, None, 7), (2, 6, None, 1000), (3, 150, 30, 1000), (4, 0, None, 1000)])
def test_all_pairs_in_a_task(spark, monkeypatch, seed, n, ids, asked):
    monkeypatch.setattr(knn, "ASKED", asked)
    train = spark.createDataFrame(rows(seed, n, 1), SCHEMA)
    test = spark.createDataFrame(rows(seed + 10, 60, 1000, ids), SCHEMA)
    pairs = knn.distances(train, test)
    want = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    assert key(knn.spans(train, test).collect()) == key(want.collect())
    for k in (1, 3, 200):
        assert key(knn.ranked(train, test, k).collect()) == key(knn.nearest(pairs, k, partial=False).collect())
    monkeypatch.setattr(knn, "HELD", 0)
    assert key(knn.spans(train, test).collect()) == key(want.collect())


def test_no_pairs_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(knn, "distances", lambda *_: pytest.fail("pairs are joined"))
    for name in ("knn_distances", "knn_predict_shuffle"):
        plan = sinks.plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"), "simple")
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_work_does_not_grow_with_equal_rows(spark, monkeypatch):
    """All distances are sorted once for equal test rows, not for each; the nearest come without looking at all rows."""
    spent = spark.sparkContext.accumulator(0)

    def counted(run):
        def out(*args):
            spent.add(1)
            return run(*args)

        return out

    monkeypatch.setattr(knn, "_span", counted(knn._span))
    monkeypatch.setattr(knn, "_first", counted(knn._first))
    test = [(i, "ab"[i % 2], float(i % 10), f"p{i % 100}", 0) for i in range(1000)]
    train = [(5000 + i, "ab"[i % 2], i % 50 + 0.25, f"p{i % 60}", i % 2) for i in range(600)]
    train, test = (spark.createDataFrame(x, SCHEMA) for x in (train, test))
    pairs = knn.distances(train, test)
    want = pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    assert key(knn.spans(train, test).collect()) == key(want.collect())
    assert 0 < spent.value <= 10
    assert key(knn.ranked(train, test, 3).collect()) == key(knn.nearest(pairs, 3, partial=False).collect())
    assert spent.value <= 10


def test_rounding_and_runs(monkeypatch):
    """Many rows at once give what one at a time do: amounts of any size, one party with most rows, windows of one row."""
    rng = np.random.default_rng(2)
    for scale, side in ((1.0, 1), (1e3, 6), (1e15, 2), (1e17, 1)):
        monkeypatch.setattr(knn, "SIDE", side)
        monkeypatch.setattr(knn, "PAIRS", 50)
        amount = np.unique(np.round(rng.random(80) * 8, 1) * scale)
        n = len(amount)
        pack = knn.Pack(pa.table({"type": pa.array(rng.choice(["a", "b", "c"], n)), "amount": amount, "cls": pa.array(rng.integers(0, 3, n))}))
        at = np.sort(rng.choice(n, n // 2, replace=False))
        own = knn.Own(pack.code[at], pack.amount[at], pack.cls[at], np.where(at % 2, knn.NO_CLASS, 1), at % 2 == 1, at)
        code, x = rng.choice([0, 1, knn.NO_MATCH], 60).astype(np.int32), np.round(rng.random(60) * 8, 1) * scale
        first, last = np.zeros(60, np.int64), np.where(np.arange(60) % 3, len(at), 0)
        lone = [knn._span(pack, pack.split, own.part(0, 0), t, a)[0] for t, a in zip(code.tolist(), x.tolist(), strict=True)]
        asked = knn.Asked(own, code, x, first, last, [np.array(c) for c in zip(*lone, strict=True)])
        each = [(int(t), float(a), own.part(0, int(b))) for t, a, b in zip(code, x, last, strict=True)]
        got = sorted((i, *r) for row, cols in knn._spans(pack, pack.split, asked) for i, *r in zip(row.tolist(), *(c.tolist() for c in cols), strict=True))
        assert got == [(i, *r) for i, (t, a, o) in enumerate(each) for r in knn._span(pack, pack.split, o, t, a)]
        for k in (1, 3, 40):
            got = sorted((i, r, d, c) for row, cols in knn._firsts(pack, pack.split, asked, k) for i, d, c, r in zip(row.tolist(), *(c.tolist() for c in cols), strict=True))
            assert got == [(i, r, d, knn.NO_CLASS if c is None else c) for i, (t, a, o) in enumerate(each) for d, c, r in knn._first(pack, o, t, a, k)]
