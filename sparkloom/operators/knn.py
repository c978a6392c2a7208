"""k nearest neighbours by distinct distance, vote and confusion counts.

Rows whose amount is null or not a number take no part, on either side. Distance: type mismatch + |amount difference| + party mismatch, added in
this order; a missing type or party matches none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import mismatch
from sparkloom.plans.iterate import cut

#: Test rows of a block; each is broadcast against all training rows. Training rows of a task, at most about.
TEST_BLOCK, TRAIN_ROWS = 20_000, 50_000
#: Ranges of amounts at most, and training rows of a cell on average; a range is cut into cells of equal width.
RANGES, CELL = 1000, 32
#: Test rows of a cell that go to one task, and cells with more of them that are broadcast at most.
CROWD, CROWDS = 20_000, 100_000
#: Test rows of a task that meets all training rows, and training rows of unequal type or amount that such a task holds at most.
ASKED, HELD = 1000, 8_000_000
#: Rows that such a task works on at once, pairs of a test row with its own party's rows or with near rows, near rows of a test
#: row on each side at first, and rows that may be within rounding of a distance where they are looked through.
TOGETHER, PAIRS, SIDE, CLOSE = 1 << 16, 1 << 20, 6, 64
#: Stands for a missing class, type of a training row, type of a test row.
NO_CLASS, NO_TYPE, NO_MATCH = -(1 << 63), -1, -2


def _real(df: DataFrame) -> DataFrame:
    return df.filter(F.col("amount").isNotNull() & ~F.isnan(F.col("amount").cast("double")))


def _asked(test: DataFrame) -> DataFrame:
    return _real(test).select(F.col("txn_id").alias("id"), F.col("type").alias("t"), F.col("amount").alias("a"), F.col("nameOrig").alias("p"))


def _distance() -> Column:
    return mismatch(F.col("type"), F.col("t")) + F.abs(F.col("amount") - F.col("a")) + mismatch(F.col("nameOrig"), F.col("p"))


def distances(train: DataFrame, test: DataFrame) -> DataFrame:
    """id, dist, cls: the largest class at each distinct distance, of all pairs. Test rows are a stated set, broadcast in blocks.

    Training rows are dealt out first: each makes as many pairs as there are test rows, so few of them are work for a task.
    All distances are shuffled by id; `spans` and `ranked` give what they come to without that.
    """
    blocks = max(1, -(-test.count() // TEST_BLOCK))
    known = _real(train).select("type", "amount", "nameOrig", "isFraud")
    known = known.repartition(max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // TRAIN_ROWS)))
    out = None
    for b in range(blocks):
        asked = _asked(test.filter(F.pmod(F.xxhash64("txn_id"), F.lit(blocks)) == b))
        part = known.join(F.broadcast(asked)).select("id", _distance().alias("dist"), F.col("isFraud").alias("cls"))
        out = part if out is None else out.union(part)
    return out.groupBy("id", "dist").agg(F.max("cls").alias("cls"))


class Pack:
    """Training rows of unequal type or amount, by type, then amount, with the largest class of each; no party."""

    def __init__(self, rows: pa.Table):
        found = rows.column("type").combine_chunks().dictionary_encode()
        self.types = {t: i for i, t in enumerate(found.dictionary.to_pylist())}
        code = found.indices.fill_null(NO_TYPE).to_numpy(zero_copy_only=False).astype(np.int32)
        amount = rows.column("amount").to_numpy() + 0.0
        order = np.lexsort((amount, code))
        self.code, self.amount = code[order], amount[order]
        self.cls = rows.column("cls").combine_chunks().fill_null(NO_CLASS).to_numpy(zero_copy_only=False)[order]

        self._all: tuple[np.ndarray, np.ndarray] | None = None

    def split(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Ascending amounts of the type, and of all others."""
        same = self.code == t
        return self.amount[same], np.sort(self.amount[~same])

    def sides(self, t: int) -> tuple[tuple[np.ndarray, np.ndarray, float], ...]:
        """Ascending amounts of the type, where their rows are and 0; the same of all types, of which those of others count, and 1."""
        if self._all is None:
            order = np.argsort(self.amount, kind="stable").astype(np.int32)
            self._all = self.amount[order], order
        a, b = np.searchsorted(self.code, t), np.searchsorted(self.code, t, "right")
        return (self.amount[a:b], np.arange(a, b, dtype=np.int32), 0.0), (*self._all, 1.0)

    def places(self, code: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """Where the training rows of these types and amounts are."""
        out = np.zeros(len(code), np.int64)
        for t in np.unique(code).tolist():
            a, b = np.searchsorted(self.code, t), np.searchsorted(self.code, t, "right")
            out[code == t] = a + np.searchsorted(self.amount[a:b], amount[code == t])
        return out


def _apart(code: np.ndarray, amount: np.ndarray, t: int, x: float, party: float) -> np.ndarray:
    """Distances as whole numbers of the same order: the bits of doubles that aren't negative, NaN last."""
    return ((code != t) + np.abs(amount - x) + party).view(np.int64)


class Own:
    """Training rows of a party: type, amount, class, the class of other parties' rows of that type and amount, and whether there are none."""

    def __init__(self, code: np.ndarray, amount: np.ndarray, cls: np.ndarray, others: np.ndarray, sole: np.ndarray, places: np.ndarray):
        self.code, self.amount, self.cls, self.others, self.sole, self.places = code, amount, cls, others, sole, places

    def part(self, first: int, last: int) -> Own:
        return Own(*(x[first:last] for x in (self.code, self.amount, self.cls, self.others, self.sole, self.places)))


def _span(pack: Pack, split: Callable, own: Own, t: int, x: float) -> list[tuple]:
    """Number, least and greatest of the distinct distances to all training rows: all are sorted, as of another party; then
    those that only rows of the own party have are taken away, and the own party's added."""
    parts = []
    for amounts, other in zip(split(t), (0.0, 1.0), strict=True):
        d, at = other + np.abs(amounts - x) + 1.0, int(np.searchsorted(amounts, x))
        parts += [d[:at][::-1], d[at:]]
    every = np.concatenate(parts).view(np.int64)
    every.sort(kind="stable")  # of four ascending runs
    gone, lost = np.unique(_apart(own.code, own.amount, t, x, 1.0)[own.sole], return_counts=True)
    had = lambda v: np.searchsorted(every, v, "right") - np.searchsorted(every, v)
    removed = gone[lost == had(gone)]
    exact = np.unique(_apart(own.code, own.amount, t, x, 0.0))
    exact = exact[(had(exact) == 0) | np.isin(exact, removed)]
    n = int(np.count_nonzero(every[1:] != every[:-1])) + (len(every) > 0) - len(removed) + len(exact)
    if not n:
        return []
    low, high, without = 0, len(every), set(removed.tolist())
    while low < high and int(every[low]) in without:
        low = int(np.searchsorted(every, every[low], "right"))
    while low < high and int(every[high - 1]) in without:
        high = int(np.searchsorted(every, every[high - 1]))
    ends = np.array([*every[low:high][:1], *every[low:high][-1:], *exact[:1], *exact[-1:]], np.int64)
    return [(n, *np.array([ends.min(), ends.max()]).view(np.float64).tolist())]


def _first(pack: Pack, own: Own, t: int, x: float, k: int) -> list[tuple]:
    """Distance, class and rank of the k smallest distinct distances to all training rows."""
    every = _apart(pack.code, pack.amount, t, x, 1.0)
    wanted = k + int(own.sole.sum())  # as many distances at most go with rows of no other party
    take = 2 * wanted
    while True:
        low = np.unique(np.partition(every, take - 1)[:take] if take < len(every) else every)
        if len(low) >= wanted or take >= len(every):
            break
        take *= 4
    at = np.flatnonzero(every <= low[min(wanted, len(low)) - 1]) if len(low) else np.empty(0, np.int64)
    dist, cls, keep = every[at], pack.cls[at], np.ones(len(at), bool)
    spot = np.searchsorted(at, own.places)
    there = spot < len(at)
    there[there] = at[spot[there]] == own.places[there]
    cls[spot[there]] = own.others[there]
    keep[spot[there & own.sole]] = False
    dist = np.concatenate([dist[keep], _apart(own.code, own.amount, t, x, 0.0)])
    cls = np.concatenate([cls[keep], own.cls])
    order = np.argsort(dist, kind="stable")
    found, first = np.unique(dist[order], return_index=True)
    best = np.maximum.reduceat(cls[order], first) if len(first) else cls
    return [(d, None if c == NO_CLASS else c, n) for n, (d, c) in enumerate(zip(found[:k].view(np.float64).tolist(), best[:k].tolist(), strict=True), 1)]


def _runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first to before each last, one run after another, and each number's run."""
    size = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


class Asked:
    """Test rows: type, amount, the training rows of their party (from `first` to before `last` in `own`); what goes with them."""

    def __init__(self, own: Own, code: np.ndarray, amount: np.ndarray, first: np.ndarray, last: np.ndarray, base: list[np.ndarray]):
        self.own, self.code, self.amount, self.first, self.last, self.base = own, code, amount, first, last, base

    def take(self, at: np.ndarray) -> Asked:
        return Asked(self.own, self.code[at], self.amount[at], self.first[at], self.last[at], [x[at] for x in self.base])

    def chunks(self, more: int) -> Iterator[np.ndarray]:
        """Runs of test rows that make about PAIRS pairs with their own party's rows and `more` others each."""
        cost = np.cumsum(self.last - self.first + more)
        at = 0
        while at < len(cost):
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
            yield np.arange(at, to)
            at = to


def _held(pack: Pack, t: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many unequal training rows have the distance v, as of another party; -1 where too many are within rounding of it."""
    out = np.zeros(len(v), np.int64)
    for code in np.unique(t).tolist():
        rows = np.flatnonzero(t == code)
        a, d = x[rows], v[rows]
        slack = (np.abs(a) + d) * 2.0**-48
        for amounts, places, other in pack.sides(code):
            at, far = np.searchsorted(amounts, a), d - 1.0 - other
            for side, low, high in ((a - far, np.zeros_like(at), at), (a + far, at, np.full_like(at, len(amounts)))):
                first = np.clip(np.searchsorted(amounts, side - slack), low, high)
                last = np.clip(np.searchsorted(amounts, side + slack, "right"), low, high)
                many = last - first > CLOSE
                spot, of = _runs(first, np.where(many, first, last))
                same = (other + np.abs(amounts[spot] - a[of]) + 1.0 == d[of]) & ((other == 0.0) | (pack.code[places[spot]] != code))
                got = np.bincount(of[same], minlength=len(rows))
                out[rows] = np.where(many | (out[rows] < 0), -1, out[rows] + got)
    return out


def _spans(pack: Pack, split: Callable, asked: Asked) -> Iterator[tuple]:
    """`_span` of many test rows: base has it as of a party without training rows; the own party's are taken away and added."""
    for chunk in asked.chunks(0):
        part = asked.take(chunk)
        own, n = part.own, len(chunk)
        spot, of = _runs(part.first, part.last)
        t, x = part.code[of], part.amount[of]
        exact = (own.code[spot] != t) + np.abs(own.amount[spot] - x)
        apart = exact + 1.0
        sole = own.sole[spot]
        value = np.concatenate([exact, apart[sole]])
        row = np.concatenate([of, of[sole]])
        lone = np.concatenate([np.zeros(len(of), np.int64), np.ones(int(sole.sum()), np.int64)])
        # one line for each test row and value: how often it is an own row's distance, and one that goes
        order = np.lexsort((value, row))
        value, row, lone = value[order], row[order], lone[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        starts = np.flatnonzero(new)
        value, row = value[starts], row[starts]
        lost = np.add.reduceat(lone, starts) if len(starts) else lone
        come = np.diff(np.append(starts, len(lone))) > lost
        odd = ~np.isfinite(part.amount)
        odd[row[~np.isfinite(value)]] = True
        fine = np.flatnonzero(~odd[row])
        had = np.full(len(row), -1, np.int64)
        had[fine] = _held(pack, part.code[row[fine]], part.amount[row[fine]], value[fine])
        odd[row[had < 0]] = True
        gone = (lost > 0) & (lost == had)
        count, least, most = (b.copy() for b in part.base)
        odd[row[gone & ((value == least[row]) | (value == most[row]))]] = True
        # a value counts if others have it or it has come
        change = come & ((had == 0) | gone)
        count = count + np.bincount(row[change], minlength=n) - np.bincount(row[gone], minlength=n)
        np.minimum.at(least, row[come], value[come])
        np.maximum.at(most, row[come], value[come])
        keep = np.flatnonzero(~odd)
        yield chunk[keep], [count[keep].astype(np.int64), least[keep], most[keep]]
        for i in np.flatnonzero(odd).tolist():
            for found in _span(pack, split, own.part(part.first[i], part.last[i]), int(part.code[i]), float(part.amount[i])):
                yield chunk[i : i + 1], [np.array([y]) for y in found]


def _firsts(pack: Pack, split: Callable, asked: Asked, k: int) -> Iterator[tuple]:
    """`_first` of many test rows: the nearest amounts on each side, of its type and of others, as many more as turn out to be
    wanted, until none that is farther can matter."""
    todo, side = np.arange(len(asked.code)), SIDE
    odd = ~np.isfinite(asked.amount)
    for i in np.flatnonzero(odd).tolist():
        found = _first(pack, asked.own.part(asked.first[i], asked.last[i]), int(asked.code[i]), float(asked.amount[i]), k)
        if found:
            d, c, r = zip(*found, strict=True)
            yield np.full(len(d), i), [np.array(d), np.array([NO_CLASS if y is None else y for y in c], np.int64), np.array(r, np.int64)]
    todo = todo[~odd]
    while len(todo):
        again = []
        for chunk in asked.take(todo).chunks(4 * side):
            chunk = todo[chunk]
            part = asked.take(chunk)
            own, n = part.own, len(chunk)
            spot, of = _runs(part.first, part.last)
            rows, dist, cls = [of], [(own.code[spot] != part.code[of]) + np.abs(own.amount[spot] - part.amount[of])], [own.cls[spot]]
            # where a test row's own party has rows, by test row and place
            mine = of * max(1, len(pack.code)) + own.places[spot]
            order = np.argsort(mine)
            mine, at_own = mine[order], spot[order]
            frontier = np.full(n, np.inf)
            bounded = np.zeros(n, bool)
            for code in np.unique(part.code).tolist():
                of_type = np.flatnonzero(part.code == code)
                x = part.amount[of_type]
                for amounts, places, other in pack.sides(code):
                    at = np.searchsorted(amounts, x)
                    first, last = np.maximum(at - side, 0), np.minimum(at + side, len(amounts))
                    for there, end in ((first > 0, first), (last < len(amounts), last - 1)):
                        limit = other + np.abs(amounts[end[there]] - x[there]) + 1.0
                        frontier[of_type[there]] = np.minimum(frontier[of_type[there]], limit)
                        bounded[of_type[there]] = True
                    near, who = _runs(first, last)
                    if other:
                        of_others = pack.code[places[near]] != code
                        near, who = near[of_others], who[of_others]
                    d, place, who = other + np.abs(amounts[near] - x[who]) + 1.0, places[near], of_type[who]
                    c = pack.cls[place]
                    key = who * max(1, len(pack.code)) + place
                    hit = np.searchsorted(mine, key)
                    own_row = np.flatnonzero(hit < len(mine))
                    own_row = own_row[mine[hit[own_row]] == key[own_row]]
                    c[own_row] = own.others[at_own[hit[own_row]]]
                    keep = np.ones(len(c), bool)
                    keep[own_row] = ~own.sole[at_own[hit[own_row]]]
                    rows.append(who[keep])
                    dist.append(d[keep])
                    cls.append(c[keep])
            row, d, c = (np.concatenate(y) for y in (rows, dist, cls))
            order = np.lexsort((d, row))
            row, d, c = row[order], d[order], c[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1])
            starts = np.flatnonzero(new)
            best = np.maximum.reduceat(c, starts) if len(starts) else c
            row, d = row[starts], d[starts]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            # final: k distances nearer than anything not looked at
            ready = ~bounded
            kth = rank == k
            ready[row[kth]] |= d[kth] < frontier[row[kth]]
            keep = (rank <= k) & ready[row]
            yield chunk[row[keep]], [d[keep], best[keep], rank[keep].astype(np.int64)]
            again.append(chunk[~ready])
        todo, side = np.concatenate(again), 4 * side


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by cell and salt, in runs of about TOGETHER rows that never part a cell and salt."""
    parts, held, most = [], 0, TOGETHER
    for batch in batches:
        parts.append(batch)
        held += batch.num_rows
        if held >= most:
            whole = pa.Table.from_batches(parts).combine_chunks()
            starts = _starts(whole)
            if end := int(starts[-1]):
                yield whole.slice(0, end)
            parts = whole.slice(end).to_batches()
            held = whole.num_rows - end
            most = max(TOGETHER, 2 * held)
    if held:
        yield pa.Table.from_batches(parts).combine_chunks()


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a cell and salt begins."""
    cell = rows.column("cell").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    salt = rows.column("salt").to_numpy()
    return np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1])]))


def _codes(pack: Pack, types: pa.ChunkedArray) -> np.ndarray:
    """Numbers of types, NO_TYPE for null and those of no training row."""
    known = pa.array([y for y in pack.types if y is not None], pa.string())
    number = np.array([*(pack.types[y] for y in known.to_pylist()), NO_TYPE], np.int32)
    return number[pc.index_in(types.cast(pa.string()), known).fill_null(len(known)).to_numpy()]


def _whole(train: DataFrame, test: DataFrame, answer: Callable, columns: str, base: bool) -> DataFrame | None:
    """id and what `answer` makes of all the training rows for each test row, or None if these are too many for a task.

    Test rows are dealt out by party, together with that party's training rows; every task holds all unequal types and
    amounts. So pairs are made, and go, where they are used, and only rows are shuffled. Ids must not repeat.
    base: what `_span` gives for a party without training rows goes with each test row; it is found once for equal ones.
    """
    spark = train.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _real(train).groupBy("type", F.col("amount").cast("double").alias("amount"), "nameOrig").agg(F.max("isFraud").cast("long").alias("cls"))
    same = Window.partitionBy("type", "amount")
    rows = rows.withColumn("nth", F.row_number().over(same.orderBy(F.desc("cls"), "nameOrig")))
    rows = cut(rows.withColumn("top", F.max(F.when(F.col("nth") == 1, F.col("cls"))).over(same)).withColumn("next", F.max(F.when(F.col("nth") == 2, F.col("cls"))).over(same)).withColumn("sole", F.max("nth").over(same) == 1))
    unequal = rows.filter("nth = 1")
    if unequal.count() > HELD:
        return None
    shared = spark.sparkContext.broadcast(Pack(unequal.select("type", "amount", "cls").toArrow()))
    # a test row without a party has no training rows of its own and may go anywhere
    asking = _real(test).select(F.coalesce("nameOrig", F.col("txn_id").cast("string")).alias("cell"), F.lit(True).alias("asks"), F.col("txn_id").alias("id"), F.col("type"), F.col("amount").cast("double").alias("amount"), F.col("nameOrig").alias("party"))
    asking = cut(asking)
    known = ["n", "least", "most"] if base else []
    if base:
        kinds = cut(asking.select("type", "amount").distinct())

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack = shared.value
            split = lru_cache(4)(pack.split)
            none = _own(pack, pa.table({"type": pa.array([], pa.string()), "amount": pa.array([], pa.float64()), "cls": pa.array([], pa.int64()), "others": pa.array([], pa.int64()), "sole": pa.array([], pa.bool_())}))
            for batch in batches:
                code = _asked_codes(pack, pa.chunked_array([batch.column("type")]))
                with np.errstate(invalid="ignore"):
                    found = [(i, *x) for i, (t, a) in enumerate(zip(code.tolist(), (batch.column("amount").to_numpy() + 0.0).tolist(), strict=True)) for x in _span(pack, split, none, t, a)]
                if found:
                    i, n, low, high = zip(*found, strict=True)
                    own = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([own.column("type"), own.column("amount"), pa.array(n, pa.int64()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], ["type", "amount", *known])

        # a stated number: each of these few rows is met by all training rows
        dealt = kinds.repartition(max(least, -(-kinds.count() // ASKED)), "amount").sortWithinPartitions("type")
        found = cut(dealt.mapInArrow(alike, "type string, amount double, n long, least double, most double")).withColumnRenamed("type", "t").withColumnRenamed("amount", "a")
        asking = cut(asking.join(found, F.col("type").eqNullSafe(F.col("t")) & (F.col("amount") == F.col("a"))).drop("t", "a"))
    met = rows.filter("nameOrig is not null").select(F.col("nameOrig").alias("cell"), F.lit(False).alias("asks"), "type", "amount", F.col("nameOrig").alias("party"), "cls", F.when(F.col("nth") == 1, F.col("next")).otherwise(F.col("top")).alias("others"), "sole")
    asking, met = _salted(asking, met, ASKED)
    parts = max(least, -(-asking.count() // (TOGETHER if base else 8 * ASKED)))
    names = ["cell", "salt", "asks", "id", "type", "amount", "party", "cls", "others", "sole", *known]
    both = met.unionByName(asking, allowMissingColumns=True).select(names).repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = shared.value
        split = lru_cache(4)(pack.split)
        for table in _meet(batches):
            starts = _starts(table)
            asks = table.column("asks").to_numpy()
            before = np.concatenate([[0], np.cumsum(~asks)])  # training rows before a row
            at = np.flatnonzero(asks)
            group = starts[np.searchsorted(starts, at, "right") - 1]
            party = table.column("party").is_valid().to_numpy()[at]
            own = table.filter(pa.array(~asks))
            last = before[at]
            asked = Asked(_own(pack, own), _asked_codes(pack, table.column("type").take(pa.array(at))), table.column("amount").to_numpy()[at] + 0.0, np.where(party, before[group], last), last, [table.column(c).take(pa.array(at)).to_numpy() for c in known])
            ids = table.column("id").take(pa.array(at)).combine_chunks()
            with np.errstate(invalid="ignore"):
                for row, found in answer(pack, split, asked):
                    arrays = [pa.array(x, type=f.type, mask=x == NO_CLASS if f.name == "cls" else None) for x, f in zip(found, list(schema)[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *arrays], schema=schema)

    kind = test.schema["txn_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"id {kind}, {columns}")
    schema = empty.toArrow().schema
    return both.mapInArrow(run, empty.schema)


def _asked_codes(pack: Pack, types: pa.ChunkedArray) -> np.ndarray:
    code = _codes(pack, types)
    return np.where(code == NO_TYPE, NO_MATCH, code)


def _own(pack: Pack, rows: pa.Table) -> Own:
    code, amount = _codes(pack, rows.column("type")), rows.column("amount").to_numpy() + 0.0
    cls, others = (rows.column(c).fill_null(NO_CLASS).to_numpy() for c in ("cls", "others"))
    return Own(code, amount, cls, others, rows.column("sole").to_numpy().astype(bool), pack.places(code, amount))


def _once(test: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id occurs once, and the others if there are any: their distances count together."""
    often = cut(test.groupBy(F.col("txn_id").alias("of")).count().filter("count > 1").select("of"))
    if often.isEmpty():
        return test, None
    same = F.col("txn_id").eqNullSafe(F.col("of"))
    return test.join(often, same, "left_anti"), test.join(often, same, "left_semi")


def spans(train: DataFrame, test: DataFrame) -> DataFrame:
    """id, n, least, most: number, least and greatest of each test row's distinct distances to all training rows."""
    once, often = _once(test)
    out = _whole(train, once, _spans, "n long, least double, most double", base=True)
    plain = test if out is None else often
    if plain is not None:
        slow = distances(train, plain).groupBy("id").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
        out = slow if out is None else out.unionByName(slow)
    return out


def ranked(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """id, dist, cls, rank of the k smallest distinct distances, out of all training rows met in one task."""
    once, often = _once(test)
    out = _whole(train, once, lambda pack, split, asked: _firsts(pack, split, asked, k), "dist double, cls long, rank long", base=False)
    plain = test if out is None else often
    if out is not None:
        out = out.withColumn("cls", F.col("cls").cast(train.schema["isFraud"].dataType))
    if plain is not None:
        slow = nearest(distances(train, plain), k, partial=False)
        out = slow if out is None else out.unionByName(slow)
    return out


class Grid:
    """Cells of amounts, numbered in their order: ranges of like numbers of training rows, each cut into cells of equal width."""

    def __init__(self, train: DataFrame):
        amounts = _real(train).select(F.col("amount").cast("double").alias("amount"))
        parts = [i / RANGES for i in range(RANGES + 1)]
        cuts, self.rows = amounts.agg(F.percentile_approx("amount", parts, 100 * RANGES), F.count("*")).first()
        self.cuts = sorted(set(cuts or []))  # at most RANGES + 1 numbers
        self.ranges = max(1, len(self.cuts) - 1)
        self.fine = max(1, -(-self.rows // (self.ranges * CELL)))
        self.cells = self.ranges * self.fine

    def number(self, df: DataFrame, amount: str) -> DataFrame:
        """df with `cell`; amounts beyond the training rows' are in the first or last cell."""
        if len(self.cuts) < 2:
            return df.withColumn("cell", F.lit(0).cast("long"))
        inner = [float("-inf"), *self.cuts[1:-1], float("inf")]
        found = Bucketizer(splits=inner, inputCol="__amount", outputCol="__range", handleInvalid="keep").transform(df.withColumn("__amount", F.col(amount).cast("double")))
        at = F.col("__range").cast("int")
        low, high = (F.element_at(F.lit(x), at + 1) for x in (self.cuts[:-1], self.cuts[1:]))
        part = F.floor((F.col("__amount") - low) / (high - low) * self.fine)
        return found.withColumn("cell", at.cast("long") * self.fine + F.greatest(F.lit(0), F.least(F.lit(self.fine - 1), part))).drop("__amount", "__range")

    def edges(self, df: DataFrame) -> DataFrame:
        """df with `gap`: what is in no cell from `first` to `last` differs from `a` by more than this. Edges are drawn in by
        a share of 1e-9, so that a rounded cell number makes no difference."""
        if len(self.cuts) < 2:
            return df.withColumn("gap", F.lit(float("inf")))

        def edge(cell: Column) -> Column:
            at = F.floor(cell / self.fine).cast("int")
            low, high = (F.element_at(F.lit(x), at + 1) for x in (self.cuts[:-1], self.cuts[1:]))
            return low + (high - low) * (cell % self.fine) / self.fine

        slack = 1e-9 * max(abs(self.cuts[0]), abs(self.cuts[-1]), 1.0)
        below = F.when(F.col("first") <= 0, F.lit(float("inf"))).otherwise(F.col("a") - edge(F.greatest(F.col("first"), F.lit(0))) - slack)
        above = F.when(F.col("last") >= self.cells - 1, F.lit(float("inf"))).otherwise(edge(F.least(F.col("last"), F.lit(self.cells - 2)) + 1) - F.col("a") - slack)
        return df.withColumn("gap", F.least(below, above))


def _near(dists: DataFrame, k: int, *by: str) -> DataFrame:
    """The rows of each id, within `by`, with its k smallest distinct distances."""
    return dists.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by, "id").orderBy("dist"))).filter(F.col("rank") <= k).drop("rank")


def _best(dists: DataFrame, k: int) -> DataFrame:
    """The k smallest distinct distances of each id, with the largest class at each."""
    grouped = dists.groupBy("id", "dist").agg(F.max("cls").alias("cls"))
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist")).cast("long")).filter(F.col("rank") <= k)


def _known(train: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Training rows by cell: all that differ, and of each type and amount the best classes of two parties.

    A test row of another party than these needs no more of them: equal amounts, however many, are two rows. For its own
    party it looks into the first table.
    """
    rows = _real(train).groupBy("type", "amount", "nameOrig").agg(F.max("isFraud").alias("isFraud"))
    rows = cut(grid.number(rows, "amount"))
    order = Window.partitionBy("type", "amount").orderBy(F.desc("isFraud"), "nameOrig")
    return rows, cut(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2).drop("n"))


def _salted(spread: DataFrame, few: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with `salt`: a cell of many test rows is dealt out to several tasks, its few training rows to each."""
    crowded = spread.groupBy("cell").count().filter(F.col("count") > crowd).select(F.col("cell").alias("of"), F.ceil(F.col("count") / crowd).cast("int").alias("salts"))
    crowded = cut(crowded)
    if crowded.count() <= CROWDS:
        crowded = F.broadcast(crowded)
    asking = spread.join(crowded, F.col("cell") == F.col("of"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int"))
    met = few.join(crowded, F.col("cell") == F.col("of"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return asking.drop("of", "salts"), met.drop("of", "salts")


def _dealt(spread: DataFrame, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides salted. The test rows come by cell and salt, so that what a task joins it can also cut to k before the next
    shuffle."""
    asking, met = _salted(spread, few, CROWD)
    # a stated number: these rows are few bytes, but each makes many pairs
    parts = max(int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spread.count() // CROWD))
    return asking.repartition(parts, "cell", "salt"), met


def nearest_cells(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """id, dist, cls, rank of the k smallest distinct distances, by equality joins on cells of amounts.

    A test row meets the training rows of its own cell and those next to it. Its answer is final if the k-th distance is smaller
    than what any other cell's row can have; else it is asked again, of all cells within its k-th distance, or of four times
    as many on each side where it has met fewer than k distances. Each cell's rows are cut to k before they are shuffled by id.
    """
    grid = Grid(train)
    every, few = _known(train, grid)
    asked = cut(grid.number(_asked(test), "a"))
    pair = ["id", _distance().alias("dist"), F.col("isFraud").alias("cls")]
    done, reach = None, 1
    todo = grid.edges(asked.withColumn("first", F.col("cell") - reach).withColumn("last", F.col("cell") + reach))
    while True:
        spread = todo.withColumn("cell", F.explode(F.sequence(F.greatest(F.col("first"), F.lit(0).cast("long")), F.least(F.col("last"), F.lit(grid.cells - 1).cast("long")))))
        spread = spread.select("cell", "id", "t", "a", "p")
        own = every.withColumnRenamed("cell", "c").join(spread, (F.col("c") == F.col("cell")) & (F.col("nameOrig") == F.col("p")))
        asking, met = _dealt(spread, few)
        near = _near(asking.join(met, ["cell", "salt"]).select("cell", "salt", *pair), k, "cell", "salt")
        found = cut(_best(near.select("id", "dist", "cls").unionByName(own.select(*pair)), k))
        bound = found.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("n"), F.max("dist").alias("most"))
        judged = cut(todo.join(bound, F.col("id") == F.col("of"), "left").drop("of"))
        full = F.coalesce(F.col("n"), F.lit(0)) >= k
        final = (full & (F.col("most") < F.col("gap"))) | (F.col("gap") == float("inf"))
        ready = found.join(judged.filter(final).select(F.col("id").alias("of")), F.col("id") == F.col("of"), "left_semi")
        done = ready if done is None else done.union(ready)
        rest = judged.filter(~final)
        if rest.isEmpty():
            return done.select("id", "dist", "cls", "rank")
        reach *= 4
        # of the cells that hold amounts within the k-th distance
        near = grid.number(grid.number(rest.drop("cell").withColumn("low", F.col("a") - F.col("most")).withColumn("high", F.col("a") + F.col("most")), "low").withColumnRenamed("cell", "low_cell"), "high").withColumnRenamed("cell", "high_cell")
        own = grid.number(near, "a")
        full = F.coalesce(F.col("n"), F.lit(0)) >= k
        own = own.withColumn("first", F.when(full, F.least("low_cell", "first") - 1).otherwise(F.col("cell") - reach)).withColumn("last", F.when(full, F.greatest("high_cell", "last") + 1).otherwise(F.col("cell") + reach))
        todo = cut(grid.edges(own.drop("low", "high", "low_cell", "high_cell", "n", "most", "gap")))


def nearest(dists: DataFrame, k: int = 3, partial: bool = True) -> DataFrame:
    """id, dist, cls, rank of the k smallest distinct distances. partial: cut to k before the shuffle (a window's group
    limit); else all distances of an id are ranked after it."""
    w = Window.partitionBy("id").orderBy("dist")
    rank = F.row_number().over(w)
    ranked = dists.select("id", "dist", "cls", rank.cast("long").alias("rank"))
    if partial:
        return ranked.filter(F.col("rank") <= k)
    # a second function of the window keeps the limit from being pushed below it
    return dists.select("id", "dist", "cls", rank.cast("long").alias("rank"), F.count("*").over(Window.partitionBy("id")).alias("all")).filter(F.col("rank") <= k).drop("all")


def vote(neighbours: DataFrame) -> DataFrame:
    """id, prediction: the most frequent class, the lower of equals."""
    counted = neighbours.groupBy("id", "cls").agg(F.count("*").alias("votes"))
    return counted.groupBy("id").agg(F.max(F.struct(F.col("votes"), (-F.col("cls")).alias("low")))["low"].alias("low")).select("id", (-F.col("low")).alias("prediction"))


def knn(train: DataFrame, test: DataFrame, k: int = 3, strategy: str = "topk") -> DataFrame:
    """id, prediction. `topk` joins near cells of amounts and cuts to k before the shuffle; `shuffle` ranks all distances
    of a test row in the task that it is shuffled to."""
    if strategy == "topk":
        return vote(nearest_cells(train, test, k))
    return vote(ranked(train, test, k))


def labelled(predictions: DataFrame, test: DataFrame) -> DataFrame:
    """The test row of each prediction, beside it."""
    return predictions.join(test, F.col("id") == F.col("txn_id")).select("txn_id", "type", "amount", "nameOrig", "isFraud", "prediction")


def confusion(rows: DataFrame, label: str = "isFraud", prediction: str = "prediction") -> DataFrame:
    one = lambda a, b: F.coalesce(F.sum(F.when((F.col(label) == a) & (F.col(prediction) == b), 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(0, 0).alias("tn"), one(1, 0).alias("fn"))
