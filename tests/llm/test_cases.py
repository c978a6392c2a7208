"""Cases that need a test of their own: texts made to collide, clashing names, long texts, huge numbers, neighbours, recall."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import benchmark, bpe, common, jaccard, langid, licences, linededup, pii, secrets, tokencount, topk

#: Thue-Morse words of 1,024 letters: sums of powers modulo 2^64 can't tell one from its complement.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
OTHER = "".join("ba"[bin(i).count("1") & 1] for i in range(1024))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ------------------------------------------------ the hash


@pytest.mark.parametrize("seed", [1, 2])
def test_hash(seed):
    rng = random.Random(seed)
    words = {MORSE, OTHER, "", "a", "a\0", "\0" * 8, "\0" * 9, MORSE[:8], MORSE[:9], *("".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(3000))}
    data = np.frombuffer(" ".join(sorted(words)).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in sorted(words)]) - 1
    starts = ends - [len(w) for w in sorted(words)]
    got = common.hasher(seed)(data, starts, ends)
    assert len(set(got.tolist())) == len(words)
    for w in sorted(words)[:50]:  # whatever stands around it, in upper case too
        alone = np.frombuffer(f"x{w.upper()}y".encode(), np.uint8)
        assert common.hasher(seed)(alone, np.array([1]), np.array([1 + len(w)]))[0] == got[sorted(words).index(w)]


def test_lines_that_collide_in_sums_of_powers(spark):
    docs = frame(spark, [(1, MORSE), (2, MORSE), (3, OTHER)])
    assert rows(linededup.dedup_lines(docs), "doc_id", "n_dropped") == [(1, 0), (2, 0), (3, 0)]
    assert rows(linededup.dedup_lines(docs, documents=2), "doc_id", "n_dropped") == [(1, 1), (2, 0), (3, 0)]


def test_digests():
    data = np.frombuffer((MORSE + OTHER.upper()).encode(), np.uint8)
    got = linededup.digests(data, np.array([0, 1024]), np.array([1024, 2048])).tolist()
    assert got[0] != got[1] == linededup.digests(np.frombuffer(OTHER.encode(), np.uint8), np.array([0]), np.array([1024])).tolist()[0]


def test_sets_that_collide_in_sums_of_powers(spark):
    got = rows(jaccard.with_components(frame(spark, [(1, MORSE), (2, MORSE.upper()), (3, OTHER)]), 3, 90), "doc_id", "component_id")
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_items_and_templates_that_collide_in_sums_of_powers(spark):
    text = lambda w: " ".join([w, "one", "two", "three", "four", "five"])
    docs = frame(spark, [(1, text(MORSE)), (3, text(OTHER).replace("five", MORSE))])
    items = spark.createDataFrame([(9, " ".join([MORSE] * 2 + ["one", "two", "three"]))], "item_id long, text string")
    assert benchmark.contaminated(docs, items).count() == 0
    template = {"x": " ".join([MORSE, "one", "two", "three", "four"])}
    assert rows(licences.find_licences(docs, template), "doc_id") == [(1,)]


# ------------------------------------------------ names, empty tables


ODD = [(1, None), (2, ""), (None, "word"), (3, "some words and 12 34\n\n"), (3, "some words and 12 34\n\n")]


@pytest.mark.parametrize(
    ("name", "run"),
    [
        ("n_tokens", lambda d, keep: bpe.encode(d, keep)),
        ("ids", lambda d, keep: bpe.encode(d, keep)),
        ("spans", lambda d, keep: pii.scan(d, keep)),
        ("spans", lambda d, keep: secrets.scan(d, keep)),
        ("score", lambda d, keep: langid.identify(d, None, keep)),
        ("n_bytes", lambda d, keep: tokencount.count_tokens(d, keep)),
        ("n_lines", lambda d, keep: linededup.dedup_lines(d)),
    ],
)
def test_clashing_names_and_empty_tables(spark, name, run):
    docs = spark.createDataFrame([(a, b, "mine", 5) for a, b in ODD], f"doc_id long, text string, {name} string, `a b` int")
    got = run(docs, ["doc_id", name, "a b"])
    assert got.columns.count(name) == 1 and len(got.collect()) == len(ODD)
    assert all(r["a b"] == 5 and r[name] != "mine" for r in got.collect())
    assert run(docs.limit(0), ["doc_id", name, "a b"]).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert licences.find_licences(none).count() == 0
    assert benchmark.contaminated(none, items).count() == benchmark.contaminated(frame(spark, ODD), items).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# ------------------------------------------------ long texts


def test_memory_of_pieces_is_bounded(monkeypatch):
    own = bpe.BpeCodec(bpe.parse_ranks(bpe.tokenizer()[0]), bpe.tokenizer()[1])
    monkeypatch.setattr(bpe, "MEMO_CHARACTERS", 1000)
    rng = random.Random(2)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 40, 3000]))) for _ in range(30))
        assert own.decode(own.encode(text)) == text.encode()
        assert sum(len(k) + len(v) for k, v in own.memo.items()) < 30_000 and max(map(len, own.memo)) <= bpe.MEMO_LENGTH


def test_long_texts_are_encoded_by_groups(spark, monkeypatch):
    import hashlib

    raw, pattern = bpe.tokenizer()
    own = bpe.BpeCodec(bpe.parse_ranks(raw), pattern)
    rng = random.Random(3)
    text = "".join(rng.choice(["some ", "wörds", " and", "\n\n", "漢字", " 12", "!?", "x" * 300]) for _ in range(900))
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "GROUP", 7)
    assert [int(x) for group, ids in own.groups(text) for p in group for x in ids[p].split(",")] == whole
    long = text * 500  # over LONG characters
    assert len(long) > bpe.LONG
    r = bpe.encode(frame(spark, [(1, long), (2, text), (3, "")]), ["doc_id"]).collect()
    ids = own.encode(long)
    assert r[0]["ids"] == ids and r[0]["n_tokens"] == len(ids) and r[1]["ids"] == whole and r[2]["ids"] == []
    assert r[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert r[0]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJ." * 260_000, "eyJeyJ." * 150_000, "a: -----BEGIN PRIVATE KEY-----\n" * 33_000, "token " * 170_000, "-----BEGIN PRIVATE KEY-----" + "\n" * 100_000, "-----BEGIN PRIVATE KEY-----\n" + "A: b\n" * 100_000])
def test_secrets_in_linear_time(text):
    began = time.perf_counter()
    secrets.find_secrets(text)
    assert time.perf_counter() - began < 10


def test_a_long_text_with_items_at_both_ends():
    """20 MB between two copies: windows are worked on where items' shingles stand, not over all that lies between."""
    rng = random.Random(4)
    item = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    own = benchmark.Items([5], [" ".join(item)], 1)
    filler = "plain words without end " * 850_000
    hashes, of, *_ = benchmark.word_hashes(pa.array([" ".join(item) + " " + filler + " ".join(item[2:])]), benchmark.NON_WORD)
    places = own.places(benchmark.shingle_hashes(hashes, of, 5, whole=False)[0])
    assert len(places) > 3_000_000
    import tracemalloc

    tracemalloc.start()
    assert own.search(places) == [(0, 1.0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_stretches_give_the_same(monkeypatch):
    rng = random.Random(6)
    draw = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    items = [draw(rng.randrange(8, 30)) for _ in range(20)]
    own = benchmark.Items(list(range(20)), [" ".join(x) for x in items], 20)
    text = " ".join(w for _ in range(60) for w in rng.choice(items)[rng.randrange(3) :] + draw(rng.randrange(20)))
    hashes, of, *_ = benchmark.word_hashes(pa.array([text]), benchmark.NON_WORD)
    places = own.places(benchmark.shingle_hashes(hashes, of, 5, whole=False)[0])
    whole = own.search(places)
    monkeypatch.setattr(benchmark, "STRETCH", 25)
    assert own.search(places) == whole and len(whole) > 10


# ------------------------------------------------ operator 8: the index and its recall


def test_the_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 24)) for _ in range(400)]
    own = benchmark.Items(list(range(400)), texts, 400)
    bits = np.unpackbits(own.prints.view(np.uint8).reshape(400, -1), axis=1)
    flips = rng.integers(0, benchmark.RADIUS + 20, 400)
    for i, n in enumerate(flips.tolist()):
        bits[i, rng.permutation(benchmark.BITS)[:n]] ^= 1
    prints = np.packbits(bits, axis=1).view("<u2").reshape(400, -1)
    row, item = own.retrieve(prints, np.full(400, 20))
    near = np.bitwise_count(prints.view(np.uint64).reshape(400, 1, -1) ^ own.prints[None]).sum(2) <= benchmark.RADIUS
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert (flips <= benchmark.RADIUS).sum() <= len(row) < 400


@pytest.mark.parametrize("common", [1, 2, 6, 50])
def test_recall_of_near_copies(common):
    """Against brute force, items that share passages, copies cut to between 0.8 and 1, beside plain words or other items."""
    rng = random.Random(common)
    draw = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passages = [draw(17) for _ in range(-(-200 // common))]
    items = [passages[i // common] + draw(17) if common > 1 else draw(34) for i in range(200)]
    own = benchmark.Items(list(range(200)), [" ".join(x) for x in items], 200)
    found = true = 0
    for i, x in enumerate(items):
        for cut in range(1, 9):
            core = x[cut:] if i % 2 else x[:-cut]
            around = draw(20) if cut % 2 else items[(i * 7 + 3) % 200]
            hashes, of, *_ = benchmark.word_hashes(pa.array([" ".join(around + core + around)]), benchmark.NON_WORD)
            places = own.places(benchmark.shingle_hashes(hashes, of, 5, whole=False)[0])
            width, weight = 30, own.idf[own.sets[i]]
            if max(weight[np.isin(own.sets[i], places[a : a + width])].sum() for a in range(len(places) - width + 1)) >= 0.8 * weight.sum():
                true += 1
                found += any(j == i for j, _, _ in own.search(places))
    assert true > 500 and found >= 0.99 * true


# ------------------------------------------------ operator 9: a row has no say in another's result


def test_licences_by_document():
    own = licences.Templates(licences.templates())

    def scan(texts):
        words, of, *_ = licences.word_hashes(pa.array(texts), licences.NON_WORD)
        got, at, _ = licences.shingle_hashes(words, of, 5, whole=False)
        return own.search(got, at)

    rng = random.Random(8)
    mit = licences.templates()["MIT-text"].split()
    texts = []
    for extra in (0, 10, 30, 60):
        for _ in range(25):
            cut = rng.randrange(10, len(mit) - 10)
            texts.append(" ".join([*["before"] * rng.randrange(70), *mit[:cut], *(f"z{rng.randrange(10**5)}" for _ in range(extra)), *mit[cut:]]))
    together = scan(texts)
    for i, t in enumerate(texts):
        assert [(n, s) for (_, n), (s, _) in sorted(scan([t]).items())] == [(n, s) for (r, n), (s, _) in sorted(together.items()) if r == i]
    backwards = scan(texts[::-1])
    assert {(len(texts) - 1 - r, n): s for (r, n), (s, _) in backwards.items()} == {k: s for k, (s, _) in together.items()}
    assert sum(own.names[n] == "MIT-text" for _, n in together) == 100


def test_licences_in_stretches(monkeypatch):
    texts = dict(list(licences.templates().items())[:6]) | {"MIT-text": licences.templates()["MIT-text"]}
    own = licences.Templates(texts)
    filler = "words that no licence holds at all "
    text = (filler * 40).join(texts.values())
    words, of, *_ = licences.word_hashes(pa.array([text, text]), licences.NON_WORD)
    got, at, _ = licences.shingle_hashes(words, of, 5, whole=False)
    whole = own.search(got, at)
    monkeypatch.setattr(licences, "STRETCH", 64)
    assert own.search(got, at) == whole and len(whole) == 2 * len(texts)


# ------------------------------------------------ operator 7


def brute_top(ids, whole, k, every=20):
    out = []
    for q in ids:
        if q % every == 0:
            scores = {i: min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))) for i in ids if i != q}
            best = sorted(scores, key=lambda i: (-scores[i], i))[:k]
            out += [(q, n, i, scores[i]) for n, i in enumerate(best, 1)]
    return sorted(out)


def test_huge_components(spark):
    rng = random.Random(1)
    vectors = {i: [rng.choice([0.5, -1.25, 3.0, 1e12, -1e12, 1e308, 7e15]) if i % 3 else rng.random() for _ in range(4)] for i in range(60)}
    import math

    whole = {i: [int(x) * 64 if abs(x) > 1e17 else math.floor(64 * x) for x in v] for i, v in vectors.items()}
    got = rows(topk.top_k(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), 5), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == brute_top(sorted(vectors), whole, 5)


def test_skewed_vectors_are_read_in_part():
    """Scores that few components carry: the answer is brute force's, from under half of the lists."""
    rng = np.random.default_rng(0)
    values = rng.standard_normal((4000, 64)) * np.exp(-np.arange(64) / 2.5)
    ids = np.arange(4000)
    queries = ids[ids % 20 == 0]
    search = topk.Search(queries, values[queries], 20)
    search.size = topk.CANDIDATES - 500  # lists of 500 candidates
    for a in range(0, 4000, 500):
        search.add(ids[a : a + 500], values[a : a + 500])
        search.size = topk.CANDIDATES - 500
    whole = np.floor(values * 64)
    for i, q in enumerate(queries.tolist()):
        scores = whole @ whole[q]
        best = [x for x in np.lexsort((ids, -scores)).tolist() if x != q][:20]
        assert search.best[i].tolist() == best and search.scores[i].tolist() == scores[best].tolist()
    assert np.concatenate(search.read).mean() < 0.5


def test_blocks_and_tiles_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "ASKED", 7)
    monkeypatch.setattr(topk, "TILE", 150)
    rng = np.random.default_rng(5)
    data = [(i % 900, (rng.standard_normal(8) * 0.4).tolist()) for i in range(1000)]  # ids repeat
    got = rows(topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 4), "query_id", "rank", "vec_id", "score")
    assert len(got) == 45 * 4
    for q in range(0, 900, 20):
        own = np.floor(64 * np.array(min(v for i, v in data if i == q))).astype(int)
        scores = sorted(((-int(np.floor(64 * np.array(v)).astype(int) @ own), i) for i, v in data if i != q))[:4]
        assert [(r[2], r[3]) for r in got if r[0] == q] == [(i, -s) for s, i in scores]


# ------------------------------------------------ operator 6


def test_every_byte_is_labelled_once():
    network = langid.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    texts = pa.array(["x", "a b, c!" * 50, "é漢 " * 33, "z" * 63, "z" * 64, "z" * 65, ""])
    data, offsets = common.buffers(texts)
    start, end, of = langid.windows(offsets)
    sums = network.totals(common.LOWER[data], np.maximum(start - langid.CONTEXT, offsets[of]), start, end, np.minimum(end + langid.CONTEXT, offsets[of + 1]))
    size = np.bincount(of, sums.sum(1), len(texts))
    assert size == pytest.approx(np.diff(offsets), rel=1e-4)
    # a window's labels are those of the network run over it and its context
    at = 1 + int(rng.integers(2))
    low, high = max(int(start[at]) - langid.CONTEXT, offsets[of[at]]), min(int(end[at]) + langid.CONTEXT, offsets[of[at] + 1])
    whole, part = common.LOWER[data[low:high]], slice(int(start[at]) - low, int(end[at]) - low)
    states = {}
    for d, piece in (("f", whole[: part.stop]), ("b", whole[part.start :][::-1])):
        states[d] = np.array(network._run(d, piece[:, None], np.ones((len(piece), 1), np.float32), None))[:, 0]
    both = np.concatenate([states["f"][part], states["b"][::-1][: part.stop - part.start]], 1)
    logits = both @ network.p["out"] + network.p["bias"]
    prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert sums[at] == pytest.approx(prob.sum(0), rel=1e-3)


def test_equal_probabilities():
    network = langid.Network(["m", "n", "o"])
    network.p["out"][:] = 0
    names, scores = langid.predict(network, pa.array(["some text", "12 34"]))
    assert names == ["m", "und"] and scores[0] == pytest.approx(1 / 3, abs=1e-4) and scores[1] == 0


def test_every_label_is_learned(spark):
    docs = spark.createDataFrame([(i, f"l{i % 300:03d}", "text of it " * 3) for i in range(1500)], "doc_id long, lang string, text string")
    network = langid.learn(docs, 2, 300, 1)
    assert network.languages == sorted({f"l{i % 300:03d}" for i in range(1500) if zlib.crc32(str(i).encode()) % 4 != 2})


def test_prediction_without_tangents(monkeypatch):
    """Windows are labelled as in training, by exponentials only, which cost a third; large weights overflow to the same limits."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 40).astype(np.uint8)
    for scale in (1, 400):
        network = langid.Network(["a", "b", "c"])
        for k in network.p:
            network.p[k] = network.p[k] * np.float32(scale if k[0] in "xgc" else 1)
        want = network.label(data[None], np.array([40]))[0].sum(0)
        with monkeypatch.context() as m:
            m.setattr(langid.np, "tanh", lambda *_, **__: pytest.fail("tanh"))
            got = network.totals(data, np.array([0]), np.array([0]), np.array([40]), np.array([40]))
        assert np.allclose(got, want, atol=1e-3)
