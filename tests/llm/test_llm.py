"""The training-data operators against brute force, public libraries, round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import benchmark, bpe, components, jaccard, langid, licences, linededup, pii, secrets, tokencount, topk

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_tokens string, spans int, lang_pred int, n_lines int, component_id string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "the quick brown fox jumps over"), (4, "é🙂" * 50), (5, "a" * 5000), (5, "a" * 5000)]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(a, b, "x", 1, 2, 3, "y") for a, b in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


def fuzz(n, seed, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_bpe(spark, docs, texts):
    import tiktoken

    raw, pattern = bpe.tokenizer()
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})
    own = bpe.codec(raw, pattern)
    for t in fuzz(500, 1, ["the", " ", "ing", "'s", "\n", "é", "漢", "🙂", "12", "\x85", "　", "!!", "\x1c"]) + ["abcde" * 2000]:
        assert own.encode(t) == other.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    for r in bpe.encode(docs, ["doc_id", "text"]).collect():
        ids = other.encode_ordinary(r["text"])
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = bpe.encode(odd(spark), ["doc_id"]).collect()
    assert len(got) == len(ODD) and [r["n_tokens"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert bpe.encode(odd(spark).limit(0), ["doc_id"]).count() == 0


def test_token_counts(spark, texts, monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path(tokencount.TOKENIZER), "rb") as f:
        own = tokencount.Counter(f.read())
    for t in [x for _, x in texts[:40]] + fuzz(300, 2, ["<|endoftext|>", "don't", " ", "\n", "é", "é", "漢字", "x1y22", "!!", "aaaa"]) + ["b" * 3000]:
        assert own.count(t, 100, 40) == own.plain([t])[0] == own.encoded([t])[0]
    odd_words = fuzz(3000, 3, ["<|endoftext|>", "<|", "|>", "'", "s", "RE", " ", "  ", "\n", "\t", "\0", "\x85", "\u3000", "\u0301", "\u0327", "e", "Σ", "İ", "가", "ᆨ", "9", "."])
    assert own.mark is not None and own.plain(odd_words) == own.encoded(odd_words) and own.plain([]) == []
    monkeypatch.setattr(tokencount, "MEMO", 20)  # too small for a batch: nothing is remembered, nothing is lost
    assert own.plain(odd_words[:300]) == own.encoded(odd_words[:300]) and not own.memo
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        other = tokencount.Counter(f.read())
    assert other.mark is None and other.plain(["a b", " a"]) == other.encoded(["a b", " a"])
    got = {r["doc_id"]: r for r in tokencount.count_tokens(odd(spark), ["doc_id"]).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[1]["over_limit"]) == (0, 0, False)


def test_pii(spark, texts):
    def plain(t):
        out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for t in [x for _, x in texts[:60]] + fuzz(1500, 3, ["a", "0", "12", "255", ".", "@", "-", " ", "+", "(", "4111 1111 1111 1111", "x.y", "%"]):
        assert pii.base_spans(t) == plain(t)
    field = pii.field()
    right = found = true = 0
    for t, labels in pii.generated(80, 77):
        got = set(field.best(t))
        right, found, true = right + len(got & set(labels)), found + len(got), true + len(labels)
    assert right / found > 0.85 and right / true > 0.85
    assert [pii.KINDS[k] for k, *_ in pii.find_pii("call 555-123-4567 or jane (at) example dot com", field)] == ["email", "phone"]
    rows = {r["doc_id"]: r["spans"] for r in pii.scan(odd(spark), ["doc_id"]).collect()}
    assert rows[1] == rows[2] == []


def test_secrets(spark, texts):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])

    for t in [x for _, x in texts] + fuzz(3000, 4, ["password", "token", "apiKey", "ſecret", "toKen", "=", ":", '"', " ", "AKIA", "ABCDEF0123", "0123456789abcdef", "é"]):
        assert [(a, secrets.KINDS.index(k), b) for k, a, b in secrets.find_secrets(t) if k in secrets.KINDS[:3]] == plain(t)
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)
    assert [k for k, *_ in secrets.find_secrets(f"x {good} y")] == ["checked"]
    assert secrets.find_secrets(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y") == []
    assert secrets.scan(odd(spark), ["doc_id"]).count() == len(ODD)


def brute_lines(rows):
    key = lambda s: lower(s.strip(" \t\n\r\x0b\x0c"))
    seen = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and d is not None:
                seen[key(x)].add(d)
    gone = lambda d, x: d is not None and len(seen.get(key(x), ())) >= 3 and max(seen[key(x)]) != d
    return sorted(((d, (t or "").count("\n") + 1, "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in rows), key=repr)


def test_line_dedup(spark, texts):
    line = "The quick brown fox jumps over"
    extra = [(None, line), (9001, f" {line.lower()}\t\nA"), (9002, f"{line}\n{line}"), (9002, line), (9003, f"x\n{line}\n"), (9004, "\n"), (9005, "é" * 20), (9006, "é" * 20 + " \x0b"), (9007, "\t" + "é" * 20), (9008, None)]
    rows = texts + extra
    got = linededup.dedup_lines(odd(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["text"] or "") for r in got), key=repr) == brute_lines(rows)
    tiny = linededup.dedup_lines(odd(spark, rows), filter_bits=1 << 16)
    assert sorted(((r["doc_id"], r["text"] or "") for r in tiny.collect()), key=repr) == [(d, t) for d, _, t in brute_lines(rows)]
    assert linededup.dedup_lines(odd(spark).limit(0)).count() == 0


def brute_groups(rows, k, t):
    sets = []
    for d, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(x or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, o in sets[:i]:
            if s and o and 100 * len(s & o) >= t * len(s | o):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets)


@pytest.mark.parametrize(("k", "t"), [(3, 90), (5, 80)])
def test_jaccard(spark, k, t):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for size in (20, 90):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(110):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows += [(2000 + i, " ".join(common + [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 30]))])) for i in range(80)]
    rows += [(3000, None), (3001, ""), (3002, "One two"), (3003, "one TWO"), (3004, "one")]
    assert sorted(tuple(r) for r in jaccard.with_components(odd(spark, rows), k, t).collect()) == brute_groups(rows, k, t)


def test_jaccard_defined_cases(spark):
    got = {(r[0], r[2]) for r in jaccard.with_components(odd(spark)).collect()}
    assert got == {(i, i) for i in (1, 2, 3, 4, 5)} | {(None, None)}
    assert jaccard.with_components(odd(spark).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(61)} | {(500 + i, 500) for i in range(60)}


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = langid.learn(docs, 64, 8000, 2)
    rows = langid.identify(docs, network, ["doc_id", "lang"]).filter(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.93
    data, lengths = np.array([[97, 98, 99], [100, 101, 0]], np.uint8), np.array([3, 2])
    tiny = langid.Network(["a", "b"], 3)
    tiny.p = {k: v.astype(np.float64) for k, v in tiny.p.items()}
    grad, _ = tiny.gradient(data, lengths, np.array([0, 1]))
    for name, at in (("xf", (97, 1)), ("gb", (0, 2)), ("cf", (1, 1)), ("out", (2, 0))):
        step = []
        for e in (1e-4, -1e-4):
            tiny.p[name][at] += e
            step.append(tiny.gradient(data, lengths, np.array([0, 1]))[1])
            tiny.p[name][at] -= e
        assert grad[name][at] == pytest.approx((step[0] - step[1]) / 2e-4, abs=2e-4)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd(spark), network, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and 0 <= got[4][1] <= 1
    assert langid.learn(docs.limit(0)) is None


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(16) * 0.3).tolist()) for i in range(600)] + [(i, [0.5] * 16) for i in range(600, 640)]
    rows += [(700, None), (720, [None] * 16), (740, [float("nan")] * 16), (760, [float("inf")] * 16), (None, [1.0] * 16), (780, []), (800, [1.0, 2.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    matrix = np.floor(64 * np.array([v for _, v in rows[:640]])).astype(np.int64)
    want = []
    for q in range(0, 640, 20):
        scores = matrix @ matrix[q]
        best = [int(i) for i in np.lexsort((np.arange(640), -scores)) if i != q][:20]
        want += [(q, n, i, int(scores[i])) for n, i in enumerate(best, 1)]
    assert got == sorted(want)


def test_benchmark(spark, docs, texts):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(3)
    planted = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        planted.append((5000 + i, "before it " + " ".join(w) + " and after"))
    words = lambda t: re.findall(r"\w+", lower(t))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    own = {i: (len(words(t)), shingles(words(t))) for i, t in items}
    held = collections.Counter(s for _, x in own.values() for s in x)
    weight = {s: np.log(1 + len(items) / n) for s, n in held.items()}
    want = set()
    for d, t in texts + planted:
        w = words(t)
        for i, (size, s) in own.items():
            if s & shingles(w):
                share = max(sum(weight[x] for x in s & shingles(w[a : a + size])) for a in range(max(1, len(w) - size + 1))) / sum(weight[x] for x in s)
                if share >= 0.8 - 1e-9:
                    want.add((d, i))
    got = {(r[0], r[1]) for r in benchmark.contaminated(odd(spark, texts + planted), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 5
    assert benchmark.contaminated(odd(spark), spark.createDataFrame([(1, None), (2, "two words")], "item_id long, text string")).count() == 0


def test_licences(spark):
    templates = licences.templates()
    rows = [(i, f"some words here.\n{t}\nand other words after it " * (1 + i % 2)) for i, t in enumerate(templates.values())]
    got = {(r[0], r[1]) for r in licences.find_licences(odd(spark, rows)).collect()}
    assert got >= {(i, n) for i, n in enumerate(templates)}
    assert licences.find_licences(odd(spark)).count() == 0
