"""Operator 5: secrets by an Aho-Corasick keyword prefilter, anchored expressions near hits, and embedded checksums.

One automaton pass over a text (ASCII letters lower-cased) finds where a keyword stands; only there is the rule's
expression matched, anchored at the keyword. Rules with an embedded checksum or structure (tokens that end in a base-62
CRC-32, signed web tokens, key blocks) then keep only what validates. Runs of hexadecimal digits have no keyword; they are
matched where a run of that length can begin.

Base spans (assign, access, hex) are as a left-to-right, non-overlapping search would give per kind; a match that fails its
length is dropped without another try. Further kinds are added, never taken away. A signed token begins where a run of token
characters does, and a block's header lines hold no dashes in a row, so that no hit reads what another has read and failed on:
the time is in proportion to the text, also where keywords follow each other without end.

Null and empty texts have no spans, an empty table gives no rows; very long texts are scanned whole; repeated rows are scanned each by
itself. Equal starts: in the order of KINDS. Other columns pass if kept; one named spans is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, slices, tidy

# The three base rules, and public formats of tokens.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f][0-9a-f]{31,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
BLOCK = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z0-9-]*: (?:(?!-----)[^\n])*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "signed": ("eyj",),
    "block": ("-----begin ",),
}
KINDS = ("assign", "access", "hex", "checked", "signed", "block")
BASE = 3
LEAST = {"assign": 8, "access": 16, "hex": 32}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


AUTOMATON = _automaton()


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(width, "0")


def checksum_ok(body: str, tail: str) -> bool:
    return base62(zlib.crc32(body.encode()), 6) == tail


def _json(part: str) -> dict | None:
    try:
        got = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _key(name: str, headers: str, body: str) -> bool:
    """Whether a block's body begins as its header says: OpenSSH's magic, whole cipher blocks if encrypted, else DER."""
    body = "".join(body.split())
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except (ValueError, binascii.Error):
        return False
    if name == "OPENSSH PRIVATE KEY" and raw.startswith(b"openssh-key-v1\0"):
        return True
    if re.search(r"^\s*Proc-Type: 4,ENCRYPTED\s*$", headers, re.M):
        return len(raw) >= 16 and len(raw) % 8 == 0
    return raw[:1] == b"\x30"


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as in KINDS."""
    if not text:
        return []
    # ASCII only: other letters may change their length, and must not match
    lower = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)
    for end, (kind, length) in AUTOMATON.iter(lower):
        at = end - length + 1
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= LEAST[kind]:
                    out.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST[kind]:
                    out.append((at, 1, m.end()))
        elif kind == "checked":
            if (m := CHECKED.match(text, at)) and checksum_ok(m[1], m[2]):
                free[kind] = m.end()
                out.append((at, 3, m.end()))
        elif kind == "signed":
            if (m := SIGNED.match(text, at)) and "alg" in (_json(m[1]) or ()) and _json(m[2]) is not None:
                free[kind] = m.end()
                out.append((at, 4, m.end()))
        elif (m := BLOCK.match(text, at)) and _key(m[1], m[2], m[3]):
            free[kind] = m.end()
            out.append((at, 5, m.end()))
    out.extend((m.start(), 2, m.end()) for m in HEX.finditer(text))
    out.sort()
    return [(KINDS[k], a, b) for a, k, b in out]


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of docs: the columns `keep` and spans, an array of (kind, start, end), by start, then kind."""
    keep = [c for c in keep if c != "spans"]
    kept = "".join(f"`{c}` {t}, " for c, t in docs.select(*[f"`{c}`" for c in keep]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "__text"):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(found, kind)], [*keep, "spans"])

    return docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("__text")).mapInArrow(tidy(run), f"{kept}spans array<struct<kind string, start long, end long>>")


def digest_columns(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """doc_id, the number of each base kind, base_sha256 and the joined spans, from the operator's spans."""
    from pyspark.sql import functions as F

    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = lambda k: F.filter("spans", lambda s: s["kind"] == k if isinstance(k, str) else s["kind"].isin(*k))
    base_only = F.filter("spans", lambda s: s["base"]) if "base" in spans.schema["spans"].dataType.elementType.names else own(base)
    counted = (lambda k: F.filter("spans", lambda s: (s["kind"] == k) & s["base"])) if "base" in spans.schema["spans"].dataType.elementType.names else own
    return spans.select("doc_id", *[F.size(counted(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(joined(base_only), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan(read(spark, sf_dir, "documents"), ["doc_id"]), KINDS[:BASE])


QUERIES: dict[str, Callable] = {"op5_secret_scan": op5_secret_scan}
