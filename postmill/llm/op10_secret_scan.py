"""Secret scans: fixed patterns, and strings that a BPE vocabulary can only spell in very short pieces.

Base kinds (fixed values of the contract): assign, access, hex. The method's kind, `token`, takes maximal
runs of [A-Za-z0-9+/_=-], less the base spans in them, of MIN_RUN characters and more that mix digits with letters
(or change case often), leaves out known digests (hex of a standard length) and UUIDs, and reports those
with at most MAX_RATIO characters per token of a tiktoken vocabulary: trained merges cover words, not
random strings. What is above that ratio is judged again in its parts between / and =, and those between _ and -,
each of MIN_RUN and more, so words joined to a secret do not hide it. A hex span inside a longer random word is
reported with that whole word. Not found: a secret that its own separators cut into parts under MIN_RUN, behind words.

Work is on UTF-8 bytes, a block of documents at a time; spans are in code points.

Defined cases: a null or empty text has no spans and the digest of the empty string. Repeated rows each
keep their row. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postmill.llm.blocks import Block, blocks
from postmill.llm.common import documents, narrow, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed values of the contract, and the order of kinds at one start.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "token")
MIN_HEX, MIN_ACCESS, MIN_VALUE = 24, 20, 6
#: The method's own.
MIN_RUN, MAX_RATIO = 20, 2.0
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
#: Parts of a run, from coarse to fine.
PARTS = (re.compile(rb"[^/=]+"), re.compile(rb"[^/=_-]+"))
UUID = re.compile(rb"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile(rb"[0-9a-f]+|[0-9A-F]+")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX_CHARS, RUN_CHARS = _table(_DIGITS + "abcdef"), _table(_DIGITS + _UPPER + _LOWER + "+/_=-")


@lru_cache(2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _runs(b: Block, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each maximal run of the table's bytes, inside a document, of `least` and more."""
    on = table[b.data]
    n = len(on)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = on[:-1], on[1:]
    inner = b.off[(b.off > 0) & (b.off < n)]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    keep = end - start >= least
    start, end = start[keep], end[keep]
    return np.searchsorted(b.off, start, "right") - 1, start, end


def _random(s: bytes, vocabulary: str) -> bool:
    """Whether the vocabulary spells the string in very short pieces and it is no known digest or identifier."""
    digits = sum(48 <= c < 58 for c in s)
    letters = sum(65 <= c < 91 or 97 <= c < 123 for c in s)
    flips = sum((97 <= a < 123) != (97 <= c < 123) for a, c in zip(s, s[1:], strict=False) if (a | 32) >= 97 and (c | 32) >= 97)
    if not letters or not (digits >= 2 or flips >= 6):
        return False
    if UUID.fullmatch(s) or (HEX_ONLY.fullmatch(s) and len(s) in DIGEST_LENGTHS):
        return False
    return len(s) <= MAX_RATIO * len(_encoding(vocabulary).encode_ordinary(s.decode()))


def _hidden(data: bytes, s: int, e: int, base: list[tuple[int, int, int]], vocabulary: str) -> list[tuple[int, int]]:
    """Start and end of the random strings in a run: its words around hex spans, its parts outside base spans, and their parts."""
    out: list[tuple[int, int]] = []
    cuts = [(x, y) for x, k, y in base]
    for x, k, y in base:
        if k == 2:
            for m in PARTS[1].finditer(data, s, e):
                a, b = m.span()
                alone = all(q == 2 or not (v < b and a < w) for v, q, w in base)
                if a <= x and y <= b and y - x < b - a and alone and (a, b) not in out and _random(m[0], vocabulary):
                    out.append((a, b))
    open_parts, at = [], s
    for x, y in sorted(cuts + out):
        open_parts.append((at, x))
        at = max(at, y)
    open_parts.append((at, e))
    for k in range(len(PARTS) + 1):
        held = []
        for a, b in open_parts:
            if b - a >= MIN_RUN:
                if _random(data[a:b], vocabulary):
                    out.append((a, b))
                elif k < len(PARTS):
                    held += [m.span() for m in PARTS[k].finditer(data, a, b)]
        open_parts = held
    return out


def find(texts: pa.Array, vocabulary: str = VOCABULARY) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end), sorted; kind: an index in KINDS."""
    out: list[list[tuple[int, int, int]]] = []
    for b in blocks(texts):
        found: dict[int, list[tuple[int, int, int]]] = {}
        for d, s, e in zip(*(x.tolist() for x in _runs(b, HEX_CHARS, MIN_HEX)), strict=True):
            found.setdefault(d, []).append((s, 2, e))
        whole = b.data.tobytes()
        off = b.off.tolist()
        low = whole.lower()
        near = {d for hint in ASSIGN_HINTS for d in _having(low, hint, b.off)}
        for d in near:
            for m in ASSIGN.finditer(whole, off[d], off[d + 1]):
                if m.end(2) - m.start(2) >= MIN_VALUE:
                    found.setdefault(d, []).append((m.start(), 0, m.end()))
        for d in _having(whole, b"AKIA", b.off):
            for m in ACCESS.finditer(whole, off[d], off[d + 1]):
                if m.end() - m.start() >= MIN_ACCESS:
                    found.setdefault(d, []).append((m.start(), 1, m.end()))
        beside = _Overlapping(found).of
        for d, s, e in zip(*(x.tolist() for x in _runs(b, RUN_CHARS, MIN_RUN)), strict=True):
            base = beside(d, s, e)
            for x, y in _hidden(whole, s, e, base, vocabulary):
                found.setdefault(d, []).append((x, 3, y))
        out += [[] for _ in range(b.n)]
        for d, spans in found.items():
            text = whole[off[d] : off[d + 1]]
            points = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            at = np.concatenate([[0], np.cumsum(points)]).tolist()
            out[b.first + d] = sorted((at[s - off[d]], k, at[e - off[d]]) for s, k, e in spans)
    return out


class _Overlapping:
    """Base spans by document, sorted once, for looking up those that overlap a run."""

    def __init__(self, found: dict[int, list[tuple[int, int, int]]]):
        self.spans, self.starts, self.ends = {}, {}, {}
        for d, spans in found.items():
            self.spans[d] = sorted(spans)
            self.starts[d] = [s for s, _, _ in self.spans[d]]
            self.ends[d] = list(accumulate((e for _, _, e in self.spans[d]), max))  # of all up to here, so that it grows

    def of(self, d: int, start: int, end: int) -> list[tuple[int, int, int]]:
        if d not in self.spans:
            return []
        first, last = bisect_right(self.ends[d], start), bisect_left(self.starts[d], end)
        return [p for p in self.spans[d][first:last] if start < p[2]]


def _having(data: bytes, hint: bytes, off: np.ndarray) -> set[int]:
    """Documents with a hint in them (at a boundary perhaps one too many: what reads them looks inside only)."""
    got, at = set(), data.find(hint)
    while at >= 0:
        d = int(np.searchsorted(off, at, "right")) - 1
        got.add(d)
        at = data.find(hint, max(at + 1, min(int(off[d + 1]) - len(hint) + 1, len(data))))
    return got


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans of every document."""
    ship(docs.sparkSession)

    def run(batches):
        for x in batches:
            got = find(x.column(1), vocabulary)
            counts = [pa.array([sum(k == j for _, k, _ in s) for s in got], pa.int64()) for j in range(4)]
            base = [hashlib.sha256(_joined([p for p in s if p[1] < 3]).encode()).hexdigest() for s in got]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([x.column(0), *counts, pa.array(base, pa.string()), pa.array(map(_joined, got), pa.string())], names=names)

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its secrets replaced; n_chars follows its text."""
    ship(spark)
    names = docs.schema.names

    def run(batches):
        for x in batches:
            t = x.column(names.index("text"))
            hit = {i: s for i, s in enumerate(find(t)) if s}
            if hit:
                texts = t.to_pylist()
                for i, s in hit.items():
                    texts[i] = redact(texts[i], s)
                cols = list(x.columns)
                cols[names.index("text")] = pa.array(texts, t.type)
                if "n_chars" in names:
                    n = x.column(names.index("n_chars")).to_pylist()
                    for i in hit:
                        n[i] = len(texts[i])
                    cols[names.index("n_chars")] = pa.array(n, x.column(names.index("n_chars")).type)
                x = pa.RecordBatch.from_arrays(cols, schema=x.schema)
            yield x

    return docs.mapInArrow(run, docs.schema)
