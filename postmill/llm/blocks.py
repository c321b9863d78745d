"""Whole texts of an Arrow batch as numpy arrays: bytes, words, and their hashes.

A batch is cut into blocks of whole documents of about BLOCK_BYTES bytes, so a task's memory
follows the block (or its longest single document), never the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
KEPT_POWERS = (1 << 20) + (1 << 17)
U64 = np.uint64

#: Words are runs of bytes other than these; UTF-8 never uses them inside a longer character.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The prime of the polynomial hashes, their base, and what hashing begins with.
PRIME = U64((1 << 61) - 1)
_BASE = 0x11D4A27F5C3B9E61 % int(PRIME)
_SEED, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one; prefix sums go this many bytes at a time (each term is below 2**40).
LONG, TERMS = 256, 1 << 15
_pow = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    low31, low30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low31, b >> U64(31), b & low31
    mid = a1 * b0 + a0 * b1
    return reduced(U64(2) * a1 * b1 + (mid >> U64(30)) + ((mid & low30) << U64(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME."""
    x = (x & PRIME) + (x >> U64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(n: int) -> dict[str, np.ndarray]:
    """By doubling: the first m powers times base**m are the next m."""
    out = {}
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, int(PRIME)))):
        x = np.ones(n, U64)
        m = 1
        while m < n:
            k = min(m, n - m)
            x[m : m + k] = mulmod(x[:k], U64(pow(base, m, int(PRIME))))
            m += k
        out[name] = x
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n; as many as a block needs are kept for the worker's life."""
    now = _pow
    if len(now["up"]) < n:
        now = _powers(max(n, KEPT_POWERS))
        if n <= KEPT_POWERS:
            _pow.update(now)
    return now["up"], now["down"]


def trim() -> None:
    """Give freed memory back: the C library keeps it, and a worker lives on for other tasks."""
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums S of (data[i] + 1) * base**i modulo PRIME, S[0] = 0; see span()."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    for at in range(0, len(data), TERMS):
        v, p = data[at : at + TERMS].astype(U64) + U64(1), up[at : at + min(TERMS, len(data) - at)]
        low, high = np.cumsum(v * (p & U64((1 << 31) - 1))), np.cumsum(v * (p >> U64(31)))
        out[at + 1 : at + 1 + len(v)] = reduced(mulmod(reduced(high), U64(1 << 31)) + reduced(low) + out[at])
    return out


def polynomial(S: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The polynomial of data[start:end], the same wherever the span stands. down: powers(len(S))[1]."""
    return mulmod(reduced(S[end] + (PRIME - S[start])), down[start])


def span(S: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end]: its polynomial mixed with its length."""
    return mix(polynomial(S, start, end, powers(len(S))[1]) + (end - start).astype(U64) * _STEP)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One hash from a hash of what stood before, and the next part's: a bijection in either."""
    x = (x ^ y) * _STEP
    return x ^ (x >> U64(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, and zeros past the end, as a number."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time through a bijective mixer, so no pattern of bytes makes two
    of them meet more often than chance; of more than LONG bytes by BLAKE2."""
    n = end - start
    out = mix(n.astype(U64) * _STEP + _SEED)
    eight, todo = eights(data), np.flatnonzero((n > 0) & (n <= LONG))
    at, left = start[todo], n[todo]
    while len(todo):
        x = eight[at] & np.where(left < 8, (U64(1) << (U64(8) * np.minimum(left, 7).astype(U64))) - U64(1), ~U64(0))
        out[todo] = mix(out[todo] ^ x)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(memoryview(data)[int(start[i]) : int(end[i])], digest_size=8).digest(), "little")
    return out


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` of the hashes."""
    n = max(0, len(h) - size + 1)
    x = mix(h[:n] + U64(size * int(_SEED) % 2**64))
    for k in range(1, size):
        x = joined(x, h[k : n + k])
    return x


class Block:
    """Some whole documents. data: their bytes on end; off: where each begins, and the end of the last."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the byte positions in flags each document has."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def words(self, lower: bool = False) -> Words:
        return Words(self, lower)


class Words:
    """start, end: byte spans of all words; off: where each document's words begin; h: their 64-bit hashes."""

    def __init__(self, block: Block, lower: bool = False, space: np.ndarray = SPACE, alone: bool = False):
        """alone: characters from U+3000 on are words of their own (scripts that put no spaces between words)."""
        solid = ~space[block.data]
        n = len(solid)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        if alone:
            first = np.flatnonzero(block.data >= 0xE3)
            for at in (first, first + np.where(block.data[first] < 0xF0, 3, 4)):
                at = at[(at > 0) & (at < n)]
                before[at], after[at - 1] = False, False
        inner = block.off[(block.off > 0) & (block.off < n)]
        before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.solid = solid
        self.off = np.searchsorted(self.start, block.off)
        self.n = np.diff(self.off)
        self.h = hashes(LOWER[block.data] if lower else block.data, self.start, self.end)
        self.doc = np.repeat(np.arange(block.n), self.n)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of `size` words inside a document."""
        at = np.arange(max(0, len(self.h) - size + 1))
        inside = self.doc[at] == self.doc[at + size - 1] if len(at) else np.zeros(0, bool)
        return at[inside], grams(self.h, size)[inside]


def per_doc_keys(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes of one document only."""
    return mix(h + (doc.astype(U64) + U64(1)) * U64(0xA24BAED4963EE407))


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, sorted."""
    s = np.sort(keys)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = distinct(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def shingle_sets(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `size`-word shingle hashes of each document (all its words as one if it has fewer), document by
    document in increasing order, and where each document's begin. A document without words has none."""
    at, h = w.windows(size)
    doc = w.doc[at]
    for k in range(1, size):
        few = np.flatnonzero(w.n == k)
        if len(few):
            h = np.concatenate([h, grams(w.h, k)[w.off[few]]])
            doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(w.n) + 1))


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts (null: empty) in blocks; Block.first: index of its first document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        last = min(last, n)
        yield Block(data[off[first] : off[last]], (off[first : last + 1] - off[first]).astype(np.int64), first)
        first = last
    trim()


class HashTable:
    """Index of each of some distinct 64-bit hashes: sorted, with a table of where each of their first bits begins."""

    def __init__(self, hashes: np.ndarray, bits: int = 21):
        self.hashes, self.shift = hashes, U64(64 - bits)
        self.number = np.argsort(hashes)
        self.sorted = hashes[self.number]
        slot = (self.sorted >> self.shift).astype(np.int64)
        self.count = np.bincount(slot, minlength=1 << bits).astype(np.int32)
        self.first = (np.cumsum(self.count) - self.count).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index among the hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> self.shift).astype(np.int64)
        todo = np.flatnonzero(self.count[slot])
        at, left = self.first[slot[todo]], self.count[slot[todo]]
        while len(todo):  # one that shares its first bits with others is looked for among them
            hit = self.sorted[at] == h[todo]
            out[todo[hit]] = self.number[at[hit]]
            more = ~hit & (left > 1)
            todo, at, left = todo[more], at[more] + 1, left[more] - 1
        return out
