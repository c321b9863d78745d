"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts anywhere else too.

Sorting all suffixes of a corpus would move it many times over. Only suffixes that can share 200 bytes meet:

1. Anchors. Of every 200-byte string the 32-byte piece with the smallest hash is an anchor, so equal strings
   have equal anchors at equal places, about one anchor in 85 bytes. An anchor's context is the at most 168
   bytes before it and 200 from it on, within its document: all 200-byte strings around it.
2. Anchors of one piece whose contexts are equal (by a BLAKE2 digest of 128 bits over all their bytes) are repeated as
   a whole. Equal contexts of one task are counted there and one of them goes on.
3. Two anchors that share a 200-byte string share RIGHT bytes from the piece on or LEFT bytes before it. Contexts
   that share neither with another of their piece are done. The others get their bytes, to the right of the anchor and to
   the left read backwards. A string x bytes before the anchor is repeated exactly if another member shares 200 - x bytes
   to the right and x to the left. Up to PAIRED members of a piece are compared by pairs, eight bytes at a time; more are
   sorted as suffixes in both directions, and what neighbours share gives the classes for every x. No hash decides here.
4. A piece with more than GROUP such contexts is split by how far before the anchor a string begins: strings that
   begin a to b bytes before it share a bytes to the left and LENGTH - b to the right, so equal ones meet in one
   half of the range or the other. Contexts with equal bytes (by SHA-256) as far as a range's strings reach are repeated for
   the whole range, and one of them goes on for the others; one that stands alone drops out; halves go on
   splitting while they hold too many. A range of one is a class of equal strings.
5. Covered stretches are merged a document at a time.

Defined cases: a null or empty text, and one under 200 bytes, loses nothing. Repeated rows are copies of each
other and lose all (200 bytes or more). Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.blocks import Block, blocks, eights, joined, mix, repeated
from postmill.llm.common import documents, narrow, row_key, saved, ship

LENGTH, PIECE = 200, 32
REACH = LENGTH - PIECE  # how far before its anchor a string can start
RIGHT = PIECE + REACH // 2
LEFT = LENGTH - RIGHT  # a string with less than RIGHT from its anchor on has more than this before it
#: Keys that a join may broadcast, counted first (8 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Differing contexts of one piece that one task sorts at most.
GROUP = 4000
#: Anchors that a task holds before it counts and sends them, and members it sorts together.
HELD, SORTED = 300_000, 3_000
#: Members of a group that are compared by pairs.
PAIRED = 32


def _slide(v: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every `size` neighbours, by doubling."""
    width = 1
    while 2 * width <= size:
        v = best(v[:-width], v[width:])
        width *= 2
    return best(v[: len(v) - (size - width)], v[size - width :]) if size > width else v


def anchors(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors in the block, the hash of their piece, their document."""
    n = len(b.data)
    if n < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = mix(eights(b.data)[: n - 7])
    h = joined(h[:-8], h[8:])
    h = joined(h[:-16], h[16:]) | np.uint64(1)
    low = _slide(h, REACH + 1, np.minimum)  # of each string
    doc = np.repeat(np.arange(b.n), np.diff(b.off))
    low[b.off[doc[: len(low)] + 1] - np.arange(len(low)) < LENGTH] = 0  # no string across documents
    pad = np.zeros(REACH, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), REACH + 1, np.maximum)  # over the strings with a piece
    pos = np.flatnonzero(high[: len(h)] == h)
    return pos, h[pos], doc[pos]


def contexts(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Two numbers for each data[lo:hi], the same for equal bytes with equally many of them before the anchor."""
    whole = data.tobytes()
    digests = b"".join([hashlib.blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(lo.tolist(), hi.tolist(), strict=True)])
    out = np.frombuffer(digests, np.int64).reshape(-1, 2).copy()
    out[:, 0] ^= before
    return out


#: The odd base of the hash of sides, modulo 2**64: it only tells who may share one, the suffix sort decides.
_SIDE_BASE = 0x9E3779B97F4A7C15


@lru_cache(2)
def _side_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(n, b, np.uint64) for b in (_SIDE_BASE, pow(_SIDE_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Sides:
    """32-bit hashes of spans of data, never 0."""

    def __init__(self, data: np.ndarray):
        n = 1 << len(data).bit_length()
        up, self.down = _side_powers(n)
        self.S = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.S[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.S[end] - self.S[start]) * self.down[start]) >> np.uint64(32) | np.uint64(1)


def _merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of one key as one; sorted."""
    if not len(key):
        return key, lo, hi
    o = np.lexsort((lo, key))
    key, lo, hi = key[o], lo[o], hi[o]
    group = np.zeros(len(key), np.int64)
    group[1:] = np.cumsum(key[1:] != key[:-1])
    top = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(key), bool)
    new[1:] = (group[1:] != group[:-1]) | (lo[1:] > top[:-1])
    at = np.flatnonzero(new)
    return key[at], lo[at], top[np.append(at[1:] - 1, len(key) - 1)]


# An anchor's row. piece: a hash; context, check: its context's digest; key: its document; place: position, bytes before and after it in its context;
# sides: 32 bits of a hash of its right and of its left side (0: too short); n: how many of the task have the context.
# A covered stretch is a row too, with n = 0 and its ends in place and sides; its piece only spreads the rows.
_ROW = "piece bigint, context bigint, check bigint, key bigint, place bigint, sides bigint, n int"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _counted(parts: list) -> pa.RecordBatch:
    """The anchors of a task, one for each context, and what is covered by contexts that it has twice."""
    piece, context, check, key, place, sides = (np.concatenate(x) for x in zip(*parts, strict=True))
    o = np.lexsort((check, context, piece))
    piece, context, check, key, place, sides = piece[o], context[o], check[o], key[o], place[o], sides[o]
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (context[1:] != context[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(piece)))
    p = place[np.repeat(n, n) > 1]
    k, a, z = _merged(key[np.repeat(n, n) > 1], (p >> 16) - (p >> 8 & 255), (p >> 16) + (p & 255))
    spread = mix(k.view(np.uint64) + a.astype(np.uint64)).view(np.int64)
    zero = np.zeros(len(k), np.int64)
    cols = [(piece[first].view(np.int64), spread), (context[first], zero), (check[first], zero), (key[first], k), (place[first], a), (sides[first], z), (n.astype(np.int32), zero.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=_NAMES)


def _find_anchors(batches):
    held, size = [], 0
    for x in batches:
        keys = x.column(0).to_numpy()
        for b in blocks(x.column(1), 1 << 20):
            pos, piece, doc = anchors(b)
            if not len(pos):
                continue
            start = b.off[doc]
            lo, hi = np.maximum(start, pos - REACH), np.minimum(b.off[doc + 1], pos + LENGTH)
            context, sides = contexts(b.data, lo, hi, pos - lo), Sides(b.data)
            right = np.where(hi - pos >= RIGHT, sides.of(pos, np.minimum(pos + RIGHT, hi)), np.uint64(0))
            left = np.where(pos - lo >= LEFT, sides.of(np.maximum(pos - LEFT, lo), pos + PIECE), np.uint64(0))
            held.append((piece, context[:, 0], context[:, 1], keys[b.first : b.first + b.n][doc], pos - start << 16 | pos - lo << 8 | hi - pos, (right << np.uint64(32) | left).view(np.int64)))
            size += len(pos)
            if size >= HELD:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _rows(data: np.ndarray, start: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Suffixes as rows of one width: their bytes, then zeros."""
    width = -(-int(room.max(initial=1)) // 8) * 8
    rows = sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[start]
    rows[np.arange(width) >= room[:, None]] = 0
    return rows


def _extension(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bytes rows i and j have in common at their begin; zeros past an end count."""
    eight = rows.view("<u8")
    x = eight[i] ^ eight[j]
    at = (x != 0).argmax(axis=1)
    first = x[np.arange(len(x)), at]
    low = first & (~first + np.uint64(1))
    return np.where(first == 0, rows.shape[1], at * 8 + np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(np.int64) // 8)


class Suffixes:
    """Members' bytes, sorted as suffixes of one direction within their groups."""

    def __init__(self, data: np.ndarray, start: np.ndarray, room: np.ndarray, group: np.ndarray):
        """start: where each suffix begins in data; room: its length; group: sorted numbers."""
        self.group, self.rows = group, _rows(data, start, room)
        whole = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), self.rows], axis=1)
        self.order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
        o = self.order
        # with the one before; zeros past an end join nothing: only suffixes with room for a length are asked for its classes
        self.common = np.zeros(len(o), np.int64)
        if len(o) > 1:
            self.common[1:] = np.where(group[o[1:]] == group[o[:-1]], _extension(self.rows, o[1:], o[:-1]), 0)

    def classes(self, length: int) -> np.ndarray:
        """A number for each suffix, equal where the group and the first `length` bytes are."""
        out = np.empty(len(self.order), np.int64)
        if length:
            out[self.order] = np.cumsum(self.common < length)
        else:
            out[:] = self.group
        return out


def _pairs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of groups that begin at first and have so many."""
    i, j = [], []
    for k in np.unique(size).tolist():
        a, b = np.triu_indices(k, 1)
        at = first[size == k][:, None]
        i.append((at + a).ravel())
        j.append((at + b).ravel())
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def settle(unit: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, slices: list[bytes]) -> np.ndarray:
    """Of members sorted by unit: [i, x] whether the string that starts x bytes before anchor i is repeated.

    Two members that share r bytes from the anchor on and l before it share the strings that start LENGTH - r to l before
    it. Small groups are compared by pairs, others are sorted in both directions.
    """
    sizes = np.array([len(s) for s in slices], np.int64)
    data = np.frombuffer(b"".join(slices), np.uint8)
    begin = np.cumsum(sizes) - sizes
    left, right = (pos - lo).astype(np.int64), (hi - pos).astype(np.int64)
    new = np.ones(len(unit), bool)
    new[1:] = unit[1:] != unit[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(unit)))
    ahead, back = (data, begin + left, right), (data[::-1].copy(), len(data) - (begin + left), left)

    small = size <= PAIRED
    i, j = _pairs(first[small], size[small])
    many = np.flatnonzero((n > 1) & (left + right >= LENGTH))
    ranges = [(many, np.maximum(LENGTH - right[many], 0), np.minimum(left[many], REACH))]
    a, b = _rows(*ahead), _rows(*back)
    for at in range(0, len(i), 20_000):
        p, q = i[at : at + 20_000], j[at : at + 20_000]
        from_ = np.maximum(LENGTH - np.minimum(_extension(a, p, q), np.minimum(right[p], right[q])), 0)
        to = np.minimum(np.minimum(_extension(b, p, q), np.minimum(left[p], left[q])), REACH)
        ok = from_ <= to
        ranges += [(p[ok], from_[ok], to[ok]), (q[ok], from_[ok], to[ok])]
    row, from_, to = (np.concatenate(c) for c in zip(*ranges, strict=True))
    edge = REACH + 2
    begins, ends = (np.bincount(row * edge + x, minlength=len(unit) * edge) for x in (from_, to + 1))
    out = np.cumsum((begins - ends).reshape(-1, edge), axis=1)[:, :-1] > 0

    big = np.flatnonzero(np.repeat(~small, size))
    if len(big):
        group = np.repeat(np.arange(len(size)), size)[big]
        ahead, back = (Suffixes(d, s[big], r[big], group) for d, s, r in (ahead, back))
        for x in range(REACH + 1):
            ok = np.flatnonzero((left[big] >= x) & (right[big] >= LENGTH - x))
            if len(ok):
                out[big[ok], x] |= repeated(ahead.classes(LENGTH - x)[ok] * (len(unit) + 1) + back.classes(x)[ok])
    return out


def _stretches(hit: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of what each row's repeated strings cover."""
    wide = np.zeros((len(hit), hit.shape[1] + 2), np.int8)
    wide[:, 1:-1] = hit
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, pos[row] - (after - 1), pos[row] - first + LENGTH


def _settle_groups(batches):
    """Sorted members in, covered stretches out."""

    def flush(rows):
        unit, key, pos, lo, hi, n, s = rows
        row, a, z = _stretches(settle(unit, pos, lo, hi, n, s), pos)
        return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(a), pa.array(z)], names=["key", "lo", "hi"])

    def join(rows):
        return [np.concatenate([r[k] for r in rows]) for k in range(6)] + [[s for r in rows for s in r[6]]]

    held = None
    for x in batches:
        now = [x.column(k).to_numpy() for k in range(6)] + [x.column(6).to_pylist()]
        held = join([held, now]) if held is not None else now
        if len(held[0]) >= SORTED:
            other = np.flatnonzero(held[0] != held[0][-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if cut:
                yield flush([c[:cut] for c in held])
                held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield flush(held)


def _settled(members: DataFrame) -> DataFrame:
    rows = members.select("unit", "key", "pos", "lo", "hi", "n", "s").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_settle_groups, "key bigint, lo bigint, hi bigint")


def _split(members: DataFrame) -> list[DataFrame]:
    """Covered stretches of members (unit, a, b, ...) of units with too many, by halving their ranges a to b."""
    out = []
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    before, after = F.col("pos") - F.col("lo"), F.col("hi") - F.col("pos")
    cut = lambda first, last: F.substring("s", (before - first + 1).cast("int"), first + LENGTH - last)  # noqa: E731  bytes that strings from first to last share
    unit, same = Window.partitionBy("unit"), Window.partitionBy("unit", "same")
    while not members.isEmpty():
        x = members.withColumn("b", middle).unionByName(members.withColumn("a", middle + 1))
        x = x.filter((before >= F.col("a")) & (after >= LENGTH - F.col("b")))
        x = x.withColumn("unit", F.xxhash64("unit", "a", "b", cut(F.col("a"), F.col("b"))))
        wide = (before >= F.col("b")) & (after >= LENGTH - F.col("a"))
        x = x.withColumn("same", F.when(wide, F.sha2(cut(F.col("b"), F.col("a")), 256)).otherwise(F.concat_ws(" ", F.lit("own"), "key", "pos")))
        x = x.withColumn("i", F.row_number().over(same.orderBy("key", "pos"))).withColumn("alike", F.sum("n").over(same).cast("int"))
        x = x.withColumn("classes", F.count(F.when(F.col("i") == 1, 1)).over(unit)).filter("classes > 1 or alike > 1")
        x = saved(x, "halves")
        out.append(x.filter(wide & (F.col("alike") > 1)).select("key", (F.col("pos") - F.col("b")).alias("lo"), (F.col("pos") - F.col("a") + LENGTH).alias("hi")))
        one = x.filter("i = 1 and classes > 1").withColumn("n", F.lit(1)).drop("same", "i", "alike")  # for this range only
        out.append(_settled(one.filter(f"classes <= {GROUP}")))
        members = one.filter(f"classes > {GROUP}").drop("classes")
    return out


def only(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with one of the (distinct) keys: a broadcast where they are few enough, else a shuffle."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def covered(docs: DataFrame) -> DataFrame:
    """(key, lo, hi): covered stretches of the documents (key, text); they may overlap."""
    piece, same = Window.partitionBy("piece"), Window.partitionBy("piece", "context", "check")
    x = docs.mapInArrow(_find_anchors, _ROW)
    x = x.withColumn("all", F.sum("n").over(piece)).filter("all > 1 or n = 0")
    x = x.withColumn("i", F.row_number().over(same.orderBy("key", "place"))).withColumn("alike", F.sum("n").over(same).cast("int"))
    x = saved(x.select("piece", "key", "place", "sides", "n", "alike", "i", (F.col("alike") < F.col("all")).alias("differ")), "repeated")
    pos = F.shiftright("place", 16)
    at = {"pos": pos, "lo": pos - F.shiftright("place", 8).bitwiseAND(F.lit(255)), "hi": pos + F.col("place").bitwiseAND(F.lit(255))}
    parts = x.filter("n > 0 and alike > 1").select("key", at["lo"].alias("lo"), at["hi"].alias("hi"))
    parts = parts.unionByName(x.filter("n = 0").select("key", F.col("place").alias("lo"), F.col("sides").alias("hi")))

    right, left = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    one = x.filter("n > 0 and differ and i = 1").select("piece", "key", F.col("alike").alias("n"), right.alias("right"), left.alias("left"), *[c.alias(k) for k, c in at.items()])
    for side in ("right", "left"):
        one = one.withColumn(f"n_{side}", F.when(F.col(side) != 0, F.count("*").over(Window.partitionBy("piece", side))).otherwise(0))
    one = one.filter("n_right > 1 or n_left > 1").withColumn("size", F.count("*").over(piece))
    # a member is sorted with its piece; where these are too many, its piece is split further
    one = saved(one.select("piece", (F.col("size") > GROUP).alias("large"), "key", "pos", "lo", "hi", "n"), "members")
    wanted = one.groupBy("key").agg(F.collect_list(F.struct("piece", "large", "pos", "lo", "hi", "n")).alias("at"))
    cut = only(docs, one.select("key").distinct()).join(wanted, "key").select("key", "text", "at")

    def slices(batches):
        names = ["unit", "large", "key", "pos", "lo", "hi", "n", "s"]
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                x = whole.slice(first, 256)
                at, size = x.column(2).flatten(), x.column(2).value_lengths().to_pylist()
                lo, hi = at.field("lo").to_pylist(), at.field("hi").to_pylist()
                s, k = [], 0
                for text, n in zip(x.column(1), size, strict=True):
                    t = (text.as_py() or "").encode()
                    s += [t[lo[j] : hi[j]] for j in range(k, k + n)]
                    k += n
                key = pa.array(np.repeat(x.column(0).to_numpy(), size))
                yield pa.RecordBatch.from_arrays([at.field("piece"), at.field("large"), key, *(at.field(c) for c in ("pos", "lo", "hi")), at.field("n"), pa.array(s, pa.binary())], names=names)

    members = cut.mapInArrow(slices, "unit bigint, large boolean, key bigint, pos bigint, lo bigint, hi bigint, n int, s binary")
    parts = parts.unionByName(_settled(members.filter("not large")))
    if not one.filter("large").isEmpty():
        large = saved(members.filter("large").drop("large").withColumn("a", F.lit(0)).withColumn("b", F.lit(REACH)), "large")
        for x in _split(large):
            parts = parts.unionByName(x)
    return parts


def _spans(at: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted((r["lo"], r["hi"]) for r in at):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans of every document."""
    return _removed(docs, True)


def _removed(docs: DataFrame, with_bytes: bool) -> DataFrame:
    ship(docs.sparkSession)
    d = narrow(docs, "doc_id", "text")
    d = d.select("doc_id", row_key(F.col("text"), F.col("doc_id")).alias("key"), "text")
    spans = saved(covered(d.select("key", "text")).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("at")), "spans")
    keys = spans.select("key")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    if few:  # only texts with something to remove are shuffled
        none = d.join(F.broadcast(keys), "key", "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["at"].dataType).alias("at"))
        both = only(d, keys).join(spans, "key").select("doc_id", "text", "at").unionByName(none)
    else:
        both = d.join(spans, "key", "left").select("doc_id", "text", "at")

    def run(batches):
        for x in batches:
            rows = []
            for t, at in zip(x.column(1), x.column(2), strict=True):
                t, runs = (t.as_py() or "").encode(), _spans(at.as_py() or [])
                kept, last = [], 0
                for a, z in runs:
                    kept.append(t[last:a])
                    last = z
                kept = b"".join([*kept, t[last:]])
                rows.append((kept if with_bytes else hashlib.sha256(kept).hexdigest(), len(t), len(t) - len(kept), len(runs)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(cols[0], pa.binary() if with_bytes else pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.mapInArrow(run, f"doc_id bigint, kept {'binary' if with_bytes else 'string'}, n_bytes bigint, n_removed bigint, n_spans bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _removed(documents(spark, sf_dir), False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
