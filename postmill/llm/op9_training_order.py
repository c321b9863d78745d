"""Training-order materialisation: token ids in fixed-stride binary shards, in a keyed order.

Documents' tokens, each closed by an end token, make one stream, in the order of doc_id (null first) and a hash of
the text, cut into sequences of LENGTH tokens (the last is filled up with end tokens). The order of the input's files
and how they are read play no part. A Feistel network over the sequences' numbers, with cycle walking to their count,
is the training order: it gives every sequence its global slot, and its inverse gives a slot's sequence, with no table.

Slots are dealt to range partitions by shard; each partition writes its shards, SEQUENCES slots of equal stride
each, as little-endian unsigned 16-bit integers: slot s is at byte (s % SEQUENCES) * stride of shard
s // SEQUENCES. A shard is written under a name of its own attempt and renamed (a whole one that is there already
stays), so that a lost executor or a second attempt leaves a whole file; Shards reads on from any slot.

Where a document begins in the stream needs no shuffle of tokens: each task writes its documents' tokens once; their
lengths are sorted by range and summed, a total for each range going to the driver; and every task's offsets are
written to the shared folder beside its tokens, to be read by whoever reads these.

Defined cases: a null or empty text is its end token. Repeated rows each have their tokens; rows of one id and text
(ties) have the same tokens, so their order is of no matter. Extra columns are not read. An empty table gives no
sequences and no shards. A text's tokens are held whole by its task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import documents, narrow, row_key, saved, shared, ship, transient

VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
LENGTH, SEQUENCES = 2048, 2048
KEY, ROUNDS = 20240611, 8


class Permutation:
    """A keyed permutation of range(n) and its inverse, over arrays."""

    def __init__(self, n: int, key: int = KEY):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{n}:{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _walk(self, x: np.ndarray, keys: list, turned: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        out = np.asarray(x).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> h, out[todo] & mask
            for k in keys:
                if turned:
                    left, right = right ^ self._f(left, k), left
                else:
                    left, right = right, left ^ self._f(right, k)
            out[todo] = left << h | right
            todo = todo[out[todo] >= self.n]  # outside: once more
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


@lru_cache(2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("order", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stream(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, str, np.ndarray]:
    """(part, i, doc_id, ids): each document's tokens, as the i-th of a task; a folder with the offsets of each task's
    documents within their range; and where each range begins in the stream."""
    spark = docs.sparkSession
    ship(spark)

    def encode(batches):
        enc, part, i = _encoding(vocabulary), TaskContext.get().partitionId(), 0
        for x in batches:
            ids = []
            for t in x.column(2):
                text = t.as_py() or ""
                ids.append(np.append(enc.encode_to_numpy(text) if text else np.zeros(0, np.uint32), END).astype("<u2").tobytes())
            at = np.arange(i, i + len(ids))
            i += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(at), x.column(0), x.column(1), pa.array(ids, pa.binary())], names=["part", "i", "doc_id", "key", "ids"])

    d = narrow(docs, "doc_id", "text").select("doc_id", row_key(F.col("text"), F.col("doc_id")).alias("key"), "text")
    placed = saved(d.mapInArrow(encode, "part int, i bigint, doc_id bigint, key bigint, ids binary"), "stream")
    lengths = placed.select("doc_id", "key", "part", "i", (F.length("ids") / 2).cast("bigint").alias("n"))
    order = [F.asc_nulls_first("doc_id"), F.asc("key"), F.asc("part"), F.asc("i")]

    def run_up(batches):
        here, total = TaskContext.get().partitionId(), 0
        for x in batches:
            n = x.column(4).to_numpy()
            at = np.cumsum(n) - n + total
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([x.column(2), x.column(3), pa.array(np.full(len(n), here, np.int32)), pa.array(at), x.column(4)], names=["part", "i", "range", "at", "n"])

    offsets = saved(lengths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run_up, "part int, i bigint, range int, at bigint, n bigint"), "offsets")
    totals = offsets.groupBy("range").agg(F.sum("n").alias("n")).collect()  # a row for each range
    size = np.zeros(max((r.range for r in totals), default=-1) + 2, np.int64)
    for r in totals:
        size[r.range + 1] = r.n
    folder = shared(spark, "offsets-of-parts")
    offsets.select("part", "i", "range", "at").repartition("part").sortWithinPartitions("part", "i").write.partitionBy("part").parquet(folder)
    transient(spark, folder)
    return placed.drop("key"), folder, np.cumsum(size)


class Offsets:
    """Where documents begin in the stream: those of the parts that a task meets, read once each."""

    def __init__(self, folder: str, begin: np.ndarray):
        self.folder, self.begin = folder, begin
        self.parts: dict[int, np.ndarray] = {}

    def of(self, part: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        for p in np.unique(part).tolist():
            if p not in self.parts:
                self.parts = {p: self._read(p)}  # one at a time: a task's rows come part by part
            mine = part == p
            out[mine] = self.parts[p][i[mine]]
        return out

    def _read(self, part: int) -> np.ndarray:
        import pyarrow.parquet as pq
        from pyarrow import fs

        f, top = _open(self.folder)
        files = [x.path for x in f.get_file_info(fs.FileSelector(f"{top}/part={part}")) if x.path.endswith(".parquet")]
        tables = [pq.read_table(f.open_input_file(x), columns=["i", "range", "at"]) for x in files]
        i, r, at = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("i", "range", "at"))
        out = np.zeros(len(i), np.int64)
        out[i] = self.begin[r] + at
        return out


def pc_length(x: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(x).to_pylist()


def pieces(placed: DataFrame, folder: str, begin: np.ndarray, order: Permutation, length: int) -> DataFrame:
    """(slot, shard, at, doc_ids, ids): stretches of sequences, put together from neighbouring documents; ids compressed."""

    def run(batches):
        offsets = Offsets(folder, begin)
        for x in batches:
            n = np.array(pc_length(x.column(3)), np.int64) // 2
            first = offsets.of(x.column(0).to_numpy(), x.column(1).to_numpy())
            ids, doc_ids = x.column(3), x.column(2).to_pylist()
            rows: list[tuple[int, int, list, list]] = []
            for i in np.argsort(first, kind="stable").tolist():
                body, g, end = ids[i].as_buffer(), int(first[i]), int(first[i] + n[i])
                while g < end:
                    stop = min(end, (g // length + 1) * length)
                    part = memoryview(body)[2 * (g - int(first[i])) : 2 * (stop - int(first[i]))]
                    if rows and rows[-1][0] == g // length and rows[-1][1] + sum(map(len, rows[-1][3])) // 2 == g % length:
                        rows[-1][2].append(doc_ids[i])
                        rows[-1][3].append(part)
                    else:
                        rows.append((g // length, g % length, [doc_ids[i]], [part]))
                    g = stop
            pack = zstandard.ZstdCompressor(level=6).compress  # Spark's own codec does little for token ids
            slot = order.slot(np.array([r[0] for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(slot // SEQUENCES), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([pack(b"".join(r[3])) for r in rows], pa.binary())],
                names=["slot", "shard", "at", "doc_ids", "ids"],
            )

    return placed.mapInArrow(run, "slot bigint, shard bigint, at bigint, doc_ids array<bigint>, ids binary")


#: A shard's file; with a dot before and a mark behind while it is written.
SHARD_NAME = re.compile(r"(\.)?shard-([0-9]{8,})\.bin(?:\.[0-9a-f]{32})?")


def file_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def commit(fs, name: str, target: str) -> None:
    """Gives a finished file its name. A file of the same bytes, as another attempt of its task leaves, stays; one of another run
    goes, for all full shards have one size."""
    if _equal(fs, name, target):
        fs.delete_file(name)
        return
    if fs.type_name != "local" and fs.get_file_info(target).is_file:  # a local rename replaces its target
        fs.delete_file(target)
    fs.move(name, target)


def _equal(fs, a: str, b: str, piece: int = 1 << 22) -> bool:
    x, y = fs.get_file_info([a, b])
    if not y.is_file or x.size != y.size:
        return False
    with fs.open_input_stream(a) as f, fs.open_input_stream(b) as g:
        while chunk := f.read(piece):
            if chunk != g.read(piece):
                return False
    return True


def clear_beyond(folder: str, shards: int) -> None:
    """Deletes an earlier, longer run's last shards, and what its lost attempts left."""
    from pyarrow.fs import FileSelector

    fs, top = _open(folder)
    for f in fs.get_file_info(FileSelector(top, allow_not_found=True)):
        shard = SHARD_NAME.fullmatch(f.base_name)
        if f.is_file and shard and (shard[1] or int(shard[2]) >= shards):
            fs.delete_file(f.path)


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Writes the shards below folder (shared by all executors); returns a row for each slot: slot, shard, byte_offset,
    sequence, n_tokens (without filling), sha256 of its bytes, doc_ids in it."""
    placed, offsets, begin = stream(docs)
    total = int(begin[-1])
    count = -(-total // length)
    order = Permutation(count, key)
    shards = max(1, -(-count // SEQUENCES))
    rows = pieces(placed, offsets, begin, order, length).repartitionByRange(shards, "shard").sortWithinPartitions("slot", "at")
    stride = 2 * length
    filler = np.full(length, END, "<u2").tobytes()
    schema = "slot bigint, shard bigint, byte_offset bigint, sequence bigint, n_tokens bigint, sha256 string, doc_ids array<bigint>"

    def write(batches):
        fs, top = _open(folder)
        fs.create_dir(top, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        shard, out, name, done, slot, parts, ids = -1, None, "", [], -1, [], []

        def end_slot():
            body = b"".join(parts)
            n = len(body) // 2
            body += filler[len(body) :]
            out.write(body)
            done.append((slot, shard, (slot % SEQUENCES) * stride, n, hashlib.sha256(body).hexdigest(), list(dict.fromkeys(ids))))

        def end_shard():
            out.close()
            commit(fs, name, f"{top}/{file_name(shard)}")

        def flush():
            cols = list(zip(*done, strict=True)) or [()] * 6
            sequence = order.sequence(np.array(cols[0], np.int64)) if done else np.zeros(0, np.int64)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(sequence, pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.int64()))],
                names=["slot", "shard", "byte_offset", "sequence", "n_tokens", "sha256", "doc_ids"],
            )

        for x in batches:
            for s, k, d, body in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist(), strict=True):
                if s != slot:
                    if slot >= 0:
                        end_slot()
                    if k != shard:
                        if out:
                            end_shard()
                        shard, name = k, f"{top}/.{file_name(k)}.{uuid.uuid4().hex}"
                        out = fs.open_output_stream(name)
                    slot, parts, ids = s, [], []
                parts.append(unpack(body))
                ids += d
            yield flush()
        if slot >= 0:
            end_slot()
            end_shard()
            yield flush()

    manifest = saved(rows.mapInArrow(write, schema), "manifest")
    clear_beyond(folder, -(-count // SEQUENCES))
    return manifest


class Shards:
    """Sequences of a written folder, in training order, from any slot on."""

    def __init__(self, folder: str, count: int, length: int = LENGTH):
        self.fs, self.top = _open(folder)
        self.count, self.stride = count, 2 * length

    def read(self, start: int = 0):
        for shard in range(start // SEQUENCES, -(-self.count // SEQUENCES)):
            first, last = max(start, shard * SEQUENCES), min(self.count, (shard + 1) * SEQUENCES)
            with self.fs.open_input_file(f"{self.top}/{file_name(shard)}") as f:
                f.seek((first % SEQUENCES) * self.stride)
                for _ in range(first, last):
                    yield np.frombuffer(f.read(self.stride), "<u2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest; the shards themselves, in the shared folder, go with the driver."""
    folder = shared(spark, "shards")
    transient(spark, folder)
    return materialise(documents(spark, sf_dir), folder)
