"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted documents are those labelled quality 1 and toxic 0. One in HOLD_OUT of them never trains; of the rest those
with the smallest hash train the model, MAX_TRUSTED documents and MAX_BYTES bytes at most (the bound on its size). All
that don't train calibrate it. Words seen twice and more in training are the vocabulary; any other word is one of a few
shapes (plain, capitalised, upper case, with digits, symbols, ...), so unknown words of ordinary text stay likely and
junk does not: the perplexity is one of vocabulary words and shapes.

Counts are grouped by n-gram; continuation counts (n-grams that begin a document keep their own), context totals and
discounts are further grouped counts, and the interpolated probabilities come from joins of n-gram, context and
lower-order tables. Interpolation is folded into the usual table form: a probability for each seen n-gram, a weight for
each context.

Scoring is a join by the middle word of a trigram: all that its probability takes (its own, its context's weight, the
bigram that it ends with, the middle word's weight) stands in the shard of that word, modulo SHARDS. Tasks have the lower
orders (words, bigrams, their weights: bounded by MAX_BYTES, like the vocabulary) and a Bloom filter of the model's
trigrams. Trigrams that it has not seen back off where they are, into sums by document. A task packs a block's other
trigrams for each shard (sorted, with their documents and counts), the packs are shuffled by shard, each shard's
part of the model meets them first, and only sums by document come back. Shards are dealt on by salt, half as many as
the session's shuffle partitions (each takes a copy of its shard's model), so a frequent middle word's trigrams are in
many tasks.

A document's score is its mean negative log10 probability a token, drawn towards its language's median by PRIOR
tokens (so short texts are not judged by a few words). Thresholds are quantiles by language of the calibration
documents' scores (of bounded sketches, exact to ACCURACY), times SLACK; a language with fewer than MIN_CALIBRATION of
them uses those of all.

Defined cases: a null or empty text has one token, its end, and is not kept. A null language uses the common
threshold. A null doc_id is never trusted. Repeated rows are scored alike, each in its row. Without trusted documents
nothing is judged: the threshold is null, and texts with words are kept. Labels that repeat or disagree: trusted if all
say so. Words of equal count are numbered by hash. Extra columns are not read; an empty table gives no rows. A text
takes about 80 bytes of memory for each of its own while its task works on it.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.blocks import Block, HashTable, Words, blocks, mix
from postmill.llm.common import documents, narrow, row_key, saved, ship

#: Training documents and their bytes; with so many bytes, words that are seen twice number less than 2 ** BITS.
MAX_TRUSTED, MAX_BYTES, MIN_COUNT = 4000, 8_000_000, 2
SHARDS, HOLD_OUT, ACCURACY = 8, 5, 10_000
PRIOR, QUANTILE, SLACK, MIN_CALIBRATION = 10, 0.995, 1.04, 50
#: Word numbers take 21 bits of an n-gram's key: 0 begins a document, 1 ends it, then the shapes, then the vocabulary.
BITS, BEGIN, END, SHAPES = 21, 0, 1, 8
FIRST_WORD = 2 + SHAPES

_SYMBOL, _DIGIT, _UPPER, _LOWER, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>=+_~^@\\{}[]/"]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_LOWER[97:123] = _LOWER[128:] = True
_PUNCT[[ord(c) for c in ".,;:!?\"'()-"]] = True


def shapes(b: Block, w: Words) -> np.ndarray:
    """The shape of each word: 0 plain, 1 capitalised, 2 and 3 the same before punctuation, 4 upper case, 5 digits,
    6 symbols, 7 other (much punctuation)."""
    has = {}
    for name, table in (("symbol", _SYMBOL), ("digit", _DIGIT), ("upper", _UPPER), ("lower", _LOWER), ("punct", _PUNCT)):
        c = np.zeros(len(b.data) + 1, np.int32)
        np.cumsum(table[b.data], out=c[1:])
        has[name] = c[w.end] - c[w.start]
    first = _UPPER[b.data[w.start]] if len(w.start) else np.zeros(0, bool)
    out = first + 2 * (has["punct"] > 0)
    out = np.where((has["punct"] > 1) | (has["lower"] == 0), 7, out)
    out = np.where((has["upper"] > 1) & (has["lower"] == 0), 4, out)
    out = np.where(has["digit"] > 0, 5, out)
    return np.where(has["symbol"] > 0, 6, out)


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.table = HashTable(hashes, 20)
        self.size = FIRST_WORD + len(hashes)

    def numbers(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """The block's words as numbers, each document between two begins and an end; and each one's document."""
        w = b.words()
        at = self.table.find(w.h)
        ids = np.where(at >= 0, FIRST_WORD + at, 2 + shapes(b, w))
        out = np.full(len(ids) + 3 * b.n, BEGIN, np.int64)
        doc = np.repeat(np.arange(b.n), w.n + 3)
        start = w.off[:-1] + 3 * np.arange(b.n)
        out[start + w.n + 2] = END
        inner = np.ones(len(out), bool)
        inner[start] = inner[start + 1] = inner[start + w.n + 2] = False
        out[inner] = ids
        return out, doc


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of trusted documents."""
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok")).filter("ok").select("doc_id")


def vocabulary(texts: DataFrame) -> Vocabulary:
    def run(batches):
        for x in batches:
            for b in blocks(x.column(0)):
                h, n = np.unique(b.words().h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    top = texts.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    return Vocabulary(np.array([r.h for r in top.orderBy(F.desc("n"), "h").select("h").collect()], np.int64).view(np.uint64))


def trigrams(texts: DataFrame, voc: Vocabulary) -> DataFrame:
    """(g, c): trigram keys and counts."""

    def run(batches):
        for x in batches:
            for b in blocks(x.column(0)):
                w, doc = voc.numbers(b)
                at = np.flatnonzero(doc[2:] == doc[:-2])
                g, c = np.unique((w[at] << 2 * BITS) | (w[at + 1] << BITS) | w[at + 2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

    return texts.select("text").mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> list[float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 and more, from how many n-grams have counts 1 to 4."""
    n = {r.c: r["count"] for r in grams.filter("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]


def _level(grams: DataFrame, lower: DataFrame | None, words: int, floor: float) -> tuple[DataFrame, DataFrame]:
    """From (g, c) of n-grams and the probabilities (g, p) of their last n - 1 words: (g, p) and the contexts' (g, weight)."""
    d = discounts(grams)
    cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    x = grams.withColumn("context", F.shiftright("g", BITS)).withColumn("cut", cut)
    weights = x.groupBy("context").agg((F.sum("cut") / F.sum("c")).alias("weight"), F.sum("c").alias("total"))
    x = x.join(weights, "context")
    if lower is None:
        p = F.lit(floor)
    else:
        mask = (1 << BITS * (words - 1)) - 1
        x = x.withColumn("tail", F.col("g").bitwiseAND(F.lit(mask))).join(lower.select(F.col("g").alias("tail"), F.col("p").alias("below")), "tail")
        p = F.col("below")
    return x.select("g", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("weight") * p).alias("p")), weights.select(F.col("context").alias("g"), "weight")


def _thin(a: np.ndarray) -> tuple[bytes, ...]:
    """The first bytes of all numbers compressed, their second bytes, ...: each such plane has its own statistics."""
    planes, zip_ = a.view(np.uint8).reshape(len(a), a.itemsize).T, zstandard.ZstdCompressor(level=3)
    return tuple(zip_.compress(np.ascontiguousarray(p).tobytes()) for p in planes)


def _thick(planes: tuple[bytes, ...], kind: type) -> np.ndarray:
    unzip = zstandard.ZstdDecompressor()
    return np.stack([np.frombuffer(unzip.decompress(p), np.uint8) for p in planes], axis=1).view(kind).ravel()


def _word_columns(g: np.ndarray) -> tuple[tuple[bytes, ...], ...]:
    """Sorted n-gram keys as a column a word, the first as steps: frequent words have small numbers, and so they compress
    better than steps of whole keys."""
    mask = (1 << BITS) - 1
    return tuple(_thin(c.astype(np.int32)) for c in (np.diff(g >> 2 * BITS, prepend=np.int64(0)), (g >> BITS) & mask, g & mask))


def _from_word_columns(columns: tuple[tuple[bytes, ...], ...]) -> np.ndarray:
    first, middle, last = (_thick(c, np.int32).astype(np.int64) for c in columns)
    return (np.cumsum(first) << 2 * BITS) | (middle << BITS) | last


class Table:
    """Sorted keys with float values; a miss gives the default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: float = 0.0):
        o = np.argsort(keys)
        self.keys, self.values, self.default = keys[o], values[o].astype(np.float32), np.float32(default)

    def __getstate__(self):
        return _word_columns(self.keys), _thin(self.values), self.default

    def __setstate__(self, state):
        words, values, self.default = state
        self.keys, self.values = _from_word_columns(words), _thick(values, np.float32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), self.default), np.zeros(len(keys), bool)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[k] == keys
        return np.where(hit, self.values[k], self.default), hit


class Seen:
    """A Bloom filter of keys: two probes, 16 to 32 bits a key."""

    def __init__(self, keys: np.ndarray):
        self.width = max(6, int(16 * len(keys)).bit_length())
        bits = np.zeros(1 << self.width, bool)
        for at in self._probes(keys):
            bits[at] = True
        self.bits = np.packbits(bits)

    def _probes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.view(np.uint64))
        return (h >> np.uint64(64 - self.width)).astype(np.int64), (h & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        a, b = ((self.bits[at >> 3] << (at & 7).astype(np.uint8) & 128) > 0 for at in self._probes(keys))
        return a & b


class Lower:
    """What tasks have of each shard: (Table of each kind but p3, Seen of p3), opened once a worker."""

    def __init__(self, bodies: dict[int, bytes]):
        self.bodies, self.parts = bodies, None

    def __getstate__(self):
        return self.bodies

    def __setstate__(self, bodies):
        self.__init__(bodies)

    def part(self, shard: int) -> tuple[dict[str, Table], Seen]:
        if self.parts is None:
            self.parts = {s: _opened(x) for s, x in self.bodies.items()}
        return self.parts.get(shard) or ({}, Seen(np.zeros(0, np.int64)))


#: Probabilities of one, two and three words; weights of contexts of one and two.
KINDS = ("p1", "p2", "p3", "w1", "w2")


class Model:
    """The vocabulary, and a table of log10 probabilities of seen n-grams and log10 weights of contexts, by shard."""

    def __init__(self, voc: Vocabulary, tri: DataFrame):
        self.voc = voc
        tri = saved(tri, "trigrams")
        mask2, mask1 = (1 << 2 * BITS) - 1, (1 << BITS) - 1
        # continuation counts: how many different words stand before a bigram (before one that begins a document: its own), a word
        begins = F.shiftright("g", BITS).bitwiseAND(F.lit(mask1)) == BEGIN
        bi = saved(tri.groupBy(F.col("g").bitwiseAND(F.lit(mask2)).alias("g")).agg(F.sum(F.when(begins, F.col("c")).otherwise(1)).alias("c")), "bigrams")
        uni = saved(bi.groupBy(F.col("g").bitwiseAND(F.lit(mask1)).alias("g")).agg(F.count("*").alias("c")), "unigrams")
        types = voc.size - 1  # all but the begin
        p1, w0 = _level(uni, None, 1, 1 / types)
        p1 = saved(p1, "p1")
        p2, w1 = _level(bi, p1, 2, 0)
        p2 = saved(p2, "p2")
        p3, w2 = _level(tri, p2, 3, 0)
        rest = w0.first()
        floor = float(np.log10((rest.weight if rest else 1.0) / types))
        middle = {"p3": F.shiftright("g", BITS).bitwiseAND(F.lit(mask1)), "p2": F.shiftright("g", BITS), "w2": F.col("g").bitwiseAND(F.lit(mask1)), "w1": F.col("g")}
        rows = p1.select(F.explode(F.sequence(F.lit(0), F.lit(SHARDS - 1))).alias("shard"), F.lit(KINDS.index("p1")).alias("kind"), "g", F.log10("p").alias("v"))  # the last word may be any
        for kind, df in (("p3", p3), ("p2", p2), ("w2", w2), ("w1", w1)):
            rows = rows.unionByName(df.select((middle[kind] % SHARDS).cast("int").alias("shard"), F.lit(KINDS.index(kind)).alias("kind"), "g", F.log10(df.columns[1]).alias("v")))

        def build(batches):
            parts = [[x.column(k).to_numpy() for k in range(4)] for x in batches]
            if not parts:
                return
            shard, kind, g, v = (np.concatenate(c) for c in zip(*parts, strict=True))
            for s in np.unique(shard).tolist():
                part = {}
                for i, k in enumerate(KINDS):
                    at = np.flatnonzero((shard == s) & (kind == i))
                    part[k] = Table(g[at], v[at], floor if k == "p1" else 0.0)
                lower = {k: t for k, t in part.items() if k != "p3"}, Seen(part["p3"].keys)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_packed(part)], pa.binary()), pa.array([_packed(lower)], pa.binary())], names=["shard", "body", "lower"])

        self.floor = floor
        self.shards = saved(rows.repartition(SHARDS, "shard").mapInArrow(build, "shard int, body binary, lower binary"), "model")
        self.lower = Lower({r.shard: bytes(r.lower) for r in self.shards.select("shard", "lower").collect()})  # SHARDS rows of a model that MAX_BYTES bounds


def _packed(x) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, protocol=5))


def _opened(x: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _backed_off(part: dict[str, Table], floor: float, g: np.ndarray) -> np.ndarray:
    """log10 probabilities of trigrams that the model hasn't seen, from the lower orders of their shard."""
    none = Table(np.zeros(0, np.int64), np.zeros(0))
    get = lambda kind, k: part.get(kind, none).get(k)
    mask2, mask1 = (1 << 2 * BITS) - 1, (1 << BITS) - 1
    two = g & mask2
    p, hit = get("p2", two)
    p = p.astype(np.float64)
    lost = np.flatnonzero(~hit)
    p[lost] = part.get("p1", Table(np.zeros(0, np.int64), np.zeros(0), floor)).get(two[lost] & mask1)[0] + get("w1", two[lost] >> BITS)[0]
    return p + get("w2", g >> BITS)[0]


#: Rows that meet in a shard, in this order: its part of the model, packs of trigrams, sums of what needed no join.
MODEL, PACK, SUMS = range(3)


def pack(voc: Vocabulary, lower: Lower, floor: float, b: Block, keys: np.ndarray):
    """(shard, kind, body) of a block. PACK: its documents' keys, and the shard's trigrams in order with document and
    count, of those that the model may have seen. SUMS: documents' keys, tokens and log10 probabilities of the others."""
    w, doc = voc.numbers(b)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    mask = (1 << BITS) - 1
    g, d, shard = (w[at] << 2 * BITS) | (w[at + 1] << BITS) | w[at + 2], doc[at].astype(np.int32), (w[at + 1] & mask) % SHARDS
    tokens, total = np.zeros(b.n, np.int64), np.zeros(b.n)
    for s in range(SHARDS):
        mine = np.flatnonzero(shard == s)
        part, seen = lower.part(s)
        maybe = seen.maybe(g[mine])
        other, mine = mine[~maybe], mine[maybe]
        tokens += np.bincount(d[other], minlength=b.n)
        total += np.bincount(d[other], weights=_backed_off(part, floor, g[other]), minlength=b.n)
        if not len(mine):
            continue
        mine = mine[np.lexsort((d[mine], g[mine]))]
        h, e = g[mine], d[mine]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h))).astype(np.int32)
        some, e = np.unique(e[first], return_inverse=True)
        yield s, PACK, _packed((keys[some], _word_columns(h[first]), _thin(e.astype(np.int32)), _thin(n)))
    some = np.flatnonzero(tokens)
    if len(some):
        yield int(keys[0]) % SHARDS, SUMS, _packed((keys[some], tokens[some], total[some]))


def unpack_and_sum(part: dict[str, Table], floor: float, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a pack and the model's part of its shard: documents' keys, tokens and log10 probabilities."""
    keys, words, e, n = _opened(body)
    g, e, n = _from_word_columns(words), _thick(e, np.int32), _thick(n, np.int32)
    p, hit = part.get("p3", Table(np.zeros(0, np.int64), np.zeros(0))).get(g)
    p, miss = p.astype(np.float64), np.flatnonzero(~hit)
    p[miss] = _backed_off(part, floor, g[miss])
    return keys, np.bincount(e, weights=n, minlength=len(keys)).astype(np.int64), np.bincount(e, weights=n * p, minlength=len(keys))


def training_ids(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id of the documents that train, at most MAX_TRUSTED of at most MAX_BYTES together."""
    picked = good.filter(F.pmod(F.xxhash64("doc_id", F.lit("hold out")), F.lit(HOLD_OUT)) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRUSTED)
    size = narrow(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
    rows, left = [], MAX_BYTES
    for r in size.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # MAX_TRUSTED rows at most
        if (r.n or 0) <= left:
            rows.append((r.doc_id,))
            left -= r.n or 0
    return docs.sparkSession.createDataFrame(rows, "doc_id bigint")


def train(docs: DataFrame, ids: DataFrame) -> Model:
    """From the texts of these documents (training_ids(), so they may be broadcast)."""
    ship(docs.sparkSession)
    texts = saved(narrow(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"), "trusted")
    voc = vocabulary(texts)
    return Model(voc, trigrams(texts, voc))


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_tokens, log10_p of every document."""
    spark = docs.sparkSession
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // (2 * SHARDS)))
    d = narrow(docs, "doc_id", "lang", "text").withColumn("key", row_key(F.col("text"), F.col("doc_id")))
    voc, lower, floor = spark.sparkContext.broadcast(model.voc), spark.sparkContext.broadcast(model.lower), model.floor

    def packs(batches):
        for x in batches:
            keys = x.column(0).to_numpy()
            for b in blocks(x.column(1)):
                mine = keys[b.first : b.first + b.n]
                salt = int(mine[0]) % salts
                for shard, kind, body in pack(voc.value, lower.value, floor, b, mine):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([salt], pa.int32()), pa.array([kind], pa.int32()), pa.array([body], pa.binary())], names=["shard", "salt", "kind", "body"])

    sent = d.select("key", "text").mapInArrow(packs, "shard int, salt int, kind int, body binary")
    parts = model.shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(MODEL).alias("kind"), "body")
    both = parts.unionByName(sent).repartition(SHARDS * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def join(batches):
        part, of = {}, None
        for x in batches:
            shard, salt, kind = (x.column(i).to_pylist() for i in range(3))
            for i in range(x.num_rows):
                if (shard[i], salt[i]) != of:
                    part, of = {}, (shard[i], salt[i])
                body = x.column(3)[i].as_py()
                if kind[i] == MODEL:
                    part = _opened(body)
                else:
                    sums = unpack_and_sum(part, floor, body) if kind[i] == PACK else _opened(body)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, sums)), names=["key", "n", "p"])

    sums = both.select("shard", "salt", "kind", "body").mapInArrow(join, "key bigint, n bigint, p double").groupBy("key").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    # rows of one id and text share a key: each has its part of their sum
    rows = d.select("doc_id", "lang", "key").withColumn("rows", F.count("*").over(Window.partitionBy("key")))
    return rows.join(sums, "key").select("doc_id", "lang", F.round(F.col("n") / F.col("rows")).cast("bigint").alias("n_tokens"), (F.col("p") / F.col("rows")).alias("log10_p"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, score, threshold, kept of every document."""
    good = saved(trusted(labels), "trusted")
    ids = training_ids(docs, good)
    model = train(docs, ids)
    scored = saved(perplexities(docs, model), "scored")
    mean = -F.col("log10_p") / F.col("n_tokens")
    held = scored.join(good.join(F.broadcast(ids), "doc_id", "left_anti"), "doc_id", "left_semi")
    if held.isEmpty():  # too few trusted documents: the model is calibrated on what it was trained on
        held = scored.join(good, "doc_id", "left_semi")
    held = held.filter("n_tokens > 1").withColumn("mean", mean)
    of = {r.lang: r for r in held.rollup("lang").agg(F.count("*").alias("n"), F.percentile_approx("mean", 0.5, ACCURACY).alias("median"), F.grouping("lang").alias("all")).collect() if r["all"] or r.lang is not None}
    whole = of.get(None)
    if whole is None or not whole.n:
        none = F.lit(None).cast("double")
        return scored.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), mean).alias("perplexity"), mean.alias("score"), none.alias("threshold"), (F.col("n_tokens") > 1).alias("kept"))
    median = F.lit(whole.median)
    langs = [r for r in of.values() if r.lang is not None and r.n >= MIN_CALIBRATION]
    for r in langs:
        median = F.when(F.col("lang") == r.lang, r.median).otherwise(median)
    score = (-F.col("log10_p") + PRIOR * median) / (F.col("n_tokens") + PRIOR)
    cuts = {r.lang: r.q for r in held.withColumn("score", score).rollup("lang").agg(F.percentile_approx("score", QUANTILE, ACCURACY).alias("q"), F.grouping("lang").alias("all")).collect() if r["all"] or r.lang is not None}
    threshold = F.lit(cuts[None] * SLACK)
    for r in langs:
        threshold = F.when(F.col("lang") == r.lang, cuts[r.lang] * SLACK).otherwise(threshold)
    out = scored.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), mean).alias("perplexity"), score.alias("score"), threshold.alias("threshold"))
    return out.withColumn("kept", (F.col("n_tokens") > 1) & (F.col("score") <= F.col("threshold")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
