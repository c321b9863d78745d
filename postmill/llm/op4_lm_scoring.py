"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Units: the document end, the TOP most frequent words, and CLASSES classes of all other words (by a word's last two
bytes). A unit's score in the context of the two units before it is Q[u] . (C1 R[u1] + C2 R[u2]) + b[u]. Probabilities
are normalised exactly: batched matrix products over all pairs of context units, dealt to tasks, give a table of log
partition sums, so a token costs a dot product and a look-up. A word of a class then has its smoothed share of the
class's training count, with one share for unknown words.

Training: the tokens of all training documents are dealt, in pieces, to shards of about SHARD_TOKENS tokens; every
shard trains in numpy from the same start by noise-contrastive estimation, with noise units drawn from their
frequencies and shared by a minibatch, and the shards' parameters are averaged by a grouped aggregation (a context's
vector by how often each shard saw it).

Counts cover all training tokens. A bounded sample (SAMPLE_DOCS) only decides which words (FREQUENT at most)
are counted by position in each task; occurrences of all other words are shuffled by word, counted there,
and come back as one partial sum a document. The sample decides how much is shuffled, not any count; which of its
words are units is decided by their counts over all training tokens.

Defined cases: a null or empty text is one token, the end. A null doc_id is a training document. Rows with
equal id and text score alike, each in its own row. Words of equal count are ranked by their place in the sample, and
there by hash. Without training tokens every word is unknown and the base score is 0. Extra columns are not read; an
empty table gives no rows. A text takes about 60 bytes of memory for each of its own while its task works on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.blocks import HashTable, Words, blocks, mix
from postmill.llm.common import documents, narrow, row_key, saved, ship

SAMPLE_DOCS, FREQUENT = 20_000, 120_000
TOP, CLASSES = 960, 63
UNITS = 1 + TOP + CLASSES
WIDTH = 32
#: Training tokens of a shard, about (never over twice as many), and of a piece of a document.
SHARD_TOKENS, PIECE = 1 << 21, 1 << 16
BATCH, NOISE, RATE = 1024, 64, 0.4


def _with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key, train, text."""
    d = narrow(docs, "doc_id", "text")
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    return d.select("doc_id", row_key(F.col("text"), F.col("doc_id")).alias("key"), train.alias("train"), "text")


def _classes(b, w: Words) -> np.ndarray:
    """The class of each word, from its last two bytes, lower-cased."""
    one = np.where((b.data[w.end - 1] >= 65) & (b.data[w.end - 1] < 91), b.data[w.end - 1] + 32, b.data[w.end - 1]).astype(np.uint64)
    two = b.data[np.maximum(w.end - 2, w.start)]
    two = np.where((two >= 65) & (two < 91), two + 32, two).astype(np.uint64)
    return (mix(one * np.uint64(256) + two) % np.uint64(CLASSES)).astype(np.int64)


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words of a bounded sample of training documents, most frequent first."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    picked = docs.filter("train").filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)).select("text")

    def run(batches):
        for x in batches:
            for b in blocks(x.column(0)):
                h, n = np.unique(b.words(lower=True).h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    top = picked.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64)


class Lexicon:
    """Frequent words by hash."""

    def __init__(self, hashes: np.ndarray):
        self.table = HashTable(hashes)
        self.size = len(hashes)
        self.rank_by(np.zeros(self.size))

    def rank_by(self, count: np.ndarray) -> None:
        """The words with the highest counts are units of their own."""
        self.rank = np.full(self.size + 1, 1 << 40)  # its last: no frequent word
        self.rank[np.lexsort((np.arange(self.size), -count))] = np.arange(self.size)

    def find(self, b, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word: its index among the frequent ones or -1, its class."""
        return self.table.find(w.h), _classes(b, w)

    def units(self, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The unit of each word."""
        rank = self.rank[at]
        return np.where(rank < TOP, rank + 1, 1 + TOP + cls)


def counts(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(kind, k, x, y): 0: frequent word k // 64, of class k % 64: its training count in x (-1: training documents).
    1: document key k: of its other words, the sum of log10(c + 0.5) in x, how many are known in y.
    2: class k: its other distinct training words in x, their count in y."""

    def run(batches):
        own, of, ends = np.zeros(lex.size, np.int64), np.zeros(lex.size, np.int64), 0
        names = ["h", "kind", "k", "n"]
        for x in batches:
            train_all = x.column(1).to_numpy(zero_copy_only=False).astype(bool)
            keys_all = x.column(0).to_numpy()
            ends += int(train_all.sum())
            for b in blocks(x.column(2)):
                w = b.words(lower=True)
                at, cls = lex.find(b, w)
                train, keys = train_all[b.first : b.first + b.n], keys_all[b.first : b.first + b.n]
                mine = at >= 0
                of[at[mine]] = cls[mine]
                mine &= train[w.doc]
                own += np.bincount(at[mine], minlength=lex.size)
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    order = rare[np.lexsort((w.h[rare], w.doc[rare]))]
                    h, d = w.h[order], w.doc[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    start = np.flatnonzero(new)
                    d, n = d[start], np.diff(np.append(start, len(order)))
                    kind = (1 + cls[order[start]]) * np.where(train[d], 1, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(keys[d]), pa.array(n)], names=names)
        at = np.flatnonzero(own)
        h = np.append(lex.table.hashes[at].view(np.int64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.zeros(len(h), np.int32)), pa.array(np.append(at * 64 + of[at], -1)), pa.array(np.append(own[at], ends))], names=names)

    seen = docs.select("key", "train", "text").mapInArrow(run, "h bigint, kind int, k bigint, n bigint")
    word = Window.partitionBy("h")
    c = F.sum(F.when(F.col("kind") > 0, F.col("n")).otherwise(0)).over(word)
    seen = seen.withColumn("i", F.row_number().over(word.orderBy("kind"))).withColumn("c", c)
    row = lambda kind, k, x, y: F.struct(F.lit(kind).alias("kind"), k.alias("k"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    n, c, kind = F.col("n"), F.col("c"), F.col("kind")
    of_doc = row(1, F.col("k"), n * F.log10(c + 0.5), F.when(c > 0, n).otherwise(0))
    of_class = row(2, (F.abs(kind) - 1).cast("bigint"), F.lit(1), c)
    out = F.when(kind == 0, F.array(row(0, F.col("k"), n, F.lit(0)))).when((F.col("i") == 1) & (c > 0), F.array(of_doc, of_class)).otherwise(F.array(of_doc))
    out = seen.select(F.explode(out).alias("r")).select("r.*")
    return out.groupBy("kind", "k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


class Totals:
    """What scoring needs of the training counts; its size is bounded by FREQUENT. Ranks the lexicon's words."""

    def __init__(self, lex: Lexicon, table: DataFrame):
        self.count = np.zeros(lex.size + 1)  # its last: no frequent word
        cls = np.zeros(lex.size, np.int64)
        self.docs, distinct, in_class = 0.0, np.zeros(CLASSES), np.zeros(CLASSES)
        for r in table.filter("kind <> 1").collect():
            if r.kind == 2:
                distinct[r.k], in_class[r.k] = r.x, r.y
            elif r.k < 0:
                self.docs += r.x
            else:
                self.count[r.k // 64], cls[r.k // 64] = r.x, r.k % 64
        lex.rank_by(self.count[:-1])
        known = self.count[:-1] > 0
        self.tokens = self.docs + self.count.sum() + in_class.sum()
        self.types = (self.docs > 0) + known.sum() + distinct.sum()
        tail = np.flatnonzero(known & (lex.rank[:-1] >= TOP))
        words = distinct + np.bincount(cls[tail], minlength=CLASSES)
        total = in_class + np.bincount(cls[tail], weights=self.count[tail], minlength=CLASSES)
        #: log10 of each class's mass: its count, half for each word, half for the unknown ones.
        self.class_mass = np.log10(total + 0.5 * (words + 1))
        units = np.zeros(UNITS)
        units[0] = self.docs
        top = np.flatnonzero(lex.rank[:-1] < TOP)
        units[1 + lex.rank[top]] = self.count[top]
        units[1 + TOP :] = total
        self.unit_share = (units + 0.5) / (units + 0.5).sum()
        self.log_denominator = np.log10(self.tokens + 0.5 * (self.types + 1))


def _token_stream(w: Words, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's units, each document's end (0) after its words; those one and two before; each one's document."""
    ends = w.off[1:] + np.arange(n)
    is_word = np.ones(len(unit) + n, bool)
    is_word[ends] = False
    c = np.zeros(len(is_word) + 2, np.int64)
    c[2:][is_word] = unit
    two = c[:-2].copy()
    two[w.off[:-1] + np.arange(n)] = 0  # a document's first token has only ends before it
    return c[2:], c[1:-1], two, np.repeat(np.arange(n), w.n + 1)


def start_model(unit_share: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(4)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"R": small(UNITS, WIDTH), "Q": small(UNITS, WIDTH), "C1": np.eye(WIDTH, dtype=np.float32), "C2": 0.5 * np.eye(WIDTH, dtype=np.float32), "b": np.log(unit_share).astype(np.float32).reshape(-1, WIDTH)}


def _summed(at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places in at, and the sum of each one's gradients."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(g[order], first, axis=0)


def train_shard(model: dict[str, np.ndarray], unit_share: np.ndarray, u: np.ndarray, one: np.ndarray, two: np.ndarray) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation with Adagrad over (two, one -> u), minibatches in a fixed random order."""
    m = {k: v.copy() for k, v in model.items()}
    past = {k: np.full_like(v, 1e-2) for k, v in m.items()}
    rng = np.random.default_rng(len(u))
    log_q = np.log(unit_share).astype(np.float32) + np.float32(np.log(NOISE))
    steps = np.cumsum(unit_share)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    order = rng.permutation(len(u))
    for s in range(0, len(u), BATCH):
        at = order[s : s + BATCH]
        t, w1, w2 = u[at], one[at], two[at]
        noise = np.minimum(np.searchsorted(steps, rng.random(NOISE)), UNITS - 1)
        r1, r2, Q, b = m["R"][w1], m["R"][w2], m["Q"], m["b"].ravel()
        p = r1 @ m["C1"].T + r2 @ m["C2"].T
        qt, qn = Q[t], Q[noise]
        gt = sigmoid((p * qt).sum(1) + b[t] - log_q[t]) - 1
        gn = sigmoid(p @ qn.T + (b - log_q)[noise])
        gp = gt[:, None] * qt + gn @ qn
        grads = {
            "Q": _summed(np.concatenate([t, noise]), np.concatenate([gt[:, None] * p, gn.T @ p])),
            "R": _summed(np.concatenate([w1, w2]), np.concatenate([gp @ m["C1"], gp @ m["C2"]])),
            "C1": (slice(None), gp.T @ r1),
            "C2": (slice(None), gp.T @ r2),
            "b": _summed(np.concatenate([t, noise]), np.concatenate([gt, gn.sum(0)])),
        }
        for k, (i, g) in grads.items():
            g = g * np.float32(1 / len(at))
            have, past_k = (m[k].ravel(), past[k].ravel()) if k == "b" else (m[k], past[k])  # b's rows are views of its values
            past_k[i] += g * g
            have[i] -= np.float32(RATE) * g / np.sqrt(past_k[i])
    return m


def train(docs: DataFrame, lex: Lexicon, tokens: float, unit_share: np.ndarray) -> dict[str, np.ndarray]:
    """The averaged model of all shards. tokens: how many there are to train on."""
    start = start_model(unit_share)
    parts = list(start)
    first = np.cumsum([0] + [len(start[k]) for k in parts])
    shards = max(1, int(-(-tokens // SHARD_TOKENS)))

    def pieces(batches):
        for x in batches:
            for b in blocks(x.column(1)):
                w = b.words(lower=True)
                u, one, two, doc = _token_stream(w, lex.units(*lex.find(b, w)), b.n)
                off = np.searchsorted(doc, np.arange(b.n + 1))
                of, i, body = [], [], []
                for d in range(b.n):
                    for k, at in enumerate(range(int(off[d]), int(off[d + 1]), PIECE)):
                        cut = slice(at, min(at + PIECE, int(off[d + 1])))
                        of.append(b.first + d)
                        i.append(k)
                        body.append(np.stack([u[cut], one[cut], two[cut]]).astype(np.int16).tobytes())
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(of, pa.int64())), pa.array(i, pa.int32()), pa.array(body, pa.binary())], names=["key", "piece", "t"])

    def learn(batches):
        held, size = [], 0

        def model():
            u, one, two = np.concatenate(held, axis=1).astype(np.int64)
            m = train_shard(start, unit_share, u, one, two)
            n = {k: np.full(len(v), float(len(u))) for k, v in m.items()}
            n["R"] = np.bincount(np.concatenate([one, two]), minlength=UNITS) + 1e-6
            n = np.concatenate([n[k] for k in parts])
            rows = np.concatenate([m[k] for k in parts]) * n[:, None]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["i", "v", "n"])

        for x in batches:
            for v in x.column(2):
                held.append(np.frombuffer(v.as_buffer(), np.int16).reshape(3, -1))
                size += held[-1].shape[1]
                if size > 2 * SHARD_TOKENS - PIECE:
                    yield model()
                    held, size = [], 0
        if size:
            yield model()

    dealt = docs.filter("train").select("key", "text").mapInArrow(pieces, "key bigint, piece int, t binary").repartition(shards, "key", "piece").sortWithinPartitions("key", "piece")
    learned = dealt.mapInArrow(learn, "i bigint, v array<double>, n double")
    mean = learned.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) / F.sum("n") for j in range(WIDTH)]).alias("v")).orderBy("i").collect()
    if not mean:
        return start
    rows = np.array([r.v for r in mean], np.float32)
    return {k: rows[first[j] : first[j + 1]] for j, k in enumerate(parts)}


class Network:
    """The trained parameters, ready to score."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.a1, self.a2, self.q, self.bias = model["R"] @ model["C1"].T, model["R"] @ model["C2"].T, model["Q"], model["b"].ravel()

    def partition_sums(self, two: np.ndarray) -> np.ndarray:
        """log of the sum over all units, for these units two before and each unit one before."""
        out = np.empty((len(two), UNITS), np.float32)
        for i, k in enumerate(two):
            s = (self.a1 + self.a2[k]) @ self.q.T + self.bias
            top = s.max(1)
            out[i] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def normalised(self, spark: SparkSession) -> Network:
        """With the table of log partition sums, of UNITS * UNITS numbers, made in tasks."""

        def run(batches):
            for x in batches:
                two = x.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([r.tobytes() for r in self.partition_sums(two)], pa.binary())], names=["two", "z"])

        tasks = spark.sparkContext.defaultParallelism
        rows = spark.range(0, UNITS, 1, min(UNITS, 4 * tasks)).toDF("two").mapInArrow(run, "two bigint, z binary").orderBy("two").collect()
        self.log_z = np.stack([np.frombuffer(r.z, np.float32) for r in rows])
        return self

    def log_p(self, u: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probability of each unit after its contexts."""
        p = np.empty(len(u), np.float32)
        for at in range(0, len(u), 1 << 15):
            c = slice(at, at + (1 << 15))
            p[c] = np.einsum("ij,ij->i", self.a1[one[c]] + self.a2[two[c]], self.q[u[c]]) + self.bias[u[c]] - self.log_z[two[c], one[c]]
        return p


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    ship(docs.sparkSession)
    docs = _with_keys(docs)
    lex = Lexicon(frequent_words(docs))
    table = saved(counts(docs, lex), "counts")
    tot = Totals(lex, table)
    return scored(docs, lex, table, tot, Network(train(docs, lex, tot.tokens, tot.unit_share)).normalised(docs.sparkSession))


def scored(docs: DataFrame, lex: Lexicon, table: DataFrame, tot: Totals, network: Network) -> DataFrame:
    """score(), from what was learned."""
    log_c, known = np.log10(tot.count + 0.5), tot.count > 0
    log_c[-1] = 0  # other words: their sums come from the table
    end, end_known, mass = np.log10(tot.docs + 0.5), int(tot.docs > 0), tot.class_mass
    nats = 1 / np.log(10)

    def run(batches):
        for x in batches:
            for b in blocks(x.column(3)):
                w = b.words(lower=True)
                at, cls = lex.find(b, w)
                unit = lex.units(at, cls)
                u, one, two, doc = _token_stream(w, unit, b.n)
                base = np.bincount(w.doc, weights=log_c[at], minlength=b.n) + end
                shares = np.where(unit > TOP, log_c[at] - mass[cls], 0)
                own = np.bincount(doc, weights=network.log_p(u, one, two), minlength=b.n) * nats + np.bincount(w.doc, weights=shares, minlength=b.n)
                yield pa.RecordBatch.from_arrays(
                    [*(x.column(k).slice(b.first, b.n) for k in range(3)), pa.array(w.n + 1), pa.array(np.bincount(w.doc[known[at]], minlength=b.n) + end_known), pa.array(base), pa.array(own)],
                    names=["doc_id", "key", "train", "n_tokens", "n", "base", "own"],
                )

    mine = docs.mapInArrow(run, "doc_id bigint, key bigint, train boolean, n_tokens bigint, n bigint, base double, own double")
    rest = table.filter("kind = 1").select(F.col("k").alias("key"), "x", "y")
    both = mine.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).join(rest, "key", "left")
    x, y = F.coalesce(F.col("x") / F.col("rows"), F.lit(0.0)), F.coalesce(F.col("y") / F.col("rows"), F.lit(0.0))
    return both.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n") + F.round(y).cast("bigint")).alias("n_known"),
        F.lit(int(tot.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + x - F.col("n_tokens") * F.lit(float(tot.log_denominator))).alias("base_score"),
        (F.col("own") + x).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
