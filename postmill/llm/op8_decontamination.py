"""Benchmark decontamination: every passage of the documents queries a BM25 index of benchmark items.

Words are runs of letters and digits, lower-cased (bytes past ASCII count as letters; a character from U+3000 on is a
word of its own). An item of more than PART words is indexed as overlapping parts of PART words, so that each fits
into one passage; shorter items are one part. A part's term weights are its BM25 weights divided by their sum, so a
passage with all of a part's words scores 1 against it. Passages are PASSAGE words long and begin every PASSAGE / 2.

Retrieval is block-max WAND over numpy arrays of many passages at once. The terms in most blocks of parts whose
greatest weights sum to at most LIGHT together cannot make a candidate: their lists stay closed and count by
that bound. The other terms' block maxima (ITEM_BLOCK parts a block) are summed for every half passage, and
a passage's block is opened only if both halves' sums and the bound reach THRESHOLD. What is left is scored
exactly with all terms, and everything at or above the threshold is retrieved.

A retrieved item is verified where it would stand in the document as a whole (the passage, half a passage on each
side, and what its other parts take up, with a quarter more): idf-weighted overlap of the question (its first two
thirds) and of the answer (the rest), and a common run of RUN words. Items of fewer words are verified by their whole
sequence of words; one of a single word has no answer to verify.

Items are dealt to shards of about SHARD parts. A task builds each shard's index; one shard at a time goes to all
tasks (SHARD bounds what is broadcast), and more items mean more passes. Each shard's matches are written once; the
pipeline's stage writes the keys of matched rows and drops these from its input once.

Defined cases: null and empty documents match nothing, items without words are left out. Equal items match alike, each
under its id (null too); equal scores are all retrieved. A row without doc_id has rows without one. Repeated rows each
get their rows. Extra columns are not read; an empty table on either side gives no rows. A text takes about 60 bytes of
memory for each of its own while its task works on it.
"""

from __future__ import annotations

import pickle
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.blocks import Block, Words, blocks, distinct, grams
from postmill.llm.common import documents, narrow, saved, ship, text_digest, without

PASSAGE, ITEM_BLOCK, RUN = 128, 4, 5
LIGHT, CELLS = 0.1, 4_000_000
K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER = 0.5, 0.7, 0.6
SHARD = 20_000
STEP = PART = PASSAGE // 2

NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of start[i]:end[i], and the i of each."""
    n = end - start
    i = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[i], i


def item_words(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for b in blocks(texts):
        w = Words(b, lower=True, space=NOT_WORD, alone=True)
        out += [w.h[i:j] for i, j in zip(w.off[:-1], w.off[1:], strict=True)]
    return out


def part_starts(n: int) -> list[int]:
    """Where the parts of an item of n words begin."""
    return [0] if n <= PART else [*range(0, n - PART, PART // 2), n - PART]


class Index:
    """Items' parts in blocks of ITEM_BLOCK; postings by term and part with block maxima."""

    def __init__(self, ids: list, texts: list[str], whole: tuple[int, float, dict[int, int]] | None = None):
        """whole: if these are a shard, the number of all parts, their mean length, and how many have each term."""
        words = item_words(pa.array(texts, pa.string()))
        long = [i for i, w in enumerate(words) if len(w)]
        self.ids, self.words = [ids[i] for i in long], [words[i] for i in long]
        parts = [(i, at) for i, w in enumerate(self.words) for at in part_starts(len(w))]
        self.part_item, self.part_at = (np.array(x, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        self.n = n = len(parts)
        pieces = [self.words[i][at : at + PART] for i, at in parts]
        self.terms, tid = np.unique(np.concatenate([*pieces, np.zeros(0, np.uint64)]), return_inverse=True)
        size = np.array([len(w) for w in pieces], np.int64)
        item = np.repeat(np.arange(n), size)
        key, tf = np.unique(tid * max(n, 1) + item, return_counts=True)
        term, item = key // max(n, 1), key % max(n, 1)  # sorted by term, then part
        df = np.bincount(term, minlength=len(self.terms))
        count, mean = (n, max(size.mean(), 1) if n else 1)
        if whole:
            count, mean, df = whole[0], whole[1], np.array([whole[2][t] for t in self.terms.view(np.int64).tolist()], np.int64)
        self.idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        weight /= np.bincount(item, weights=weight, minlength=n)[item]
        self.item, self.weight = item, weight
        self.n_blocks = -(-n // ITEM_BLOCK) or 1
        # postings of one term and block: first[k]:first[k + 1], their maximum best[k]
        block = term * self.n_blocks + item // ITEM_BLOCK
        self.block_key, first = np.unique(block, return_index=True)
        self.first = np.append(first, len(block))
        self.best = np.maximum.reduceat(weight, first) if len(block) else np.zeros(0)
        self.blocks_of = np.searchsorted(self.block_key, np.arange(len(self.terms) + 1) * self.n_blocks)
        self.top = np.zeros(len(self.terms))
        np.maximum.at(self.top, term, weight)
        wide = np.argsort(-np.diff(self.blocks_of), kind="stable")
        wide = wide[np.cumsum(self.top[wide]) <= LIGHT]
        self.light = np.zeros(len(self.terms), bool)
        self.light[wide] = True
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.runs = [distinct(grams(w, min(RUN, len(w)))) for w in self.words]

    def term_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their numbers."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.terms) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        ok = self.terms[t] == h[at]
        return at[ok], t[ok]

    def retrieve(self, half: np.ndarray, term: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """half, term: distinct pairs, sorted. second[h]: the other half of the passage that begins with h, h itself
        for one that has no other, -1 for none. All (passage's first half, part, score) at or above THRESHOLD."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS // self.n_blocks)
        for h in range(0, len(second), step):  # some halves at a time, and the one after them
            lo, hi = np.searchsorted(half, [h, h + step + 1])
            near = second[h : h + step]
            out.append(self._retrieve(half[lo:hi] - h, term[lo:hi], np.where(near >= 0, near - h, -1)))
            out[-1][0][:] += h
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _retrieve(self, half: np.ndarray, term: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, n = THRESHOLD - 1e-9, len(second) + 1
        light = self.light[term]
        rest = np.bincount(half[light], weights=self.top[term[light]], minlength=n)
        t = term[~light]
        k, i = _ranges(self.blocks_of[t], self.blocks_of[t + 1])
        best = np.bincount(half[~light][i] * self.n_blocks + self.block_key[k] % self.n_blocks, weights=self.best[k], minlength=n * self.n_blocks).reshape(n, self.n_blocks)
        p = np.flatnonzero(second >= 0)
        other = second[p]
        two = other != p
        bound = best[p] + best[other] * two[:, None] + np.minimum(rest[p] + rest[other] * two, LIGHT)[:, None]
        at, block = np.nonzero(bound >= low)
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first = np.searchsorted(half, np.arange(n + 1))
        a, b = p[at], other[at]  # the terms of both halves of the passages that are left, each once
        j, x = _ranges(first[a], first[a + 1])
        j2, x2 = _ranges(first[b], first[b + 1])
        key = distinct(np.concatenate([x * len(self.terms) + term[j], x2 * len(self.terms) + term[j2]]))
        x, t = key // len(self.terms), key % len(self.terms)
        want = t * self.n_blocks + block[x]
        k = np.minimum(np.searchsorted(self.block_key, want), len(self.block_key) - 1)
        ok = self.block_key[k] == want
        k, x = k[ok], x[ok]
        q, j = _ranges(self.first[k], self.first[k + 1])
        key, place = np.unique(a[x[j]] * self.n + self.item[q], return_inverse=True)
        score = np.bincount(place, weights=self.weight[q])
        ok = score >= low
        return key[ok] // self.n, key[ok] % self.n, score[ok]

    def overlaps(self, item: int, around: np.ndarray) -> tuple[float, float, bool]:
        """idf-weighted overlap of the question and of the answer with the words around, and a common run."""
        w = self.words[item]
        cut = -(-2 * len(w) // 3)
        there = np.isin(w, around)
        idf = self.idf[np.searchsorted(self.terms, w)]
        share = lambda c: float((idf[c] * there[c]).sum() / idf[c].sum()) if len(idf[c]) else 1.0
        run = bool(np.isin(grams(around, min(RUN, len(w))), self.runs[item]).any())
        return share(slice(0, cut)), share(slice(cut, None)), run


def search(index: Index, b: Block) -> list[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of verified items, each once a document."""
    w = Words(b, lower=True, space=NOT_WORD, alone=True)
    at, term = index.term_ids(w.h)
    if not len(at):
        return []
    doc = w.doc[at]
    halves = -(-w.n // STEP)
    base = np.cumsum(halves) - halves
    key = distinct((base[doc] + (at - w.off[doc]) // STEP) * len(index.terms) + term)
    second = np.arange(1, int(halves.sum()) + 1)
    last = (base + halves - 1)[halves > 0]
    second[last] = np.where(halves[halves > 0] == 1, last, -1)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    seen: dict[tuple[int, int, int], tuple[float, float, bool]] = {}
    for q, part, score in zip(*(x.tolist() for x in index.retrieve(key // len(index.terms), key % len(index.terms), second)), strict=True):
        d, item = int(np.searchsorted(base, q, "right")) - 1, int(index.part_item[part])
        start, size = int(w.off[d]) + (q - int(base[d])) * STEP, len(index.words[item])
        before, slack = int(index.part_at[part]), STEP + max(0, size - PART) // 4
        lo = max(int(w.off[d]), start - before - slack)
        hi = min(int(w.off[d + 1]), start + PASSAGE + max(0, size - before - PART) + slack)
        if (item, lo, hi) not in seen:
            seen[item, lo, hi] = index.overlaps(item, w.h[lo:hi])
        question, answer, run = seen[item, lo, hi]
        if run and question >= QUESTION and answer >= ANSWER:
            found[d, item] = max(found.get((d, item), (0.0, 0.0, 0.0)), (score, question, answer))
    return [(d, item, *v) for (d, item), v in found.items()]


def indexes(benchmark: DataFrame) -> DataFrame:
    """(shard, index): a row for each shard, its pickled index. Shards are built in tasks, from their own items and
    the numbers over all items that weights take."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def lengths(batches):
        for x in batches:
            n = [p for w in item_words(x.column(0)) if len(w) for p in (min(len(w), PART),) * len(part_starts(len(w)))]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n", "words"])

    n, size = items.select("text").mapInArrow(lengths, "n bigint, words bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD))
    rows = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard"), "item_id", "text")
    if shards > 1:  # weights are those of one index over all items: shards get their terms' counts too

        def terms(batches):
            for x in batches:
                of, h = [], [np.zeros(0, np.uint64)]
                for shard, w in zip(x.column(0).to_pylist(), item_words(x.column(2)), strict=True):
                    for at in part_starts(len(w)):
                        h.append(np.unique(w[at : at + PART]))
                        of += [shard] * len(h[-1])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate(h).view(np.int64))], names=["shard", "term"])

        by_shard = saved(rows.mapInArrow(terms, "shard bigint, term bigint").groupBy("shard", "term").count(), "terms")
        total = by_shard.groupBy("term").agg(F.sum("count").alias("df"))
        known = by_shard.join(total, "term").select("shard", F.lit(None).cast("bigint").alias("item_id"), F.lit(None).cast("string").alias("text"), "term", "df")
        rows = rows.select("*", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("bigint").alias("df")).unionByName(known)
    else:
        rows = rows.select("*", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("bigint").alias("df"))

    def build(batches):
        held: dict[int, tuple[list, dict]] = {}
        for x in batches:
            for shard, item_id, text, term, df in zip(*(c.to_pylist() for c in x.columns), strict=True):
                own = held.setdefault(shard, ([], {}))
                if text is None:
                    own[1][term] = df
                else:
                    own[0].append((item_id is None, item_id or 0, text))
        for shard, (own, df) in held.items():
            own.sort()
            index = Index([None if none else i for none, i, _ in own], [t for *_, t in own], (n, max(size / n, 1), df) if shards > 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([zstandard.ZstdCompressor().compress(pickle.dumps(index))], pa.binary())], names=["shard", "index"])

    return saved(rows.repartition(shards, "shard").mapInArrow(build, "shard bigint, index binary"), "index")


@lru_cache(1)
def _opened(packed: bytes) -> Index:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _by_shard(benchmark: DataFrame):
    """Each shard's packed index as a broadcast, one at a time."""
    table = indexes(benchmark)
    for r in table.select("shard").orderBy("shard").collect():
        packed = table.filter(F.col("shard") == r.shard).first()["index"]
        yield benchmark.sparkSession.sparkContext.broadcast(bytes(packed))


SCHEMA = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    ship(docs.sparkSession)
    parts = []
    for packed in _by_shard(benchmark):

        def run(batches, packed=packed):
            index = _opened(packed.value)
            for x in batches:
                for b in blocks(x.column(1)):
                    hits = search(index, b)
                    cols = list(zip(*hits, strict=True)) or [()] * 5
                    ids = x.column(0).take(pa.array([b.first + d for d in cols[0]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in cols[1]], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        if parts:  # what the shard before found is written, so that its index can go
            parts[-1] = saved(parts[-1], "matches")
        parts.append(narrow(docs, "doc_id", "text").mapInArrow(run, SCHEMA))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _matched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key of the rows (key, text) with a verified item, each shard's written once."""
    parts = []
    for packed in _by_shard(benchmark):

        def run(batches, packed=packed):
            index = _opened(packed.value)
            for x in batches:
                for b in blocks(x.column(1)):
                    hit = {b.first + d for d, *_ in search(index, b)}
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(sorted(hit), pa.int64()))], names=["key"])

        parts.append(saved(docs.mapInArrow(run, "key string"), "matched"))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else docs.select("key").limit(0)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with no verified benchmark item."""
    ship(spark)
    text = F.col("text").cast("string")
    return without(docs, _matched(docs.select(text_digest(text).alias("key"), text.alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
