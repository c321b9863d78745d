"""Divergence of sources by mergeable radix tries over the bytes of terms.

1. A task counts its documents' terms in one byte-wise radix trie a language. A leaf counts the documents that hold the
   term and the term's occurrences in each source. A trie that reaches MAX_COUNTERS counters is written out and a new
   one begun, so memory is bounded; a traversal in UTF-8 order writes its leaves.
2. Tries are merged by prefix range: leaves are dealt by ranges of (language, term), and one pass over a range in UTF-8
   order sums the counters of equal leaves. A very common term has one leaf a trie, whatever its occurrences.
3. A second traversal of the merged leaves streams partial sums of the sources' pairs, and for every source the
   candidates among its terms, of which a task keeps the first TOP (ties: the UTF-8 order of terms).

A pair's sum over all V terms needs only the terms that both sources have. With f(a, b) the function of two shares and
a0 a source's share of a term that it doesn't have,
    sum f = sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)] + sum over terms of g f(p, q0)
          + sum over terms of s f(p0, q) + (V - |g| - |s|) f(p0, q0).
The first part comes from the traversal; the others from how many terms of a source have which count, in SQL.

All numbers are whole: floor(10**9 * (count + 1) / (N + V)) is divided three digits at a time in 64 bits, which is exact
while N + V is below 9 * 10**15 (checked). The sources' totals (as many rows as sources, while the result has their
square) reach the tasks as a broadcast up to MAX_GROUPS rows; beyond it they are joined to the counters.

Defined cases: a null text, lang or source is the empty string. Repeated rows and null ids count once each. A language
whose terms are all too rare has V = 0: its pairs have value 0, and it has no term rows. A source without a kept term
has pairs like all others. A source alone in its language has no pairs. Extra columns are not read; an empty table
gives no rows. A very long text is read in pieces of PIECE bytes (and the rest of a term), and only its different terms are kept.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postmill.llm.common import documents, narrow, saved, ship

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
PIECE = 1 << 20
SCALE = 10**9
HEAD = 4
MIN_DOCS = 3
TOP = 200
#: Entries that wait for their trie, so that a term goes there once for many documents (about 150 bytes each).
MAX_WAITING = 1 << 18
#: Counters of a task's tries (about 300 bytes each, with their terms), rows of an Arrow batch, pairs at a time, pairs' sums of a task, and groups to broadcast.
MAX_COUNTERS, ROWS, PAIRS, MAX_SUMS, MAX_GROUPS = 1 << 20, 2000, 1 << 21, 1 << 20, 100_000
LEAF = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


class Node:
    """edges: first byte -> (the edge's bytes, the node below it). counts: occurrences by source, where a term ends here."""

    __slots__ = ("edges", "counts", "docs")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, Node]] | None = None
        self.counts: dict[str, int] | None = None
        self.docs = 0


class RadixTrie:
    """Terms by their bytes; an edge holds all bytes up to the next branch or the end of a term. The first HEAD bytes are one
    edge of the root. ends: the leaves by term, so that only a new term is walked down to its place."""

    def __init__(self):
        self.roots: dict[bytes, Node] = {}
        self.ends: dict[bytes, Node] = {}
        self.counters = 0

    def leaf(self, term: bytes) -> Node:
        """The node at which the term ends, made where it isn't there yet."""
        node = self.ends.get(term)
        if node is None:
            node = self.ends[term] = self._made(term)
            node.counts = {}
        return node

    def _made(self, term: bytes) -> Node:
        head, n = term[:HEAD], len(term)
        node = self.roots.get(head)
        if node is None:
            node = self.roots[head] = Node()
        at = len(head)
        while at < n:
            if node.edges is None:
                node.edges = {}
            edge = node.edges.get(term[at])
            if edge is None:
                new = Node()
                node.edges[term[at]] = (term[at:], new)
                return new
            label, below = edge
            if not term.startswith(label, at):  # they part inside the edge
                k = 1
                while at + k < n and label[k] == term[at + k]:
                    k += 1
                fork = Node()
                fork.edges = {label[k]: (label[k:], below)}
                node.edges[term[at]] = (label[:k], fork)
                label, below = label[:k], fork
            node, at = below, at + len(label)
        return node

    def add(self, source: str, counts: Mapping[bytes, int]) -> None:
        """Occurrences of terms in a source."""
        get = self.ends.get
        for term, n in counts.items():
            held = (get(term) or self.leaf(term)).counts
            if source in held:
                held[source] += n
            else:
                held[source] = n
                self.counters += 1

    def leaves(self) -> Iterator[tuple[bytes, Node]]:
        """All terms, in the order of their bytes."""
        todo = [(head, self.roots[head]) for head in sorted(self.roots, reverse=True)]
        while todo:
            term, node = todo.pop()
            if node.counts is not None:
                yield term, node
            edges = node.edges
            if edges:
                for first in sorted(edges, reverse=True) if len(edges) > 1 else edges:
                    label, below = edges[first]
                    todo.append((term + label, below))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that no term crosses."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def written(tries: dict[str, RadixTrie]) -> Iterator[pa.RecordBatch]:
    """The tries' leaves, language by language, in the order of their bytes."""
    for lang, trie in tries.items():
        leaves = trie.leaves()
        while part := list(islice(leaves, ROWS)):
            off = np.cumsum([0, *(len(x.counts) for _, x in part)], dtype=np.int32)
            names, counts = chain.from_iterable(x.counts for _, x in part), chain.from_iterable(x.counts.values() for _, x in part)
            yield leaf_batch(pa.array([lang] * len(part)), pa.array([t for t, _ in part], pa.binary()), pa.array([x.docs for _, x in part]), off, pa.array(names, pa.string()), pa.array(counts, pa.int64()))


def leaf_batch(lang: pa.Array, term: pa.Array, docs: pa.Array, off: np.ndarray, names: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    """off: where each leaf's counters (names, counts) begin, and the end of the last."""
    off = pa.array(off, pa.int32())
    return pa.RecordBatch.from_arrays([lang, term.cast(pa.string()), docs, pa.ListArray.from_arrays(off, names), pa.ListArray.from_arrays(off, counts)], names=["lang", "term", "docs", "sources", "counts"])


def tries(docs: DataFrame) -> DataFrame:
    """Leaves of the tries of all tasks: lang, term, docs, sources, counts."""

    def run(batches):
        gc.disable()  # millions of live objects without a cycle: looking for cycles took half of the time
        try:
            yield from counted(batches)
        finally:
            gc.enable()

    def counted(batches):
        held, names, counts, in_docs = {}, {}, {}, {}

        def moved():
            """What was counted goes into the tries."""
            for (lang, source), count in counts.items():
                held.setdefault(lang, RadixTrie()).add(source, count)
            for lang, seen in in_docs.items():
                ends = held[lang].ends
                for term, n in seen.items():
                    ends[term].docs += n
            counts.clear()
            in_docs.clear()

        for x in batches:
            text = x.column(0).cast(pa.large_string()).cast(pa.large_binary())
            for k, (lang, source) in enumerate(zip(x.column(1).to_pylist(), x.column(2).to_pylist())):
                group = (lang, names.setdefault(source, source))
                count = counts.get(group)
                if count is None:
                    count = counts[group] = Counter()
                    in_docs.setdefault(lang, Counter())
                data = text[k].as_py()
                if len(data) <= PIECE:
                    terms = TERM.findall(data.lower())  # lower() of bytes changes A-Z alone
                    count.update(terms)
                    in_docs[lang].update(set(terms))
                    continue
                seen = set()
                for part in pieces(data):
                    terms = TERM.findall(part.lower())
                    count.update(terms)
                    seen.update(terms)
                in_docs[lang].update(seen)
            if sum(map(len, counts.values())) > MAX_WAITING:
                moved()
                if sum(t.counters for t in held.values()) > MAX_COUNTERS:
                    yield from written(held)
                    held.clear()
        moved()
        yield from written(held)

    return docs.select("text", "lang", "source").mapInArrow(run, LEAF)


def summed(x: pa.RecordBatch, min_docs: int, ends: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """Leaves in order -> one a term, of those in min_docs documents; and, unless the rows end here, the last term's
    leaf apart, since its rows may go on."""
    lang, term, docs, sources, counts = x.columns
    other = lambda c: pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    new = np.concatenate([[True], other(lang) | other(term)])
    first = np.flatnonzero(new)
    total = np.add.reduceat(docs.to_numpy(), first)
    keep = total >= min_docs
    if not ends:
        keep[-1] = True
    group = (np.cumsum(keep) - 1)[np.cumsum(new) - 1]  # among those to keep
    entry = np.repeat(keep[np.cumsum(new) - 1], np.diff(sources.offsets))
    names = sources.values.slice(sources.offsets[0].as_py(), len(entry)).dictionary_encode()
    value = counts.values.slice(counts.offsets[0].as_py(), len(entry)).to_numpy()[entry]
    key = np.repeat(group, np.diff(sources.offsets))[entry] * len(names.dictionary) + names.indices.to_numpy()[entry]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value, key = (np.add.reduceat(value, at), key[at]) if len(at) else (value, key)
    size = max(1, len(names.dictionary))
    off = np.searchsorted(key // size, np.arange(int(keep.sum()) + 1))
    kept = pa.array(first[keep])
    out = leaf_batch(lang.take(kept), term.take(kept).cast(pa.binary()), pa.array(total[keep]), off, names.dictionary.take(pa.array(key % size)), pa.array(value))
    return (out, None) if ends else (out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1))


def merged(leaves: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One leaf a term of a language, of those in min_docs documents; each task has a range of prefixes."""

    def run(batches):
        carry = None
        for x in batches:
            if x.num_rows:
                x = pa.RecordBatch.from_arrays(x.columns, names=["lang", "term", "docs", "sources", "counts"])
                if carry is not None:
                    x = pa.Table.from_batches([carry, x.cast(carry.schema)]).combine_chunks().to_batches()[0]
                out, carry = summed(x, min_docs, ends=False)
                yield out
        if carry is not None:
            yield summed(carry, min_docs, ends=True)[0]

    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, LEAF)


def shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / of), exactly: a long division, three digits a step."""
    if len(of) and int(of.max()) >= 9 * 10**15:
        raise OverflowError("a source of 9 * 10**15 occurrences and more")
    out, rest = np.zeros(len(counts), np.int64), counts + 1
    whole, rest = rest // of, rest % of  # 1 only where one term is all there is
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return 1 + whole * SCALE + out


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


class Streams:
    """What a traversal gathers: sums of pairs, and each source's first terms."""

    def __init__(self, top: int):
        self.top, self.sums, self.first = top, {}, {}

    def leaves(self, lang: str, v: int, of_lang: int, terms: list[bytes], off: np.ndarray, names: list[str], count: np.ndarray, n: np.ndarray) -> None:
        """Leaves of one language. off: where each leaf's counters begin; names, count, n: sources, occurrences, the sources' totals."""
        ids = {}
        source = np.array([ids.setdefault(s, len(ids)) for s in names], np.int64)
        known = list(ids)
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), size)
        p, p0 = shares(count, n + v), shares(np.zeros(len(n), np.int64), n + v)
        total = np.add.reduceat(count, off[:-1]) if len(count) else count  # a leaf has a counter at least
        q = shares(total, np.full(len(total), of_lang + v))[row]
        self.terms(lang, known, source, terms, row, p, q)
        partners = size[row]
        upto = np.cumsum(partners)
        at = 0
        while at < len(row):  # so many counters that their pairs are about PAIRS
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            g = np.repeat(np.arange(at, end), partners[at:end])
            begin = np.cumsum(partners[at:end]) - partners[at:end]
            s = np.arange(len(g)) - np.repeat(begin, partners[at:end]) + off[row[g]]
            g, s = g[g != s], s[g != s]
            value = f(p[g], p[s]) - f(p[g], p0[s]) - f(p0[g], p[s]) + f(p0[g], p0[s])
            key, inverse = np.unique(source[g] * len(known) + source[s], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, inverse, value)
            for k, x in zip(key.tolist(), sums.tolist()):
                k = (lang, known[k // len(known)], known[k % len(known)])
                self.sums[k] = self.sums.get(k, 0) + x
            at = end

    def terms(self, lang: str, known: list[str], source: np.ndarray, terms: list[bytes], row: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        over = np.flatnonzero(p > q)
        value = f(p[over], q[over])
        for s in np.unique(source[over]).tolist():
            mine = source[over] == s
            held = self.first.setdefault((lang, known[s]), [])
            least = -held[self.top - 1][0] if len(held) >= self.top else -1
            mine &= value >= least
            held += [(-x, terms[k]) for x, k in zip(value[mine].tolist(), row[over[mine]].tolist())]
            held.sort()
            del held[self.top :]

    def pairs(self) -> pa.RecordBatch:
        rows = [("pair", *k, x) for k, x in self.sums.items()]
        self.sums = {}
        return stream_batch(rows)

    def candidates(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), held in self.first.items():
            yield stream_batch([("term", lang, source, t.decode(), -x) for x, t in held])


def stream_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["part", "lang", "source", "item", "value"])


def traversed(leaves: DataFrame, langs: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """part, lang, source, item, value: partial sums of pairs over their common terms, and candidates for the first `top` terms."""
    spark = leaves.sparkSession
    of_lang = langs.select("lang", "v", "n")
    few = groups.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS
    if few:
        totals = spark.sparkContext.broadcast({(r.lang, r.source): r.n for r in groups.collect()})
        x = leaves.select("lang", "term", "sources", "counts")
    else:  # each counter with its source's total
        entry = leaves.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
        entry = entry.join(groups.select("lang", "source", "n"), ["lang", "source"])
        entry = entry.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "count", "n")).alias("e"))
        x = entry.select("lang", "term", F.col("e.source").alias("sources"), F.col("e.count").alias("counts"), F.col("e.n").alias("ns"))
        totals = None
    x = x.join(F.broadcast(of_lang) if few else of_lang, "lang")

    def run(batches):
        out = Streams(top)
        for b in batches:
            c = {k: b.column(k) for k in b.schema.names}
            langs = np.array(c["lang"].to_pylist(), object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = {k: a.slice(i, j - i) for k, a in c.items()}
                lang = langs[i]
                names = part["sources"].flatten().to_pylist()
                n = part["ns"].flatten().to_numpy() if totals is None else np.array([totals.value[lang, s] for s in names], np.int64)
                off = np.concatenate([[0], np.cumsum(part["sources"].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                out.leaves(lang, part["v"][0].as_py(), part["n"][0].as_py(), part["term"].cast(pa.binary()).to_pylist(), off, names, part["counts"].flatten().to_numpy(zero_copy_only=False), n)
            if len(out.sums) > MAX_SUMS:
                yield out.pairs()
        yield out.pairs()
        yield from out.candidates()

    return x.mapInArrow(run, "part string, lang string, source string, item string, value bigint")


def _share(count: str, of: str) -> str:
    return f"1 + (cast({count} + 1 as decimal(20,0)) * cast({SCALE} as decimal(10,0))) div cast({of} as decimal(20,0))"


def _f(p: str, q: str) -> str:
    return f"({p} - {q}) * ({p} - {q}) div {q}"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    ship(docs.sparkSession)
    docs = narrow(docs, "text", "lang", "source").select(*[F.coalesce(k, F.lit("")).alias(k) for k in ("text", "lang", "source")])
    leaves = saved(merged(saved(tries(docs), "tries"), min_docs), "leaves")
    entry = leaves.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    #: How many of a source's terms have which count.
    spread = saved(entry.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")), "spread")
    held = spread.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"), F.sum("terms").alias("own"))
    vocabulary = leaves.groupBy("lang").agg(F.count("*").alias("v"))
    totals = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    totals = totals.select("lang", "source", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("n", "own", "v")])
    totals = totals.withColumn("p0", F.expr(f"case when v > 0 then {_share('0', 'n + v')} end"))
    groups = saved(totals, "groups")
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.sum("n").alias("n"))

    streams = saved(traversed(leaves, langs, groups, top), "streams")
    a, b = groups.alias("a"), groups.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    absent = both.select("a.lang", "a.source", F.col("b.source").alias("item"), F.expr(f"case when a.v > 0 then (a.v - a.own - b.own) * ({_f('a.p0', 'b.p0')}) else 0L end").alias("value"))
    mine = spread.join(groups.select("lang", "source", "n", "v", "p0"), ["lang", "source"]).withColumn("p", F.expr(_share("count", "n + v")))
    s, o = mine.alias("s"), groups.select("lang", "source", "p0").alias("o")
    one_side = s.join(o, (F.col("s.lang") == F.col("o.lang")) & (F.col("s.source") != F.col("o.source"))).select(
        "s.lang",
        F.explode(
            F.array(
                F.struct(F.col("s.source").alias("source"), F.col("o.source").alias("item"), F.expr(f"s.terms * ({_f('s.p', 'o.p0')})").alias("value")),
                F.struct(F.col("o.source").alias("source"), F.col("s.source").alias("item"), F.expr(f"s.terms * ({_f('o.p0', 's.p')})").alias("value")),
            )
        ).alias("e"),
    )
    one_side = one_side.select("lang", "e.source", "e.item", "e.value")
    common = streams.filter("part = 'pair'").select("lang", "source", "item", "value")
    pair = absent.unionByName(one_side).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    term = streams.filter("part = 'term'")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.select("lang", "source", "part", "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pair).unionByName(ranked(term).filter(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


#: The query in DuckDB SQL.
SQL = r"""
with d as (select row_number() over () as k, coalesce(text, '') as t, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select k, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by 1, 2 having count(distinct k) >= 3),
v as (select lang, count(*) as v, sum(n)::hugeint as n from kept group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by 1, 2, 3),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from g left join c on g.lang = c.lang and g.source = c.source group by 1, 2),
p as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) as p, 1 + (1000000000::hugeint * (kept.n + 1)) // (v.n + v.v) as q
  from gn join v using (lang) join kept using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term))
select * from r where part = 'pair' or rank <= 200"""
