"""MinHash near-dedup with sequential Bayesian verification.

1. Every document's set of distinct 5-word shingles gives a 128-bit set id, and a MinHash signature. Equal
   sets are one node from here on.
2. Bands of ROWS hashes (band_count of the threshold) give buckets. In each bucket all members are compared with one hub, the member
   with the largest buckets over all bands, and then those still apart from a second hub with that one.
   Sets that share buckets and are still apart form groups; a task compares a group's sets across components
   and sends only links that join two. A group of more than UNIT weight is dealt by bucket, and a bucket
   by pairs of blocks, so no task holds more than two blocks.
3. A candidate pair's signatures are compared BATCH hashes at a time; the pair is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold is below MISS. Over all looks
   together a pair at the threshold is dropped with probability about 1e-6.
4. Survivors are confirmed on their full sets: 100 * intersection >= percent * union (the query's: 85, the stage's: 80).
5. Confirmed links give components; the smallest doc_id of a component stays.

A pair at the threshold t shares no band with probability (1 - t**5)**bands < 1e-6: 24 bands at 0.85, 36 at 0.80.

Defined cases: null, empty and word-less texts have n_shingles 0, are their own component and stay. Texts of
one to four words are one shingle. Rows with equal doc_id each keep a row. A row without doc_id gets the
smallest id of its component (null if it has none) and kept false unless that is null. Extra columns are not
read; an empty table gives no rows. Ties (equal minima, hubs of equal degree) are broken by set id. A text takes about
60 bytes of memory for each of its own while its task works on it. The pipeline stage keeps one row of every component, whatever its doc_id,
and every text without words.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.blocks import Words, blocks, mix, shingle_sets
from postmill.llm.common import documents, narrow, saved, ship
from postmill.llm.components import components

ROWS, BATCH, MISS, MISS_BANDS = 5, 20, 1e-7, 1e-6
#: The query's threshold, and the pipeline stage's.
PERCENT, STAGE_PERCENT = 85, 80
HUB_ROUNDS = 2
#: Weight (shingles, and SET_WEIGHT a set) of what one task compares at once.
UNIT, SET_WEIGHT = 4_000_000, 500
#: Ids that a join may broadcast, counted first (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def band_count(percent: int) -> int:
    """The bands, in whole batches of hashes, that miss a pair at the threshold with probability below MISS_BANDS."""
    whole = BATCH // ROWS
    return whole * ceil(log(MISS_BANDS) / log1p(-((percent / 100) ** ROWS)) / whole)


BANDS = band_count(PERCENT)
HASHES = BANDS * ROWS


@lru_cache
def _factors(hashes: int) -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    return [rng.integers(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1) for _ in range(3)]


def signatures(sets: np.ndarray, off: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash signature (32-bit minima of so many hashes) of each set; all ones for an empty set."""
    n = len(off) - 1
    out = np.full((n, hashes), 0xFFFFFFFF, np.uint32)
    fa, fb, fc = _factors(hashes)
    full = np.flatnonzero(np.diff(off))
    x = (sets >> np.uint64(32)).astype(np.uint32)
    step, at = 1 << 15, 0
    while at < len(full):  # some sets at a time, so that the arrays stay in cache
        last = max(at + 1, int(np.searchsorted(off[full], off[full[at]] + step)))
        part = full[at:last]
        v, starts = x[off[part[0]] : off[part[-1] + 1]], off[part] - off[part[0]]
        for j in range(hashes):
            h = (v ^ fc[j]) * fa[j]
            h ^= h >> np.uint32(15)
            h *= fb[j]
            out[part, j] = np.minimum.reduceat(h, starts)
        at = last
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each signature and band."""
    bands = sig.shape[1] // ROWS
    s = sig.reshape(len(sig), bands, ROWS).astype(np.uint64)
    k = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), s.shape[:2]).copy()
    for i in range(ROWS):
        k = mix(k ^ s[:, :, i])
    return k.view(np.int64)


@lru_cache
def least_matches(percent: int = PERCENT) -> np.ndarray:
    """For each number of batches compared, the least matches with P(similarity >= threshold | matches) >= MISS.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, band_count(percent) * ROWS + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append(m)
    return np.array(out)


def survives(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of signatures pass every batch."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(percent)):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        hits[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
        alive = alive[hits[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _set_ids(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """16 bytes for each set, from order-free sums of two mixes of its shingles and its size."""
    out = np.zeros((len(off) - 1, 2), np.uint64)
    for k in range(2):
        c = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix(sets ^ np.uint64(0x1234567 + 0x9876543210 * k)), out=c[1:])
        out[:, k] = mix(c[off[1:]] - c[off[:-1]] + np.diff(off).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array's rows as binary values."""
    raw, width = np.ascontiguousarray(rows), rows.itemsize * rows.shape[1]
    off = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def _matrix(col: pa.Array, kind: type, width: int) -> np.ndarray:
    """Equal-length binary values as a two-dimensional array."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def fingerprints(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, sid (null without shingles), sig: the signature where this task first meets the set."""
    ship(docs.sparkSession)
    hashes = band_count(percent) * ROWS

    def run(batches):
        seen: set[bytes] = set()
        for x in batches:
            for b in blocks(x.column(1)):
                sets, off = shingle_sets(Words(b, lower=True))
                n = np.diff(off)
                ids = [r.tobytes() if k else None for r, k in zip(_set_ids(sets, off), n.tolist(), strict=True)]
                new = [not (i is None or i in seen or seen.add(i)) for i in ids]
                sig = _binary(signatures(sets, off, hashes)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [x.column(0).slice(b.first, b.n), pa.array(n), pa.array(ids, pa.binary()), pa.array([s if k else None for s, k in zip(sig, new, strict=True)], pa.binary())],
                    names=["doc_id", "n_shingles", "sid", "sig"],
                )

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, sid binary, sig binary")


def _bands(fp: DataFrame, percent: int) -> DataFrame:
    """(bucket, sid) of every set, once a task that met it."""
    bands = band_count(percent)

    def run(batches):
        for x in batches:
            sig = _matrix(x.column(1), np.uint32, bands * ROWS)
            if len(sig):
                keys = band_keys(sig).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys), x.column(0).take(pa.array(np.repeat(np.arange(len(sig)), bands)))], names=["bucket", "sid"])

    return fp.filter("sig is not null").select("sid", "sig").mapInArrow(run, "bucket bigint, sid binary")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ids (distinct): a broadcast where their number is small enough, else a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _by_signature(pairs: DataFrame, fp: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sequential Bayesian comparison of their signatures leaves."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    sigs = only(fp.filter("sig is not null").select("sid", "sig"), involved, "sid").groupBy("sid").agg(F.min("sig").alias("sig"))
    hashes = band_count(percent) * ROWS
    both = pairs.join(sigs.select(F.col("sid").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("sid").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches):
        for x in batches:
            if x.num_rows:
                ok = survives(_matrix(x.column(2), np.uint32, hashes), _matrix(x.column(3), np.uint32, hashes), percent)
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _sets(involved: DataFrame, fp: DataFrame, docs: DataFrame) -> DataFrame:
    """(sid, s): the full shingle sets, made anew from the texts of one document each."""
    firsts = only(fp.filter("sid is not null").select("sid", "doc_id"), involved, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = firsts.select("doc_id").distinct()

    def run(batches):
        seen: set[bytes] = set()
        for x in batches:
            for b in blocks(x.column(0)):
                sets, off = shingle_sets(Words(b, lower=True))
                ids = [r.tobytes() for r in _set_ids(sets, off)]
                at = [i for i, (k, n) in enumerate(zip(ids, np.diff(off).tolist(), strict=True)) if n and not (k in seen or seen.add(k))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.binary()), pa.array([sets[off[i] : off[i + 1]].tobytes() for i in at], pa.binary())], names=["sid", "s"])

    keyed = narrow(docs, "doc_id", "text")
    texts = only(keyed.filter("doc_id is not null"), wanted, "doc_id").unionByName(keyed.filter("doc_id is null"))
    sets = texts.select("text").mapInArrow(run, "sid binary, s binary")
    return saved(only(sets, involved, "sid").groupBy("sid").agg(F.min("s").alias("s")), "sets")


def _by_sets(pairs: DataFrame, fp: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), fp, docs)
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")

    def verify(batches):
        for x in batches:
            ok = []
            for a, b in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary")


def join_apart(root: list, block: list[int], sig: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join components of a unit's members (of two blocks, across them), each of a pair that shares a band,
    passes the signature batches, and reaches the threshold on full sets."""
    n, keys = len(sets), band_keys(sig)
    names: dict = {}
    label = np.array([names.setdefault(r, len(names)) for r in root])
    side = np.array(block)
    across = len(set(block)) > 1
    size = np.array([len(s) for s in sets])
    links = []
    for i in range(1, n):
        j = np.flatnonzero(label[:i] != label[i])
        if across:
            j = j[side[j] != side[i]]
        low, high = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
        j = j[100 * low >= percent * high]
        j = j[(keys[j] == keys[i]).any(1)]
        j = j[survives(sig[j], np.broadcast_to(sig[i], (len(j), sig.shape[1])), percent)]
        for some in np.array_split(j, max(1, int(size[j].sum()) // 500_000 + 1)) if len(j) else ():
            other = np.concatenate([sets[k] for k in some])
            at = np.minimum(np.searchsorted(sets[i], other), size[i] - 1)
            common = np.add.reduceat((sets[i][at] == other).astype(np.int64), np.cumsum(size[some]) - size[some])
            for k in some[100 * common >= percent * (size[some] + size[i] - common)].tolist():
                if label[k] != label[i]:
                    links.append((i, k))
                    label[label == label[k]] = label[i]
    return links


def _apart(members: DataFrame, fp: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links found inside buckets (bucket, sid, root) of which the members are in several components."""
    bucket = Window.partitionBy("bucket")
    groups = components(members.withColumn("v", F.min("sid").over(bucket)).select(F.col("sid").alias("u"), "v"))
    members = members.join(groups.select(F.col("node").alias("sid"), F.col("root").alias("unit")), "sid", "left").withColumn("unit", F.coalesce("unit", "sid"))
    involved = saved(members.select("sid", "root", "unit").distinct(), "apart")
    ids = involved.select("sid").distinct()
    sets = _sets(ids, fp, docs)
    sigs = only(fp.filter("sig is not null").select("sid", "sig"), ids, "sid").groupBy("sid").agg(F.min("sig").alias("sig"))
    weight = sets.select("sid", (F.length("s") / 8 + SET_WEIGHT).alias("weight"))
    whole = involved.join(weight, "sid")
    total = whole.groupBy("unit").agg(F.sum("weight").alias("total"))
    small = whole.join(total.filter(F.col("total") <= UNIT), "unit").select(F.hex("unit").alias("unit"), "sid", "root", F.lit(0).alias("block"))
    heavy = members.join(total.filter(F.col("total") > UNIT).select("unit"), "unit", "left_semi").join(weight, "sid")
    run_up = F.sum("weight").over(bucket.orderBy("root", "sid").rowsBetween(Window.unboundedPreceding, 0))
    heavy = heavy.withColumn("block", F.floor(run_up / (UNIT / 2)).cast("int")).withColumn("last", F.max("block").over(bucket))
    heavy = heavy.select("bucket", "sid", "root", "block", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    heavy = heavy.select(F.concat_ws(":", "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "sid", "root", "block")
    rows = small.unionByName(heavy).join(sigs, "sid").join(sets, "sid").select("unit", "sid", "root", "block", "sig", "s")
    rows = rows.repartition("unit").sortWithinPartitions("unit")
    hashes = band_count(percent) * ROWS

    def run(batches):
        unit, held = None, []

        def settle():
            ids, roots, block, sig, sets = zip(*held, strict=True)
            got = join_apart(roots, block, np.frombuffer(b"".join(sig), np.uint32).reshape(-1, hashes), [np.frombuffer(s, np.uint64) for s in sets], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in got], pa.binary()), pa.array([ids[k] for _, k in got], pa.binary())], names=["a", "b"])

        for x in batches:
            for u, *rest in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if u != unit and held:
                    yield settle()
                    held = []
                unit = u
                held.append(rest)
        if held:
            yield settle()

    return rows.mapInArrow(run, "a binary, b binary")


def link(fp: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, root) over set ids: sets joined by confirmed links."""
    bucket = Window.partitionBy("bucket")
    members = _bands(fp, percent).repartition("bucket").dropDuplicates(["bucket", "sid"]).withColumn("n", F.count("*").over(bucket)).filter("n > 1")
    members = saved(members, "members")
    degree = members.groupBy("sid").agg(F.sum("n").alias("degree"))
    members = saved(members.join(degree, "sid").select("bucket", "sid", "degree"), "degrees")
    links = roots = None
    for k in range(HUB_ROUNDS + 1):
        now = members
        if roots is not None:
            now = now.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        else:
            now = now.withColumn("root", F.col("sid"))
        apart = now.withColumn("lo", F.min("root").over(bucket)).withColumn("hi", F.max("root").over(bucket)).filter("lo <> hi")
        if k < HUB_ROUNDS:  # hubs in the order of degree, one more each round
            ranked = apart.withColumn("rank", F.row_number().over(bucket.orderBy(F.desc("degree"), "sid")))
            hub = F.max(F.when(F.col("rank") == k + 1, F.struct("sid", "root"))).over(bucket)
            pairs = ranked.withColumn("hub", hub).filter("hub is not null and sid <> hub.sid and root <> hub.root")
            pairs = saved(pairs.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct(), "pairs")
            if pairs.isEmpty():
                continue
            left = saved(_by_signature(pairs, fp, percent), "survivors")
            if left.isEmpty():
                continue
            found = saved(_by_sets(left, fp, docs, percent), "links")
        else:
            apart = saved(apart.select("bucket", "sid", "root"), "apart")
            if apart.isEmpty():
                break
            found = saved(_apart(apart, fp, docs, percent), "links")
        links = found if links is None else links.unionByName(found)
        roots = components(links.toDF("u", "v"))
    return roots if roots is not None else fp.sparkSession.createDataFrame([], "node binary, root binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id and root_id (hex of the ids of the shingle set and of its component) of every document."""
    fp = saved(fingerprints(docs, percent), "fingerprints")
    roots = link(fp, docs, percent)
    x = fp.select("doc_id", "n_shingles", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    x = x.withColumn("root", F.coalesce("root", "sid"))
    least = x.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))  # partial sums first: a hot component is one row a task
    out = x.join(least, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.hex("sid").alias("class_id"), F.hex("root").alias("root_id")).withColumn(
        "kept", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def _with_class(docs: DataFrame) -> DataFrame:
    """The rows with class_id: the hex of the text's shingle set id, null without shingles."""
    at = docs.schema.names.index("text")

    def run(batches):
        for x in batches:
            for b in blocks(x.column(at)):
                sets, off = shingle_sets(Words(b, lower=True))
                ids = [r.tobytes().hex().upper() if k else None for r, k in zip(_set_ids(sets, off), np.diff(off).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(b.first, b.n) for c in x.columns), pa.array(ids, pa.string())], names=[*x.schema.names, "class_id"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("class_id", T.StringType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = STAGE_PERCENT) -> DataFrame:
    """Pipeline stage: one row of each component, and every row without shingles. Where a doc_id stands once, its row is
    kept or removed by it; rows whose id is null or stands more often are told apart by (doc_id, set id)."""
    found = saved(near_duplicates(docs, percent).select("doc_id", "class_id", "root_id", "kept"), "kept")
    gone = found.filter("not kept and doc_id is not null").select("doc_id").distinct()
    twice = saved(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    none, repeated = found.filter("doc_id is null").isEmpty(), not twice.isEmpty()
    out = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    if none and not repeated:
        return out
    out = out.filter("doc_id is not null").join(twice, "doc_id", "left_anti").select(*docs.columns)
    shared = docs.filter("doc_id is null").unionByName(docs.join(twice, "doc_id", "left_semi").select(*docs.columns))
    shared = _with_class(shared)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class_id")).alias("first")
    firsts = found.filter("root_id is not null").groupBy("root_id").agg(first).select(F.col("first.doc_id").alias("first_id"), F.col("first.class_id").alias("first_class"))
    chosen = shared.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("class_id") == F.col("first_class")), "left_semi").dropDuplicates(["class_id"])
    return out.unionByName(shared.filter("class_id is null").unionByName(chosen).select(*docs.columns))


#: The query in DuckDB SQL (for tables whose doc_id is unique): pairs by shared shingles, components by recursion.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as i from w where len(ws) > 0)),
n as (select w.doc_id, count(s.g) as n_shingles from w left join s on w.doc_id = s.doc_id group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n_shingles + ny.n_shingles - c)),
both_ways as (select x, y from e union all select y, x from e),
r as (select doc_id, doc_id as other from n union select r.doc_id, b.y from r join both_ways b on r.other = b.x),
m as (select doc_id, min(other) as component_id from r group by 1)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join m on n.doc_id = m.doc_id"""
