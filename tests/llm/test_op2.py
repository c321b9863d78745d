import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from postmill.llm import op2_kneser_ney as op2
from postmill.llm.blocks import blocks
from postmill.llm.common import documents


def brute_model(seqs, types):
    """Interpolated modified Kneser-Ney by definition; seqs: word numbers between two begins and an end."""
    tri = Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
    bi = Counter()
    for g, k in tri.items():  # nothing stands before a document: its first bigram keeps its own count
        bi[g[1:]] += k if g[1] == 0 else 1
    uni = Counter(g[1:] for g in bi)
    levels = []
    for c in (uni, bi, tri):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else y, 2 - 3 * y * n[3] / n[2] if n[2] else 2 * y, 3 - 4 * y * n[4] / n[3] if n[3] else 3 * y]
        d = [min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]
        total, cut = defaultdict(int), defaultdict(float)
        for g, k in c.items():
            total[g[:-1]] += k
            cut[g[:-1]] += d[min(k, 3) - 1]
        levels.append((c, d, total, cut))

    def p(g):
        if not g:
            return 1 / types
        c, d, total, cut = levels[len(g) - 1]
        if not total[g[:-1]]:
            return p(g[1:])
        k = c[g]
        return (k - d[min(k, 3) - 1] if k else 0) / total[g[:-1]] + cut[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_model_matches_definition_and_sums_to_one(spark):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["a", "b", "c", "Dog.", "x1", "él", "zz", f"u{r.randint(0, 99)}"]) for _ in range(n))
    texts = [say(r.randint(0, 40)) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = op2.train(df, df.select("doc_id"))
    (b,) = blocks(pa.array(texts))
    w, doc = model.voc.numbers(b)
    seqs = [tuple(w[doc == i].tolist()) for i in range(len(texts))]
    p = brute_model(seqs, model.voc.size - 1)
    other = ["a b unknown Unknown, ***", "", "c c c c zz", None, "UPPER 12 a", "b " * 500, "a b unknown Unknown, ***"]
    (b,) = blocks(pa.array(other))
    rows = [(i % 6, "en", t) for i, t in enumerate(other)]  # the first and the last: one id, one text
    for parts in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r.doc_id, r.n_tokens, r.log10_p) for r in op2.perplexities(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3), model).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        w, doc = model.voc.numbers(b)
        want = []
        for i in range(len(other)):
            s = tuple(w[doc == i].tolist())
            want.append((i % 6, len(s) - 2, sum(np.log10(p(s[j : j + 3])) for j in range(len(s) - 2))))
        for x, y in zip(got, sorted(want), strict=True):
            assert x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-3 * max(1, abs(y[2]))
    for context in [(0, 0), seqs[3][2:4], (5, 9)]:
        assert abs(sum(p((*context, x)) for x in range(1, model.voc.size)) - 1) < 1e-9


def test_separates_junk_from_trusted_text(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in op2.classify(documents(spark, d), labels).collect()}
    clean, junk = [], []
    for r in labels.collect():
        (clean if r.quality else junk).append(got[r.doc_id].kept)
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.4, (np.mean(clean), np.mean(junk))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (3, "a b c", None, "x"), (3, "a b c", None, "x")], "doc_id bigint, text string, lang string, score string")
    labels = spark.createDataFrame([(3, 1, None), (3, 0, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    assert sorted((r.doc_id, r.n_tokens, r.kept, r.threshold) for r in op2.classify(docs, none).collect()) == [(1, 1, False, None), (2, 1, False, None), (3, 4, True, None), (3, 4, True, None)]
    assert op2.trusted(labels).collect()[0].doc_id == 1 and op2.trusted(labels).count() == 1
    assert op2.classify(docs, labels).count() == 4
    assert op2.classify(docs.limit(0), labels).count() == 0


def test_training_is_bounded_in_documents_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(50, "y" * 5000), (51, None)], "doc_id bigint, text string")
    good = df.select("doc_id")
    monkeypatch.setattr(op2, "MAX_BYTES", 1000)
    ids = {r.doc_id for r in op2.training_ids(df, good).collect()}
    assert 10 <= len(ids) <= 11 and 50 not in ids
    monkeypatch.setattr(op2, "MAX_TRUSTED", 3)
    assert op2.training_ids(df, good).count() <= 3


def test_no_word_of_the_vocabulary_is_lost():
    from postmill.llm.blocks import HashTable

    h = np.concatenate([np.arange(1000, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)])  # many share their first bits
    assert (HashTable(h, 4).find(h) == np.arange(len(h))).all()


def test_filter_loses_no_key_and_passes_few_others():
    r = np.random.default_rng(5)
    keys = r.integers(0, 1 << 62, 20_000)
    seen = op2.Seen(keys[:10_000])
    assert seen.maybe(keys[:10_000]).all() and seen.maybe(keys[10_000:]).mean() < 0.03
    assert not op2.Seen(keys[:0]).maybe(keys).any()
