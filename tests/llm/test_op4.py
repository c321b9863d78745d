import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from postmill.llm import op4_lm_scoring as op4
from postmill.llm.common import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, key string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def is_train(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 != 1


def brute(rows):
    c, N = Counter(), 0
    for d, t in rows:
        if is_train(d):
            w = [*words(t), None]
            c.update(w)
            N += len(w)
    low = math.log10(N + 0.5 * (len(c) + 1))
    return [(d, not is_train(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), N, sum(math.log10(c[w] + 0.5) - low for w in [*words(t), None])) for d, t in rows]


def corpus():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefgÉ") for _ in range(r.randint(1, 5))) for _ in range(3000)]
    out = [None, "", " \n", "The THE the", "x " * 3000]
    for _ in range(200):
        out.append(" ".join(vocab[min(int(r.paretovariate(0.4)), 2999)] for _ in range(r.randint(1, 200))))
    rows = list(enumerate(out, 1)) + [(50, "same id other text"), (7, out[6]), (None, "no id here")]
    return rows


def test_base_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op4, "FREQUENT", 300)  # most words go by the shuffled way
    rows = corpus()
    got = op4.score(spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])), (a, b)
        assert math.isfinite(a[6]) and a[6] < 0


def python_mix(x):
    m = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def test_score_matches_the_model_s_formula(spark, monkeypatch):
    monkeypatch.setattr(op4, "FREQUENT", 1500)
    monkeypatch.setattr(op4, "PIECE", 50)
    r = random.Random(5)
    rows = corpus()[:4] + [(100 + i, " ".join("".join(r.choice("abcdeÉ") for _ in range(r.choice([1, 2, 4, 5]))) for _ in range(r.randint(1, 130)))) for i in range(70)]
    docs = op4._with_keys(spark.createDataFrame(rows, "doc_id bigint, text string"))
    lex = op4.Lexicon(op4.frequent_words(docs))
    table = op4.saved(op4.counts(docs, lex), "counts")
    tot = op4.Totals(lex, table)
    model = op4.train(docs, lex, tot.tokens, tot.unit_share)
    got = op4.scored(docs, lex, table, tot, op4.Network(model).normalised(spark)).collect()

    c = Counter(w for d, t in rows if is_train(d) for w in words(t))
    last = {w: (w.encode()[-1], w.encode()[-2:][0]) for _, t in rows for w in words(t)}
    cls = {w: python_mix(z * 256 + y) % op4.CLASSES for w, (z, y) in last.items()}
    all_words = sorted(cls)
    b = next(iter(op4.blocks(pa.array([" ".join(all_words)]))))
    at = dict(zip(all_words, lex.find(b, b.words(lower=True))[0].tolist(), strict=True))
    order = sorted((w for w in all_words if at[w] >= 0), key=lambda w: (-c[w], at[w]))
    rank = {w: i for i, w in enumerate(order)}
    assert len(order) > op4.TOP + 50 and len(all_words) > len(order) + 50
    in_class = lambda k: [w for w in c if cls[w] == k and rank.get(w, 10**9) >= op4.TOP]
    mass = {k: sum(c[w] + 0.5 for w in in_class(k)) + 0.5 for k in range(op4.CLASSES)}
    R, Q, C1, C2, bias = (model[k].astype(np.float64) for k in ("R", "Q", "C1", "C2", "b"))

    def context(w):
        r = rank.get(w, 10**9)
        return 0 if w is None else r + 1 if r < op4.TOP else 1 + op4.TOP + cls[w]

    def formula(t):
        out, before = 0.0, [None, None]
        for w in [*words(t), None]:
            s = Q @ (C1 @ R[context(before[1])] + C2 @ R[context(before[0])]) + bias.ravel()
            r = rank.get(w, 10**9)
            u = 0 if w is None else r + 1 if r < op4.TOP else 1 + op4.TOP + cls[w]
            out += (s[u] - np.log(np.exp(s).sum())) / np.log(10)
            if u > op4.TOP:
                out += math.log10((c[w] + 0.5) / mass[cls[w]])
            before = [before[1], w]
        return out

    want = sorted((str(d), formula(t)) for d, t in rows)
    for (d, x), (e, y) in zip(sorted((str(r.doc_id), r.score) for r in got), want, strict=True):
        assert d == e and abs(x - y) < 1e-3 * max(1, abs(y)), (d, x, y)


def test_large_scores_do_not_overflow():
    m = op4.start_model(np.full(op4.UNITS, 1 / op4.UNITS))
    m["Q"] = m["Q"] * 4000
    n = op4.Network(m)
    s = (n.a1 + n.a2[7]).astype(np.float64) @ n.q.T + n.bias
    top = s.max(1)
    assert top.max() > 100
    assert np.allclose(n.partition_sums(np.array([7]))[0], top + np.log(np.exp(s - top[:, None]).sum(1)), rtol=1e-3)


def test_beats_the_base_on_held_out_text(spark):
    got = [r for r in op4.score(documents(spark, "/root/testdata/sf0.01")).collect() if r.held_out]
    assert len(got) > 100
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


def test_empty_and_untrained(spark):
    assert op4.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(d for d in range(100) if not is_train(d))
    (r,) = op4.score(spark.createDataFrame([(held, "a b", "")], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9


def test_every_training_document_trains_the_network(spark, monkeypatch):
    text = "one two three two one four"
    docs = op4._with_keys(spark.createDataFrame([(i, text) for i in range(40)], "doc_id bigint, text string"))
    n = sum(is_train(i) for i in range(40))
    lex = op4.Lexicon(op4.frequent_words(docs))
    share = np.full(op4.UNITS, 1 / op4.UNITS)
    b = next(iter(op4.blocks(pa.array([text]))))
    w = b.words(lower=True)
    u, one, two, _ = op4._token_stream(w, lex.units(*lex.find(b, w)), 1)
    assert one.tolist() == [0, *u[:-1]] and two.tolist() == [0, 0, *u[:-2]]
    want = op4.train_shard(op4.start_model(share), share, *(np.tile(z, n) for z in (u, one, two)))
    got = op4.train(docs, lex, 7 * n, share)
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in want)
    monkeypatch.setattr(op4, "SHARD_TOKENS", 70)
    monkeypatch.setattr(op4, "PIECE", 4)
    monkeypatch.setattr(op4, "train_shard", lambda m, s, u, one, two: {k: v + len(u) for k, v in m.items()})
    got = op4.train(docs, lex, 7 * n, share)  # many small shards: their mean
    assert got["b"].shape == want["b"].shape and (got["b"] - op4.start_model(share)["b"]).max() <= 140
