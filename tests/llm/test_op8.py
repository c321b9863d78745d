import random
import re

import numpy as np
import pyarrow as pa

from postmill.llm import op8_decontamination as op8
from postmill.llm.blocks import blocks

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string"


def corpus(seed=8):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 6))) for _ in range(900)]
    say = lambda n: " ".join(vocab[min(int(r.paretovariate(0.6)), 899)] for _ in range(n))
    items = [(i, say(r.randint(5, 90))) for i in range(70)] + [(70, None), (71, "zz yy"), (72, "")]
    items += [(73, items[3][1]), (74, say(150)), (75, say(700)), (76, "日本語の問題です。答えは何ですか"), (None, "no id has this one here")]
    docs = [None, "", "x", say(3000), "so zz yy it is", "zz x yy", say(300) + " " + items[74][1] + " " + say(90), say(40) + " " + items[75][1], "これは日本語の問題です。答えは何ですか？ " + say(9), "no id has this one here"]
    docs.append(say(77) + " " + " ".join(x for i, x in enumerate(items[75][1].split()) if i % 9))  # some words left out
    for i in range(60):
        t = say(r.randint(1, 400))
        if i % 3 == 0:
            x = r.choice(items[:70])[1]
            t += r.choice([" ", "\n"]) + r.choice([x, x.upper(), x.replace(" ", ", ")]) + " " + say(r.randint(0, 200))
        docs.append(t)
    return items, docs


def brute(items, docs):
    """All passages against all parts of items, scored one by one, with the verification."""
    tok = lambda t: re.findall(r"[0-9A-Za-z\x80-\u2fff]+|[\u3000-\U0010ffff]", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    whole = {k: tok(t) for k, (_, t) in enumerate(items) if tok(t)}
    kept = [(k, at, q[at : at + 64]) for k, q in whole.items() for at in ([0] if len(q) <= 64 else sorted({*range(0, len(q) - 64, 32), len(q) - 64}))]
    n, avg = len(kept), np.mean([len(w) for *_, w in kept])
    df = {}
    for *_, w in kept:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {x: np.log(1 + (n - d + 0.5) / (d + 0.5)) for x, d in df.items()}
    weigh = [{x: idf[x] * q.count(x) * 2.2 / (q.count(x) + 1.2 * (0.25 + 0.75 * len(q) / avg)) for x in set(q)} for *_, q in kept]
    out = {}
    for d, t in enumerate(docs):
        w = tok(t)
        halves = -(-len(w) // 64)
        for p in range(max(halves - 1, 1)):
            have = set(w[64 * p : 64 * p + 128])
            for (k, at, _), f in zip(kept, weigh, strict=True):
                score = sum(f[x] for x in f.keys() & have) / sum(f.values())
                if score < 0.5 - 1e-9:
                    continue
                q = whole[k]
                slack = 64 + max(0, len(q) - 64) // 4
                around = w[max(0, 64 * p - at - slack) : 64 * p + 128 + max(0, len(q) - at - 64) + slack]
                there, cut, r = set(around), -(-2 * len(q) // 3), min(5, len(q))
                share = lambda part: sum(idf[x] * (x in there) for x in part) / sum(idf[x] for x in part) if part else 1.0
                runs = {tuple(q[j : j + r]) for j in range(len(q) - r + 1)} & {tuple(around[j : j + r]) for j in range(len(around) - r + 1)}
                if runs and share(q[:cut]) >= 0.7 and share(q[cut:]) >= 0.6:
                    i = items[k][0]
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


def test_matches_brute_force(spark):
    items, docs = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in enumerate(docs)], SCHEMA).repartition(3)
    got = {(r.doc_id, r.item_id): r.score for r in op8.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute(items, docs)
    assert got.keys() == want.keys() and len(got) >= 15
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_shards_find_the_same_documents(spark, monkeypatch, tmp_path):
    items, docs = corpus(9)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {r.doc_id for r in op8.contaminated(df, bench).collect()}
    monkeypatch.setattr(op8, "SHARD", 30)
    assert op8.indexes(bench).count() > 1
    assert {r.doc_id for r in op8.contaminated(df, bench).collect()} == whole
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in op8.stage(spark, df, str(tmp_path)).collect()} == set(range(len(docs))) - whole


def test_wand_retrieves_all_above_threshold(monkeypatch):
    monkeypatch.setattr(op8, "CELLS", 40)
    items, docs = corpus(10)
    index = op8.Index([i for i, t in items if t], [t for _, t in items if t])
    r = np.random.default_rng(0)
    p = np.sort(r.integers(0, 40, 3000))
    key = np.unique(p * len(index.terms) + r.integers(0, len(index.terms), 3000))
    p, t = key // len(index.terms), key % len(index.terms)
    dense = np.zeros((40, index.n))
    for a, b in zip(p, t, strict=True):
        for k in range(index.blocks_of[b], index.blocks_of[b + 1]):
            s = slice(index.first[k], index.first[k + 1])
            dense[a, index.item[s]] += index.weight[s]
    got = {(a, b) for a, b, _ in zip(*index.retrieve(p, t, np.arange(40)), strict=True)}
    assert got == set(zip(*np.nonzero(dense >= op8.THRESHOLD - 1e-9), strict=True)) and got


def test_stage_and_empty_tables(spark, tmp_path):
    items, docs = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bad = {d for d, _ in brute(items, docs)}
    out = op8.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [i for i in range(len(docs)) if i not in bad]
    assert op8.contaminated(df.limit(0), bench).count() == 0
    assert op8.contaminated(df, bench.limit(0)).count() == 0
    assert not list(blocks(pa.array([], pa.string())))


def test_items_of_every_length_are_found_word_by_word():
    r = random.Random(11)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [say(n) for n in (1, 2, 3, 4, 5, 20, 63, 64, 65, 100, 128, 129, 200, 250, 300, 400, 600, 1000, 2000)]
    index = op8.Index(list(range(len(items))), items)
    docs = [f"{say(r.randint(0, 150))} {x} {say(r.randint(0, 150))}" for x in items] + [say(3000)]
    (b,) = blocks(pa.array(docs))
    assert sorted((d, i) for d, i, *_ in op8.search(index, b)) == [(i, i) for i in range(len(items))]
