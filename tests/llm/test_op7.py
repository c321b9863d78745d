import hashlib
import random
from collections import Counter

import numpy as np

from postmill.llm import op7_suffix_dedup as op7

SCHEMA = "doc_id bigint, text string, key string"


def brute(rows):
    count = Counter()
    data = [(t or "").encode() for _, t in rows]
    for t in data:
        count.update(t[i : i + 200] for i in range(len(t) - 199))
    out = []
    for (d, _), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, many=60):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abc é\n") for _ in range(n))
    shared = [noise(r.randint(150, 900)) for _ in range(6)]
    out = [None, "", "x" * 199, "y" * 200, "y" * 201, "z" * 3000, "ab" * 800, noise(400)]
    for _ in range(many):
        t = noise(r.randint(0, 500))
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            t += s[a : r.randint(a, len(s))] + noise(r.choice([0, 1, 5, 300]))
        out.append(t)
    out += out[-3:] + [out[-5]] * 3
    return list(enumerate(out, 1)) + [(5, out[-1]), (6, out[-1]), (6, out[-1])]


def run(spark, rows):
    got = op7._removed(spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(4), False).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got)


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_dealt_out_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op7, "GROUP", 4)
    monkeypatch.setattr(op7, "HELD", 50)
    rows = corpus(2, 80)
    assert run(spark, rows) == brute(rows)


def test_suffix_sort_matches_plain_sort():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(200)]
    group = np.sort(np.array([r.randint(0, 20) for _ in texts]))
    size = np.array([len(t) for t in texts])
    s = op7.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, group)
    want = sorted(range(200), key=lambda i: (group[i], texts[i], i))
    assert s.order.tolist() == want


def test_kept_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 150), (2, "w" * 500)], "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.kept) for r in op7.remove_repeats(df).collect()}
    assert got == {1: b"q" * 150, 2: b""}
    assert op7.remove_repeats(df.limit(0)).count() == 0


def test_contexts_are_equal_for_equal_bytes_at_an_equal_place_only():
    data = np.frombuffer(b"abab" * 50 + b"abac" * 50, np.uint8)
    lo, hi, before = np.array([0, 4, 0, 200, 1]), np.array([100, 104, 100, 300, 101]), np.array([10, 10, 12, 10, 10])
    got = [tuple(x) for x in op7.contexts(data, lo, hi, before).tolist()]
    assert got[0] == got[1] and len(set(got)) == 4
    sides = op7.Sides(data).of(lo, hi)
    assert sides[0] == sides[1] == sides[2] and sides[3] != sides[0] and sides.all()


def test_settle_matches_plain_strings(monkeypatch):
    """By pairs and by suffix sort, with zero bytes at ends, groups of any size and members that count twice."""
    r = random.Random(5)
    shared = [bytes(r.choice(b"\0ab") for _ in range(368)) for _ in range(4)]
    unit, pos, lo, hi, n, slices = [], [], [], [], [], []
    for u in range(40):
        for _ in range(r.randint(1, 9)):
            s = bytearray(r.choice(shared))
            for _ in range(r.randint(0, 2)):
                s[r.randint(0, 367)] = r.choice(b"\0ab")
            left, right = r.choice([168, 168, r.randint(0, 168)]), r.choice([200, 200, r.randint(32, 200)])
            slices.append(bytes(s[168 - left : 168 + right]))
            for c, v in ((unit, u), (pos, 1000), (lo, 1000 - left), (hi, 1000 + right), (n, r.choice([1, 1, 1, 2]))):
                c.append(v)
    arrays = [np.array(c, np.int64) for c in (unit, pos, lo, hi, n)]
    count = Counter()
    at = lambda i, x: (unit[i], x, slices[i][1000 - lo[i] - x :][:200])
    fits = [[x for x in range(169) if 1000 - lo[i] >= x and hi[i] - 1000 >= 200 - x] for i in range(len(unit))]
    for i, xs in enumerate(fits):
        count.update({at(i, x): n[i] for x in xs})
    want = np.zeros((len(unit), 169), bool)
    for i, xs in enumerate(fits):
        want[i, xs] = [count[at(i, x)] > 1 for x in xs]
    for paired in (1, 3, 32):
        monkeypatch.setattr(op7, "PAIRED", paired)
        assert (op7.settle(*arrays, slices) == want).all() and 0 < want.sum() < want.size
