import inspect
import math
import random
import re

import numpy as np

from postmill.llm import op3_minhash_dedup as op3

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sid string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeÉñ") for _ in range(r.randint(2, 7)))
    out = [None, "", " \n", "one two", "One  TWO", "one two three", "a b c d e", "A b c d e", "É b c d e"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 300))]
        out.append(" ".join(base))
        for _ in range(r.randint(1, 8)):  # copies of copies, some below the threshold
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = word()
            out.append(r.choice([" ", "\n", "  "]).join(copy))
            if r.random() < 0.4:
                base = copy
    out += [out[20]] * 30 + ["x " * 20000]
    r.shuffle(out)
    return list(enumerate(out, 100))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en", "s", 0, "clash") for d, t in rows], SCHEMA).repartition(5)
    got = op3.near_duplicates(df).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == brute(rows)


def test_heavy_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(op3, "UNIT", 2500)
    monkeypatch.setattr(op3, "HUB_ROUNDS", 0)
    rows = corpus()
    got = op3.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == brute(rows)


def test_stage_keeps_one_of_each_group_even_of_repeated_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B C D E F G"), (3, "other words stand here for now"), (None, "other words stand here for now"), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = op3.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect() if x.doc_id is not None) == [1, 3]
    assert op3.stage(spark, df.limit(0), "").count() == 0


def test_posterior_bound_keeps_similar_pairs():
    least = op3.least_matches()
    assert len(least) == op3.HASHES // op3.BATCH and (least < 0.86 * op3.BATCH * (1 + __import__("numpy").arange(len(least)))).all()


def at_percent(percent, rows):
    """brute() with another threshold: kept ids."""
    source = inspect.getsource(brute)
    assert ">= 85 *" in source
    names = dict(globals())
    exec(source.replace(">= 85 *", f">= {percent} *"), names)
    return names["brute"](rows)


def test_pairs_at_the_threshold_are_missed_once_in_a_million_by_all_looks_together():
    for percent in (80, 85):
        t = percent / 100
        look = [math.comb(op3.BATCH, k) * t**k * (1 - t) ** (op3.BATCH - k) for k in range(op3.BATCH + 1)]
        alive = np.ones(1)
        for least in op3.least_matches(percent):
            alive = np.convolve(alive, look)
            alive[:least] = 0
        assert 1 - alive.sum() < 1.2e-6


def test_texts_that_collide_under_polynomials_modulo_a_power_of_two_are_apart(spark):
    a = "a"
    while len(a) < 2048:  # Thue and Morse
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, a), (4, " ".join(a)), (5, " ".join(b))]
    got = op3.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == brute(rows)


def test_another_similarity(spark):
    rows = corpus()
    assert at_percent(80, rows) != brute(rows)
    got = op3.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 80).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got) == at_percent(80, rows)
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** op3.ROWS) ** op3.band_count(percent) < 1e-6


def test_stage_tells_rows_of_one_id_apart(spark):
    a, b, c, d = "a b c d e f g", "other words stand here for now", "these words have no id at all", "one more text that stands alone"
    rows = [(0, a), (1, a), (1, b), (1, c + " x"), (2, b), (None, c), (None, c), (None, a), (None, None), (3, d), (3, "")]
    for order in (rows, rows[::-1]):
        got = op3.stage(spark, spark.createDataFrame(order, "doc_id bigint, text string"), "").collect()
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in got) == sorted([(0, a), (1, b), (1, c + " x"), (-1, c), (-1, ""), (3, d), (3, "")])
