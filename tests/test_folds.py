"""Order-dependent operators against plain versions, one row after the other."""

import random
import re
from difflib import SequenceMatcher

from postmill.operators import folds, sets, stories
from postmill.operators.components import components
from postmill.operators.joins import near_hashes, similar_sets
from postmill.operators.select import numbered
from pyspark.sql import functions as F


def token_rows(seed, n=60):
    r = random.Random(seed)
    return [(i, r.choice("ab"), r.sample("one two three four five six seven eight".split(), r.randint(1, 6))) for i in range(n)]


def first_fit(rows, fits, grow=None):
    """Clusters of rows of one key: the first that fits, else a new one."""
    out, clusters = {}, {}
    for i, key, t in sorted(rows):
        own = clusters.setdefault(key, [])
        k = fits(own, set(t))
        if k is None:
            k = len(own)
            own.append(set(t))
        elif grow:
            own[k] |= set(t)
        out[i] = k
    return out


def test_token_clusters(spark):
    rows = token_rows(1)
    df = spark.createDataFrame(rows, "id bigint, key string, tokens array<string>")
    for least, share, grow in ((3, 0.55, True), (2, 0.4, False), (2, 0.0, False)):

        def fits(own, t, least=least, share=share):
            return next((k for k, c in enumerate(own) if len(t & c) >= least and len(t & c) / min(len(t), len(c)) >= share), None)

        got = {r.id: r.cluster for r in folds.token_clusters(df, ["key"], [("id", True)], "tokens", least, share, grow).collect()}
        assert got == first_fit(rows, fits, grow) and max(got.values()) > 1


def test_best_title_clusters(spark):
    rows = token_rows(2)

    def fits(own, t):
        scores = [(len(t & c) / min(len(t), len(c)), -k) for k, c in enumerate(own)]
        return -max(scores)[1] if scores and max(scores)[0] >= 0.55 else None

    got = {r.id: r.cluster for r in folds.best_title_clusters(spark.createDataFrame(rows, "id bigint, key string, pairs array<string>"), ["key"], [("id", True)], "pairs").collect()}
    assert got == first_fit(rows, fits)


def test_cards_hashes_and_mains(spark):
    cards = spark.createDataFrame([(1, 0, "price 10", ["10"]), (1, 1, "price 10 now", ["10"]), (1, 2, "price 20 now", ["20"]), (1, 3, "", []), (1, 4, "price", []), (1, 5, "other words", [])], "id int, at int, t string, n array<string>")
    got = {r.at: (r.card, r.card_text) for r in folds.merge_cards(cards, ["id"], [("at", True)], "t", "n").collect()}
    assert got == {0: (0, "price 10 now"), 1: (0, "price 10 now"), 2: (1, "price 20 now"), 3: (None, None), 4: (0, "price 10 now"), 5: (2, "other words")}
    pics = spark.createDataFrame([(0, 0b0, 1), (1, 0b1, 2), (2, 0b11111, 1), (3, 0b1111100000, 2), (4, 0b1111100001, 3)], "id int, bits bigint, scene int").withColumn("k", F.lit(1))
    assert {r.id: r.pick for r in folds.drop_near_hashes(pics, ["k"], [("id", True)], "bits", 3).collect()} == {0: 0, 1: None, 2: 1, 3: 2, 4: None}
    assert {r.id: r.pick for r in folds.drop_near_hashes(pics, ["k"], [("id", True)], "bits", 3, 2, "scene").collect()} == {0: 0, 1: None, 2: None, 3: 1, 4: None}
    pool = spark.createDataFrame([(1, "x", "s", 40.0), (2, "x", "t", 40.0), (3, "y", "s", 40.0), (4, "z", "u", 5.0)], "id int, author string, source string, seconds double").withColumn("k", F.lit(1))
    assert {r.id: r.role for r in folds.main_and_support(pool, ["k"], [("id", True)], "author", "source", "seconds", 30.0).collect()} == {1: "main", 2: "support", 3: "main", 4: "support"}
    assert {r.id: r.role for r in folds.main_and_support(pool, ["k"], [("id", True)], "author", "source", "seconds", 90.0).collect()} == {1: "main", 2: "support", 3: "main", 4: "support"}


def judged(a, b):
    """The relation of two signatures, by sets."""
    both = {s: set(a[s]) & set(b[s]) for s in stories.SETS}
    if a["models"] and b["models"] and not both["models"]:
        return "different"
    if a["entities"] and b["entities"] and not (both["entities"] or both["subjects"] or both["models"]):
        return "different"
    if len(both["models"]) == 1 and min(len(a["models"]), len(b["models"])) >= 3:
        return "related"
    if both["models"] or both["subjects"]:
        return "same"
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    if both["entities"] and both["dates"]:
        cut = []
        for x in (a, b):
            t = x["text"]
            for name in [e for e in a["entities"] if e in both["entities"]] + [d for d in a["dates"] if d in both["dates"]]:
                t = t.replace(name, " ")
            cut.append({g for g in grams(t, 3) if " " not in g})
        if cut[0] & cut[1]:
            return "same"
    n, j = len(both["tokens"]), len(both["tokens"]) / max(1, len(set(a["tokens"]) | set(b["tokens"])))
    if (n >= 5 and j >= 0.52) or (both["entities"] and n >= 4 and j >= 0.22):
        return "same"
    p, q = grams(a["text"], 2), grams(b["text"], 2)
    if 2 * len(p & q) / max(1, len(p) + len(q)) >= 0.68:
        return "same"
    return "related" if both["entities"] or n >= 2 else "different"


def test_story_clusters(spark):
    r = random.Random(4)
    some = lambda words, least, most: r.sample(words.split(), r.randint(least, most))
    rows = []
    for i in range(90):
        tokens = some("ax by cz dw ev fu gt hs", 0, 7)
        rows.append((i, r.choice("kl"), some("m1 m2 m3 m4", 0, 1) if r.random() < 0.8 else some("m1 m2 m3 m4", 3, 4), some("s1 s2 s3 s4 s5 s6 s7", 0, 1), some("acme bolt cora", 0, 2), some("0501 0502", 0, 1), tokens, "".join(tokens + some("acme0501xyz pqrs mno", 0, 2))))
    schema = "id bigint, key string, models array<string>, subjects array<string>, entities array<string>, dates array<string>, tokens array<string>, text string"
    df = spark.createDataFrame(rows, schema)
    got = {x.id: x.cluster for x in stories.story_clusters(df, ["key"], "id").collect()}
    sig = {x[0]: dict(zip(schema.replace(",", "").split()[::2], x, strict=True)) for x in rows}
    relation = lambda a, b: judged(sig[a], sig[b])
    want, clusters = {}, []
    for i in sorted(sig):
        c = next((c for c in clusters if sig[c[0]]["key"] == sig[i]["key"] and relation(c[0], i) == "same" and all(relation(m, i) != "different" for m in c[1:])), None)
        if c is None:
            c = []
            clusters.append(c)
        c.append(i)
        want[i] = c[0]
    assert got == want and 10 < len(clusters) < 80


def test_stories_without_a_common_word(spark):
    """Two texts that differ in a letter and share no token are one story; a word that all rows have joins nobody."""
    none = ([], [], [], [])
    rows = [(1, "k", *none, ["qwertyuiop"], "qwertyuiopasdfghjkl"), (2, "k", *none, ["qwertyuiap"], "qwertyuiapasdfghjkl"), *((10 + i, "k", *none, ["every", f"w{i}"], "every" + "".join(chr(300 + 20 * i + k) for k in range(12))) for i in range(30))]
    schema = "id bigint, key string, models array<string>, subjects array<string>, entities array<string>, dates array<string>, tokens array<string>, text string"
    df = spark.createDataFrame(rows, schema)
    got = {x.id: x.cluster for x in stories.story_clusters(df, ["key"], "id").collect()}
    assert got == {i: (1 if i == 2 else i) for i in got} and len(got) == 32
    assert stories.candidates(df, ["key"], "id").count() < 30  # of 435 pairs that share a word


def test_card_texts_grow(spark):
    """Against the rule, row by row: the card's present text decides, and its numbers."""
    r = random.Random(9)
    parts = ["alpha beta", "alpha beta gamma", "gamma", "price 10", "price 20", "price", "alpha bexa", "", "delta epsilon zeta", "delta epsilon zets"]
    rows = [(k % 3, k, " ".join(r.sample(parts, r.randint(1, 2))).strip()) for k in range(70)]
    rows = [(v, at, t, sorted(set(re.findall("[0-9]+", t)))) for v, at, t in rows]
    got = {x.at: (x.card, x.card_text) for x in folds.merge_cards(spark.createDataFrame(rows, "id int, at int, t string, n array<string>").repartition(3), ["id"], [("at", True)], "t", "n").collect()}
    want = {}
    for v in range(3):
        cards = []
        for _, at, t, n in [x for x in rows if x[0] == v]:
            fits = lambda c, t=t, n=n: not (n and c[1] and n != c[1]) and (t in c[0] or c[0] in t or SequenceMatcher(None, c[0], t).ratio() >= 0.85)
            c = next((c for c in cards if fits(c)), None) if t else None
            if t and c is None:
                c = [t, n, []]
                cards.append(c)
            elif t and len(t) > len(c[0]):
                c[:2] = t, n
            if t:
                c[2].append(at)
            else:
                want[at] = (None, None)
        want |= {at: (k, c[0]) for k, c in enumerate(cards) for at in c[2]}
    assert got == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 300: 200}


def test_similar_sets_and_hashes_lose_no_pair(spark):
    r = random.Random(7)
    words = "abcdefghijklmnop"
    sets = [(i, r.sample(words[:5], r.randint(1, 5)) if i % 2 else r.sample(words, r.randint(0, 9))) for i in range(120)] + [(200, list("abc")), (201, list("cab"))]
    first = {}
    for i, s in sorted(sets):
        first.setdefault(frozenset(s), i)
    want = {(first[frozenset(s)], i): 1.0 for i, s in sets if len(set(s)) >= 3 and first[frozenset(s)] != i}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a & b) >= 3 and len(a & b) / min(len(a), len(b)) >= 0.55:
                want[i, j] = len(a & b) / min(len(a), len(b))
    got = {(x.left_id, x.right_id): x.overlap for x in similar_sets(spark.createDataFrame(sets, "id bigint, s array<string>"), "id", "s", 3, 0.55).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 100

    base = [r.getrandbits(64) - 2**63 for _ in range(6)]
    hashes = [(i, r.choice(base) ^ sum(1 << b for b in r.sample(range(63), r.randint(0, 3)))) for i in range(80)]
    first = {}
    for i, h in hashes:
        first.setdefault(h, i)
    want = {(first[h], i): 0 for i, h in hashes if first[h] != i} | {(i, j): d for a, i in first.items() for b, j in first.items() if i < j and (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 4}
    got = {(x.left_id, x.right_id): x.distance for x in near_hashes(spark.createDataFrame(hashes, "id bigint, bits bigint"), "id", "bits", 4).collect()}
    assert got == want


def test_places_in_a_whole_table(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 91).alias("v")).repartition(7)
    got = [r.id for r in sorted(numbered(df, "place", F.desc("v"), F.asc("id")).collect(), key=lambda r: r.place)]
    assert got == [r.id for r in df.orderBy(F.desc("v"), F.asc("id")).collect()]


def test_stories_of_equal_titles_make_no_pairs(spark, monkeypatch):
    """Copies go where the first of them went, and blocks of any size find the same pairs."""
    words = ["launch", "of", "the", "new", "probe"]
    one = lambda i, models, t: (i, "k", models, [], [], [], t, "".join(t))
    rows = [one(i, [], words) for i in range(0, 400, 2)] + [one(i, ["m1"], [*words, "m1"]) for i in range(1, 400, 4)] + [one(i, ["m2"], [*words, "m2"]) for i in range(3, 400, 4)]
    df = spark.createDataFrame(rows, "id bigint, key string, models array<string>, subjects array<string>, entities array<string>, dates array<string>, tokens array<string>, text string")
    pairs, found = [], stories.same_pairs
    monkeypatch.setattr(stories, "same_pairs", lambda rows, size=None: pairs.append(found(rows, size)) or pairs[-1])
    got = {x.id: x.cluster for x in stories.story_clusters(df, ["key"], "id").collect()}
    assert got == {i: 3 if i % 4 == 3 else 0 for i in range(400)} and pairs[0].count() == 2
    whole, small = (sorted(map(tuple, found(stories.signed(df.filter("id < 40"), ["key"], "id"), n).collect())) for n in (None, 7))
    assert whole == small and len(whole) == 680  # all of 780 but those of m1 with m2


def test_most_shared_against_plain_counts(spark, monkeypatch):
    """Equal rows count as one, nulls as least, whatever the blocks; no window gets more than n rows a task and event."""
    r = random.Random(12)
    some = lambda most: r.sample("ab bc cd de ef fg gh hi".split(), r.randint(0, most))
    rows = [(i % 150, r.choice([None, 1, 2, 3]) if i < 150 else 7, [*some(4), "all"]) for i in range(200)] + [(3, 7, ["ab", "bc"]), (3, 7, ["ab"]), (None, 9, ["ab"]), (900, None, None)]
    events = [(k % 7, [*some(5), "all", "none"]) for k in range(9)] + [(50, [])]
    df, ev = spark.createDataFrame(rows, "doc long, n int, t array<string>"), spark.createDataFrame(events, "item long, t array<string>")
    often = {w for w in {w for x in rows for w in x[2] or ()} if sum(w in (x[2] or ()) for x in rows) > 0.4 * len(rows)}
    want, counts = set(), {}
    for item, words in events:
        for doc, n, t in rows:
            for w in set(t or ()) & set(words) - often:
                counts[item, doc, n] = counts.get((item, doc, n), 0) + 1
    for item in {e[0] for e in events}:
        found = sorted(((-s, n is None, -(n or 0), d is not None, d or 0, d) for (i, d, n), s in counts.items() if i == item))[:3]
        want |= {(item, x[5], -x[0], k) for k, x in enumerate(found, 1)}
    for size in (10_000, 2):
        monkeypatch.setattr(sets, "EVENTS", size)
        assert {(x["item"], x.doc, x.n_shared, x.place) for x in sets.most_shared(df.repartition(3), ev, 3, 0.4).collect()} == want and "all" in often and len(want) > 15
