"""Sets compared by blocks and quotas by ranges, against plain loops; blocks are small, so that every row meets heads of earlier ones."""

import random

from postmill.operators import sets
from postmill.operators.select import evict_oldest
from pyspark.sql import functions as F


def test_blocks_of_sets(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["x", None]), r.sample("abcdefghij", r.randint(0, 6))) for i in range(120)]
    _, classes = sets.sets_of(spark.createDataFrame(rows, "id bigint, k string, t array<string>"), "id", "t", 2, ["k"])
    first, want = {}, set()
    for i, k, t in rows:
        if len(t) >= 2:
            first.setdefault((k, frozenset(t)), i)
    like = lambda a, b: a[0] == b[0] and len(a[1] & b[1]) >= 2 and len(a[1] & b[1]) / min(len(a[1]), len(b[1])) >= 0.6
    want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and like(a, b)}
    got = [(p.left_id, p.right_id) for p in sets.like_pairs(classes, 2, 0.6, 25).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    heads, expected = [], {}
    for a, i in sorted(first.items(), key=lambda v: v[1]):
        expected[i] = next((j for b, j in heads if like(a, b)), i)
        if expected[i] == i:
            heads.append((a, i))
    found, kept = sets.first_like(classes, 2, 0.6, 25)
    assert {x.left_id: x.head for x in found.collect()} == expected and {x.left_id for x in kept.collect()} == {i for _, i in heads}


def test_a_quota_over_many_ranges(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["hot", "hot", "hot", "cold", None]), r.randint(0, 9), r.choice([None, *range(50)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k string, day int, size bigint").repartition(5)
    x = evict_oldest(df, "size", 400, ["k"], F.asc("day"), F.asc("id"))
    want = {}
    for key in ("hot", "cold", None):
        own = sorted((d, i, n or 0) for i, k, d, n in rows if k == key)
        left = sum(n for *_, n in own)
        for _, i, n in own:
            want[i], left = left > 400, left - n
    assert {v.id: v.evicted for v in x.collect()} == want
