"""Nearest rank against sorted lists: ties, nulls, groups of one, a group with most rows."""

import random

from postmill.operators.select import nearest_rank


def test_nearest_rank(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["b", "c", None]), r.choice([None, *map(float, range(12))]), i) for i in range(600)] + [("one", 5.0, 600), ("two", 1.0, 601), ("two", 2.0, 602)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(5)
    for share in (0.0, 0.3, 0.5, 1.0):
        want = {}
        for key in {k for k, _, _ in rows}:
            v = sorted((v for k, v, _ in rows if k == key), key=lambda v: (v is not None, v or 0))
            want[key] = v[round((len(v) - 1) * share)]
        out = nearest_rank(df, ["k"], "v", share, "floor")
        assert out.columns == ["k", "v", "id", "floor"]
        assert sorted((tuple(x) for x in out.collect()), key=lambda x: x[2]) == [(k, v, i, want[k]) for k, v, i in rows]
    assert nearest_rank(df.limit(0), ["k"], "v", 0.3, "floor").count() == 0
