"""Greedy choices by rounds, against loops over the rows."""

import random

from postmill.operators import rounds
from pyspark.sql import functions as F


def test_conflicts_as_pairs(spark):
    r = random.Random(1)
    graphs = {"chain": [(i, i + 1) for i in range(15)], "clique": [(i, j) for i in range(12) for j in range(i)], "random": [tuple(sorted(r.sample(range(80), 2))) for _ in range(160)], "none": []}
    for name, pairs in graphs.items():
        pairs = {tuple(sorted(p)) for p in pairs}
        taken, out = set(), set()
        for n in sorted({x for p in pairs for x in p}):
            (out if any((t, n) in pairs for t in taken) else taken).add(n)
        got = [x.node for x in rounds.kept_out(spark.createDataFrame(sorted(pairs), "a bigint, b bigint")).collect()]
        assert sorted(got) == sorted(out), name


def loop(rows, marks):
    """rows: (id, key, marks...), in order."""
    seen, out = {}, {}
    for own, key, *values in rows:
        hit = next((seen[key, k, v] for k, v in enumerate(values) if v and (key, k, v) in seen), None)
        out[own] = hit
        if hit is None:
            seen |= {(key, k, v): own for k, v in enumerate(values) if v}
    return out


def test_marks(spark):
    r = random.Random(2)
    some = lambda n: r.choice([None, "", *[f"m{k}" for k in range(n)]])
    rows = [(i, r.choice(["x", "y", None]), some(9), some(30), some(60)) for i in range(200)]
    rows += [(1000 + i, "chain", f"c{i // 2}", f"d{(i + 1) // 2}", None) for i in range(20)]  # each one meets the next
    rows += [(2000 + i, "hot", "same", None, f"h{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, key string, a string, b string, c string").repartition(3)
    got = {x.id: x.duplicate_of for x in rounds.first_of_marks(df, ["key"], [("id", True)], ["a", "b", "c"], "id").collect()}
    assert got == loop(rows, 3)
    back = {x.id: x.duplicate_of for x in rounds.first_of_marks(df, ["key"], [("id", False)], ["a", "b", "c"], "id").collect()}
    assert back == loop(rows[::-1], 3)
    assert rounds.first_of_marks(df.limit(0), ["key"], [("id", True)], ["a", "b"], "id").collect() == []


def test_first_fit_with_empty_sets_and_repeated_ones(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["x", None]), r.choice([None, [], r.sample("abcdefgh", r.randint(1, 5))])) for i in range(150)] + [(200 + i, "x", list("abc")) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, key string, t array<string>").repartition(3)
    for least, share, best in ((2, 0.4, False), (1, 0.55, True), (2, 0.0, False)):
        want, heads = {}, {}
        for i, key, t in rows:
            own, t = heads.setdefault(key, []), set(t or [])
            score = [len(t & h) / max(1, min(len(t), len(h))) if len(t & h) >= least else -1.0 for h in own]
            fit = [k for k, s in enumerate(score) if s >= share]
            want[i] = (max(fit, key=lambda k: (score[k], -k)) if best else fit[0]) if fit else len(own)
            if not fit:
                own.append(t)
        got = {x.id: x.cluster for x in rounds.first_fit(df, ["key"], [("id", True)], "t", least, share, best).collect()}
        assert got == want, (least, share, best)


def test_picks(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", None, "z"]), r.randint(0, 5), r.choice([None, "s", "t", "u"])) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, key string, v int, s string")
    new = lambda taken: F.col("s").isNotNull() & ~F.exists(taken, lambda t: F.coalesce(t["s"] == F.col("s"), F.lit(False)))
    far = lambda taken: F.forall(taken, lambda t: F.abs(t["v"] - F.col("v")) > 1)
    got = {x.id: x.pick for x in rounds.picks(df, ["key"], [("v", False), ("id", True)], ["v", "s"], [[lambda t: new(t) & far(t), far]] * 4, "pick").collect()}
    want = dict.fromkeys((x[0] for x in rows))
    for key in {x[1] for x in rows}:
        taken = []
        for _ in range(4):
            left = [x for x in sorted(rows, key=lambda x: (-x[2], x[0])) if x[1] == key and x not in taken and all(abs(x[2] - t[2]) > 1 for t in taken)]
            fresh = [x for x in left if x[3] is not None and x[3] not in {t[3] for t in taken}]
            if left:
                x = (fresh or left)[0]
                want[x[0]] = len(taken)
                taken.append(x)
    assert got == want


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([(1, "k", "a")], "id bigint, key string, a string")
    plan = rounds.first_of_marks(df, ["key"], [("id", True)], ["a"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
