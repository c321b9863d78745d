"""Account hints by path, against a plain substring search; the plan has no product."""

from postmill.sources import records


def test_hints_by_path(spark):
    ids = ["a", "ab", "ABCDEFGH", "xABCDEFGHI", "MS4wLjABAAAA_one", "MS4wLjABAAAA_two", "one", "ü1", "", None]
    files = ["file:/d/ms4wljabaaaa_one.json", "file:/d/MS4wLjABAAAA_two/creator.jsonl", "file:/zz/xabcdefghi_1.json", "file:/zz/xabcdefgh.json", "q", "file:/k/Ü1.json", "x/ab"]
    posts = spark.createDataFrame([(f, s, "own", "Own") for f in files for s in ("creator", "search")], "raw_file string, source string, account_id string, account_name string")
    hints = spark.createDataFrame([(i, f"N {i}") for i in ids], "account_id string, account_name string")
    out = records.with_hints(posts, hints)
    want = set()
    for f in files:
        named = sorted((i for i in ids if i and i.lower() in f.lower()), key=lambda i: (-len(i), i))
        want.add((f, "creator", named[0] if named else "own", f"N {named[0]}" if named else "Own"))
        want.add((f, "search", "own", "Own"))
    assert {tuple(r) for r in out.select("raw_file", "source", "account_id", "account_name").collect()} == want and out.count() == len(posts.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
