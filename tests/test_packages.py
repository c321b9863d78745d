"""Publishing, the self-describing size, and resumable stages, broken where they can break."""

import json
import os

import pytest

from postmill.plans import selections
from postmill.plans.stages import Stages
from postmill.sinks import packages
from pyspark.sql import functions as F


class Killed(Exception):
    pass


def test_a_killed_writer_leaves_the_old_revision(spark, tmp_path):
    root = str(tmp_path)
    first = packages.publish(spark, {"a": spark.range(3), "b": spark.range(2)}, root, "pack")
    assert first["revision"] == 1 and packages.load(spark, root, "pack")["a"].count() == 3
    for step in ("staged", "moved"):

        def stop(at, step=step):
            if at == step:
                raise Killed

        with pytest.raises(Killed):
            packages.publish(spark, {"a": spark.range(5), "b": spark.range(2)}, root, "pack", stop)
        assert packages.pointer(spark, root, "pack") == first and packages.load(spark, root, "pack")["a"].count() == 3
        assert os.listdir(f"{root}/.staging") == []
    # the second one had moved its revision: other content may not take its place, the same content goes on from there
    with pytest.raises(packages.Collision):
        packages.publish(spark, {"a": spark.range(6), "b": spark.range(2)}, root, "pack")
    second = packages.publish(spark, {"a": spark.range(5), "b": spark.range(2)}, root, "pack")
    assert second["revision"] == 2 and second["supersedes"] == first["path"] and packages.load(spark, root, "pack")["a"].count() == 5


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path)

    def other(step):
        if step == "staged":
            packages.publish(spark, {"a": spark.range(9)}, root, "pack")

    with pytest.raises(packages.Collision):
        packages.publish(spark, {"a": spark.range(4)}, root, "pack", other)
    assert packages.pointer(spark, root, "pack")["revision"] == 1 and packages.load(spark, root, "pack")["a"].count() == 9
    assert os.listdir(f"{root}/.staging") == []


def test_equal_content_is_not_written(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", None), (2, None, [1])], "k int, v string, w array<int>")
    first = packages.publish(spark, {"t": rows}, root, "pack")
    before = {d: sorted(os.listdir(os.path.join(root, d))) for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))}
    assert packages.publish(spark, {"t": rows.repartition(3).orderBy(F.desc("k"))}, root, "pack") == first
    assert before == {d: sorted(os.listdir(os.path.join(root, d))) for d in os.listdir(root) if os.path.isdir(os.path.join(root, d))}
    assert packages.digest(rows) != packages.digest(rows.withColumn("v", F.coalesce("v", F.lit("")))) != packages.digest(rows.withColumnRenamed("v", "u"))


def test_text_is_replaced(spark, tmp_path):
    path = f"{tmp_path}/x.json"
    for text in ("one", "zwei ü", ""):
        packages.put_text(spark, path, text)
        assert packages.read_text(spark, path) == text
    assert [f for f in os.listdir(tmp_path) if f.endswith(".tmp")] == [] and packages.read_text(spark, f"{tmp_path}/none") is None


def test_artefacts_are_replaced(spark, tmp_path):
    from postmill.sinks.export import write_artefacts

    for n in (3, 2):
        write_artefacts({"board": spark.range(n).orderBy("id")}, f"{tmp_path}/out")
        with open(f"{tmp_path}/out/board.jsonl") as f:
            assert [json.loads(x) for x in f] == [{"id": k} for k in range(n)]


def test_a_size_that_counts_itself(spark, tmp_path):
    for size in (*range(0, 130), *(10**k + d for k in range(2, 13) for d in range(-140, 20))):
        files = [{"path": "ü", "bytes": max(0, size)}]
        text = packages.self_describing(files)
        assert json.loads(text)["total_bytes"] == max(0, size) + len(text.encode())
    folder = tmp_path / "f"
    (folder / "sub").mkdir(parents=True)
    (folder / "sub" / "a.bin").write_bytes(b"x" * 900)
    for _ in range(2):  # the second time over its own manifest
        got = packages.size_gate(spark, str(folder), 1000)
        real = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))
        assert got == {"total_bytes": real, "limit": 1000, "ok": real <= 1000}
    assert packages.size_gate(spark, str(folder), real)["ok"] and not packages.size_gate(spark, str(folder), real - 1)["ok"]


def test_stages_go_on_where_they_broke(spark, tmp_path):
    root, made = str(tmp_path), []

    def job(power, broken=False):
        s = Stages(spark, root)

        def step(name, fn):
            def make(*rows, **settings):
                made.append(name)
                if broken and name == "last":
                    raise Killed
                return fn(*rows, **settings)

            return make

        a = s.run("first", [s.source("numbers", spark.range(4))], step("first", lambda x: x.withColumn("v", F.col("id") + 1)))
        b = s.run("middle", [a], step("middle", lambda x, power: x.withColumn("v", F.pow("v", F.lit(power)).cast("bigint"))), {"power": power})
        c = s.run("last", [a, b], step("last", lambda x, y: y.agg(F.sum("v").alias("v"))))
        return c.rows.first().v, s.log

    with pytest.raises(Killed):
        job(2, broken=True)
    assert made == ["first", "middle", "last"]
    made.clear()
    assert job(2)[0] == 30 and made == ["last"]
    made.clear()
    files = sorted(os.listdir(root))
    assert job(2)[0] == 30 and made == [] and sorted(os.listdir(root)) == files
    assert job(3)[0] == 100 and made == ["middle", "last"]


CANDIDATE = "id bigint, title string, author string, source string, media string, seconds double, size bigint, heat double"


def test_themed_selection(spark, tmp_path):
    rows = [(1, "robot arm", "a", "s", "video", 40.0, 10, 9.0), (2, "robot leg", "a", "s", "video", 41.0, 10, 8.0), (3, "robot eye", "a", "t", "video", 50.0, 10, 7.0), (4, "robot hand advert", "b", "t", "video", 50.0, 10, 9.0),
            (5, "robot ear", "b", "t", "image", 50.0, 10, 9.0), (6, "robot toe", "b", "t", "video", 5.0, 10, 9.0), (7, "robot rib", "c", "t", "video", None, 10, 6.0), (8, "robot hip", "c", "t", "video", 50.0, 10, 0.5), (9, "cat", "c", "t", "video", 50.0, 10, 9.0),
            (10, "robot jaw", "d", "u", "video", 60.0, 10, 5.0), (11, "robot lip", "e", "u", "video", 60.0, 999, 4.0), (12, "robot neck", "f", "u", "video", 60.0, 10, 3.0)]
    c, d = spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([(10,)], "id bigint")
    settings = ({"exclude": ["advert"], "least_seconds": 10.0, "most_seconds": 100.0, "least_heat": 1.0}, None, {"target": 4, "floor": 0, "ceiling": 100, "per_author": 2})
    got = selections.themed_selection(spark, c, d, str(tmp_path), ["robot"], *settings)
    assert {r.id: (r.stage, r.role) for r in got["selection"].collect()} == {1: ("taken", "main"), 2: ("taken", "support"), 3: ("author", None), 7: ("taken", "support"), 11: ("ceiling", None), 12: ("taken", "main")}
    assert {r.reason: r.n for r in got["audit"].collect()} == {"excluded_term": 1, "media_type": 1, "duration": 1, "heat": 1, "not_in_pool": 2, "selected": 4, "quota_author": 1, "quota_ceiling": 1}
    again = selections.themed_selection(spark, c, d, str(tmp_path), ["robot"], *settings)
    assert all(kept for _, _, kept in again["log"])
    changed = selections.themed_selection(spark, c, d, str(tmp_path), ["robot"], settings[0], None, settings[2] | {"target": 1})
    assert [(n, kept) for n, _, kept in changed["log"]] == [("gates", True), ("pool", True), ("selection", False), ("audit", False)]


def test_daily_pool(spark, tmp_path):
    from tests.test_jobs import ARTICLE, POST, D

    a = [("a", "media", "Robot maker opens new plant", "https://x.example/1", "x.example", "", D), ("b", "media", "Robot maker opens a new plant today", "https://y.example/1", "y.example", "", D.replace(hour=10)),
         ("c", "official", "Chip act passes", "https://z.example/1", "z.example", "", D), ("d", "media", "Robot of the day before", "https://w.example/1", "w.example", "", D.replace(day=24))]
    p = [("v1", "s", "the robot plant", "https://v.example/1", "", D, 1000, 0, 0, 0, None), ("v1", "s", "the robot plant again", "https://v.example/9", "", D, 10, 0, 0, 0, None), ("v2", "s", "nothing here", "https://v.example/2", "", D, 5, 0, 0, 0, None),
         ("v3", "s", None, "https://v.example/3", "", D, 5, 0, 0, 0, None), ("v4", "s", "robot", "https://v.example/4", "", D.replace(day=24), 5, 0, 0, 0, None)]
    posts, news = spark.createDataFrame(p, POST), spark.createDataFrame(a, ARTICLE)
    got = selections.daily_pool(spark, posts, news, "2026-08-25", str(tmp_path))
    assert [(r.title, r.n_articles, r.confirmed, r.videos) for r in got["pool"].orderBy(F.desc("engagement")).collect()] == [("Robot maker opens new plant", 2, True, ["v1"]), ("Chip act passes", 1, True, [])]
    assert {r.reason: r.n for r in got["audit"].collect()} == {"in_an_event": 1, "duplicate": 1, "no_event": 1, "no_title_or_link": 1, "outside_day": 1}
    files = sorted(os.listdir(tmp_path))
    again = selections.daily_pool(spark, posts, news, "2026-08-25", str(tmp_path))
    assert all(kept for _, _, kept in again["log"]) and sorted(os.listdir(tmp_path)) == files
