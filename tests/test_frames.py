from pyspark.sql import functions as F

from postmill.operators import frames

BOX = "array<struct<w: double, h: double>>"


def clip(spark, rows):
    boxes = lambda x: x if x is None else [tuple(map(float, b)) for b in x]
    rows = [(k, boxes(frames), [boxes(x) for x in found]) for k, frames, found in rows]
    return spark.createDataFrame(rows, f"k int, frames {BOX}, boxes array<{BOX}>")


def test_hits_belong_to_frames_by_place_and_uneven_lengths_are_violations(spark):
    rows = [
        (1, [(100, 100), (100, 100), (100, 100)], [[(10, 15)], [(10, 14.9)], [(1, 1), (50, 50)]]),
        (2, [(100, 100), (100, 100)], [[(90, 90)]]),
        (3, [(100, 100)], [[], [(90, 90)]]),
        (4, [(0, 0)], [[(0.1, 0.2)]]),
        (5, [], []),
        (6, [(10, 10)], [None]),
        (7, [(10, 10)], [[(-5, -5)]]),
    ]
    hits, bad = frames.frame_hits(F.col("frames"), F.col("boxes")), frames.uneven(F.col("frames"), F.col("boxes"))
    got = {r.k: (r.hits, r.bad) for r in clip(spark, rows).select("k", hits.alias("hits"), bad.alias("bad")).collect()}
    assert got == {1: ([True, False, True], False), 2: ([True, False], True), 3: ([False], True), 4: ([True], False), 5: ([], False), 6: ([False], False), 7: ([False], False)}


def test_classes_by_share_of_hit_frames(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.0501,), (0.15,), (0.16,), (None,)], "r double")
    assert [r.c for r in df.select(frames.clip_class(F.col("r")).alias("c")).collect()] == ["face_free", "face_free", "low_face", "low_face", "face_heavy", "unavailable"]
    df = clip(spark, [(1, [(1, 1)] * 4, [[(1, 1)]]), (2, [], [])])
    assert [r.r for r in df.select(frames.hit_ratio(frames.frame_hits(F.col("frames"), F.col("boxes"))).alias("r")).collect()] == [0.25, None]


def test_severely_truncated_samples_say_nothing(spark):
    rows = [
        (1, "face_free", None, True, 10, 4, False, None),
        (2, "face_free", None, True, 10, 5, True, 0.5),
        (3, "low_face", "given", True, 9, 4, None, None),
        (4, "low_face", "", False, 10, 1, False, None),
        (5, "low_face", "", True, 0, 0, False, None),
        (6, "face_heavy", "", True, 3, None, False, None),
        (7, "face_heavy", None, None, 3, 1, False, None),
    ]
    df = spark.createDataFrame(rows, "k int, class string, reason string, cut boolean, expected int, emitted int, low_confidence boolean, sample_coverage double")
    got = {r.k: (r["class"], r.reason, r.low_confidence, r.sample_coverage) for r in frames.with_sample_check(df, "cut", "expected", "emitted").collect()}
    assert got == {
        1: ("unavailable", "sample_truncated", True, 0.4),
        2: ("face_free", None, True, 0.5),
        3: ("unavailable", "given", True, 0.444444),
        4: ("low_face", "", False, None),
        5: ("low_face", "", False, None),
        6: ("unavailable", "sample_truncated", True, 0.0),
        7: ("face_heavy", None, False, None),
    }
