"""Values at the edges of a rule, where an engine's own types and names of numbers decide."""

from postmill.functions.number import half_up
from postmill.functions.text import sentences
from postmill.operators import folds
from postmill.plans.catalogue import QUERIES
from pyspark.sql import functions as F


def test_a_double_is_rounded_as_the_double_it_is(spark):
    x = spark.createDataFrame([(0.45 * 1.13,), (0.5,), (-0.0625,), (None,)], "x double")
    assert [r.y for r in x.select(half_up("x", 3).alias("y")).collect()] == [0.508, 0.5, -0.063, None]


def test_sentences_keep_the_digits_at_their_ends(spark):
    x = spark.createDataFrame([("Zero here it is 0. 10.20.30.41. 22 of these 2!\u00a0\n x \u3000",)], "t string")
    assert x.select(sentences(F.col("t"), 1, 9).alias("s")).first().s == ["Zero here it is 0.", "10.20.30.41.", "22 of these 2!", "x"]


def test_a_hash_like_one_left_out_is_left_out(spark):
    # 2 is near 1 and goes; 3 equals 2, so 1 keeps it out as well
    x = spark.createDataFrame([(1, 0b0), (2, 0b11), (3, 0b11), (4, 0b111111111)], "id int, bits bigint").withColumn("k", F.lit(1))
    assert {r.id: r.pick for r in folds.drop_near_hashes(x, ["k"], [("id", True)], "bits", 4).collect()} == {1: 0, 2: None, 3: None, 4: 1}


def test_a_float_is_compared_as_a_float(spark, tmp_path):
    spark.createDataFrame([(1, 0, [0.15, 0.2, 0.1]), (2, 0, [0.3])], "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_large, r.first_large, r.last_large) for r in QUERIES["frame_positions"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 0, 0)}
    assert {r.vec_id: r.face_ratio for r in QUERIES["face_class"](spark, str(tmp_path)).collect()} == {1: 0.0, 2: 1.0}
