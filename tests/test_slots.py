"""Slots of made-up headlines."""

from pyspark.sql import functions as F

from postmill.operators import slots as s

V = s.Vocabulary(
    actions=["发布", "开源", "发布会", "launches"], names=["Acme", "星河"], hints=["公司", "大学"], noise=["合集", "网友"], lead=["消息称", "最新"], kinds=["模型", "系统"], generic=["模型", "The Tool"],
    ahead=["即将", "预计"], times=["[0-9]{4}-[0-9]{2}-[0-9]{2}", "明天|昨天"],
)


def test_slots(spark):
    cases = {
        "ACME launches a small robot。more": ("Acme", "launches", "a small robot", ""),
        "最新消息称南山大学开源视觉模型，网友热议 昨天": ("南山大学", "开源", "视觉模型", "昨天"),
        "星河多语模型开源#标签": ("星河", "开源", "多语模型", ""),
        "昨天开源，星河即将在北京发布 推理系统": ("星河", "发布", "推理系统", "昨天"),
        "2026-01-02 网友合集发布《长夜》": ("", "发布", "《长夜》", "2026-01-02"),
        "星河发布会结束": ("星河", "发布会", "结束", ""),
        "nothing to see": ("", "", "", ""),
        "": ("", "", "", ""),
        None: ("", "", "", ""),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").transform(s.with_slots, F.col("t"), V).collect()
    assert {r.t: tuple(r)[1:] for r in rows} == cases


def test_a_long_text_without_breaks(spark):
    text = "word " * 200_000 + "Acme launches x"
    (r,) = s.with_slots(spark.createDataFrame([(text, 1)], "t string, subject int"), F.col("t"), V).select("subject", "action", "time").collect()
    assert tuple(r) == ("Acme", "launches", "")


def test_plausible(spark):
    names = {"": False, "南山大学": True, "网友团": False, "Acme2": True, "two words": False, "two words 公司": True, "9a": False, "x": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", s.plausible_subject(F.col("n"), V).alias("p")).collect()
    assert {r.n: r.p for r in got} == names
    things = {"，x模型": False, "a": False, "the tool": False, "模型": False, "新模型": True, "v2": True}
    got = spark.createDataFrame([(n,) for n in things], "n string").select("n", s.plausible_object(F.col("n"), V).alias("p")).collect()
    assert {r.n: r.p for r in got} == things


def test_supported(spark):
    (r,) = spark.createDataFrame([("Acme-Bot 2", "the ACME bot, 2nd", "bot")], "v string, e string, f string").select(s.supported(F.col("v"), F.col("e")).alias("a"), s.supported(F.col("v"), F.col("f")).alias("b"), s.supported(F.lit("-a"), F.col("e")).alias("c")).collect()
    assert (r.a, r.b, r.c) == (True, False, False)
