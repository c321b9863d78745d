from pyspark.sql import functions as F

from postmill.sinks import export
from postmill.sources import registry
from postmill.streaming import ingest


def test_manifest_finds_every_difference(spark, tmp_path):
    a = tmp_path / "pack"
    a.mkdir()
    for n in ("one", "two", "three"):
        (a / f"{n}.txt").write_text(n)
    m = spark.createDataFrame(export.manifest(spark, str(a)).collect())
    assert {r.path: r.bytes for r in m.collect()} == {"one.txt": 3, "two.txt": 3, "three.txt": 5}
    h = export.content_hash(m)
    assert export.verify(m, export.manifest(spark, str(a))).count() == 0
    (a / "one.txt").write_text("ONE")
    (a / "two.txt").unlink()
    (a / "four.txt").write_text("4")
    found = export.manifest(spark, str(a))
    assert {r.path: r.problem for r in export.verify(m, found).collect()} == {"one.txt": "content", "two.txt": "missing", "four.txt": "unlisted"}
    assert export.content_hash(found) != h


def test_publish_moves_on_only_with_new_content(spark, tmp_path):
    df = spark.range(5)
    first = export.publish(spark, df, str(tmp_path), "pack", None)
    assert first["revision"] == 1
    assert export.publish(spark, df, str(tmp_path), "pack", first) == first
    second = export.publish(spark, spark.range(6), str(tmp_path), "pack", first)
    assert second["revision"] == 2 and second["supersedes"] == first["path"]


def test_sanitised(spark):
    df = spark.createDataFrame([("1", "t", "c", "f", 0), ("2", "u", "c", "f", 1)], "video_id string, title string, session_cookie string, raw_file string, position int")
    out, removed, sensitive = export.sanitised(df, 1)
    assert out.columns == ["video_id", "title"] and out.collect()[0].video_id == "1" and removed == ["session_cookie", "raw_file", "position"] and sensitive == ["session_cookie"]


def test_registry(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert registry.load("parquet", spark, f"{tmp_path}/p").count() == 3 and "feed_xml" in registry.names()


def test_stream_counts_each_event_once(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.union(e.limit(50)).repartition(3).write.parquet(f"{tmp_path}/in")
    posts = ingest.once(ingest.read_posts(spark, f"{tmp_path}/in", e.schema), "60 days")
    ingest.write(posts, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == e.count() and got.select("event_id").distinct().count() == e.count()
    heat = ingest.windowed_heat(ingest.read_posts(spark, f"{tmp_path}/in", e.schema))
    q = heat.writeStream.format("memory").queryName("heat").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("heat").agg(F.sum("n_posts")).first()[0] == e.count() + 50
