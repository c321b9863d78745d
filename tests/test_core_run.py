"""The core run over exports made here: six records, five of the day, four different ones."""

import json

import pytest

from postmill.config import EngineConfig, distinct_terms, expand_keywords, keyword_plan
from postmill.plans import core_run
from postmill.sources import feeds, records


@pytest.fixture
def exports(tmp_path):
    flat = [
        {"aweme_id": "1", "title": "Robot walks", "create_time": "2026-08-25T09:00:00+08:00", "nickname": "科***号", "creator_hash": "acc1", "liked_count": "1.2万", "collected_count": "300", "comment_count": "80", "share_count": "1,024", "aweme_url": "https://v.example/video/1"},
        {"aweme_id": "2", "title": "Chip news", "create_time": "2026-08-25T10:00:00+08:00", "creator_hash": "acc1", "liked_count": "5", "aweme_url": "https://v.example/video/2"},
        {"aweme_id": "3", "title": "Late one", "create_time": "2026-08-24T23:59:59+08:00", "creator_hash": "acc1", "aweme_url": "https://v.example/video/3"},
        {"aweme_id": "4", "title": "Open model", "create_time": "2026-08-25T12:00:00", "creator_hash": "acc2", "liked_count": "7", "aweme_url": "https://v.example/video/4"},
    ]
    lines = [json.dumps(x, ensure_ascii=False) for x in flat]
    lines[1] = lines[1].replace("Chip news", "Chip\nnews")  # cut inside a string
    (tmp_path / "creator_contents.jsonl").write_text("﻿" + "\n".join(lines[:2]) + "\nnot json\n" + "\n".join(lines[2:]) + "\n\n")
    nested = {"data": {"aweme_list": [
        {"aweme_id": "1", "desc": "Robot walks again", "create_time": 1787634000000, "author": {"uid": "acc9", "nickname": "N"}, "statistics": {"digg_count": 12000, "comment_count": "3.5万"}, "share_url": "https://v.example/video/1?x=1"},
        {"aweme_id": "5", "desc": "Satellite", "create_time": 1787634000, "author": {"uid": "acc9"}, "statistics": {"digg_count": 1}, "share_url": "https://v.example/video/5"},
    ]}}
    (tmp_path / "search_contents.json").write_text(json.dumps(nested, ensure_ascii=False))
    return [str(tmp_path / "creator_contents.jsonl"), str(tmp_path / "search_contents.json")]


def test_six_records_five_of_the_day_four_different(spark, exports):
    out = core_run.run(spark, exports, "2026-08-25", EngineConfig(categories=[("tech", 1, ["chip"])]))
    rows = {(r.video_id, r.source): r for r in out["normalised"].collect()}
    assert len(rows) == 6
    assert rows["1", "creator"].likes == 12000 and rows["1", "creator"].shares == 1024 and rows["1", "search"].comments == 35000
    assert rows["2", "creator"].title == "Chip\nnews" and rows["2", "creator"].plays is None and "plays" in rows["2", "creator"].missing
    assert out["eligible"].count() == 5 and [r.reason for r in out["excluded"].collect()] == ["outside_day"]
    accepted = {r.video_id: r for r in out["accepted"].collect()}
    assert set(accepted) == {"1", "2", "4", "5"} and out["duplicates"].count() == 1
    assert out["state"].count() == 4 and all([str(d) for d in r.days] == ["2026-08-25"] for r in out["state"].collect())
    assert all(r.flag == "play_count_missing" for r in out["benchmark"].collect())
    again = core_run.run(spark, exports, "2026-08-25", EngineConfig(categories=[("tech", 1, ["chip"])]), out["state"].drop("status"))
    assert {r.status for r in again["state"].collect()} == {"seen_again"}


def test_hints_and_first_seen(spark, exports):
    x = records.normalise(records.read_raw(spark, exports))
    assert records.first_seen(x).count() == 5
    h = spark.createDataFrame([("creator_contents", "Known")], "account_id string, account_name string")
    assert {r.account_name for r in records.with_hints(x, h).filter("source = 'creator'").collect()} == {"Known"}


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>https://n.example/a</link><pubDate>Tue, 25 Aug 2026 00:00:00 +0800</pubDate><description>&lt;p&gt;Text&lt;/p&gt;</description></item>"
        "<item><title>No date</title><link>https://n.example/b</link></item><item><title>cut off"
    )
    (tmp_path / "f.json").write_text(json.dumps({"items": [{"title": "J - The Paper", "url": "https://j.example/1", "date_published": "2026-08-25T01:02:03Z"}]}))
    (r,) = feeds.read_xml(spark, [str(tmp_path / "f.xml")], "wire").collect()
    assert (r.title, r.domain, str(r.published)) == ("A & B", "n.example", "2026-08-24 16:00:00")
    both, errors = feeds.read_all(spark, [{"name": "x", "paths": [str(tmp_path / "f.xml")]}, {"name": "j", "format": "json", "paths": [str(tmp_path / "f.json")]}, {"name": "gone", "paths": [str(tmp_path / "none.xml")]}])
    assert both.count() == 2 and errors == [{"source": "gone", "error": "AnalysisException"}]
    assert {(r.source, r.title) for r in feeds.split_publisher(both).collect()} == {("x", "A & B"), ("The Paper", "J")}


def test_config():
    with pytest.raises(ValueError, match="pool_size"):
        EngineConfig(pool_size=10)
    with pytest.raises(ValueError, match="priority_weights"):
        EngineConfig(priority_weights={"heat": 1.0})
    assert distinct_terms(["A", " b"], ["a", "c", ""]) == ["A", "b", "c"]
    assert keyword_plan(["x"], ["y"], 3, 3) == ["x"] and keyword_plan(["x"], ["y"], 2, 3) == ["x", "y"]
    assert expand_keywords("s", [["a", "b"], ["A", "c"]], 4) == ["s", "a", "b", "c"]
