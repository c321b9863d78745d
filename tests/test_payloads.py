"""Configured sources read in tasks: failures and budgets are rows, no source stops another."""

import json

import pytest

from postmill.sources import payloads

ITEM = '<item><title>T{0}</title><link>https://n.example/{0}</link><pubDate>Tue, 25 Aug 2026 00:00:0{0} +0800</pubDate>{1}</item>'


@pytest.fixture
def sources(tmp_path):
    pic = '<enclosure url="https://i.example/e.jpg" type="image/jpeg"/>'
    (tmp_path / "a.xml").write_text("<rss><channel>" + ITEM.format(1, pic) + ITEM.format(2, "") + "<item><title>cut")
    (tmp_path / "b.json").write_text(json.dumps({"items": [{"title": "J", "url": "https://j.example/1", "date_published": "2026-08-25T01:02:03Z"}, {"title": "no date"}]}))
    (tmp_path / "p.json").write_text("﻿" + json.dumps({"data": [{"aweme_id": "7", "title": "Post", "create_time": 1787634000}]}))
    (tmp_path / "empty.xml").write_text("")
    s = lambda name, file, form, **o: {"name": name, "path": str(tmp_path / file), "format": form, **o}
    return [s("a", "a.xml", "xml"), s("gone", "none.xml", "xml"), s("b", "b.json", "json", kind="official"), s("p", "p.json", "posts"), s("empty", "empty.xml", "xml"), s("odd", "a.xml", "csv"), s("off", "a.xml", "xml", enabled=False), {"name": "pathless"}]


def test_fetch(spark, sources):
    assert payloads.read(spark, sources).rdd.getNumPartitions() == 7
    got = payloads.fetch(spark, sources)
    report = {r.name: r for r in got["report"].collect()}
    assert {n: (r.status, r.n_items) for n, r in report.items()} == {"a": ("success", 2), "gone": ("failed", 0), "b": ("success", 1), "p": ("success", 1), "empty": ("empty", 0), "odd": ("failed", 0), "pathless": ("failed", 0)}
    assert report["odd"].error == "unknown_format csv" and "KeyError" in report["pathless"].error and report["gone"].error
    assert {(r.source, r.source_kind, r.title) for r in got["articles"].collect()} == {("a", "media", "T1"), ("a", "media", "T2"), ("b", "official", "J")}
    assert [(r.video_id, r.raw_file) for r in got["posts"].collect()] == [("7", "p")]
    assert str(report["a"].newest) == "2026-08-24 16:00:02"


def test_shared_budgets(spark, sources, tmp_path):
    size = {s["name"]: (tmp_path / s["path"]).stat().st_size for s in sources if s["name"] in ("a", "b", "p")}
    status = lambda **o: {r.name: r.error for r in payloads.read(spark, sources, **o).collect()}
    got = status(total_bytes=size["a"] + size["p"])  # b does not fit any more, p does
    assert size["b"] > size["p"] and (got["a"], got["b"], got["p"]) == (None, "byte_budget", None)
    assert status(max_bytes=size["a"] - 1)["a"] == "too_large"
    got = status(max_requests=3)
    assert (got["b"], got["p"], got["empty"]) == (None, "request_budget", "request_budget")
    assert status(total_seconds=-1)["a"] == "time_budget"


def test_health(spark, sources):
    got = {r.name: (r.status, r.image_candidates, r.image_kinds) for r in payloads.health(spark, sources[:2] + sources[4:5]).collect()}
    assert got == {"a": ("reachable_with_images", 1, ["enclosure"]), "gone": ("unreachable", 0, []), "empty": ("reachable_no_images", 0, [])}


def test_no_sources(spark):
    assert payloads.read(spark, []).count() == 0
    assert payloads.fetch(spark, [])["report"].count() == 0
