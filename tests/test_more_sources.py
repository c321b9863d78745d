import json
import os

from postmill.sources import feeds, ledgers, records


def test_feed_images(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss xmlns:media="m"><item><link>https://n.example/1</link><enclosure url="https://i.example/e.jpg" type="image/jpeg"/><enclosure url="https://i.example/a.mp3" type="audio/mpeg"/>'
        '<media:content url="https://i.example/m.jpg"/><description>&lt;img src=&quot;https://i.example/x.png&quot;&gt; &lt;img src=&quot;https://i.example/m.jpg&quot;&gt;</description></item>'
        "<item><link>https://n.example/2</link></item></rss>"
    )
    got = sorted((r.place, r.kind, r.url) for r in feeds.image_candidates(spark, [str(tmp_path / "f.xml")]).collect())
    assert got == [(1, "media", "https://i.example/m.jpg"), (2, "enclosure", "https://i.example/e.jpg"), (3, "embedded", "https://i.example/x.png")]
    assert feeds.image_candidates(spark, [str(tmp_path / "f.xml")], 1).count() == 1


def test_newest_files(spark, tmp_path):
    for i, n in enumerate("abc"):
        p = tmp_path / f"search_{n}.json"
        p.write_text("{}")
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [os.path.basename(p) for p in records.newest(spark, str(tmp_path), "search_*.json", 2)] == ["search_c.json", "search_b.json"]


def test_ledgers(spark, tmp_path):
    e = lambda v, s, t: {"video_id": v, "status": s, "at": t}
    (tmp_path / "ledger.json").write_text(json.dumps({"owner": "us", "entries": [e("1", "done", "2026-01-02"), e("2", "done", "2026-01-01"), e("", "x", "")]}))
    (tmp_path / "old.json").write_text(json.dumps({"owner": "us", "entries": [e("1", "seen", "2026-01-01"), e("2", "late", "2026-02-01")]}))
    (tmp_path / "their.json").write_text(json.dumps({"owner": "them", "entries": []}))
    (tmp_path / "config.json").write_text("{}")
    found = ledgers.discover(spark, str(tmp_path), "us")
    assert {(os.path.basename(r.path), r.found_by, r.problem) for r in found.collect()} == {("ledger.json", "name", None), ("old.json", "content", None), ("their.json", "content", "other_owner")}
    assert {(r.video_id, r.status) for r in ledgers.entries(found).collect()} == {("1", "done"), ("2", "late")}
