from datetime import datetime

from postmill.plans import jobs

ARTICLE = "source string, source_kind string, title string, url string, domain string, summary string, published timestamp"
POST = "video_id string, source string, title string, url string, keyword string, published timestamp, likes bigint, comments bigint, shares bigint, collects bigint, plays bigint"
D = datetime(2026, 8, 25, 9)


def test_daily_news(spark):
    a = [
        ("a", "media", "Robot maker opens new plant", "https://x.example/1", "x.example", "", D),
        ("b", "media", "Robot maker opens a new plant today", "https://y.example/1", "y.example", "", D.replace(hour=10)),
        ("c", "official", "Chip act passes", "https://z.example/1", "z.example", "", D),
        ("d", "media", "Weather is fine", "https://w.example/1", "w.example", "", D),
    ]
    p = [("v1", "s", "the robot plant", "u", "", D, 1000, 0, 0, 0, None), ("v2", "s", "nothing here", "u", "", D, 5, 0, 0, 0, None)]
    got = jobs.daily_news(spark.createDataFrame(a, ARTICLE), spark.createDataFrame(p, POST)).collect()
    rows = {r.title: r for r in got}
    r = rows["Robot maker opens new plant"]
    assert (r.n_articles, r.n_domains, r.confirmed, r.n_posts, r.engagement, r.score, r["rank"]) == (2, 2, True, 1, 1000.0, 74.0, 1)
    assert rows["Chip act passes"].confirmed and not rows["Weather is fine"].confirmed and len(got) == 3


def test_ranking_board(spark):
    p = [("1", "s", "robot plant opens today", "a", "robot", D, 100, 1, 1, 1, None), ("1", "s", "robot plant opens today", "b", "robot", D, 10, 1, 1, 1, None), ("2", "s", "robot plant opens now", "c", "robot", D.replace(hour=11), 5, 0, 0, None, 3), ("3", "s", "chip act", "d", "", D.replace(hour=12), 7, 0, 0, 0, 0), ("4", "s", None, "e", "", D, 1, 1, 1, 1, 1)]
    got = jobs.ranking_board(spark.createDataFrame(p, POST)).collect()
    assert [(r["rank"], r.title, r.n_videos) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "robot plant opens today", 2), (2, "chip act", 1)]
    assert all(abs(r.score - (r.likes + r.comments + r.collects + r.shares + r.freshness + r.related)) < 1e-6 for r in got)
