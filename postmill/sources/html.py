"""Pages: titles, links, listing cards, image candidates, article text. Expressions first; a parser where tags nest."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import plain_text
from postmill.functions.time import parse_listing_date
from postmill.functions.url import canonical


def title(html: Column) -> Column:
    return plain_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), 300)


def heading(html: Column) -> Column:
    return plain_text(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), 300)


def links(html: Column) -> Column:
    """All link targets, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def paragraphs(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?: [^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: plain_text(p, 5000))


def detail_text(html: Column, least: int = 40, most: int = 900) -> Column:
    """The description, or else the first paragraph, of at least `least` characters."""
    description = F.regexp_extract(html, r'(?i)<meta [^>]*name="description"[^>]*content="([^"]*)"', 1)
    found = F.filter(F.concat(F.array(plain_text(description, most)), paragraphs(html)), lambda x: F.length(x) >= least)
    return F.substring(F.get(found, F.lit(0)), 1, most)


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a full URL: of the page's own host where it begins with a slash."""
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(origin, link))


def image_candidates(pages: DataFrame, most: int = 8) -> DataFrame:
    """(page_id, url, kind, place): og and twitter images, then img sources, then what scripts name; each URL once, names
    of icons and logos last, at most `most` a page."""
    html = F.col("html")
    kinds = {
        "meta": F.regexp_extract_all(html, F.lit(r'(?i)<meta [^>]*(?:og:image|twitter:image)[^>]*content="([^"]+)"'), F.lit(1)),
        "img": F.regexp_extract_all(html, F.lit(r'(?i)<img [^>]*src="([^"]+)"'), F.lit(1)),
        "script": F.regexp_extract_all(html, F.lit(r'(?i)"image" *: *"([^"]+)"'), F.lit(1)),
    }

    def tagged(n, k, v):
        return F.transform(v, lambda u, i: F.struct(F.lit(n).alias("rank"), i.alias("i"), F.lit(k).alias("kind"), u.alias("url")))

    all_of = F.flatten(F.array(*[tagged(n, k, v) for n, (k, v) in enumerate(kinds.items())]))
    x = pages.select("page_id", F.col("url").alias("page_url"), F.explode(all_of).alias("c")).select("page_id", absolute(F.col("c.url"), F.col("page_url")).alias("url"), "c.kind", "c.rank", "c.i")
    x = x.filter("url is not null").groupBy("page_id", "url").agg(F.min(F.struct("rank", "i", "kind")).alias("c"))
    from postmill.operators.select import top

    generic = F.lower("url").rlike("logo|icon|avatar|placeholder|sprite")
    return top(x.select("page_id", "url", "c.kind", "c.rank", "c.i"), ["page_id"], most, generic, F.col("rank"), F.col("i"), keep_rank="place").select("page_id", "url", "kind", "place")


class _Cards(HTMLParser):
    """Anchors with their text, the outermost of nested ones, and the text since the last one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.href, self.depth, self.text, self.between = [], None, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.depth += 1
            if self.depth == 1:
                self.href, self.text = dict(attrs).get("href") or "", []

    def handle_endtag(self, tag):
        if tag == "a" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.cards.append({"href": self.href, "text": " ".join("".join(self.text).split()), "before": " ".join("".join(self.between).split())[-200:]})
                self.between = []

    def handle_data(self, data):
        (self.text if self.depth else self.between).append(data)


_CARD = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("href", "text", "before")]))


@F.pandas_udf(_CARD)
def _cards(html: pd.Series) -> pd.Series:
    def one(h):
        p = _Cards()
        p.feed(h or "")
        return p.cards

    return html.map(one)


def listing(pages: DataFrame) -> DataFrame:
    """(page_id, link, title, published): cards of the page's own host with a text and a date in or before them; each link once."""
    x = pages.select("page_id", "url", F.explode(_cards("html")).alias("c"))
    link = absolute(F.col("c.href"), F.col("url"))
    x = x.select("page_id", canonical(link).alias("link"), canonical(F.col("url")).alias("own"), F.col("c.text").alias("title"), F.coalesce(parse_listing_date(F.col("c.text")), parse_listing_date(F.col("c.before"))).alias("published"))
    host = lambda u: F.regexp_extract(u, "^[a-z]+://([^/]+)", 1)
    x = x.filter((F.col("link") != "") & (F.length("title") >= 4) & F.col("published").isNotNull() & (host(F.col("link")) == host(F.col("own"))))
    return x.groupBy("page_id", "link").agg(F.min(F.struct("title", "published")).alias("c")).select("page_id", "link", "c.title", "c.published")
