"""Queries over pages, conversations (transcripts) and embeddings (perceptual hashes)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.ids import derived_id, sign_bits
from postmill.functions.number import clock, half_up
from postmill.functions.url import canonical, host, redact
from postmill.operators import verdicts
from postmill.operators.frames import ENOUGH, FREE, LEAST_AREA, LOW, clip_class, frame_hits, hit_ratio, uneven, with_sample_check
from postmill.operators.joins import in_windows, near_hashes
from postmill.operators.select import chunks, evenly
from postmill.plans.registry import query
from postmill.sources import html
from postmill.sources.tables import table

#: Ours: lines shipped within so many days are frames that came; lines with so much discount have boxes.
EMITTED_DAYS, BOX_DISCOUNT = 60, 0.05


@query(r"""
select page_id, regexp_extract(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)), '.*', 0) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))
  || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') as canonical_url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host from pages""")
def url_canonical(spark, sf_dir):
    """Canonical URLs and hosts."""
    return table(spark, sf_dir, "pages").select("page_id", canonical(F.col("url")).alias("canonical_url"), host(F.col("url")).alias("host"))


@query("""
with b as (select page_id, split_part(url, '#', 1) as bare from pages), p as (select page_id, split_part(bare, '?', 1) as base, list_filter(string_split(case when contains(bare, '?') then substr(bare, strpos(bare, '?') + 1) else '' end, '&'),
  lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ('token', 'sign', 'signature', 'key', 'auth', 'expires', 'session', 'ref')) as kept from b)
select page_id, case when len(kept) > 0 then base || '?' || array_to_string(kept, '&') else base end as safe_url from p""")
def url_redact(spark, sf_dir):
    """URLs without fragment and sensitive parameters."""
    return table(spark, sf_dir, "pages").select("page_id", redact(F.col("url")).alias("safe_url"))


_PLAIN = lambda x: (
    f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
)


@query(f"""select page_id, substr({_PLAIN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, 1, 300) as title, substr({_PLAIN("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, 1, 300) as heading from pages""")
def html_title_extract(spark, sf_dir):
    """Titles and first headings."""
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.heading(F.col("html")).alias("heading"))


@query(r"""select page_id, i - 1 as place, l as href from (select page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)) as l, generate_subscripts(regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1), 1) as i from pages)""")
def html_links(spark, sf_dir):
    """All links of each page with their place."""
    x = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("place", "href"))
    return x.select("page_id", F.col("place").cast("bigint").alias("place"), "href")


@query(r"""select page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as raw_length,
  len(regexp_extract_all(html, '(?i)<p[ >]')) as n_paragraphs from pages""")
def html_text_len(spark, sf_dir):
    """Length of each page's text, and its paragraphs."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " "), "<[^>]*>", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("bigint").alias("raw_length"), F.size(F.regexp_extract_all("html", F.lit("(?i)<p[ >]"), F.lit(0))).cast("bigint").alias("n_paragraphs"))


@query("""
with h as (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host from pages)
select host, count(*) as n_pages, 'host-' || substr(sha256(host), 1, 16) as host_id, min(page_id) as first_page from h group by host""")
def host_directory(spark, sf_dir):
    """Hosts with derived ids."""
    h = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))
    return h.groupBy("host").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).select("host", "n_pages", derived_id("host-", 16, F.col("host")).alias("host_id"), "first_page")


@query("select conv_id, turn, round(length(regexp_replace(text, '\\s+', '', 'g')) / greatest(1.0, 2 + turn * 3), 4) as chars_per_second, length(regexp_replace(text, '\\s+', '', 'g')) / greatest(1.0, 2 + turn * 3) < 60 as sparse from conversations")
def speech_density(spark, sf_dir):
    """Characters a second of each segment."""
    rate = verdicts.speech_rate(F.col("text"), 2.0 + F.col("turn") * 3)
    raw = F.length(F.regexp_replace("text", r"\s+", "")) / F.greatest(F.lit(1.0), 2.0 + F.col("turn") * 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rate.alias("chars_per_second"), (raw < 60).alias("sparse"))


@query("""
with s as (select conv_id, turn, 10.0 * turn as a, 10.0 * turn + 7 as z from conversations), w(lo, hi, name) as (values (0, 15, 'opening'), (15, 45, 'middle'), (45, 90, 'close'))
select conv_id, turn, name from s, w where (a >= lo and a < hi) or ((a + z) / 2 >= lo and (a + z) / 2 < hi)""")
def segment_window_join(spark, sf_dir):
    """Segments that begin or have their middle in a window of the script."""
    a = F.col("turn") * 10.0
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("a"), (a + 3.5).alias("m"))
    w = spark.createDataFrame([(0, 15, "opening"), (15, 45, "middle"), (45, 90, "close")], "lo int, hi int, name string")
    w = s.select("conv_id").distinct().withColumn("w", F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(n).alias("name")) for lo, hi, n in w.collect()]))).select("conv_id", "w.*")
    return in_windows(s, w, "conv_id", F.col("a"), F.col("m"), F.col("lo"), F.col("hi")).select("conv_id", "turn", "name")


@query("""
with d as (select conv_id, cast(sum(length(text)) as double) / 50 as duration from conversations group by 1), c as (select conv_id, duration, unnest(generate_series(0, cast(floor(duration / 8) as bigint))) as i from d)
select conv_id, i * 8.0 as clip_start, round(least(duration, i * 8.0 + 8), 3) as clip_end from c where least(duration, i * 8.0 + 8) - i * 8.0 >= 3 - 1e-9""")
def clip_intervals(spark, sf_dir):
    """Clips of 3 to 8 seconds from each timeline."""
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.length("text")).cast("double") / 50).alias("duration"))
    return d.select("conv_id", F.explode(chunks(F.lit(0.0), F.col("duration"), 3.0, 8.0)).alias("c")).select("conv_id", "c.clip_start", "c.clip_end")


@query("""
with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
p as (select *, list_transform([0, 1, 2, 3], lambda k: cast(round_even(k * (n - 1) / 3.0, 0) as bigint)) as picks from r)
select conv_id, turn from p where n <= 4 or list_contains(picks, i)""")
def even_sample(spark, sf_dir):
    """Four frames of each video, evenly spread."""
    return evenly(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 4)


@query("""
select conv_id, string_agg('[' || lpad(cast(turn * 37 // 60 as varchar), 2, '0') || ':' || lpad(cast(turn * 37 % 60 as varchar), 2, '0') || '] ' || role, chr(10) order by turn) as script from conversations group by 1""")
def script_lines(spark, sf_dir):
    """Each transcript as lines with times."""
    line = F.concat(F.lit("["), clock(F.col("turn") * 37), F.lit("] "), F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("script"))


@query("""
with v as (select vec_id, label, list_count(list_filter(embedding, lambda x: x > 0.2)) / len(embedding) as ratio, list_max(embedding) as top from embeddings)
select vec_id, label, round(ratio, 4) as face_ratio, case when ratio <= 0.05 then 'face_free' when ratio <= 0.15 then 'low' else 'high' end as face_class from v""")
def face_class(spark, sf_dir):
    """The share of frames with a face, and its class."""
    ratio = F.size(F.filter("embedding", lambda x: x > F.lit(0.2).cast("float"))) / F.size("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", half_up(ratio, 4).alias("face_ratio"), verdicts.face_class(ratio).alias("face_class"))


@query("""
with h as (select vec_id, array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bits from embeddings), c as (select bits, min(vec_id) as left_id from h group by 1)
select a.left_id, b.left_id as right_id, cast(hamming(a.bits, b.bits) as int) as distance from c a join c b on a.left_id < b.left_id where hamming(a.bits, b.bits) <= 3
union all select left_id, vec_id, 0 from h join c using (bits) where vec_id <> left_id""")
def hamming_pairs(spark, sf_dir):
    """Pairs of 64-bit hashes that differ in at most 3 bits; equal ones as members of a class, which one of them stands for."""
    return near_hashes(table(spark, sf_dir, "embeddings").select("vec_id", sign_bits(F.col("embedding")).alias("bits")), "vec_id", "bits", 3)


@query("""
with t as (select conv_id, turn, role, text, lag(role) over (partition by conv_id order by turn) as prior from conversations)
select conv_id, count(*) as n_turns, count_if(role = prior) as n_repeats, count_if(turn > 0 and role = 'system') as n_late_system, cast(sum(length(text)) as bigint) as n_chars from t group by 1""")
def script_skeleton_check(spark, sf_dir):
    """Transcripts whose parts are out of order."""
    t = table(spark, sf_dir, "conversations").withColumn("prior", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == F.col("prior")).alias("n_repeats"), F.count_if((F.col("turn") > 0) & (F.col("role") == "system")).alias("n_late_system"), F.sum(F.length("text")).alias("n_chars"))


@query()
def listing_cards(spark, sf_dir):
    """Dated cards of listing pages, by an HTML parser."""
    stamped = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "<li>", "<li>2024-01-31 "))
    return html.listing(stamped)


@query()
def page_images(spark, sf_dir):
    """Image candidates of pages: link targets read as pictures, since the pages have none of their own."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", '<a href="', '<img src="'))
    return html.image_candidates(p)


@query(f"""
with l as (select l_orderkey as clip, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_tax) as i, l_quantity * 1.0 as w, l_partkey * 1.0 as h, l_partkey * l_tax as bh, l_shipdate <= o_orderdate + interval {EMITTED_DAYS} day as emitted, l_discount >= {BOX_DISCOUNT} as found
  from lineitem join orders on l_orderkey = o_orderkey),
f as (select clip, row_number() over (partition by clip order by i) as place, w, h from l where emitted),
b as (select clip, row_number() over (partition by clip order by i) as place, w * bh as area from l where found),
n as (select clip, count(*) as expected, cast(count_if(emitted) as bigint) as emitted, count_if(found) as n_boxes from l group by 1),
h as (select f.clip, cast(count_if(coalesce(area / (greatest(w, 1) * greatest(h, 1)) >= {LEAST_AREA}, false)) as bigint) as n_hits from f left join b on f.clip = b.clip and f.place = b.place group by 1),
r as (select n.clip, expected, emitted, n_boxes <> emitted as uneven, coalesce(n_hits, 0) as n_hits, case when emitted > 0 then coalesce(n_hits, 0) / emitted end as ratio from n left join h on n.clip = h.clip),
c as (select *, emitted < expected * {ENOUGH} as cut, case when ratio is null then 'unavailable' when ratio <= {FREE} then 'face_free' when ratio <= {LOW} then 'low_face' else 'face_heavy' end as class from r)
select clip, expected, emitted, uneven, n_hits, case when cut then 'unavailable' else class end as class, case when cut then 'sample_truncated' end as reason, cut as low_confidence, case when cut then round(emitted / expected, 6) end as sample_coverage from c""")
def sampled_clip_class(spark, sf_dir):
    """An order as a clip: lines shipped early are the frames that came, discounted lines the lists of boxes, matched by
    place; the class by the share of hit frames, unavailable for a badly cut sample."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")  # noqa: E741
    came = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr(f"interval {EMITTED_DAYS} days")
    size = lambda h: F.struct(F.col("l_quantity").cast("double").alias("w"), h.cast("double").alias("h"))
    line = F.struct(*key, came.alias("came"), (F.col("l_discount") >= BOX_DISCOUNT).alias("found"), size(F.col("l_partkey")).alias("frame"), F.array(size(F.col("l_partkey") * F.col("l_tax"))).alias("boxes"))
    c = l.groupBy(F.col("l_orderkey").alias("clip")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    frames = F.transform(F.filter("lines", lambda x: x["came"]), lambda x: x["frame"])
    boxes = F.transform(F.filter("lines", lambda x: x["found"]), lambda x: x["boxes"])
    c = c.select("clip", F.size("lines").cast("bigint").alias("expected"), F.size(frames).cast("bigint").alias("emitted"), uneven(frames, boxes).alias("uneven"), frame_hits(frames, boxes).alias("hits"))
    c = c.withColumns({"n_hits": F.size(F.filter("hits", lambda h: h)).cast("bigint"), "class": clip_class(hit_ratio(F.col("hits"))), "reason": F.lit(None).cast("string"), "low_confidence": F.lit(False), "sample_coverage": F.lit(None).cast("double")})
    c = c.withColumn("truncated", F.col("emitted") < F.col("expected"))
    return with_sample_check(c, "truncated", "expected", "emitted").drop("hits", "truncated")
