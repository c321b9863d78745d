"""Queries over evidence, materials, probes and packages: fallbacks, orders, budgets by rank, constraints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.number import clamp, clock_seconds, duration_seconds, half_up
from postmill.functions.text import has_any, safe_name, strip_suffixes, words
from postmill.functions.time import parse_feed_date, parse_listing_date
from postmill.functions.url import allowed_https, host, is_signed, safe_relative_path
from postmill.operators import checks
from postmill.operators.select import best, first_reason, ranked, top
from postmill.operators.text_rules import ladder
from postmill.plans.articles import any_of
from postmill.plans.registry import query
from postmill.sources.tables import ARTICLES_SQL, POSTS_SQL, articles, posts, table


@query(f"""
select lang, count(*) as n, count_if({any_of('text', ['license'])}) as n_notice, count_if(contains(text, '|')) as n_table, count_if(n_chars > 3000) as n_long, count(distinct source) as n_domains from documents group by 1""")
def source_category_counts(spark, sf_dir):
    """Counts of kinds and domains by language, in one pass."""
    c = F.count_if
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), c(has_any(F.col("text"), ["license"])).alias("n_notice"), c(F.contains("text", F.lit("|"))).alias("n_table"), c(F.col("n_chars") > 3000).alias("n_long"), F.countDistinct("source").alias("n_domains")
    )


@query("""
with l as (select conv_id, length(text) as chars, (50 + turn * 9 + length(text) % 30) / 120.0 as conf from conversations),
q as (select conv_id, count(*) as n_lines, cast(sum(chars) as bigint) as chars, round(median(conf), 6) as confidence, count_if(chars >= 200) as long_cards, round(count_if(conf >= 0.5) / count(*), 6) as coverage from l group by 1)
select *, case when (chars >= 800 or long_cards >= 2) and confidence >= 0.6 and coverage >= 0.5 then 'success' when chars >= 200 and (confidence >= 0.6 or coverage >= 0.5) then 'partial' else 'failed' end as tier from q""")
def ocr_quality(spark, sf_dir):
    """Lines of recognised text to a quality tier: amount, median confidence, coverage."""
    l = table(spark, sf_dir, "conversations").select("conv_id", F.length("text").alias("chars"), ((50 + F.col("turn") * 9 + F.length("text") % 30) / F.lit(120.0)).alias("conf"))  # noqa: E741
    q = l.groupBy("conv_id").agg(
        F.count("*").alias("n_lines"), F.sum("chars").alias("chars"), half_up(F.percentile("conf", F.lit(0.5)), 6).alias("confidence"), F.count_if(F.col("chars") >= 200).alias("long_cards"),
        half_up(F.count_if(F.col("conf") >= 0.5) / F.count("*"), 6).alias("coverage"),
    )
    sure, wide = F.col("confidence") >= 0.6, F.col("coverage") >= 0.5
    return q.withColumn("tier", ladder((((F.col("chars") >= 800) | (F.col("long_cards") >= 2)) & sure & wide, "success"), ((F.col("chars") >= 200) & (sure | wide), "partial"), otherwise="failed"))


_TITLE_WORDS = "list_distinct(regexp_extract_all(lower(substr(split_part(text, chr(10), 1), 1, 180)), '[\\p{L}\\p{N}]{2,}'))"


@query(f"""
with d as (select source, doc_id, {_TITLE_WORDS} as ws from documents), n as (select source, count(*) as n from d group by 1), t as (select source, unnest(ws) as token from d),
c as (select source, token, count(*) as seen from t group by all), r as (select c.source, token, seen, n, row_number() over (partition by c.source order by seen desc, token) as place, max(seen * 2 >= n) over (partition by c.source) as any_common from c join n on c.source = n.source)
select source, array_to_string(list(token order by place), ',') as anchors, any(any_common) as common from (select * from r where case when any_common then seen * 2 >= n else place <= 3 end) group by 1""".replace("any(any_common)", "bool_or(any_common)"))
def cluster_signature(spark, sf_dir):
    """A cluster's anchors: tokens that half of its titles have, or its three most frequent."""
    d = articles(spark, sf_dir).select("source", F.array_distinct(words(F.substring("title", 1, 180))).alias("ws"))
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    c = d.select("source", F.explode("ws").alias("token")).groupBy("source", "token").agg(F.count("*").alias("seen")).join(n, "source")
    w = Window.partitionBy("source")
    r = c.withColumn("place", F.row_number().over(w.orderBy(F.desc("seen"), F.asc("token")))).withColumn("common", F.max(F.col("seen") * 2 >= F.col("n")).over(w))
    r = r.filter(F.when(F.col("common"), F.col("seen") * 2 >= F.col("n")).otherwise(F.col("place") <= 3))
    anchors = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ",")
    return r.groupBy("source").agg(anchors.alias("anchors"), F.bool_or("common").alias("common"))


@query("""
with f as (select l_orderkey, abs(l_discount - lag(l_discount) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)) as delta from lineitem)
select l_orderkey, count(delta) as n_deltas, round(avg((round(delta, 6) >= 0.02)::int), 6) as motion_ratio, avg((round(delta, 6) >= 0.02)::int) >= 0.2 as moving from f group by 1 having count(delta) > 0""")
def motion_ratio(spark, sf_dir):
    """The share of neighbouring frames that differ enough."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", F.abs(F.col("l_discount") - F.lag("l_discount").over(w)).alias("delta"))
    moved = F.avg(F.when(F.col("delta").isNotNull(), (half_up("delta", 6) >= 0.02).cast("int")))
    return f.groupBy("l_orderkey").agg(F.count("delta").alias("n_deltas"), half_up(moved, 6).alias("motion_ratio"), (moved >= 0.2).alias("moving")).filter("n_deltas > 0")


@query("""
select l_orderkey, array_to_string(list(l_partkey order by floor(l_quantity / 10), l_extendedprice, l_partkey), ',') as reading_order, round(avg(l_tax), 6) as confidence from lineitem group by 1""")
def ocr_reading_order(spark, sf_dir):
    """Text boxes of a frame, by line and then from left to right."""
    key = F.struct(F.floor(F.col("l_quantity") / 10).alias("y"), F.col("l_extendedprice").alias("x"), F.col("l_partkey").alias("t"))
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("b"), half_up(F.avg("l_tax"), 6).alias("confidence"))
    return x.select("l_orderkey", F.array_join(F.transform("b", lambda z: z["t"].cast("string")), ",").alias("reading_order"), "confidence")


@query("""
with c as (select p_partkey as k, p_size as size, p_type as stamp, 'cached' as verdict from part where p_type = 'ECONOMY'), f as (select p_partkey as k, case when p_brand = 'Brand#7' then p_size + 1 else p_size end as size, p_type as stamp from part)
select f.k, coalesce(verdict, 'fresh') as verdict from f left join c on f.k = c.k and f.size = c.size and f.stamp = c.stamp""")
def validation_cache_replay(spark, sf_dir):
    """A cached verdict counts if size and stamp are still the same."""
    p = table(spark, sf_dir, "part")
    c = p.filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_type").alias("stamp"), F.lit("cached").alias("verdict"))
    f = p.select(F.col("p_partkey").alias("k"), F.when(F.col("p_brand") == "Brand#7", F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.col("p_type").alias("stamp"))
    return f.join(c, ["k", "size", "stamp"], "left").select("k", F.coalesce("verdict", F.lit("fresh")).alias("verdict"))


@query("""
with t as (select event_id, case event_id % 4 when 0 then lpad(cast(event_id % 60 as varchar), 2, '0') || ':' || lpad(cast(event_id % 50 as varchar), 2, '0') when 1 then '1:0' || event_id % 10 || ':30' when 2 then cast(event_id as varchar) else 'N/A' end as written from events)
select event_id, written, case when regexp_matches(written, '^[0-9]+(:[0-9]{1,2}){1,2}$') then list_reduce(list_transform(string_split(written, ':'), lambda x: cast(x as bigint)), lambda a, x: a * 60 + x) end as seconds from t""")
def progress_parse(spark, sf_dir):
    """MM:SS and H:MM:SS to seconds."""
    e = F.col("event_id")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    written = F.when(e % 4 == 0, F.concat(pad(e % 60), F.lit(":"), pad(e % 50))).when(e % 4 == 1, F.concat(F.lit("1:0"), (e % 10).cast("string"), F.lit(":30"))).when(e % 4 == 2, e.cast("string")).otherwise("N/A")
    return table(spark, sf_dir, "events").select("event_id", written.alias("written"), clock_seconds(written).alias("seconds"))


@query("""
with e as (select conv_id, max(case when role = 'system' then text end) as caption, max(case when role = 'assistant' and turn = 1 and length(text) > 200 then text end) as ocr, max(case when role = 'assistant' and turn = 3 then text end) as ocr_part, max(case when role = 'user' and turn = 0 then text end) as description from conversations group by 1)
select conv_id, case when caption is not null then 'caption' when ocr is not null then 'ocr' when ocr_part is not null and description is not null then 'ocr_partial_description' when description is not null then 'description' else 'none' end as method,
  length(coalesce(caption, ocr, ocr_part || chr(10) || description, description, '')) as n_chars from e""")
def content_fallback_chain(spark, sf_dir):
    """The first content that there is: caption, recognised text, part of it with the description, the description."""
    pick = lambda cond: F.max(F.when(cond, F.col("text")))
    role, turn = F.col("role"), F.col("turn")
    e = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        pick(role == "system").alias("caption"), pick((role == "assistant") & (turn == 1) & (F.length("text") > 200)).alias("ocr"), pick((role == "assistant") & (turn == 3)).alias("ocr_part"), pick((role == "user") & (turn == 0)).alias("description")
    )
    c = F.col
    method = ladder((c("caption").isNotNull(), "caption"), (c("ocr").isNotNull(), "ocr"), (c("ocr_part").isNotNull() & c("description").isNotNull(), "ocr_partial_description"), (c("description").isNotNull(), "description"), otherwise="none")
    text = F.coalesce("caption", "ocr", F.concat(c("ocr_part"), F.lit("\n"), c("description")), "description", F.lit(""))
    return e.select("conv_id", method.alias("method"), F.length(text).cast("bigint").alias("n_chars"))


@query("""
with f as (select conv_id, turn, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') as print from conversations), r as (select conv_id, turn, print, row_number() over (partition by conv_id, print order by turn) as i from f where length(print) >= 12)
select conv_id, array_to_string(list(turn order by turn), ',') as kept_turns from r where i = 1 group by 1""")
def evidence_fingerprint_dedup(spark, sf_dir):
    """Pieces of evidence whose fingerprint, of 12 letters and more, is new, in order."""
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "").alias("print")).filter("length(print) >= 12")
    x = best(f, ["conv_id", "print"], F.asc("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    return x.select("conv_id", F.array_join(F.transform("t", lambda v: v.cast("string")), ",").alias("kept_turns"))


@query("""
with r as (select doc_id, source, n_chars, row_number() over (partition by lang order by case when source = 'src0' then 0 when source in ('src1', 'src2') then 1 else 2 end, n_chars desc, doc_id) as i from documents) select doc_id, source, i as place from r where i <= 15""")
def detail_fetch_order(spark, sf_dir):
    """Which details to fetch first: kind of source, score, id; fifteen of a language."""
    kind = F.when(F.col("source") == "src0", 0).when(F.col("source").isin("src1", "src2"), 1).otherwise(2)
    return top(table(spark, sf_dir, "documents"), ["lang"], 15, kind, F.desc("n_chars"), F.asc("doc_id"), keep_rank="place").select("doc_id", "source", "place")


@query("""
with o as (select o_orderkey, o_orderdate::date as d, case o_orderkey % 4 when 0 then 'on ' || cast(o_orderdate::date as varchar) when 1 then year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' when 2 then strftime(o_orderdate, '%Y/%m/%d') else 'no date' end || ' report ' || o_orderstatus as page from orders)
select o_orderkey, contains(page, 'report') as has_text, (contains(page, cast(d as varchar)) or contains(page, year(d) || '年' || month(d) || '月' || day(d) || '日') or contains(page, strftime(d, '%Y/%m/%d'))) as has_date from o""")
def source_verification(spark, sf_dir):
    """A page verifies a source if it has the text and any of three spellings of the date."""
    d = F.to_date("o_orderdate")
    cjk = F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))
    iso, slash, k = d.cast("string"), F.date_format(d, "yyyy/MM/dd"), F.col("o_orderkey") % 4
    page = F.concat(F.when(k == 0, F.concat(F.lit("on "), iso)).when(k == 1, cjk).when(k == 2, slash).otherwise("no date"), F.lit(" report "), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.contains(page, F.lit("report")).alias("has_text"), (F.contains(page, iso) | F.contains(page, cjk) | F.contains(page, slash)).alias("has_date"))


@query("""
with r as (select l_partkey, l_returnflag as tag, min(l_orderkey * 10 + l_linenumber) as first_at from lineitem group by all) select l_partkey, array_to_string(list(tag order by first_at, tag), '+') as stages, count(*) as n_stages from r group by 1""")
def selected_row_collapse(spark, sf_dir):
    """One row an id with its stage tags, in the order in which they came."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("tag")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    x = r.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("t"), F.count("*").alias("n_stages"))
    return x.select("l_partkey", F.array_join(F.transform("t", lambda z: z["tag"]), "+").alias("stages"), "n_stages")


@query(f"""
with {ARTICLES_SQL} select doc_id, case when {any_of('text', ['may ', 'rumour', 'könnte'])} then 'rumoured' when {any_of('text', ['will ', 'wird ', 'va '])} then 'announced' when {any_of('text', ['was ', 'fue', 'était', 'war '])} then 'happened' else 'unclear' end as event_status,
  regexp_extract(title, '([A-Z][a-z]{{3,}})', 1) as subject, regexp_extract(title, '(^|[^a-zà-ÿ])([a-z]{{3,}}(ed|ing|en))([^a-zà-ÿ]|$)', 2) as act from articles""")
def event_status(spark, sf_dir):
    """Whether an event is rumoured, announced or happened, with a subject and an action."""
    t = F.col("text")
    status = ladder((has_any(t, ["may ", "rumour", "könnte"]), "rumoured"), (has_any(t, ["will ", "wird ", "va "]), "announced"), (has_any(t, ["was ", "fue", "était", "war "]), "happened"), otherwise="unclear")
    return articles(spark, sf_dir).select("doc_id", status.alias("event_status"), F.regexp_extract("title", "([A-Z][a-z]{3,})", 1).alias("subject"), F.regexp_extract("title", "(^|[^a-zà-ÿ])([a-z]{3,}(ed|ing|en))([^a-zà-ÿ]|$)", 2).alias("act"))


@query("""select p_partkey, regexp_replace(replace(p_name, ' ', ''), '^(.{2,}?)(?:widget|ring|bolt|gear|nut)+$', '\\1') as topic, trim(regexp_replace(regexp_replace(p_name || ':' || p_type, '[<>:"/|?*]', ' ', 'g'), '\\s+', ' ', 'g')) as folder from part""")
def topic_suffixes(spark, sf_dir):
    """Topics without their common endings, and as folder names."""
    return table(spark, sf_dir, "part").select("p_partkey", strip_suffixes(F.replace("p_name", F.lit(" "), F.lit("")), ["widget", "ring", "bolt", "gear", "nut"]).alias("topic"), safe_name(F.concat("p_name", F.lit(":"), "p_type")).alias("folder"))


@query(f"""
with {ARTICLES_SQL} select doc_id, case when length(title) < 8 then 'title_too_short' when {any_of('title', ['!!'])} then 'slogan' when not regexp_matches(title, '[A-ZÀ-Þ][a-zß-ÿ]{{3,}}') then 'no_named_actor' when not {any_of('text', ['tion', 'ing ', 'en '])} then 'no_concrete_action' when n_chars < 150 then 'too_little' end as reason from articles""")
def candidate_exclusion(spark, sf_dir):
    """The first rule that a public candidate breaks."""
    title, t = F.col("title"), F.col("text")
    reason = first_reason(
        (F.length(title) < 8, "title_too_short"), (has_any(title, ["!!"]), "slogan"), (~title.rlike("[A-ZÀ-Þ][a-zß-ÿ]{3,}"), "no_named_actor"), (~has_any(t, ["tion", "ing ", "en "]), "no_concrete_action"), (F.col("n_chars") < 150, "too_little")
    )
    return articles(spark, sf_dir).select("doc_id", reason.alias("reason"))


@query("""
select rule, count(*) as n, min(row_id) as first_row from (
  select cast(p_partkey as varchar) as row_id, 'size' as rule from part where not (p_size between 2 and 49) union all select cast(p_partkey as varchar), 'kind' from part where not p_type in ('ECONOMY', 'SMALL', 'STANDARD', 'LARGE', 'MEDIUM', 'PROMO')
  union all select cast(p_partkey as varchar), 'price' from part where not p_retailprice <= 1090 union all select p_name || '|' || p_brand || '|' || p_size, 'duplicate_path' from part group by p_name, p_brand, p_size having count(*) > 1
  union all select '', 'folder_cap' from part having sum(p_retailprice) > 1000) group by 1""")
def catalog_checks(spark, sf_dir):
    """A material catalogue against its contract: sizes, kinds, prices, duplicate paths, the folder's cap."""
    p = table(spark, sf_dir, "part")
    kinds = ["ECONOMY", "SMALL", "STANDARD", "LARGE", "MEDIUM", "PROMO"]
    v = checks.union(
        checks.violations(p, "p_partkey", {"size": F.col("p_size").between(2, 49), "kind": F.col("p_type").isin(kinds), "price": F.col("p_retailprice") <= 1090}),
        checks.duplicates(p, ["p_name", "p_brand", "p_size"], "duplicate_path"), checks.total_is(p, F.sum("p_retailprice"), 0, 1000, "folder_cap"),
    )
    return v.groupBy("rule").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("""
with s as (select conv_id, turn, 10 * turn + length(text) % 25 as secs from conversations), p as (select *, lag(secs) over (partition by conv_id order by turn) as before from s)
select cast(conv_id as varchar) || '|' || cast(turn as varchar) as row_id, 'time_goes_back' as rule from p where before > secs union all select cast(conv_id as varchar) || '|' || cast(turn as varchar), 'beyond_end' from s where secs > 80""")
def segment_timecode_checks(spark, sf_dir):
    """Segments whose times go back or beyond the end."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", (10 * F.col("turn") + F.length("text") % 25).alias("at")).withColumn("row", F.concat_ws("|", "conv_id", "turn"))
    return checks.union(checks.not_monotone(s, ["conv_id"], "turn", "at", "time_goes_back"), checks.violations(s, "row", {"beyond_end": F.col("at") <= 80}))


@query("""
with a as (select doc_id as path, n_chars as bytes from documents where source <> 'src3'), b as (select doc_id as path, case when source = 'src4' then n_chars + 1 else n_chars end as bytes from documents where source <> 'src5')
select problem, count(*) as n from (select case when b.path is null then 'missing' when a.path is null then 'unlisted' when a.bytes <> b.bytes then 'size' end as problem from a full outer join b on a.path = b.path) where problem is not null group by 1""")
def manifest_difference(spark, sf_dir):
    """A manifest and its files, compared in both directions."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("bytes"), "source")
    a, b = d.filter("source <> 'src3'"), d.filter("source <> 'src5'").select("path", F.when(F.col("source") == "src4", F.col("bytes") + 1).otherwise(F.col("bytes")).alias("found"))
    x = a.join(b, "path", "full_outer")
    problem = first_reason((F.col("found").isNull(), "missing"), (F.col("bytes").isNull(), "unlisted"), (F.col("bytes") != F.col("found"), "size"))
    return x.select(problem.alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


@query("""
with r as (select doc_id, lang, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents)
select doc_id, lang, rank, case when rank <= 5 then 'detailed' when rank <= 20 and n_chars >= 400 then 'selected' else 'listed' end as level, case when rank <= 5 then 3 when rank <= 20 and n_chars >= 400 then 1 else 0 end as evidence_limit, cast((rank - 1) // 6 as bigint) as batch from r""")
def enrichment_budget(spark, sf_dir):
    """How far each ranked story is enriched, and in which batch of six."""
    r = ranked(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "rank", F.desc("n_chars"), F.asc("doc_id"), within=["lang"])
    detailed, selected = F.col("rank") <= 5, (F.col("rank") <= 20) & (F.col("n_chars") >= 400)
    return r.select("doc_id", "lang", "rank", ladder((detailed, "detailed"), (selected, "selected"), otherwise="listed").alias("level"), F.when(detailed, 3).when(selected, 1).otherwise(0).alias("evidence_limit"), F.floor((F.col("rank") - 1) / 6).cast("bigint").alias("batch"))


@query("""
with d as (select conv_id, greatest(0.01, cast(sum(length(text)) as double) / 50) as t from conversations group by 1)
select conv_id, round(least(5.0, t * 0.15), 4) as hook_end, round(greatest(round(least(5.0, t * 0.15), 4), t * 0.25), 4) as setup_end, round(t * 0.45, 4) as middle, round(t * 0.75, 4) as turn_at, round(t, 4) as script_end,
  case when t <= 15 then 20 when t <= 30 then 30 when t <= 60 then 40 when t <= 120 then 60 else 80 end as frame_budget from d""")
def script_boundaries(spark, sf_dir):
    """Points of a script by its duration, and how many frames to look at."""
    t = F.greatest(F.lit(0.01), F.sum(F.length("text")).cast("double") / 50)
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(t.alias("t"))
    t, hook = F.col("t"), half_up(F.least(F.lit(5.0), F.col("t") * 0.15), 4)
    return d.select(
        "conv_id", hook.alias("hook_end"), half_up(F.greatest(hook, t * 0.25), 4).alias("setup_end"), half_up(t * 0.45, 4).alias("middle"), half_up(t * 0.75, 4).alias("turn_at"), half_up(t, 4).alias("script_end"),
        F.when(t <= 15, 20).when(t <= 30, 30).when(t <= 60, 40).when(t <= 120, 60).otherwise(80).alias("frame_budget"),
    )


@query("""
with s as (select p_partkey, p_brand, case when contains(p_name, 'blue') then 50 else least(12, p_size % 15) end + 20 * (p_type = 'ECONOMY')::int + case when p_size > 40 then 18 when p_size > 20 then 10 else 0 end + case when p_retailprice > 1050 then 8 else 4 end - 40 * contains(p_name, 'red')::int as score from part)
select p_partkey, p_brand, cast(score as bigint) as score, case when score >= 70 then 'relevant' when score >= 40 then 'weak' else 'rejected' end as relevance, row_number() over (partition by p_brand order by score desc, p_partkey) as place from s""")
def image_score_rank(spark, sf_dir):
    """Picture candidates by match, page, source, resolution and negatives."""
    n, z = F.col("p_name"), F.col("p_size")
    score = (
        F.when(F.contains(n, F.lit("blue")), 50).otherwise(F.least(F.lit(12), z % 15)) + F.when(F.col("p_type") == "ECONOMY", 20).otherwise(0) + F.when(z > 40, 18).when(z > 20, 10).otherwise(0)
        + F.when(F.col("p_retailprice") > 1050, 8).otherwise(4) - F.when(F.contains(n, F.lit("red")), 40).otherwise(0)
    )
    s = table(spark, sf_dir, "part").select("p_partkey", "p_brand", score.cast("bigint").alias("score"))
    s = s.withColumn("relevance", ladder((F.col("score") >= 70, "relevant"), (F.col("score") >= 40, "weak"), otherwise="rejected"))
    return ranked(s, "place", F.desc("score"), F.asc("p_partkey"), within=["p_brand"])


@query(f"""
with {POSTS_SQL}, p as (select video_id, account_id % 10 as group_id, event_id, value, row_number() over (partition by video_id order by value desc, event_id) as i from posts), rep as (select video_id, event_id as representative, group_id as own_group from p where i = 1),
s as (select p.video_id, p.event_id, row_number() over (partition by p.video_id order by p.value desc, p.event_id) as j from p join rep on p.video_id = rep.video_id where p.group_id <> own_group)
select rep.video_id, representative, array_to_string(list(s.event_id order by j) filter (where j <= 2), ',') as supporting from rep left join s on rep.video_id = s.video_id group by all""")
def representative_support(spark, sf_dir):
    """Each event's representative, and its two best posts from other source groups."""
    p = posts(spark, sf_dir).select("video_id", (F.col("account_id") % 10).alias("group_id"), "event_id", "value")
    rep = best(p, ["video_id"], F.desc("value"), F.asc("event_id")).select("video_id", F.col("event_id").alias("representative"), F.col("group_id").alias("own_group"))
    s = top(p.join(rep, "video_id").filter("group_id <> own_group"), ["video_id"], 2, F.desc("value"), F.asc("event_id"), keep_rank="j")
    s = s.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("supporting"))
    return rep.join(s, "video_id", "left").select("video_id", "representative", "supporting")


@query("""
select c_custkey, c_mktsegment as status, case when c_acctbal < 0 then 'retired' when c_mktsegment = 'HOUSEHOLD' and c_acctbal > 5000 then 'approved' when c_mktsegment = 'MACHINERY' and c_acctbal > 5000 then 'paused' else 'candidate' end as next_status,
  not (c_acctbal < 0) and c_mktsegment = 'HOUSEHOLD' and c_acctbal > 5000 as enabled from customer""")
def account_lifecycle(spark, sf_dir):
    """An account's next status, and whether it is enabled."""
    s, b = F.col("c_mktsegment"), F.col("c_acctbal")
    nxt = ladder((b < 0, "retired"), ((s == "HOUSEHOLD") & (b > 5000), "approved"), ((s == "MACHINERY") & (b > 5000), "paused"), otherwise="candidate")
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("status"), nxt.alias("next_status"), (nxt == "approved").alias("enabled"))


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 3 = 0 then l_extendedprice / 1000 when l_quantity * 400 > 10000 then l_quantity * 400 / 1000 when l_quantity > 0 then l_quantity * 400 end as seconds from lineitem""")
def duration_resolution(spark, sf_dir):
    """Durations from milliseconds, or from seconds of which large ones are milliseconds."""
    ms = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", duration_seconds(ms, F.col("l_quantity") * 400).alias("seconds"))


@query("""
select event_id, ts::date as listed, case when event_id % 3 = 2 then ts::date else ts::date end as again, epoch(date_trunc('second', ts))::bigint as feed_seconds from events""")
def listing_and_feed_dates(spark, sf_dir):
    """Dates as listings print them and times as feeds do, read back."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    d = F.to_date("ts")
    shown = F.when(k == 0, F.concat(F.lit("posted "), F.date_format(d, "yyyy/MM/dd"))).when(k == 1, F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"), F.dayofmonth(d).cast("string"), F.lit("日"))).otherwise(F.date_format(d, "MMM d, yyyy"))
    rfc = F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss Z")
    x = table(spark, sf_dir, "events")
    return x.select("event_id", parse_listing_date(shown).alias("listed"), parse_listing_date(F.concat(F.lit("on "), shown, F.lit("."))).alias("again"), F.unix_seconds(parse_feed_date(rfc)).alias("feed_seconds"))


@query(r"""
with u as (select page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '')) as h, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) as path from pages)
select page_id, starts_with(url, 'https://') and (h = 'example.org' or ends_with(h, '.example.org') or h = 'example.net' or ends_with(h, '.example.net')) as allowed, regexp_matches(url, '(?i)[?&](x-[a-z]+-signature|signature|sign|expires|token)=') as signed,
  path <> '' and not regexp_matches(path, '^/|^[A-Za-z]:|\\') and not list_contains(string_split(path, '/'), '..') as safe_path from u""")
def url_checks(spark, sf_dir):
    """Allowed hosts, signed URLs, safe paths."""
    u = F.col("url")
    path = F.regexp_extract(u, "^[a-z]+://[^/]*/(.*)$", 1)
    return table(spark, sf_dir, "pages").select("page_id", allowed_https(u, ["example.org", "example.net"]).alias("allowed"), is_signed(u).alias("signed"), safe_relative_path(path).alias("safe_path"))


@query(f"""
with {POSTS_SQL}, e as (select *, coalesce(likes, 0) + 3 * coalesce(comments, 0) + 5 * coalesce(shares, 0) + 4 * coalesce(collects, 0) as e from posts), u as (select * from (select *, row_number() over (partition by video_id order by e desc, event_id) as i from e) where i = 1)
select video_id, event_id, cast(e as bigint) as engagement, case when e >= 100000 then 'S' when e >= 10000 then 'A' else 'B' end as grade from u""")
def inspiration_cards(spark, sf_dir):
    """The strongest post of each video and its grade."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    e = posts(spark, sf_dir).withColumn("engagement", (z("likes") + 3 * z("comments") + 5 * z("shares") + 4 * z("collects")).cast("bigint"))
    u = best(e, ["video_id"], F.desc("engagement"), F.asc("event_id"))
    return u.select("video_id", "event_id", "engagement", ladder((F.col("engagement") >= 100000, "S"), (F.col("engagement") >= 10000, "A"), otherwise="B").alias("grade"))


@query(f"""
with {POSTS_SQL}, s as (select video_id, coalesce(cast(sum(likes) as bigint), 0) as likes, coalesce(cast(sum(comments) as bigint), 0) as comments, count(*) as n from posts group by 1)
select video_id, round(least(40.0, 0.4 * (n % 100)) + least(20.0, 200.0 * comments / nullif(likes, 0)) + case when video_id % 3 = 0 then 15 else 0 end + case when video_id % 4 = 0 then 15 else 0 end + least(10.0, n / 10.0), 3) as creative_value,
  round(greatest(0.0, 30 - video_id % 40) + least(55.0, 11 * log10(1 + likes)) + case when video_id % 2 = 0 then 15 else 0 end, 3) as material_score from s""")
def creative_value(spark, sf_dir):
    """The creative value of topics, and the score of materials."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    s = posts(spark, sf_dir).groupBy("video_id").agg(zero("likes"), zero("comments"), F.count("*").alias("n"))
    v, n = F.col("video_id"), F.col("n")
    talk = F.least(F.lit(20.0), 200.0 * F.col("comments") / F.nullif(F.col("likes"), F.lit(0)))
    creative = F.least(F.lit(40.0), 0.4 * (n % 100)) + talk + F.when(v % 3 == 0, 15).otherwise(0) + F.when(v % 4 == 0, 15).otherwise(0) + F.least(F.lit(10.0), n / 10)
    material = F.greatest(F.lit(0.0), 30.0 - v % 40) + F.least(F.lit(55.0), 11 * F.log10(1 + F.col("likes"))) + F.when(v % 2 == 0, 15).otherwise(0)
    return s.select("video_id", half_up(creative, 3).alias("creative_value"), half_up(material, 3).alias("material_score"))


@query("""
with h as (select lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '')) as domain, page_id, length(html) as n from pages), f as (select *, n > 2500 as ready from h),
r as (select *, row_number() over (order by n desc, page_id) as place from f where ready)
select page_id, domain, place, cast((place + 7) // 8 as bigint) as batch from r where place <= 60""")
def consumer_screening(spark, sf_dir):
    """Fact-ready stories, the sixty first, in batches of eight."""
    f = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("domain"), F.length("html").alias("n")).filter("n > 2500")
    r = ranked(f.orderBy(F.desc("n"), F.asc("page_id")).limit(60), "place", F.desc("n"), F.asc("page_id"))
    return r.select("page_id", "domain", "place", F.ceil(F.col("place") / 8).cast("bigint").alias("batch"))


@query("""
with k as (select json_keys(props) as ks, event_type from events), x as (select event_type, unnest(ks) as key from k) select event_type, key, count(*) as n, regexp_matches(key, '(?i)(cookie|token|secret|password)') as sensitive from x group by all""")
def sensitive_keys(spark, sf_dir):
    """Keys of the raw records, and which of them must not be exported."""
    x = table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return x.groupBy("event_type", "key").agg(F.count("*").alias("n")).withColumn("sensitive", F.col("key").rlike("(?i)(cookie|token|secret|password)"))


@query(f"""
with {ARTICLES_SQL}, x as (select lang, substr(title, 1, 30) as piece, min(doc_id) as first_at from articles group by all), r as (select *, row_number() over (partition by lang order by first_at) as i from x)
select lang, array_to_string(list(piece order by i), ' / ') as first_titles from r where i <= 3 group by 1""")
def raw_content_index(spark, sf_dir):
    """The first three different titles of each language, in order."""
    x = articles(spark, sf_dir).groupBy("lang", F.substring("title", 1, 30).alias("piece")).agg(F.min("doc_id").alias("at"))
    r = top(x, ["lang"], 3, F.asc("at"), keep_rank="i")
    return r.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda z: z["piece"]), " / ").alias("first_titles"))


@query("""
with c as (select o_orderkey, count_if(l_returnflag = 'A') as a, count_if(l_returnflag = 'R') as r, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1)
select o_orderkey, case when n = 0 then 'no_material' when a = n then 'approve' when r = n then 'reject' when r * 2 > n then 'review' else 'hold' end as disposition, round(a / nullif(n, 0), 4) as share from c""".replace("count_if(l_returnflag = 'A')", "count(case when l_returnflag = 'A' then 1 end)").replace("count_if(l_returnflag = 'R')", "count(case when l_returnflag = 'R' then 1 end)"))
def disposition(spark, sf_dir):
    """What becomes of an episode by the standing of all its materials."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")  # noqa: E741
    c = table(spark, sf_dir, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("l_orderkey").alias("n")
    )
    a, r, n = F.col("a"), F.col("r"), F.col("n")
    return c.select("o_orderkey", ladder((n == 0, "no_material"), (a == n, "approve"), (r == n, "reject"), (r * 2 > n, "review"), otherwise="hold").alias("disposition"), half_up(a / F.nullif(n, F.lit(0)), 4).alias("share"))


@query("""
select o_orderpriority, round(least(1.0, greatest(0.0, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) / 1e9)), 6) as budget_share, count(*) as n from orders group by 1""")
def budget_share(spark, sf_dir):
    """The share of a budget that each lane has used, between 0 and 1."""
    used = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1e9
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(half_up(clamp(used, 0.0, 1.0), 6).alias("budget_share"), F.count("*").alias("n"))
