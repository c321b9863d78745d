"""Queries of the editorial side: scope, gates, slots, cards, ledgers, reports, and what becomes of candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.number import half_up
from postmill.functions.text import has_any, has_word, hits, numbers, words
from postmill.operators import folds
from postmill.operators.select import best, first_reason, ranked, top
from postmill.operators.text_rules import ladder
from postmill.plans.articles import any_of, h
from postmill.plans.folds import first_fit_sql, first_like
from postmill.plans.registry import query
from postmill.sources.tables import ARTICLES_SQL, POSTS_SQL, articles, posts, table


@query(r"""
select page_id, case when regexp_matches(url, '/([0-9]+)') then 'https://v.example/video/' || regexp_extract(url, '/([0-9]+)', 1) else '' end as share_url, case when regexp_matches(url, '^https?://blog\.') then 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) else '' end as profile_url from pages""")
def safe_share_urls(spark, sf_dir):
    """Plain share and profile links, made anew from an id or a host; empty where there is none."""
    u = F.col("url")
    share = F.when(u.rlike("/([0-9]+)"), F.concat(F.lit("https://v.example/video/"), F.regexp_extract(u, "/([0-9]+)", 1))).otherwise("")
    profile = F.when(u.rlike(r"^https?://blog\."), F.concat(F.lit("https://"), F.regexp_extract(u, "^https?://([^/?#]+)", 1))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", share.alias("share_url"), profile.alias("profile_url"))


@query("""
with r as (select c_custkey, c_nationkey, c_acctbal > 9000 as recent from customer), n as (select *, bool_or(recent) over (partition by c_nationkey) as any_recent from r) select c_custkey, c_nationkey from n where recent or not any_recent""")
def recent_or_all(spark, sf_dir):
    """Recent rows of each pool; a pool that has none keeps all."""
    r = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 9000).alias("recent"))
    return r.withColumn("any_recent", F.bool_or("recent").over(Window.partitionBy("c_nationkey"))).filter(F.col("recent") | ~F.col("any_recent")).select("c_custkey", "c_nationkey")


@query(f"""
with {ARTICLES_SQL}, g as (select doc_id, source, regexp_matches(lower(title), '(^|[^a-z0-9])with($|[^a-z0-9])') as title_hit, {any_of('text', ['idiot', 'clown'])} as game from articles),
s as (select source, bool_or(title_hit) as named, count_if(game) as n_game, count(*) as n from g group by 1)
select source, named, n_game, n, case when named then 'excluded_by_title' when n_game * 2 > n then 'excluded_by_majority' else 'in_scope' end as scope from s""")
def scope_gate(spark, sf_dir):
    """Out of scope by a term in a title, as a word, or by a strict majority of videos."""
    g = articles(spark, sf_dir).select("source", has_word(F.col("title"), "with").alias("title_hit"), has_any(F.col("text"), ["idiot", "clown"]).alias("game"))
    s = g.groupBy("source").agg(F.bool_or("title_hit").alias("named"), F.count_if("game").alias("n_game"), F.count("*").alias("n"))
    return s.withColumn("scope", ladder((F.col("named"), "excluded_by_title"), (F.col("n_game") * 2 > F.col("n"), "excluded_by_majority"), otherwise="in_scope"))


@query("""
select l_returnflag, verdict, count(*) as n from (select l_returnflag, case when l_quantity <= 0 or l_extendedprice <= 0 then 'invalid_probe' when l_quantity * 2 < 15 * 0.95 then 'too_short' when l_quantity * 2 > 80 * 1.05 then 'too_long' else 'ok' end as verdict from lineitem) group by all""")
def duration_precheck(spark, sf_dir):
    """Probes that are valid and of a length within a window and its tolerance."""
    d = F.col("l_quantity") * 2
    verdict = ladder(((F.col("l_quantity") <= 0) | (F.col("l_extendedprice") <= 0), "invalid_probe"), (d < 15 * 0.95, "too_short"), (d > 80 * 1.05, "too_long"), otherwise="ok")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""
with {ARTICLES_SQL} select doc_id, title from articles where not {any_of('title', ['license', '***'])} and length(title) between 12 and 400 and {any_of('title', ['tion', 'ing', 'heit', 'ción'])} and not {any_of('title', ['!!', '|'])}""")
def major_events(spark, sf_dir):
    """Titles of events: an event's verb, no routine or noise."""
    t = F.col("title")
    return articles(spark, sf_dir).filter(~has_any(t, ["license", "***"]) & F.length(t).between(12, 400) & has_any(t, ["tion", "ing", "heit", "ción"]) & ~has_any(t, ["!!", "|"])).select("doc_id", "title")


@query("""
select o_orderkey, case when o_orderdate >= timestamp '1997-03-10' and o_orderdate < timestamp '1997-03-11' then 'in_day' when o_orderdate >= timestamp '1997-03-09' and o_orderdate < timestamp '1997-03-12' then 'grace' else 'outside' end as window_class from orders""")
def detail_window(spark, sf_dir):
    """Details of a business day, with some hours of grace on both sides."""
    d = F.col("o_orderdate")
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", ladder(((d >= t("1997-03-10")) & (d < t("1997-03-11")), "in_day"), ((d >= t("1997-03-09")) & (d < t("1997-03-12")), "grace"), otherwise="outside").alias("window_class"))


@query("""
select p_partkey, array_to_string(list_filter([case when p_type = 'SMALL' then 'kind' end, case when p_size < 10 then 'small' end, case when p_retailprice < 950 then 'rights' end, case when contains(p_name, 'red') then 'negative' end], lambda x: x is not null), '+') as reasons from part""")
def image_gates(spark, sf_dir):
    """All gates that a picture fails."""
    g = [(F.col("p_type") == "SMALL", "kind"), (F.col("p_size") < 10, "small"), (F.col("p_retailprice") < 950, "rights"), (F.contains("p_name", F.lit("red")), "negative")]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in g])), "+").alias("reasons"))


@query("""
with s as (select conv_id, max(case when turn = 0 then text end) as q, max(case when turn = 1 then text end) as a from conversations group by 1),
n as (select *, list_distinct(regexp_extract_all(a, '[0-9]+(?:\\.[0-9]+)?')) as out_n, regexp_extract_all(q, '[0-9]+(?:\\.[0-9]+)?') as in_n, list_distinct(regexp_extract_all(lower(a), '[\\p{L}\\p{N}]{2,}')) as out_w, list_distinct(regexp_extract_all(lower(q), '[\\p{L}\\p{N}]{2,}')) as in_w from s where a is not null and q is not null)
select conv_id, len(list_filter(out_n, lambda x: not list_contains(in_n, x))) as new_numbers, len(list_intersect(out_w, in_w)) as shared_words, len(list_filter(out_n, lambda x: not list_contains(in_n, x))) = 0 and len(list_intersect(out_w, in_w)) >= 3 as supported from n""")
def slot_validation(spark, sf_dir):
    """Whether a written answer brings in numbers that its source doesn't have, and shares its words."""
    pick = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pick(0).alias("q"), pick(1).alias("a")).filter("a is not null and q is not null")
    new = F.size(F.array_except(numbers(F.col("a")), numbers(F.col("q")))).cast("bigint")
    shared = F.size(F.array_intersect(words(F.col("a")), words(F.col("q")))).cast("bigint")
    return s.select("conv_id", new.alias("new_numbers"), shared.alias("shared_words"), ((new == 0) & (shared >= 3)).alias("supported"))


@query("""
with b as (select l_orderkey, l_linenumber, l_partkey, (l_quantity + l_tax * 100 + l_discount * 100) / 3 as y from lineitem) select l_orderkey, count(*) as n_lines, count_if(round(y, 6) < 4 or round(y, 6) > 16) as n_ui, count(*) - count_if(round(y, 6) < 4 or round(y, 6) > 16) as n_clean from b group by 1""")
def ui_text_filter(spark, sf_dir):
    """Lines of a frame that stand where an app shows its own text."""
    y = half_up((F.col("l_quantity") + F.col("l_tax") * 100 + F.col("l_discount") * 100) / 3, 6)
    b = table(spark, sf_dir, "lineitem").withColumn("ui", (y < 4) | (y > 16))
    return b.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if("ui").alias("n_ui"), (F.count("*") - F.count_if("ui")).alias("n_clean"))


@query("""
with c as (select vec_id as card_id, vec_id % 300 as story_id, label from embeddings), r as (select *, row_number() over (partition by story_id order by card_id) as i from c)
select card_id, story_id, case when d.doc_id is null then 'unknown_story' when i > 1 then 'duplicate' else 'accepted' end as outcome from r left join (select doc_id from documents where lang = 'en') d on d.doc_id = story_id""")
def cards_to_facts(spark, sf_dir):
    """Cards joined to their facts: a card of an unknown story, or a second one of a story, is rejected."""
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("card_id"), (F.col("vec_id") % 300).alias("story_id"))
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("story_id").orderBy("card_id")))
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("known"))
    x = c.join(d, F.col("story_id") == F.col("known"), "left")
    return x.select("card_id", "story_id", ladder((F.col("known").isNull(), "unknown_story"), (F.col("i") > 1, "duplicate"), otherwise="accepted").alias("outcome"))


@query("""
with l as (select distinct o_custkey as query_id, o_orderpriority as url from orders where o_orderstatus = 'F'), a as (select c_custkey, c_mktsegment from customer)
select c_custkey, count(url) as n_leads, min(url) as first_url from a left join l on query_id = c_custkey group by 1""")
def leads_join(spark, sf_dir):
    """Articles with their discovery leads, each query and URL once."""
    l = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("url")).distinct()  # noqa: E741
    return table(spark, sf_dir, "customer").select("c_custkey").join(l, "c_custkey", "left").groupBy("c_custkey").agg(F.count("url").alias("n_leads"), F.min("url").alias("first_url"))


@query("""
with f as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) select vec_id, count_if(x > 0.15) as n_large, min(case when x > 0.15 then i - 1 end) as first_large, max(case when x > 0.15 then i - 1 end) as last_large from f group by 1""")
def frame_positions(spark, sf_dir):
    """Where in its frames a video has a large face."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    at = F.when(F.col("x") > F.lit(0.15).cast("float"), F.col("i")).cast("bigint")  # as floats: 0.15 itself is not large
    return f.groupBy("vec_id").agg(F.count(at).alias("n_large"), F.min(at).alias("first_large"), F.max(at).alias("last_large"))


@query(r"""
with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{4,}')) as ws from benchmark), x as (select item_id, len(ws) as n, unnest(ws) as w from t),
p as (select a.item_id as left_id, b.item_id as right_id, a.n as na, b.n as nb, count(*) as c from x a join x b on a.w = b.w and a.item_id < b.item_id group by all)
select left_id, right_id, c as n_shared, round(c / (na + nb - c), 6) as jaccard, case when c >= 5 and c / (na + nb - c) >= 0.52 then 'same' else 'related' end as relation from p where c >= 2""")
def story_relations(spark, sf_dir):
    """The graph of related stories: pairs that share words, found by an equi-join on words."""
    x = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0))).alias("ws"))
    x = x.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    p = x.alias("a").join(x.alias("b"), (F.col("a.w") == F.col("b.w")) & (F.col("a.item_id") < F.col("b.item_id"))).groupBy(F.col("a.item_id").alias("left_id"), F.col("b.item_id").alias("right_id"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("n_shared"))
    j = F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared"))
    return p.filter("n_shared >= 2").select("left_id", "right_id", "n_shared", half_up(j, 6).alias("jaccard"), F.when((F.col("n_shared") >= 5) & (j >= 0.52), "same").otherwise("related").alias("relation"))


@query("""
with p as (select o_orderkey as pack_id, o_custkey as sha from orders), s as (select c_custkey as sha, 'by_sha' as how from customer where c_mktsegment = 'HOUSEHOLD'), i as (select distinct l_orderkey as pack_id, 'by_id' as how from lineitem where l_linenumber = 1)
select p.pack_id, coalesce(s.how, i.how, 'none') as how from p left join s on p.sha = s.sha left join i on p.pack_id = i.pack_id""")
def ledger_match(spark, sf_dir):
    """A package's entry in a consumer's ledger: by content, else by id."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_custkey").alias("sha"))
    s = table(spark, sf_dir, "customer").filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("sha"), F.lit("by_sha").alias("a"))
    i = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("pack_id")).distinct().withColumn("b", F.lit("by_id"))
    return p.join(s, "sha", "left").join(i, "pack_id", "left").select("pack_id", F.coalesce("a", "b", F.lit("none")).alias("how"))


@query(f"""
with {POSTS_SQL}, k as (select account_id, event_type, min(event_id) as first_at, count(*) as n from posts group by all) select account_id, array_to_string(list(event_type order by first_at), ',') as keywords, cast(max(n) as bigint) as most from k group by 1""")
def keyword_union(spark, sf_dir):
    """The keywords of each account in the order in which they came up."""
    k = posts(spark, sf_dir).groupBy("account_id", "event_type").agg(F.min("event_id").alias("at"), F.count("*").alias("n"))
    x = k.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("k"), F.max("n").alias("most"))
    return x.select("account_id", F.array_join(F.transform("k", lambda v: v["event_type"]), ",").alias("keywords"), "most")


@query("""
with r as (select vec_id, label, 20 + vec_id % 60 as want, coalesce(sum(20 + vec_id % 60) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as used from embeddings)
select vec_id, label, cast(least(want, greatest(0, 900 - used)) as bigint) as allowance, case when used >= 900 then 'exhausted' when want > 900 - used then 'reduced' else 'full' end as grant_class from r""")
def batch_allowance(spark, sf_dir):
    """Frames that each video of a batch may use, in order, of 900."""
    want = 20 + F.col("vec_id") % 60
    used = F.coalesce(F.sum(want).over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = table(spark, sf_dir, "embeddings").select("vec_id", "label", want.alias("want"), used.alias("used"))
    left = 900 - F.col("used")
    return r.select("vec_id", "label", F.least("want", F.greatest(F.lit(0), left)).cast("bigint").alias("allowance"), ladder((left <= 0, "exhausted"), (F.col("want") > left, "reduced"), otherwise="full").alias("grant_class"))


@query(r"""
with v as (select p_partkey, regexp_extract_all(p_name || ' ' || p_brand, '[A-Za-z]{3,}|[0-9]+') as parts from part) select p_partkey, array_to_string(parts, '|') as vocabulary, len(list_filter(parts, lambda x: length(x) >= 2)) = len(parts) as usable from v""")
def subject_vocabulary(spark, sf_dir):
    """A subject's words by runs of one script; all of them must be usable, or none is."""
    parts = F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_brand"), F.lit("[A-Za-z]{3,}|[0-9]+"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "|").alias("vocabulary"), F.forall(parts, lambda x: F.length(x) >= 2).alias("usable"))


@query("""
with recursive k as (select conv_id, turn, length(text) as v, row_number() over (partition by conv_id order by turn) as rn from conversations), f as (select conv_id, turn, rn, v as kept_v, true as kept from k where rn = 1
  union all select k.conv_id, k.turn, k.rn, case when abs(k.v - f.kept_v) > 60 then k.v else f.kept_v end, abs(k.v - f.kept_v) > 60 from f join k on k.conv_id = f.conv_id and k.rn = f.rn + 1)
select conv_id, turn, kept from f""")
def frame_dedup(spark, sf_dir):
    """Frames that differ from the last one kept."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("v"))

    def decide(rows):
        last, out = None, []
        for v in rows["v"]:
            keep = last is None or abs(v - last) > 60
            last = v if keep else last
            out.append(keep)
        return {"kept": out}

    return folds.fold(k, ["conv_id"], [("turn", True)], decide, "kept boolean").select("conv_id", "turn", "kept")


@query(f"with recursive {ARTICLES_SQL}, " + first_fit_sql(r"select doc_id, source, list_distinct(regexp_extract_all(lower(substr(title, 1, 180)), '[\p{L}\p{N}]{2,}')) as t from articles", first_like(2, 0.4)))
def official_groups(spark, sf_dir):
    """Official articles by identity, or by the overlap of their titles with a group's first."""
    k = articles(spark, sf_dir).select("doc_id", "source", F.array_distinct(words(F.substring("title", 1, 180))).alias("tokens"))
    return folds.token_clusters(k, ["source"], [("doc_id", True)], "tokens", 2, 0.4, grow=False).select("doc_id", "source", "cluster")


@query("with recursive " + first_fit_sql("select * from (select doc_id, source, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) as t from documents) where len(t) >= 2", first_like(2, 0.0)))
def candidate_merge(spark, sf_dir):
    """Candidates that share two named anchors with the first of a group."""
    anchors = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    k = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", anchors.alias("tokens")).filter(F.size("tokens") >= 2)
    return folds.token_clusters(k, ["source"], [("doc_id", True)], "tokens", 2, 0.0, grow=False).select("doc_id", "source", "cluster")


@query("""
select doc_id, sha256(length(text) || '|' || substr(text, 1, 64) || '|' || substr(text, greatest(1, length(text) - 63), 64)) as fingerprint, substr(sha256('v2|' || lang || '|' || source || '|' || n_chars), 1, 12) as cache_key from documents""")
def content_fingerprints(spark, sf_dir):
    """A content's fingerprint of size, head and tail, and the key of its cached result."""
    n = F.length("text")
    tail = F.substring("text", F.greatest(F.lit(1), n - 63), F.lit(64))
    fp = F.sha2(F.concat_ws("|", n.cast("string"), F.substring("text", 1, 64), tail), 256)
    return table(spark, sf_dir, "documents").select("doc_id", fp.alias("fingerprint"), F.substring(F.sha2(F.concat_ws("|", F.lit("v2"), "lang", "source", "n_chars"), 256), 1, 12).alias("cache_key"))


@query(r"""select p_partkey, regexp_matches(lower(p_brand), '(^|[^a-z0-9])brand#1($|[^0-9])') as entity_hit, regexp_matches(lower(p_brand), 'brand#1') as loose_hit from part""")
def version_guard(spark, sf_dir):
    """An entity's phrase, not followed by a further digit of its version."""
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").rlike("(?<![a-z0-9])brand#1(?![0-9])").alias("entity_hit"), F.contains(F.lower("p_brand"), F.lit("brand#1")).alias("loose_hit"))


@query(r"""
select doc_id, len(regexp_extract_all(text, '[A-Z][a-z]{5,}')) as n_subjects, len(regexp_extract_all(text, '[0-9]{1,2}[./-][0-9]{1,2}')) as n_dates, len(regexp_extract_all(text, '[a-z]{3,}ing')) as n_actions,
  len(regexp_extract_all(text, '[A-Z][a-z]{5,}')) >= 2 and (len(regexp_extract_all(text, '[0-9]{1,2}[./-][0-9]{1,2}')) >= 2 or len(regexp_extract_all(text, '[a-z]{3,}ing')) >= 3) as roundup from documents""")
def roundup_override(spark, sf_dir):
    """Round-ups: several subjects, with several dates or actions."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    s, d, a = n("[A-Z][a-z]{5,}"), n("[0-9]{1,2}[./-][0-9]{1,2}"), n("[a-z]{3,}ing")
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("n_subjects"), d.alias("n_dates"), a.alias("n_actions"), ((s >= 2) & ((d >= 2) | (a >= 3))).alias("roundup"))


@query(f"""
with {ARTICLES_SQL} select doc_id, trim(substr(regexp_replace(title, '[.!? ]+$', ''), 1, 60)) as short_title, case when n_chars < 120 then trim(title) else trim(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 120)) || '…' end as summary,
  coalesce(nullif(regexp_extract(title, '([A-Z][a-z]{{3,}})', 1), ''), source) || ' ' || lang as detail_query from articles""")
def fallback_cards(spark, sf_dir):
    """Cards without a model: a compact title, a summary, and the query for details."""
    short = F.trim(F.substring(F.regexp_replace("title", "[.!? ]+$", ""), 1, 60))
    summary = F.when(F.col("n_chars") < 120, F.trim("title")).otherwise(F.concat(F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 120)), F.lit("…")))
    q = F.concat_ws(" ", F.coalesce(F.nullif(F.regexp_extract("title", "([A-Z][a-z]{3,})", 1), F.lit("")), "source"), "lang")
    return articles(spark, sf_dir).select("doc_id", short.alias("short_title"), summary.alias("summary"), q.alias("detail_query"))


@query("""
with r as (select l_orderkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) as i from lineitem)
select l_orderkey as episode, array_to_string(list(p_brand || ':' || l_partkey order by i), ' ') as materials, cast(sum(l_quantity) as bigint) as seconds from r join part on p_partkey = l_partkey where i <= 4 group by 1""")
def derive_materials(spark, sf_dir):
    """An episode's materials from its delivery, the four longest in order."""
    r = top(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber"), ["l_orderkey"], 4, F.desc("l_quantity"), F.asc("l_partkey"), F.asc("l_linenumber"), keep_rank="i")
    x = r.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    m = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat_ws(":", "p_brand", "l_partkey").alias("m")))), lambda v: v["m"]), " ")
    return x.groupBy(F.col("l_orderkey").alias("episode")).agg(m.alias("materials"), F.sum("l_quantity").cast("bigint").alias("seconds"))


@query(f"""
with {POSTS_SQL} select video_id, min_by(event_id, published) as first_event, count(*) as n from posts where event_type <> 'error' group by 1""")
def first_media(spark, sf_dir):
    """The first media reference of each video."""
    return posts(spark, sf_dir).filter("event_type <> 'error'").groupBy("video_id").agg(F.min_by("event_id", "published").alias("first_event"), F.count("*").alias("n"))


@query("""
with k as (select p_type, count(*) as found, least(count(*), 80) as kept from part group by 1)
select p_type, found, cast(kept as bigint) as kept, cast(greatest(0, 300 - found) as bigint) as shortfall, case when found = 0 then 'empty' when found < 300 then 'partial' else 'success' end as status from k""")
def pool_report(spark, sf_dir):
    """How full each source's pool is."""
    k = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("found"))
    n = F.col("found")
    return k.select("p_type", "found", F.least(n, F.lit(80)).cast("bigint").alias("kept"), F.greatest(F.lit(0), 300 - n).cast("bigint").alias("shortfall"), ladder((n == 0, "empty"), (n < 300, "partial"), otherwise="success").alias("status"))


@query(f"""
with {ARTICLES_SQL}, l as (select a.*, quality from articles a left join labels on labels.doc_id = a.doc_id)
select doc_id, case when quality = 1 then 'verified' when {any_of('title', ['ich', 'my', 'je '])} then 'creator_original' else 'unverified' end as label, 'https://v.example/' || doc_id as url, n_chars >= 500 and quality = 1 as news_entry from l""")
def cluster_labels(spark, sf_dir):
    """Verified, a creator's own, or unverified; and which are news entries."""
    a = articles(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    label = ladder((F.col("quality") == 1, "verified"), (has_any(F.col("title"), ["ich", "my", "je "]), "creator_original"), otherwise="unverified")
    return a.select("doc_id", label.alias("label"), F.concat(F.lit("https://v.example/"), F.col("doc_id").cast("string")).alias("url"), ((F.col("n_chars") >= 500) & (F.col("quality") == 1)).alias("news_entry"))


@query("""
with g as (select p_partkey, p_type, p_retailprice, case when p_size < 5 then 'duration' when contains(p_name, 'red') then 'relevance' when p_brand = 'Brand#3' then 'speech' end as stage from part), r as (select *, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from g),
c as (select p_type, min(case when stage is null then place end) as chosen from r group by 1)
select r.p_type, min(case when place = chosen then p_partkey end) as script, count_if(place < chosen) as rejected_before, array_to_string(list(stage order by place) filter (where place < chosen), ',') as stages from r join c on r.p_type = c.p_type group by r.p_type""")
def script_pick(spark, sf_dir):
    """The first candidate that passes all gates, and why those before it didn't."""
    stage = first_reason((F.col("p_size") < 5, "duration"), (F.contains("p_name", F.lit("red")), "relevance"), (F.col("p_brand") == "Brand#3", "speech"))
    r = ranked(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", stage.alias("stage")), "place", F.desc("p_retailprice"), F.asc("p_partkey"), within=["p_type"])
    r = r.withColumn("chosen", F.min(F.when(F.col("stage").isNull(), F.col("place"))).over(Window.partitionBy("p_type")))
    before = F.col("place") < F.col("chosen")
    why = F.transform(F.array_sort(F.collect_list(F.when(before, F.struct("place", "stage")))), lambda v: v["stage"])
    return r.groupBy("p_type").agg(F.min(F.when(F.col("place") == F.col("chosen"), F.col("p_partkey"))).alias("script"), F.count_if(before).alias("rejected_before"), F.nullif(F.array_join(why, ","), F.lit("")).alias("stages"))


@query(f"""
with t as (select conv_id, {h('text', ['tion', 'heit', 'que'])} as n, length(text) as size from conversations) select conv_id, case when max(size) < 40 then 'unknown' when max(n) >= 1 then 'hit' else 'miss' end as verdict, bool_or(n >= 2) as conclusive from t group by 1""")
def on_screen_text(spark, sf_dir):
    """Whether a video shows the expected terms: hit, miss, or unknown where too little was read."""
    n = hits(F.col("text"), ["tion", "heit", "que"])
    t = table(spark, sf_dir, "conversations").select("conv_id", n.alias("n"), F.length("text").alias("size"))
    return t.groupBy("conv_id").agg(F.when(F.max("size") < 40, "unknown").when(F.max("n") >= 1, "hit").otherwise("miss").alias("verdict"), F.bool_or(F.col("n") >= 2).alias("conclusive"))


@query(f"""
with {ARTICLES_SQL}, r as (select doc_id, source, case when length(title) < 6 then 'no_title' when n_chars < 200 then 'too_short' when {any_of('title', ['license'])} then 'routine' end as reason, n_chars from articles), k as (select *, row_number() over (partition by source, reason is null order by n_chars desc, doc_id) as i from r)
select doc_id, source, coalesce(reason, case when i > 5 then 'limit' end) as discarded from k""")
def snippet_discovery(spark, sf_dir):
    """Snippets of each source with the reason for which they were discarded, five kept."""
    t, n = F.col("title"), F.col("n_chars")
    r = articles(spark, sf_dir).select("doc_id", "source", "n_chars", first_reason((F.length(t) < 6, "no_title"), (n < 200, "too_short"), (has_any(t, ["license"]), "routine")).alias("reason"))
    k = r.withColumn("good", F.col("reason").isNull())
    k = ranked(k, "i", F.desc("n_chars"), F.asc("doc_id"), within=["source", "good"])
    return k.select("doc_id", "source", F.coalesce("reason", F.when(F.col("i") > 5, F.lit("limit"))).alias("discarded"))


@query("""
with s as (select o_custkey, count(*) as n_images, count_if(o_totalprice > 250000) as n_good, count_if(o_orderstatus = 'F') as n_sources from orders group by 1)
select status, count(*) as n, cast(sum(n_images) as bigint) as images from (select *, case when n_good >= 2 and n_sources >= 1 then 'ready' when n_good >= 1 then 'partial' else 'research' end as status from s) group by 1""")
def story_status(spark, sf_dir):
    """Stories that are ready, partial or need research."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_images"), F.count_if(F.col("o_totalprice") > 250000).alias("n_good"), F.count_if(F.col("o_orderstatus") == "F").alias("n_sources"))
    status = ladder(((F.col("n_good") >= 2) & (F.col("n_sources") >= 1), "ready"), (F.col("n_good") >= 1, "partial"), otherwise="research")
    return s.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum("n_images").alias("images"))


@query("""
with d(kind, scene, minimum) as (values ('ECONOMY', 'factory', 3), ('SMALL', null, 5), ('*', 'street', 4)) select p_partkey, coalesce(k.scene, f.scene) as scene, coalesce(k.minimum, f.minimum) as minimum from part left join d k on k.kind = p_type join d f on f.kind = '*'""")
def profile_resolution(spark, sf_dir):
    """Material profiles by kind, each missing field from the default profile."""
    d = spark.createDataFrame([("ECONOMY", "factory", 3), ("SMALL", None, 5)], "p_type string, scene string, minimum int")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type").join(F.broadcast(d), "p_type", "left").select("p_partkey", F.coalesce("scene", F.lit("street")).alias("scene"), F.coalesce("minimum", F.lit(4)).alias("minimum"))


@query(f"""
with {POSTS_SQL}, p as (select day, account_id % 5 as pack, count(*) as n, min(event_id) as first_id from posts group by all), c as (select day, max(case when pack = 0 then n end) as own, max_by(pack, struct_pack(n := n, f := -first_id)) as best_pack, max(n) as most from p group by 1)
select day, own, cast(best_pack as bigint) as best_pack, most, most < greatest(60, own) as below_floor from c""")
def raw_reuse(spark, sf_dir):
    """The package of a day with most rows, and whether it is below the floor for reuse."""
    p = posts(spark, sf_dir).groupBy("day", (F.col("account_id") % 5).alias("pack")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    c = p.groupBy("day").agg(F.max(F.when(F.col("pack") == 0, F.col("n"))).alias("own"), F.max_by("pack", F.struct("n", -F.col("first_id"))).alias("best_pack"), F.max("n").alias("most"))
    return c.withColumn("below_floor", F.col("most") < F.greatest(F.lit(60), "own"))


@query("""
with r as (select p_type, '- **' || p_name || '** (' || p_brand || ') ' || cast(p_size as varchar) || 's' as line, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as i from part) select p_type, '## ' || p_type || chr(10) || string_agg(line, chr(10) order by i) as markdown from r where i <= 5 group by 1""")
def markdown_report(spark, sf_dir):
    """A section of a report for each kind, its five best as a list."""
    line = F.concat(F.lit("- **"), "p_name", F.lit("** ("), "p_brand", F.lit(") "), F.col("p_size").cast("string"), F.lit("s"))
    r = top(table(spark, sf_dir, "part").select("p_type", line.alias("line"), "p_retailprice", "p_partkey"), ["p_type"], 5, F.desc("p_retailprice"), F.asc("p_partkey"), keep_rank="i")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda v: v["line"]), "\n")
    return r.groupBy("p_type").agg(F.concat(F.lit("## "), F.first("p_type"), F.lit("\n"), body).alias("markdown"))


@query("""
with b as (select p_partkey, 'hit <em class="keyword">' || p_name || '</em>' as title, lpad(cast(p_size % 60 as varchar), 2, '0') || ':' || lpad(cast(p_partkey % 60 as varchar), 2, '0') as duration, 1704067200 + p_partkey * 60 as pubdate, p_brand as keyword from part),
r as (select *, row_number() over (partition by keyword order by pubdate desc) as i from b)
select p_partkey, regexp_replace(title, '<[^>]*>', '', 'g') as title, cast(split_part(duration, ':', 1) as bigint) * 60 + cast(split_part(duration, ':', 2) as bigint) as seconds, strftime(make_timestamp(pubdate * 1000000), '%Y-%m-%dT%H:%M:%S') as published from r where i <= 10""")
def video_site_rows(spark, sf_dir):
    """Rows of a video site: highlight tags taken out, MM:SS to seconds, epoch to ISO, ten of a keyword."""
    from postmill.functions.number import clock_seconds

    p, s = F.col("p_partkey"), F.col("p_size")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    b = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('hit <em class="keyword">'), "p_name", F.lit("</em>")).alias("title"), F.concat(pad(s % 60), F.lit(":"), pad(p % 60)).alias("duration"), (1704067200 + p * 60).alias("pubdate"), F.col("p_brand").alias("keyword"))
    b = top(b, ["keyword"], 10, F.desc("pubdate"))
    return b.select("p_partkey", F.regexp_replace("title", "<[^>]*>", "").alias("title"), clock_seconds(F.col("duration")).alias("seconds"), F.date_format(F.timestamp_seconds("pubdate"), "yyyy-MM-dd'T'HH:mm:ss").alias("published"))


@query("""
select p_partkey, p_name from part where p_type in ('ECONOMY', 'SMALL', 'LARGE') and p_size >= 20 and (p_brand = 'Brand#1' or p_brand like 'Brand#2%') and not contains(p_name, 'red') and p_retailprice > 0""")
def commons_rows(spark, sf_dir):
    """Media rows of a kind, size, licence and author that may be used."""
    c = F.col
    return table(spark, sf_dir, "part").filter(c("p_type").isin("ECONOMY", "SMALL", "LARGE") & (c("p_size") >= 20) & ((c("p_brand") == "Brand#1") | c("p_brand").startswith("Brand#2")) & ~F.contains("p_name", F.lit("red")) & (c("p_retailprice") > 0)).select("p_partkey", "p_name")


@query(f"""
with {POSTS_SQL} select account_id, c_name as account_name, n_name as group_name, count(*) as n_posts, count(distinct video_id) as n_videos from posts join customer on c_custkey = account_id join nation on n_nationkey = c_nationkey group by all""")
def account_matrix(spark, sf_dir):
    """Posts of each account with its name and source group."""
    n = posts(spark, sf_dir).groupBy("account_id").agg(F.count("*").alias("n_posts"), F.countDistinct("video_id").alias("n_videos"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("account_name"), "c_nationkey")
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("group_name"))
    return n.join(c, "account_id").join(g, "c_nationkey").select("account_id", "account_name", "group_name", "n_posts", "n_videos")


@query(f"""
with {POSTS_SQL}, e as (select * from (select *, row_number() over (partition by video_id order by value desc, event_id) as i from posts) where i = 1) select video_id, event_id, value from e""")
def keep_strongest(spark, sf_dir):
    """One post a video: the strongest, the earlier of equals."""
    return best(posts(spark, sf_dir), ["video_id"], F.desc("value"), F.asc("event_id")).select("video_id", "event_id", "value")
