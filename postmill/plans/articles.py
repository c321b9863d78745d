"""Queries over articles (documents): titles, categories, clusters by key, routing, priorities, readiness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.number import half_up
from postmill.functions.text import categorise, has_all_parts, has_any, hits, numbers, sentences, title_key, words
from postmill.operators import text_rules as rules
from postmill.operators.joins import first_of_sources, similar_sets, token_overlap
from postmill.operators.select import audit, best, first_reason, numbered, ranked, top, within_budget
from postmill.operators.sets import most_shared
from postmill.plans.registry import query
from postmill.sources.tables import ARTICLES_SQL, articles, table

CATEGORIES = [("arts", 1, ["the ", "with"]), ("law", 3, ["und ", "nicht"]), ("money", 2, ["que ", "pour"]), ("play", 2, ["para", "ción"])]
TERMS = {
    "policy": ["erst", "der "], "model": ["tion"], "action": ["with", "pour"], "company": ["the "], "strategy": ["ing "], "core": ["heit"], "consumer": ["ción"],
    "discussion": ["?", "that"], "risk": ["idiot", "clown"], "tutorial": ["license"], "vague": ["!!"], "abstract": ["***", "|"],
}
LIVE_TERMS = ["the", "und", "que", "the and", "thion zzz", "nowhere"]


def h(column: str, terms: list[str]) -> str:
    """SQL: how many of the terms a column has."""
    return "(" + " + ".join(f"contains(lower({column}), '{t.lower()}')::int" for t in terms) + ")"


def any_of(column: str, terms: list[str]) -> str:
    return f"({h(column, terms)} > 0)"


_KEY = "case when regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g') = '' then '' else substr(sha256(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g')), 1, 20) end"


@query(f"with {ARTICLES_SQL} select doc_id, {_KEY} as title_key from articles")
def title_fingerprint(spark, sf_dir):
    """A fingerprint of each title's letters and digits."""
    return articles(spark, sf_dir).select("doc_id", title_key(F.col("title")).alias("title_key"))


@query(f"""
with {ARTICLES_SQL}, c as ({' union all '.join(f"select doc_id, {h('text', t)} as hits, {p} as priority, '{n}' as category from articles" for n, p, t in CATEGORIES)})
select doc_id, category, hits from (select *, row_number() over (partition by doc_id order by hits desc, priority desc, category desc) as i from c) where i = 1""")
def categorize_docs(spark, sf_dir):
    """Each article's category: most hits, then priority, then name."""
    best_of = F.array_max(F.array(*[F.struct(hits(F.col("text"), t).alias("hits"), F.lit(p).alias("priority"), F.lit(n).alias("name")) for n, p, t in CATEGORIES]))
    x = articles(spark, sf_dir)
    return x.select("doc_id", categorise(F.col("text"), CATEGORIES).alias("category"), best_of["hits"].alias("hits"))


@query(f"""
with {ARTICLES_SQL}, k as (select *, {_KEY} as title_key from articles)
select doc_id, title_key, n_chars, copies from (select *, row_number() over (partition by title_key order by n_chars desc, doc_id) as i, count(*) over (partition by title_key) as copies from k) where i = 1""")
def exact_dedup_keep_best(spark, sf_dir):
    """One article a title: the longest, then the earliest."""
    k = articles(spark, sf_dir).withColumn("title_key", title_key(F.col("title")))
    k = k.withColumn("copies", F.count("*").over(Window.partitionBy("title_key")))
    return best(k, ["title_key"], F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "title_key", "n_chars", "copies")


@query(f"""
with {ARTICLES_SQL}, k as (select *, {_KEY} as title_key from articles),
u as (select doc_id, title_key, 0 as source_order from k where source in ('src1', 'src2') union all select doc_id, title_key, 1 from k where lang = 'en' union all select doc_id, title_key, 2 from k where n_chars > 3000),
r as (select *, row_number() over (partition by title_key order by source_order, doc_id) as i from u)
select doc_id, title_key, source_order from r where i = 1""")
def merge_sources(spark, sf_dir):
    """Three overlapping sources in order; the first that has a title wins."""
    k = articles(spark, sf_dir).withColumn("title_key", title_key(F.col("title"))).select("doc_id", "title_key", "source", "lang", "n_chars")
    parts = [k.filter(F.col("source").isin("src1", "src2")), k.filter("lang = 'en'"), k.filter("n_chars > 3000")]
    parts = [best(p.select("doc_id", "title_key"), ["title_key"], F.asc("doc_id")) for p in parts]
    return first_of_sources(parts, ["title_key"]).select("doc_id", "title_key", "source_order")


@query("with d as (select *, lower(split_part(text, ' ', 1)) as first_word from documents) select doc_id, first_word from d where first_word not in (select lower(split_part(text, ' ', 1)) from benchmark)")
def cross_run_anti(spark, sf_dir):
    """Articles whose key is not in the delivered index."""
    first = F.lower(F.substring_index("text", " ", 1)).alias("first_word")
    return table(spark, sf_dir, "documents").select("doc_id", first).join(table(spark, sf_dir, "benchmark").select(first).distinct(), "first_word", "left_anti").select("doc_id", "first_word")


@query("with d as (select *, lower(split_part(text, ' ', 1)) as first_word from documents) select doc_id, first_word from d where first_word in (select lower(split_part(text, ' ', 1)) from benchmark)")
def cross_run_semi(spark, sf_dir):
    """Articles whose key is in the delivered index already."""
    first = F.lower(F.substring_index("text", " ", 1)).alias("first_word")
    return table(spark, sf_dir, "documents").select("doc_id", first).join(table(spark, sf_dir, "benchmark").select(first).distinct(), "first_word", "left_semi").select("doc_id", "first_word")


_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]{{2,}}'))"


@query(f"""
with d as (select doc_id, n_chars, {_WORDS('text')} as tokens from documents), b as (select item_id, {_WORDS('text')} as tokens from benchmark),
dt as (select doc_id, n_chars, unnest(tokens) as token from d), n as (select token from dt group by 1 having count(*) <= 0.2 * (select count(*) from documents)),
bt as (select item_id, unnest(tokens) as token from b),
x as (select item_id, doc_id, n_chars, count(*) as n_shared from bt join dt using (token) join n using (token) group by all)
select item_id, doc_id, n_shared, place from (select *, row_number() over (partition by item_id order by n_shared desc, n_chars desc, doc_id) as place from x) where place <= 5""")
def token_overlap_attach(spark, sf_dir):
    """The five articles that share most tokens with each event; tokens that a fifth of all articles have don't count."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.array_distinct(words(F.col("text"))).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words(F.col("text"))).alias("tokens"))
    return most_shared(d, b, 5, 0.2).select("item_id", "doc_id", "n_shared", "place")


@query(f"""
with {ARTICLES_SQL}, t as (select doc_id, list_sort({_WORDS("title")}) as tokens from articles), s as (select * from t where len(tokens) >= 3),
c as (select tokens, min(doc_id) as left_id from s group by 1), x as (select left_id, len(tokens) as n, unnest(tokens) as token from c),
p as (select a.left_id, b.left_id as right_id, least(a.n, b.n) as n, count(*) as n_shared from x a join x b using (token) where a.left_id < b.left_id group by all)
select left_id, right_id, n_shared, round(n_shared / n, 6) as overlap from p where n_shared >= 3 and n_shared / n >= 0.55
union all select left_id, doc_id, len(tokens), 1.0 from s join c using (tokens) where doc_id <> left_id""")
def overlap_coefficient_pairs(spark, sf_dir):
    """Pairs of different titles with three and more shared tokens and an overlap of 0.55; titles of equal tokens as
    members of a class, which one of them stands for."""
    t = articles(spark, sf_dir).select("doc_id", F.array_distinct(words(F.col("title"))).alias("tokens"))
    # half_up() of what lies between 0 and 1, without its decimals: there are many pairs
    return similar_sets(t, "doc_id", "tokens", 3, 0.55).withColumn("overlap", F.floor(F.col("overlap") * 1e6 + 0.5) / F.lit(1e6))


@query(f"""
with {ARTICLES_SQL}, k as (select *, {_KEY} as title_key from articles)
select title_key, count(*) as n_articles, count(distinct source) as n_domains, bool_or(source = 'src0') as has_primary, (bool_or(source = 'src0') or count(distinct source) >= 2) as confirmed, min(doc_id) as first_id from k group by 1""")
def news_confirmation(spark, sf_dir):
    """An event is confirmed by a primary source or by two independent ones."""
    k = articles(spark, sf_dir).withColumn("title_key", title_key(F.col("title")))
    x = k.groupBy("title_key").agg(F.count("*").alias("n_articles"), F.countDistinct("source").alias("n_domains"), F.bool_or(F.col("source") == "src0").alias("has_primary"), F.min("doc_id").alias("first_id"))
    return x.withColumn("confirmed", F.col("has_primary") | (F.col("n_domains") >= 2))


_F = {k: any_of("text", v) for k, v in TERMS.items()}


@query(f"""
with f as (select doc_id, n_chars, {', '.join(f'{v} as {k}' for k, v in _F.items())} from documents),
s as (select *, round(100.0 * n_chars / max(n_chars) over (), 3) as heat_normalized,
  case when policy then 92 when model and action then 88 when company and strategy then 84 when core then 82 when model then 74 when consumer then 66 else 55 end as strategic,
  case when policy then 'policy' when model and action then 'model_action' when company and strategy then 'company_strategy' when core then 'core' when model then 'model' when consumer then 'consumer' else 'general' end as kind,
  case when consumer then 86 when model and discussion then 78 when abstract then 32 when policy then 58 else 48 end as pub,
  case when abstract and not discussion then 32 when risk then greatest(case when discussion then 78 else 45 end, 72) when discussion then 78 else 45 end as talk,
  case when risk then 24 else 0 end + case when tutorial then 18 else 0 end + case when vague then 8 else 0 end as penalty from f),
p as (select doc_id, heat_normalized, case when tutorial then 'tutorial' else kind end as category,
  round(greatest(0.0, round(0.45 * heat_normalized, 3) + round(0.25 * case when tutorial then least(strategic, 38) else strategic end, 3) + round(0.20 * pub, 3) + round(0.10 * talk, 3) - penalty), 3)::double as priority from s)
select doc_id, heat_normalized::double as heat_normalized, category, priority, row_number() over (order by priority desc, doc_id) as delivery_rank from p""")
def delivery_priority(spark, sf_dir):
    """Heat, strategic weight, public relevance and discussion value, less penalties; and the order of delivery."""
    d = table(spark, sf_dir, "documents")
    most = d.agg(F.max("n_chars").alias("most"))
    x = d.join(F.broadcast(most))  # one row
    p = rules.delivery_priority(F.col("n_chars"), F.col("most"), rules.flags(F.col("text"), TERMS))
    x = x.select("doc_id", *[c.alias(k) for k, c in p.items()])
    return numbered(x, "delivery_rank", F.desc("priority"), F.asc("doc_id"))


@query(f"""
with {ARTICLES_SQL}, t as (select doc_id, {', '.join('(' + ' and '.join(f"contains(lower(title), '{p}')" for p in t.split()) + f') as t{i}' for i, t in enumerate(LIVE_TERMS))} from articles),
l as (select {', '.join(f'bool_or(t{i}) as l{i}' for i in range(len(LIVE_TERMS)))} from t),
s as (select doc_id, {' + '.join(f't{i}::int' for i in range(len(LIVE_TERMS)))} as hits, {' + '.join(f'l{i}::int' for i in range(len(LIVE_TERMS)))} as live from t, l)
select doc_id, hits, live as live_terms, case when live = 0 then 0.0 else round(hits / live, 6) end as relevance from s where hits >= 1""")
def relevance_live_terms(spark, sf_dir):
    """Titles by the share of live terms that they have; a term that no title has is dead and leaves the denominator."""
    names = [f"t{i}" for i in range(len(LIVE_TERMS))]
    t = articles(spark, sf_dir).select("doc_id", *[has_all_parts(F.col("title"), x).alias(n) for n, x in zip(names, LIVE_TERMS, strict=True)])
    live = t.agg(*[F.bool_or(n).cast("int").alias(f"l_{n}") for n in names]).select(sum((F.col(f"l_{n}") for n in names), F.lit(0)).alias("live_terms"))
    x = t.join(F.broadcast(live)).withColumn("hits", sum((F.col(n).cast("int") for n in names), F.lit(0)))
    return x.filter("hits >= 1").select("doc_id", "hits", "live_terms", rules.relevance(F.col("hits"), F.col("live_terms")).alias("relevance"))


_OFFICIAL = {"launch": 28, "chip": 24, "robot": 20, "other": 12}


@query(f"""
with {ARTICLES_SQL}, a as (select doc_id, case doc_id % 5 when 0 then 'first_party' when 1 then 'regulator' when 2 then 'agency' when 3 then 'index' else 'media' end as kind,
  case when {any_of('text', ['the ', 'und '])} then 'launch' when {any_of('text', ['que'])} then 'chip' when {any_of('text', ['ción'])} then 'robot' else 'other' end as category,
  {h('text', ['tion', 'heit', 'ción'])} as verbs, {h('title', ['the', 'der'])} as named, 1 + n_chars % 4 as refs from articles),
s as (select *, case kind when 'first_party' then 70 when 'regulator' then 64 when 'agency' then 55 when 'index' then 48 else 40 end + case category when 'launch' then 28 when 'chip' then 24 when 'robot' then 20 else 12 end
  + case when kind in ('index', 'media') then least(16, 4 * verbs + 4 * named + least(8, 4 * (refs - 1))) else 0 end as score from a)
select doc_id, kind, category, cast(score as bigint) as score, row_number() over (partition by category order by score desc, doc_id) as place from s""")
def official_event_score(spark, sf_dir):
    """Official events by source and category weight."""
    c, k = F.col, F.col("doc_id") % 5
    kind = F.when(k == 0, "first_party").when(k == 1, "regulator").when(k == 2, "agency").when(k == 3, "index").otherwise("media")
    category = rules.ladder((has_any(c("text"), ["the ", "und "]), "launch"), (has_any(c("text"), ["que"]), "chip"), (has_any(c("text"), ["ción"]), "robot"), otherwise="other")
    a = articles(spark, sf_dir).select("doc_id", "text", "title", "n_chars", kind.alias("kind"), category.alias("category"))
    score = rules.official_score(c("kind"), c("category"), hits(c("text"), ["tion", "heit", "ción"]), hits(c("title"), ["the", "der"]), 1 + c("n_chars") % 4, _OFFICIAL)
    return ranked(a.select("doc_id", "kind", "category", score.cast("bigint").alias("score")), "place", F.desc("score"), F.asc("doc_id"), within=["category"])


@query(f"""
with {ARTICLES_SQL} select doc_id, case when {any_of('text', ['idiot', 'clown'])} then 'drop' when source = 'src0' and n_chars >= 800 then 'lead' when {h('text', ['tion', 'ing ', 'heit'])} >= 2 then 'technology'
  when lang <> 'en' then 'international' when n_chars < 200 then 'brief' else 'general' end as lane,
  array_to_string(list_filter([case when {any_of('text', ['tion'])} then 'tion' end, case when {any_of('text', ['ing '])} then 'ing' end, case when {any_of('text', ['heit'])} then 'heit' end], lambda x: x is not null), ',') as hits from articles""")
def reader_routing(spark, sf_dir):
    """The reader's lane of each article, and the terms that it was routed by."""
    t = F.col("text")
    lane = rules.ladder(
        (has_any(t, ["idiot", "clown"]), "drop"), ((F.col("source") == "src0") & (F.col("n_chars") >= 800), "lead"), (hits(t, ["tion", "ing ", "heit"]) >= 2, "technology"),
        (F.col("lang") != "en", "international"), (F.col("n_chars") < 200, "brief"), otherwise="general",
    )
    found = F.array_compact(F.array(*[F.when(has_any(t, [x]), F.lit(x.strip())) for x in ("tion", "ing ", "heit")]))
    return articles(spark, sf_dir).select("doc_id", lane.alias("lane"), F.array_join(found, ",").alias("hits"))


@query("""
with c as (select d.doc_id, d.lang, 36 * (n_chars > 500)::int + 18 * (source = 'src0')::int + 8 * least(2, n_chars % 4) + least(12, n_chars % 15) + 10 * coalesce(quality, 0) + 4 * least(2, n_chars % 3) as priority,
  coalesce(toxic, 0) = 0 and n_chars % 3 > 0 as observed, n_chars % 1000 as attention from documents d left join labels l on d.doc_id = l.doc_id)
select doc_id, lang, cast(priority as bigint) as priority, row_number() over (partition by lang order by priority desc, doc_id) as selection_rank, attention,
  case when observed then row_number() over (partition by lang, observed order by attention desc, doc_id) end as attention_rank from c""")
def public_candidate_rank(spark, sf_dir):
    """Candidates by priority, and, of those that were observed, by attention."""
    b = lambda c: c.cast("int")
    d, n = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), F.col("n_chars")
    priority = 36 * b(n > 500) + 18 * b(F.col("source") == "src0") + 8 * F.least(F.lit(2), n % 4) + F.least(F.lit(12), n % 15) + 10 * F.coalesce("quality", F.lit(0)) + 4 * F.least(F.lit(2), n % 3)
    c = d.select("doc_id", "lang", priority.cast("bigint").alias("priority"), ((F.coalesce("toxic", F.lit(0)) == 0) & (n % 3 > 0)).alias("observed"), (n % 1000).alias("attention"))
    c = ranked(ranked(c, "selection_rank", F.desc("priority"), F.asc("doc_id"), within=["lang"]), "_a", F.desc("attention"), F.asc("doc_id"), within=["lang", "observed"])
    return c.select("doc_id", "lang", "priority", "selection_rank", "attention", F.when(F.col("observed"), F.col("_a")).alias("attention_rank"))


@query("""
with s as (select doc_id, lang, source, n_chars % 50 + 2 * (n_chars % 20) + 3 * (n_chars % 10) + 4 * (n_chars % 5) as signal, n_chars from documents where lang in ('en', 'de', 'fr') and n_chars >= 100),
r as (select *, row_number() over (partition by lang order by signal desc, n_chars desc, source, doc_id) as place from s)
select doc_id, lang, cast(signal as bigint) as signal, place from r where place <= 20""")
def reader_list(spark, sf_dir):
    """The twenty articles of each reader language by public signal."""
    from postmill.operators.scores import signal

    n = F.col("n_chars")
    s = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de", "fr") & (n >= 100)).withColumn("signal", signal(n % 50, n % 20, n % 10, n % 5).cast("bigint"))
    return top(s, ["lang"], 20, F.desc("signal"), F.desc("n_chars"), F.asc("source"), F.asc("doc_id"), keep_rank="place").select("doc_id", "lang", "signal", "place")


@query(f"""
with {ARTICLES_SQL} select doc_id, case when {any_of('text', ['license'])} then 'notice' when regexp_matches(title, '[?]$') then 'question' when {any_of('title', ['!!'])} then 'promotion' when contains(text, '|') then 'table'
  when n_chars < 120 then 'short_post' when {h('text', ['tion', 'the '])} = 2 then 'news' else 'commentary' end as content_type from articles""")
def content_type_ladder(spark, sf_dir):
    """The first content type of a ladder."""
    t, title = F.col("text"), F.col("title")
    kind = rules.ladder(
        (has_any(t, ["license"]), "notice"), (title.rlike("[?]$"), "question"), (has_any(title, ["!!"]), "promotion"), (F.contains(t, F.lit("|")), "table"), (F.col("n_chars") < 120, "short_post"),
        (hits(t, ["tion", "the "]) == 2, "news"), otherwise="commentary",
    )
    return articles(spark, sf_dir).select("doc_id", kind.alias("content_type"))


_SLOTS = "regexp_extract(text, '([A-Z][a-z]{5,})', 1) as subject, regexp_extract(text, '\\b([a-z]{3,}ing)\\b', 1) as act, regexp_extract(text, '\\bof ([a-z]{4,})', 1) as obj, regexp_extract(text, '([0-9]{2,4})', 1) as tm"


@query(f"""
with s as (select doc_id, lang, {_SLOTS}, contains(text, '!!') as vague from documents),
c as (select *, (subject <> '')::int * 30 + (act <> '')::int * 30 + (obj <> '')::int * 30 + (tm <> '')::int * 10 as completeness,
  array_to_string(list_filter([case when subject = '' then 'subject' end, case when act = '' then 'action' end, case when obj = '' then 'object' end], lambda x: x is not null), ',') as missing from s)
select lang, completeness, missing, (lang = 'en' and missing = '' and not vague) as ready, count(*) as n from c group by all""")
def semantic_readiness(spark, sf_dir):
    """Articles by completeness of their slots and whether they are ready."""
    t = F.col("text")
    r = rules.readiness(F.regexp_extract(t, r"([A-Z][a-z]{5,})", 1), F.regexp_extract(t, r"\b([a-z]{3,}ing)\b", 1), F.regexp_extract(t, r"\bof ([a-z]{4,})", 1), F.regexp_extract(t, r"([0-9]{2,4})", 1), F.col("lang") == "en", F.contains(t, F.lit("!!")))
    x = table(spark, sf_dir, "documents").select("lang", *[c.alias(k) for k, c in r.items()])
    return x.groupBy("lang", "completeness", "missing", "ready").agg(F.count("*").alias("n"))


@query(f"""
with {ARTICLES_SQL}, n as (select doc_id, regexp_extract_all(title, '[0-9]+(?:\\.[0-9]+)?') as a, regexp_extract_all(substr(text, 1, 400), '[0-9]+(?:\\.[0-9]+)?') as b, regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?') as c from articles)
select doc_id, len(c) as n_numbers, array_to_string(list_sort(list_filter(list_distinct(c), lambda x: not list_contains(b, x))), ',') as unsupported, len(list_filter(a, lambda x: not list_contains(c, x))) = 0 as title_supported from n where len(c) > 0""")
def number_subset_check(spark, sf_dir):
    """Numbers of a text that its beginning doesn't support."""
    n = articles(spark, sf_dir).select("doc_id", numbers(F.col("title")).alias("a"), numbers(F.substring("text", 1, 400)).alias("b"), numbers(F.col("text")).alias("c"))
    n = n.filter(F.size("c") > 0)
    return n.select("doc_id", F.size("c").cast("bigint").alias("n_numbers"), F.array_join(F.array_sort(F.array_except("c", "b")), ",").alias("unsupported"), (F.size(F.array_except("a", "c")) == 0).alias("title_supported"))


@query("""
select source, kind, visual_role, count(*) as n from (
  select source, case when source = 'src0' then 'official' when source in ('src1', 'src2', 'src3') then 'creator' when lang <> 'en' then 'media_foreign' else 'media' end as kind,
    case when n_chars % 7 = 0 then 'evidence' when n_chars % 7 < 3 then 'illustration' when source = 'src0' then 'primary' else 'context' end as visual_role from documents) group by all""")
def source_labels(spark, sf_dir):
    """Kinds of source and roles of their pictures."""
    s, n = F.col("source"), F.col("n_chars")
    kind = rules.ladder((s == "src0", "official"), (s.isin("src1", "src2", "src3"), "creator"), (F.col("lang") != "en", "media_foreign"), otherwise="media")
    role = rules.ladder((n % 7 == 0, "evidence"), (n % 7 < 3, "illustration"), (s == "src0", "primary"), otherwise="context")
    return table(spark, sf_dir, "documents").groupBy("source", kind.alias("kind"), role.alias("visual_role")).agg(F.count("*").alias("n"))


@query("""
with v as (select doc_id, source, n_chars, n_chars > 2000 as hot, lang = 'en' as local, contains(text, '?') as debate from documents)
select view, count(*) as n, min(doc_id) as first_id from (select doc_id, 'all' as view from v union all select doc_id, 'hot' from v where hot union all select doc_id, 'local' from v where local
  union all select doc_id, 'debate' from v where debate union all select doc_id, 'quiet' from v where not hot and not debate) group by 1""")
def view_partitions(spark, sf_dir):
    """Five views of one table, which overlap."""
    hot, debate = F.col("n_chars") > 2000, F.contains("text", F.lit("?"))
    views = F.array_compact(F.array(F.lit("all"), F.when(hot, F.lit("hot")), F.when(F.col("lang") == "en", F.lit("local")), F.when(debate, F.lit("debate")), F.when(~hot & ~debate, F.lit("quiet"))))
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(views).alias("view"))
    return x.groupBy("view").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query(f"""
with {ARTICLES_SQL}, r as (select case when {any_of('text', ['license'])} then 'license' when n_chars < 100 then 'too_short' when n_chars > 9000 then 'too_long' when {any_of('text', ['***', '|'])} then 'markup' when lang not in ('en', 'de') then 'language' end as reason from articles)
select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1""")
def exclusion_reason_counts(spark, sf_dir):
    """The first reason that excludes each article, counted."""
    n = F.col("n_chars")
    reason = first_reason((has_any(F.col("text"), ["license"]), "license"), (n < 100, "too_short"), (n > 9000, "too_long"), (has_any(F.col("text"), ["***", "|"]), "markup"), (~F.col("lang").isin("en", "de"), "language"))
    return audit(articles(spark, sf_dir).withColumn("reason", reason))


@query("""
with r as (select doc_id, source, n_chars, coalesce(sum(least(600, n_chars)) over (partition by source order by n_chars desc, doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents)
select doc_id, source, cast(least(least(600, n_chars), greatest(0, 5000 - before)) as bigint) as granted from r""")
def safe_input_budget(spark, sf_dir):
    """Characters that each article may put into a source's input of 5000, 600 each."""
    x = within_budget(table(spark, sf_dir, "documents"), "n_chars", F.lit(5000), ["source"], F.desc("n_chars"), F.asc("doc_id"), per_item=600)
    return x.select("doc_id", "source", F.col("granted").cast("bigint").alias("granted"))


@query("""
with s as (select doc_id, list_transform(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)) as p from documents),
f as (select doc_id, list_filter(p, lambda x: length(x) >= 12) as p from s), o as (select doc_id, list_filter(p, lambda x, i: list_position(p, x) = i) as p from f)
select doc_id, array_to_string(p[1:4], ' / ') as summary, len(p[1:4]) as n_sentences from o""")
def deterministic_summary(spark, sf_dir):
    """The first four different sentences."""
    s = sentences(F.col("text"), 12, 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(s, " / ").alias("summary"), F.size(s).cast("bigint").alias("n_sentences"))


@query(f"""
with d as (select doc_id, {_WORDS("split_part(text, chr(10), 1)")} as tokens from documents), b as (select item_id, {_WORDS('text')} as tokens from benchmark),
x as (select doc_id, len(tokens) as n_left, unnest(tokens) as token from d), y as (select item_id, len(tokens) as n_right, unnest(tokens) as token from b),
p as (select doc_id, item_id, n_left, n_right, count(*) as n_shared from x join y using (token) group by all having count(*) >= 2)
select doc_id, min(item_id) as item_id from p where n_shared / greatest(1, least(n_left, n_right)) >= 0.5 group by 1""")
def official_first_match(spark, sf_dir):
    """The first official event with two shared tokens and an overlap of a half of each title."""
    from postmill.sources.tables import articles as load

    d = load(spark, sf_dir).select("doc_id", F.array_distinct(words(F.col("title"))).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(words(F.col("text"))).alias("tokens"))
    p = token_overlap(d, b, "doc_id", "item_id", 2)
    return p.filter(F.col("n_shared") / F.greatest(F.lit(1), F.least("n_left", "n_right")) >= 0.5).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
