"""Queries over the order tables, which stand for candidates, accounts, claims, packages and probes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.functions.number import clamp, half_up
from postmill.functions.text import masked_name_matches
from postmill.operators import verdicts
from postmill.operators.joins import latest, unmatched, with_overrides
from postmill.operators.select import evict_oldest, first_reason, nearest_rank, ranked, top
from postmill.plans.registry import query
from postmill.sources.tables import table

_DAY = "date_trunc('day', o_orderdate)"


@query("""
with v as (select o_orderkey, c_nationkey as group_id, n_regionkey as lane, c_custkey, cast(round(o_totalprice) as bigint) as heat, o_orderpriority as event_id, year(o_orderdate) as y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
r as (select *, row_number() over (partition by event_id, y, group_id order by heat desc, o_orderkey desc) as i from v)
select event_id, y, cast(sum(case when i = 1 then heat end) as bigint) as effective, cast(sum(heat) as bigint) as raw, count(distinct group_id) as n_groups, count_if(i > 1) as suppressed, min(case when i = 1 then o_orderkey end) as first_chosen from r group by all""")
def source_group_dedup(spark, sf_dir):
    """Of each event and source group only the strongest post counts; the others are suppressed."""
    v = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("group_id"), F.round("o_totalprice").cast("bigint").alias("heat"), F.col("o_orderpriority").alias("event_id"), F.year("o_orderdate").alias("y")
    )
    r = v.withColumn("i", F.row_number().over(Window.partitionBy("event_id", "y", "group_id").orderBy(F.desc("heat"), F.desc("o_orderkey"))))
    return r.groupBy("event_id", "y").agg(
        F.sum(F.when(F.col("i") == 1, F.col("heat"))).alias("effective"), F.sum("heat").alias("raw"), F.countDistinct("group_id").alias("n_groups"), F.count_if(F.col("i") > 1).alias("suppressed"),
        F.min(F.when(F.col("i") == 1, F.col("o_orderkey"))).alias("first_chosen"),
    )


@query("""
select o_custkey as event_id, min(o_orderdate)::date as first_day, max(o_orderdate)::date as last_day, count(*) as n_posts, count(distinct o_orderpriority) as n_keywords, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as lanes,
  cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as total, max_by(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) as representative from orders group by 1""")
def event_rollup(spark, sf_dir):
    """One row an event: times, lanes, keywords, sums, and its strongest post."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(
        F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"), F.count("*").alias("n_posts"), F.countDistinct("o_orderpriority").alias("n_keywords"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("lanes"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("representative"),
    )


@query("""
with s as (select o_orderkey, o_orderstatus, round(10 * exp(-least(48.0, greatest(0.0, (date '2002-01-01' - o_orderdate::date) / 60.0)) / 24.0) + least(22.0, 22 * ln(1 + o_totalprice) / ln(1000001)), 3) as score from orders)
select o_orderkey, o_orderstatus, score, place from (select *, row_number() over (partition by o_orderstatus order by score desc, o_orderkey) as place from s) where place <= 100""")
def freshness_decay_rank(spark, sf_dir):
    """Posts by heat and an exponential decay with age, the hundred best of each status."""
    age = clamp(F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")) / F.lit(60.0), 0.0, 48.0)
    score = half_up(10 * F.exp(-age / 24.0) + F.least(F.lit(22.0), 22 * F.log1p("o_totalprice") / F.log(F.lit(1000001.0))), 3)
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", score.alias("score"))
    return top(s, ["o_orderstatus"], 100, F.desc("score"), F.asc("o_orderkey"), keep_rank="place")


@query("""
with h as (select p_partkey, p_type, p_size, round(p_retailprice / max(p_retailprice) over (partition by p_type), 6) as heat_score from part)
select p_partkey, p_type, heat_score, row_number() over (partition by p_type order by heat_score desc, p_size desc, p_partkey) as place from h""")
def pool_heat_rank(spark, sf_dir):
    """Candidates by heat as a share of their pool's greatest, then length, then id."""
    h = half_up(F.col("p_retailprice") / F.max("p_retailprice").over(Window.partitionBy("p_type")), 6)
    return ranked(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", h.alias("heat_score")), "place", F.desc("heat_score"), F.desc("p_size"), F.asc("p_partkey"), within=["p_type"]).drop("p_size")


@query("""
with r as (select p_partkey, p_type, p_retailprice, row_number() over (partition by p_type order by p_retailprice) as i, cast(round_even((count(*) over (partition by p_type) - 1) * 0.3, 0) as bigint) + 1 as pick from part),
f as (select *, max(case when i = pick then p_retailprice end) over (partition by p_type) as floor_value from r)
select p_partkey, p_type, floor_value, p_retailprice >= floor_value as passed from f""")
def heat_percentile_gate(spark, sf_dir):
    """Candidates at or above the heat at their pool's thirtieth percentile, by nearest rank."""
    x = nearest_rank(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", 0.3, "floor_value")
    return x.select("p_partkey", "p_type", "floor_value", (F.col("p_retailprice") >= F.col("floor_value")).alias("passed"))


_BRANDS = [("Brand#1", 5, 40), ("Brand#2", 10, 45), ("Brand#3", 1, 20)]


@query(f"""
with w(brand, lo, hi) as (values {', '.join(f"('{b}', {lo}, {hi})" for b, lo, hi in _BRANDS)})
select p_partkey, case when contains(p_name, 'red') then 'exclude_term' when p_type = 'SMALL' then 'media_type' when p_size < coalesce(lo, 3) then 'too_short' when p_size > coalesce(hi, 48) then 'too_long' when p_retailprice < 1000 then 'heat' else 'passed' end as stage
from part left join w on p_brand = brand""")
def prefilter_chain(spark, sf_dir):
    """The first gate that a candidate fails: terms, media type, its source's duration window, heat."""
    w = F.broadcast(spark.createDataFrame(_BRANDS, "p_brand string, lo int, hi int"))  # a list of sources in the configuration
    stage = first_reason(
        (F.contains("p_name", F.lit("red")), "exclude_term"), (F.col("p_type") == "SMALL", "media_type"), (F.col("p_size") < F.coalesce("lo", F.lit(3)), "too_short"), (F.col("p_size") > F.coalesce("hi", F.lit(48)), "too_long"),
        (F.col("p_retailprice") < 1000, "heat"),
    )
    return table(spark, sf_dir, "part").join(w, "p_brand", "left").select("p_partkey", F.coalesce(stage, F.lit("passed")).alias("stage"))


@query("""
with a as (select o_orderpriority, date_diff('day', o_orderdate::date, date '2002-01-01') as age from orders)
select o_orderpriority, count(*) as n_before, median(age) as median_before, count_if(age <= 730) as n_after, median(case when age <= 730 then age end) as median_after from a group by 1""")
def freshness_gate_medians(spark, sf_dir):
    """How many posts a gate of 730 days keeps, and the median age before and after."""
    a = table(spark, sf_dir, "orders").select("o_orderpriority", F.datediff(F.lit("2002-01-01").cast("date"), F.to_date("o_orderdate")).alias("age"))
    fresh = F.when(F.col("age") <= 730, F.col("age"))
    return a.groupBy("o_orderpriority").agg(F.count("*").alias("n_before"), F.percentile("age", F.lit(0.5)).alias("median_before"), F.count(fresh).alias("n_after"), F.percentile(fresh, F.lit(0.5)).alias("median_after"))


@query("""
with r as (select p_partkey, p_brand, p_size, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as place, count(*) over (partition by p_brand) as n from part)
select p_partkey, p_brand, place from r where place <= greatest(5, ceil(n * 0.1)) and p_size between 10 and 40""")
def script_pool_topratio(spark, sf_dir):
    """The best tenth of each source, five at least, of these those of a fitting length."""
    w = Window.partitionBy("p_brand")
    r = table(spark, sf_dir, "part").withColumn("place", F.row_number().over(w.orderBy(F.desc("p_retailprice"), F.asc("p_partkey")))).withColumn("n", F.count("*").over(w))
    return r.filter((F.col("place") <= F.greatest(F.lit(5), F.ceil(F.col("n") * 0.1))) & F.col("p_size").between(10, 40)).select("p_partkey", "p_brand", "place")


@query("""
with s as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as i from lineitem where l_returnflag <> 'R'),
r as (select *, row_number() over (order by l_extendedprice desc, l_orderkey, l_linenumber) as place from s where i <= 2)
select l_orderkey, l_linenumber, l_suppkey, l_extendedprice, place from r where place <= 100""")
def topn_per_author_cap(spark, sf_dir):
    """The hundred best rows with at most two of an author; rows without a link don't use the author's share."""
    s = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = (F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    s = top(s, ["l_suppkey"], 2, *order).orderBy(*order).limit(100)
    return ranked(s, "place", *order)


@query("""
with r as (select o_custkey, o_orderkey, o_orderstatus, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as i from orders) select o_custkey, o_orderkey, o_orderstatus from r where i = 1""")
def delivered_latest(spark, sf_dir):
    """The delivered index: the latest delivery of each id."""
    return latest(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


_OVERRIDES = [(1, "PINNED", None), (7, None, 1.0), (7, "LATER", 2.0), (42, "HIDDEN", 0.0)]


@query("""
with o(c_custkey, seg, bal) as (values (1, 'PINNED', null), (7, null, 1.0), (42, 'HIDDEN', 0.0))
select c.c_custkey, coalesce(seg, c_mktsegment) as c_mktsegment, coalesce(bal, c_acctbal) as c_acctbal from customer c left join o on c.c_custkey = o.c_custkey""")
def override_apply(spark, sf_dir):
    """Topics with manual overrides put in, field by field."""
    o = spark.createDataFrame(_OVERRIDES[:2] + _OVERRIDES[3:], "c_custkey bigint, c_mktsegment string, c_acctbal double")
    return with_overrides(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), o, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("""
with s as (select p_partkey, p_brand, 8 * contains(p_name, 'blue')::int + 3 * contains(p_name, 'ring')::int as theme, 2 * (p_type = 'ECONOMY')::int as event, case when p_size between 15 and 30 then 5 else 0 end as bonus, p_retailprice, p_size from part)
select p_partkey, p_brand, theme, event, bonus, row_number() over (partition by p_brand order by theme desc, event desc, bonus desc, p_retailprice desc, p_size desc, p_partkey) as place from s""")
def material_rank(spark, sf_dir):
    """Materials by theme hits, event hits, profile bonus, heat, length, id."""
    i = lambda c: c.cast("int")
    s = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", (8 * i(F.contains("p_name", F.lit("blue"))) + 3 * i(F.contains("p_name", F.lit("ring")))).alias("theme"), (2 * i(F.col("p_type") == "ECONOMY")).alias("event"),
        F.when(F.col("p_size").between(15, 30), 5).otherwise(0).alias("bonus"), "p_retailprice", "p_size",
    )
    return ranked(s, "place", F.desc("theme"), F.desc("event"), F.desc("bonus"), F.desc("p_retailprice"), F.desc("p_size"), F.asc("p_partkey"), within=["p_brand"]).drop("p_retailprice", "p_size")


@query("""
with m as (select l_shipdate, l_returnflag, l_quantity as probed, l_quantity * (1 - l_discount) as decoded, cast(l_quantity * 30 as bigint) as expected, cast(floor(l_quantity * 30 * (1 - l_tax)) as bigint) as frames, l_linenumber - 1 as errors from lineitem),
c as (select l_returnflag, case when probed is null or probed <= 0 then 'missing_duration' when frames = 0 then 'undecodable' when errors > 3 then 'corrupt'
  when expected - frames > greatest(2, 0.02 * expected) or (decoded / probed < 0.95 and probed - decoded > greatest(1.0, 0.05 * probed)) then 'short_decode'
  when abs(probed - decoded) > greatest(1.0, 0.05 * probed) then 'duration_mismatch' else 'valid' end as conclusion from m)
select case when grouping(conclusion) = 1 then 'all' else conclusion end as conclusion, case when grouping(l_returnflag) = 1 then 'all' else l_returnflag end as stage, count(*) as n from c group by grouping sets ((conclusion), (l_returnflag), (conclusion, l_returnflag), ())""")
def validation_conclusions(spark, sf_dir):
    """Decode conclusions by stage, by each, and in all."""
    q = F.col("l_quantity")
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), verdicts.decode_conclusion(q, q * (1 - F.col("l_discount")), (q * 30).cast("bigint"), F.floor(q * 30 * (1 - F.col("l_tax"))).cast("bigint"), F.col("l_linenumber") - 1).alias("what")
    )
    x = m.groupingSets([("what",), ("flag",), ("what", "flag"), ()], "what", "flag").agg(
        F.when(F.grouping("what") == 1, "all").otherwise(F.col("what")).alias("conclusion"), F.when(F.grouping("flag") == 1, "all").otherwise(F.col("flag")).alias("stage"), F.count("*").alias("n")
    )
    return x.select("conclusion", "stage", "n")


@query("""
select verdict, l_returnflag, count(*) as n from (select l_returnflag, case when l_discount * 2.5 >= 0.2 then 'true' when l_tax = 0 then 'unknown' when l_tax * 10 >= 0.4 then 'true' else 'false' end as verdict from lineitem) group by all""")
def visual_verdict(spark, sf_dir):
    """Motion or on-screen text, in three values."""
    v = verdicts.visual_verdict(F.col("l_discount") * 2.5, F.when(F.col("l_tax") != 0, F.col("l_tax") * 10))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(v.cast("string"), F.lit("unknown")).alias("verdict"), "l_returnflag").agg(F.count("*").alias("n"))


@query("""
with s as (select o_orderkey, o_orderstatus, o_orderdate, cast(round(o_totalprice) as bigint) as size from orders),
r as (select *, sum(size) over (partition by o_orderstatus) as total, coalesce(sum(size) over (partition by o_orderstatus order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from s)
select o_orderkey, o_orderstatus, (total - before) > 600000000 as evicted from r""")
def temp_quota_eviction(spark, sf_dir):
    """Oldest files go until a folder fits its quota."""
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", F.round("o_totalprice").cast("bigint").alias("size"))
    return evict_oldest(s, "size", 600_000_000, ["o_orderstatus"], F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "o_orderstatus", "evicted")


@query("""
with c as (select o_orderkey as claim_id, count(case when l_returnflag <> 'R' then 1 end) as facts, count(distinct case when l_returnflag <> 'R' then coalesce(nullif(s_nationkey % 7, 0), -l_suppkey) end) as publishers from orders left join lineitem on l_orderkey = o_orderkey left join supplier on s_suppkey = l_suppkey group by 1)
select case when facts = 0 then 'unsupported' when publishers >= 2 then 'verified' else 'single_source' end as status, count(*) as n, cast(sum(facts) as bigint) as facts, min(claim_id) as first_claim from c group by 1""")
def claim_source_checks(spark, sf_dir):
    """Claims by how many facts and independent publishers support them; a syndicated report counts for its origin."""
    fact = F.col("l_returnflag") != "R"
    origin = F.coalesce(F.nullif(F.col("s_nationkey") % 7, F.lit(0)).cast("bigint"), -F.col("l_suppkey"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")  # noqa: E741
    # lines become a row a claim before they meet the orders; one publisher or more is told by the least and the greatest, without a set
    x = l.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    x = x.groupBy("l_orderkey").agg(F.count_if(fact).alias("n"), F.min(F.when(fact, origin)).alias("low"), F.max(F.when(fact, origin)).alias("high"))
    c = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("times")).join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    publishers = F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2)
    c = c.select("o_orderkey", F.coalesce(F.col("n") * F.col("times"), F.lit(0)).alias("facts"), publishers.alias("publishers"))
    return c.groupBy(verdicts.claim_status(F.col("facts"), F.col("publishers")).alias("status")).agg(F.count("*").alias("n"), F.sum("facts").alias("facts"), F.min("o_orderkey").alias("first_claim"))


@query("""
select problem, count(*) as n, min(k) as first_key from (
  select distinct l_orderkey as k, 'item_without_order' as problem from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
  union all select o_orderkey, 'order_without_item' from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem)) group by 1""")
def referential_checks(spark, sf_dir):
    """References without a partner, in both directions."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return unmatched(i, o, ["k"], "item_without_order", "order_without_item").groupBy("problem").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@query("""
with recursive e as (select n_nationkey as a, (n_nationkey * 3 + 1) % 25 as b from nation where n_regionkey <> 0 union all select n_nationkey, n_regionkey from nation where n_nationkey > 4),
w as (select a as root, b, 1 as depth from e union select root, e.b, depth + 1 from w join e on w.b = e.a where depth < 25)
select distinct root from w where root = b""")
def graph_cycle_check(spark, sf_dir):
    """Nodes of a relation graph that reach themselves: reachability by repeated joins until nothing new is reached."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("r"))
    e = n.filter("r <> 0").select("a", ((F.col("a") * 3 + 1) % 25).alias("b")).unionByName(n.filter("a > 4").select("a", F.col("r").alias("b"))).distinct()
    from postmill.operators.graph import on_cycles

    return on_cycles(e).withColumnRenamed("node", "root")


@query("""
with m as (select c_custkey, c_name, substr(c_name, 1, 3) || '***' || substr(c_name, length(c_name) - c_custkey % 4, 5) as masked from customer),
n as (select c_custkey, replace(c_name, '0', case when c_custkey % 3 = 0 then 'O' else '0' end) as c_name2 from customer)
select m.c_custkey, masked, (left(c_name2, 3) = substr(masked, 1, 3) and right(c_name2, length(masked) - 6) = substr(masked, 7) and length(c_name2) >= length(masked) - 3) as matches from m join n on m.c_custkey = n.c_custkey""")
def masked_name_match(spark, sf_dir):
    """Whether a masked display name can be the account's."""
    name = F.col("c_name")
    masked = F.concat(F.substring(name, 1, 3), F.lit("***"), F.substring(name, F.length(name) - (F.col("c_custkey") % 4).cast("int"), F.lit(5)))
    full = F.replace(name, F.lit("0"), F.when(F.col("c_custkey") % 3 == 0, F.lit("O")).otherwise(F.lit("0")))
    return table(spark, sf_dir, "customer").select("c_custkey", masked.alias("masked"), masked_name_matches(masked, full).alias("matches"))


@query("""
select n_name, r_name, count(*) as n_accounts, count_if(c_acctbal < 0) as n_inactive, cast(sum(cast(c_acctbal as decimal(18, 2))) as double) as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all""")
def account_dimension(spark, sf_dir):
    """Accounts by source group and editorial lane."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_accounts"), F.count_if(F.col("c_acctbal") < 0).alias("n_inactive"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    x = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("n_name", "r_name", "n_accounts", "n_inactive", "balance")
