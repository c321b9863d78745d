"""Queries over the slots of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.operators import slots as s
from postmill.operators.text_rules import readiness
from postmill.plans.articles import any_of
from postmill.plans.registry import query
from postmill.sources.tables import table

#: Ours: terms that the generated texts have.
WORDS = s.Vocabulary(
    actions=["with", "pour", "und", "para", "ation"], names=["Thorre", "Erst", "Ention"], hints=["tion", "heit", "the "], noise=["***", "!!", "license"], lead=["the", "der", "que"],
    kinds=["tion", "ment", "heit", "ing"], generic=["the", "of the", "la"], ahead=["will", "is the", "wird"], times=["[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{1,2}:[0-9]{2}"],
)
_ACT, _CLAUSE, _KIND = f"(?:{s.either(WORDS.actions)})", f"[^{s.BREAKS}]", f"(?:{s.either(WORDS.kinds)})"
_AHEAD = f"(?s)^(.*?(?:{s.either(WORDS.ahead)}){_CLAUSE}{{0,24}}?)({_ACT})"
_FIRST = f"(?s)^(.*?)({_ACT})"
_NAMES = " ".join(f"when '{n.lower()}' then '{n}'" for n in WORDS.names)
_ENDS, _BARE = s.ENDS, "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"


@query(f"""
with d as (select doc_id, coalesce(text, '') as t from documents), a as (
  select *, case when regexp_matches(t, '{_AHEAD}') then '{_AHEAD}' else '{_FIRST}' end as ahead, regexp_matches(t, '{_AHEAD}') as is_ahead from d), b as (
  select doc_id, t, case when is_ahead then regexp_extract(t, '{_AHEAD}', 1) else regexp_extract(t, '{_FIRST}', 1) end as before,
    case when is_ahead then regexp_extract(t, '{_AHEAD}', 2) else regexp_extract(t, '{_FIRST}', 2) end as action,
    coalesce(case lower(regexp_extract(t, '(?i)(?:{s.either(WORDS.names)})', 0)) {_NAMES} end, '') as known from a), c as (
  select *, substring(t, length(before) + length(action) + 1) as after, trim(regexp_replace(split_part(translate(before, '{s.BREAKS}', repeat(chr(10), {len(s.BREAKS)})), chr(10), -1), '^ *(?:(?:{s.either(WORDS.lead)}) *)+', ''), '{_ENDS}') as own from b), e as (
  select *, case when known <> '' then known when action <> '' and length(own) between 2 and 36 and not {any_of('own', WORDS.noise)}
    and (regexp_matches(own, '^\\p{{L}}[\\p{{L}}\\p{{N}}·._-]{{1,35}}$') or {any_of('own', WORDS.hints)}) then own else '' end as subject from c), f as (
  select *, case when subject <> '' and instr(lower(before), lower(subject)) > 0 then substring(before, instr(lower(before), lower(subject)) + length(subject)) end as middle,
    coalesce(nullif(regexp_extract(after, '^({_CLAUSE}{{2,60}}?{_KIND})', 1), ''), nullif(regexp_extract(after, '^({_CLAUSE}{{2,60}})', 1), '')) as follows from e), g as (
  select *, trim(middle, '{_ENDS}') as between_them, not regexp_matches(middle, '[{s.BREAKS}]') as one from f), h as (
  select *, case when one and regexp_matches(between_them, '{_KIND}$') and length(between_them) between 2 and 60 then between_them when one and length(middle) <= 12 and follows is not null then trim(follows, '{_ENDS}')
    else regexp_extract(t, '《[^》]{{2,60}}》|[A-Z][A-Za-z0-9._-]{{2,60}}', 0) end as raw_object from g), i as (
  select doc_id, subject, action, case when not regexp_matches(raw_object, '^[！!？?，,。；;：:、]') and length({_BARE.format('raw_object')}) >= 2 and {_BARE.format('raw_object')} not in ('the', 'ofthe', 'la') then raw_object else '' end as object,
    coalesce(nullif(regexp_extract(t, '{WORDS.times[0]}', 0), ''), nullif(regexp_extract(t, '{WORDS.times[1]}', 0), ''), '') as time from h)
select *, 30 * (subject <> '')::int + 30 * (action <> '')::int + 30 * (object <> '')::int + 10 * (time <> '')::int as completeness,
  concat_ws(',', case when subject = '' then 'subject' end, case when action = '' then 'action' end, case when object = '' then 'object' end) as missing from i""")
def news_slots(spark, sf_dir):
    """Subject, action, object and time of every whole text, how complete they are and which are missing."""
    d = s.with_slots(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), WORDS).drop("text")
    there = readiness(F.col("subject"), F.col("action"), F.col("object"), F.col("time"), F.lit(True), F.lit(False))
    return d.withColumns({k: there[k] for k in ("completeness", "missing")})
