"""Who did what to what, and when: slots of a text by vocabularies, one scan a vocabulary whatever its size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import first_text, has_any

#: What ends a clause, what is cut from a slot's ends; lengths of subjects and objects, how far a verb may
#: stand behind a word that announces it, and a subject before its verb.
BREAKS = "，,。.；;：:！!？?\n"
ENDS = " ，,。；;：:！!？?"
SUBJECT = (2, 36)
OBJECT = (2, 60)
ANNOUNCED = 24
NEAR = 12


@dataclass(frozen=True)
class Vocabulary:
    """Term lists of a language; actions must not be empty."""

    actions: list[str]
    names: list[str] = field(default_factory=list)  # known subjects, in the spelling to return
    hints: list[str] = field(default_factory=list)  # what makes any phrase a subject
    noise: list[str] = field(default_factory=list)  # what no subject has
    lead: list[str] = field(default_factory=list)  # cut from a subject's beginning
    kinds: list[str] = field(default_factory=list)  # words that end an object's phrase
    generic: list[str] = field(default_factory=list)  # objects that say nothing
    ahead: list[str] = field(default_factory=list)  # words that announce an action
    times: list[str] = field(default_factory=list)  # patterns, the first that is found counts


def either(terms: list[str]) -> str:
    """A pattern of any of the terms, a longer one before what it begins with."""
    quoted = ["".join("\\" + c if c.isascii() and not c.isalnum() and c != " " else c for c in t) for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return "|".join(quoted)


def _letters(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}_]", ""))


def supported(value: Column, evidence: Column) -> Column:
    """Whether evidence has a value's letters and digits (two at least) in a row, whatever stands between them."""
    return (F.length(_letters(value)) >= 2) & F.contains(_letters(evidence), _letters(value))


def plausible_subject(value: Column, v: Vocabulary) -> Column:
    """One word of letters, or a phrase with a hint; nothing with a word of noise."""
    word = value.rlike(rf"^\p{{L}}[\p{{L}}\p{{N}}·._-]{{1,{SUBJECT[1] - 1}}}$")
    return (value != "") & ~has_any(value, v.noise) & (word | has_any(value, v.hints))


def plausible_object(value: Column, v: Vocabulary) -> Column:
    """Two letters or digits at least, not begun by punctuation, and no word that says nothing."""
    bare = _letters(value)
    empty_words = [t.lower().replace(" ", "") for t in v.generic]
    return ~value.rlike("^[！!？?，,。；;：:、]") & (F.length(bare) >= 2) & ~bare.isin(empty_words or [""])


def with_slots(df: DataFrame, text: Column, v: Vocabulary) -> DataFrame:
    """With columns subject, action, object, time; '' where there is none, also for a null text. They replace columns of
    these names. Each step is a projection of its own, so that none of its patterns runs twice.

    Action: the first that a word announces, else the first. Subject: the known name that comes first, else the clause
    before the action. Object: the phrase between them if it ends in a kind, else what follows the action, else a title in
    book quotes or a name in Latin letters."""
    acts, clause = f"(?:{either(v.actions)})", f"[^{BREAKS}]"
    c = lambda name: F.col("_slots_" + name)
    x = df.withColumn("_slots_t", F.coalesce(text, F.lit("")))

    def step(**columns):
        nonlocal x
        x = x.withColumns({"_slots_" + k: e for k, e in columns.items()})

    cut = lambda pattern: F.regexp_extract_all(c("t"), F.lit(pattern), F.lit(1))
    first = F.get(cut(rf"(?s)\A(.*?){acts}"), F.lit(0))
    if v.ahead:
        first = F.coalesce(F.get(cut(rf"(?s)\A(.*?(?:{either(v.ahead)}){clause}{{0,{ANNOUNCED}}}?){acts}"), F.lit(0)), first)
    step(before=F.coalesce(first, F.lit("")))
    step(action=F.regexp_extract(F.substring(c("t"), F.length(c("before")) + 1, F.lit(max(map(len, v.actions)))), f"^{acts}", 0))
    step(after=F.substring(c("t"), F.length(c("before")) + F.length(c("action")) + 1, F.lit(OBJECT[1] + max(map(len, [*v.kinds, ""])))))
    spelling = F.create_map(*[F.lit(y) for n in v.names for y in (n.lower(), n)]) if v.names else None
    own = F.substring_index(F.translate(c("before"), BREAKS, "\n" * len(BREAKS)), "\n", -1)
    if v.lead:
        own = F.regexp_replace(own, f"^ *(?:(?:{either(v.lead)}) *)+", "")
    known = spelling[F.lower(F.regexp_extract(c("t"), f"(?i)(?:{either(v.names)})", 0))] if v.names else F.lit(None).cast("string")
    step(known=known, own=F.trim(own, F.lit(ENDS)))
    fits = (c("action") != "") & F.length(c("own")).between(*SUBJECT) & plausible_subject(c("own"), v)
    step(subject=F.coalesce(c("known"), F.when(fits, c("own")), F.lit("")))
    step(start=F.instr(F.lower(c("before")), F.lower(c("subject"))))
    step(middle=F.when((c("subject") != "") & (c("start") > 0), F.substring(c("before"), c("start") + F.length(c("subject")), F.length(c("before")))))
    step(between=F.trim(c("middle"), F.lit(ENDS)), one=~c("middle").rlike(f"[{BREAKS}]"))
    kind = f"(?:{either(v.kinds)})" if v.kinds else "(?:$a)"
    bounded = [F.regexp_extract(c("after"), rf"^({clause}{{{OBJECT[0]},{OBJECT[1]}}}{lazy})", 1) for lazy in (f"?{kind}", "")]
    step(follows=first_text(*bounded), named=F.regexp_extract(c("t"), r"《[^》]{2,60}》|[A-Z][A-Za-z0-9._-]{2,60}", 0))
    near, phrase = c("one") & (F.length(c("middle")) <= NEAR), F.length(c("between")).between(*OBJECT)
    step(object=F.when(c("one") & phrase & F.substring(c("between"), -max(map(len, [*v.kinds, ""])), 99).rlike(f"{kind}$"), c("between")).when(near & c("follows").isNotNull(), F.trim(c("follows"), F.lit(ENDS))).otherwise(c("named")))
    when = first_text(*[F.regexp_extract(c("t"), p, 0) for p in v.times]) if v.times else F.lit(None).cast("string")
    out = {"subject": c("subject"), "action": c("action"), "object": F.when(plausible_object(c("object"), v), c("object")).otherwise(""), "time": F.coalesce(when, F.lit(""))}
    return x.withColumns(out).drop(*[k for k in x.columns if k.startswith("_slots_")])
