"""Rule ladders over titles and texts: content type, readiness, routing, official scores, priorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.number import half_up
from postmill.functions.text import has_any, hits

#: Base scores of delivery priority by kind of subject, and its weights.
STRATEGIC = [("policy", 92), ("model_action", 88), ("company_strategy", 84), ("core", 82), ("model", 74), ("consumer", 66)]
PRIORITY_WEIGHTS = {"heat": 0.45, "strategic": 0.25, "public": 0.20, "discussion": 0.10}
#: Weights of an official event's source and category.
SOURCE_WEIGHT = {"first_party": 70, "regulator": 64, "agency": 55, "index": 48}
OTHER_SOURCE = 40


def flags(text: Column, terms: dict[str, list[str]]) -> dict[str, Column]:
    """Whether a text has a term of each named list."""
    return {k: has_any(text, v) for k, v in terms.items()}


def delivery_priority(heat: Column, max_heat: Column, f: dict[str, Column]) -> dict[str, Column]:
    """heat_normalized, category, priority from flags policy, model, action, company, strategy, core, consumer, discussion, risk,
    tutorial, vague, abstract."""
    normal = half_up(F.lit(100.0) * heat / F.when(max_heat == 0, 1.0).otherwise(max_heat), 3)
    when = {"policy": f["policy"], "model_action": f["model"] & f["action"], "company_strategy": f["company"] & f["strategy"], "core": f["core"], "model": f["model"], "consumer": f["consumer"]}
    category, strategic = F.lit("general"), F.lit(55)
    for name, value in reversed(STRATEGIC):
        category, strategic = F.when(when[name], F.lit(name)).otherwise(category), F.when(when[name], F.lit(value)).otherwise(strategic)
    public = F.when(f["consumer"], 86).when(f["model"] & f["discussion"], 78).when(f["abstract"], 32).when(f["policy"], 58).otherwise(48)
    talk = F.when(f["discussion"], 78).otherwise(45)
    talk = F.when(f["risk"], F.greatest(talk, F.lit(72))).otherwise(talk)
    talk = F.when(f["abstract"] & ~f["discussion"], 32).otherwise(talk)
    strategic = F.when(f["tutorial"], F.least(strategic, F.lit(38))).otherwise(strategic)
    category = F.when(f["tutorial"], F.lit("tutorial")).otherwise(category)
    penalty = F.when(f["risk"], 24).otherwise(0) + F.when(f["tutorial"], 18).otherwise(0) + F.when(f["vague"], 8).otherwise(0)
    w = PRIORITY_WEIGHTS
    total = half_up(w["heat"] * normal, 3) + half_up(w["strategic"] * strategic, 3) + half_up(w["public"] * public, 3) + half_up(w["discussion"] * talk, 3)
    return {"heat_normalized": normal, "category": category, "priority": half_up(F.greatest(F.lit(0.0), total - penalty), 3)}


def readiness(subject: Column, action: Column, obj: Column, time: Column, newslike: Column, vague: Column) -> dict[str, Column]:
    """completeness (30, 30, 30, 10 for each slot there is), missing (names), ready."""
    there = lambda c: c.isNotNull() & (c != "")
    slots = {"subject": (subject, 30), "action": (action, 30), "object": (obj, 30), "time": (time, 10)}
    score = F.lit(0)
    for c, w in slots.values():
        score = score + F.when(there(c), w).otherwise(0)
    missing = F.array_compact(F.array(*[F.when(~there(c), F.lit(k)) for k, (c, _) in list(slots.items())[:3]]))
    return {"completeness": score, "missing": F.array_join(missing, ","), "ready": newslike & (F.size(missing) == 0) & ~vague}


def official_score(source: Column, category: Column, verbs: Column, named: Column, refs: Column, weights: dict[str, int]) -> Column:
    """Source and category weights; an index or media source adds at most 16 for verbs, names and references."""
    base = F.lit(OTHER_SOURCE)
    for k, v in SOURCE_WEIGHT.items():
        base = F.when(source == k, v).otherwise(base)
    cat = F.lit(0)
    for k, v in weights.items():
        cat = F.when(category == k, v).otherwise(cat)
    bonus = F.least(F.lit(16), 4 * verbs + 4 * named + F.least(F.lit(8), 4 * (refs - 1)))
    return base + cat + F.when(source.isin("index", "media"), bonus).otherwise(0)


def relevance(live_hits: Column, live_terms: Column) -> Column:
    """Live terms that a title has, as a share of all live terms."""
    return F.when(live_terms == 0, F.lit(0.0)).otherwise(half_up(live_hits / live_terms, 6))


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(otherwise)
    for condition, label in reversed(steps):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


__all__ = ["delivery_priority", "flags", "hits", "ladder", "official_score", "readiness", "relevance"]
