"""The engine's settings, checked when they are made. Values that the engine itself chose are marked ours."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    timezone: str = "Asia/Shanghai"
    top_n: int = 30
    seen_dates: int = 30
    categories: list[tuple[str, int, list[str]]] = field(default_factory=list)
    #: Bounds that any setting must keep.
    pool_size: int = 80
    script_top_ratio: float = 0.10
    script_min_top: int = 5
    material_target: int = 4
    folder_cap_bytes: int = 200_000_000
    priority_weights: dict[str, float] = field(default_factory=lambda: {"heat": 0.45, "strategic": 0.25, "public": 0.20, "discussion": 0.10})
    exclude_terms: list[str] = field(default_factory=list)  # ours: none

    def __post_init__(self):
        wrong = []
        if not 40 <= self.pool_size <= 120:
            wrong.append("pool_size must be 40 to 120")
        if not 0 < self.script_top_ratio <= 1 or self.script_min_top < 1:
            wrong.append("script_top_ratio must be above 0 and at most 1, script_min_top at least 1")
        if set(self.priority_weights) != {"heat", "strategic", "public", "discussion"} or abs(sum(self.priority_weights.values()) - 1) > 1e-9:
            wrong.append("priority_weights must be four that sum to 1")
        if not 1 <= self.material_target <= 20:
            wrong.append("material_target must be 1 to 20")
        if self.top_n < 1 or self.seen_dates < 1:
            wrong.append("top_n and seen_dates must be positive")
        names = [n for n, _, _ in self.categories]
        if len(names) != len(set(names)):
            wrong.append("category names must differ")
        if wrong:
            raise ValueError("; ".join(wrong))


def distinct_terms(*lists: list[str]) -> list[str]:
    """Terms in order, each once without regard to case; empty ones left out."""
    seen, out = set(), []
    for t in (t.strip() for x in lists for t in x):
        if t and t.lower() not in seen:
            seen.add(t.lower())
            out.append(t)
    return out


def keyword_plan(core: list[str], supplemental: list[str], n_events: int, enough: int) -> list[str]:
    """Core keywords always; supplemental ones only while there are too few events."""
    return distinct_terms(core, supplemental if n_events < enough else [])


def expand_keywords(subject: str, lanes: list[list[str]], most: int = 10) -> list[str]:
    """The subject, then one term of each lane in turn, each once, at most so many."""
    out, cycle = [subject], 0
    while len(out) < most and any(cycle < len(x) for x in lanes):
        for lane in lanes:
            if cycle < len(lane):
                out = distinct_terms(out, [lane[cycle]])
        cycle += 1
    return out[:most]
