"""Score expressions: decay, activity, priority, fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weights of the five priority factors.
WEIGHTS = {"recency": 0.25, "relevance": 0.30, "centrality": 0.20, "git_activity": 0.15, "user_focus": 0.10}


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def recency(age_hours: Column) -> Column:
    return clamp(F.exp(-age_hours / 24))


def weighted(weights: dict[str, float] | None = None) -> Column:
    out = F.lit(0.0)
    for name, w in {**WEIGHTS, **(weights or {})}.items():
        out = out + F.lit(w) * F.col(name).cast("double")
    return out


def git_activity(n7: Column, n30: Column, days_since: Column) -> dict[str, Column]:
    """recent, frequency, recency and combined; all zero for a path without commits."""
    recent = F.when(n7 == 0, F.lit(0.0)).otherwise(F.least(F.ln(n7.cast("double")) / F.ln(F.lit(10.0)) + 0.3, F.lit(1.0)))
    frequency = F.least(n30 / F.lit(30 / 7) / 3, F.lit(1.0))
    fresh = F.exp(-0.1 * days_since)
    none = days_since.isNull()
    parts = {"recent": recent, "frequency": frequency, "recency": fresh, "combined": 0.4 * recent + 0.3 * frequency + 0.3 * fresh}
    return {k: F.when(none, F.lit(0.0)).otherwise(v) for k, v in parts.items()}


def watch_score(entry: Column, seconds: Column, accesses: Column, references: Column) -> Column:
    score = 0.3 * entry.cast("double") + 0.25 * F.exp(-seconds / 3600) + 0.25 * F.least(F.log1p(accesses) / 10, F.lit(1.0)) + 0.2 * F.least(F.log1p(references) / 5, F.lit(1.0))
    return F.when(seconds.isNull(), F.lit(0.0)).otherwise(F.least(score, F.lit(1.0)))


def fusion_term(weight: float, k: int, rank: Column) -> Column:
    return F.lit(weight) / (F.lit(k) + rank)


def score_tier(score: Column) -> Column:
    return F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low")
