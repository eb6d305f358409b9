"""Scores that rank memories for a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents, in the order in which ties between them are decided.
INTENTS = ("coding", "debugging", "architecture", "testing", "review", "general")
#: Types that matter most for an intent, in order.
PRIORITY = {
    "coding": ("code_snippet", "context", "decision", "relationship"),
    "debugging": ("analysis", "code_snippet", "context", "conversation"),
    "architecture": ("decision", "analysis", "context", "summary"),
    "testing": ("code_snippet", "analysis", "context", "decision"),
    "review": ("code_snippet", "decision", "context", "analysis"),
    "general": ("context", "decision", "conversation", "summary"),
}
WEIGHTS = (1.0, 0.7, 0.4, 0.2)
OTHER = 0.1


def similarity(distance: Column) -> Column:
    return F.exp(-distance)


def type_priority(intent: Column, content_type: Column) -> Column:
    """Weight of a type for an intent, by its place in the intent's list; an unknown intent counts as general."""
    table = F.create_map(*[x for i, types in PRIORITY.items() for t, w in zip(types, WEIGHTS) for x in (F.lit(f"{i}:{t}"), F.lit(w))])
    known = F.when(intent.isin(*PRIORITY), intent).otherwise("general")
    return F.coalesce(table[F.concat_ws(":", known, content_type)], F.lit(OTHER))


def recency(age_days: Column) -> Column:
    return F.greatest(F.lit(0.3), F.exp(-age_days / 60))


def composite(similar: Column, priority: Column, recent: Column) -> Column:
    return 0.6 * similar + 0.3 * priority + 0.1 * recent


def budget(best: Column, base: int = 800, least: int = 200, most: int = 1200) -> Column:
    """Tokens to spend, more of them the higher the best composite score is."""
    return F.least(F.greatest((F.lit(base) * (0.3 + 0.9 * best)).cast("int"), F.lit(least)), F.lit(most))
