"""Text rules, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HAZARDS, HEARSAY, KEYWORDS, URGENCY_HIGH, URGENCY_LOW


def any_of(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(False))


def urgency(text: Column, default: str = "medium") -> Column:
    return F.when(any_of(text, URGENCY_HIGH), "high").when(any_of(text, URGENCY_LOW), "low").otherwise(default)


def hearsay(text: Column) -> Column:
    return any_of(text, HEARSAY)


def keyword_hits(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, (F.contains(low, F.lit(w.lower())).cast("int") for w in words))


def classify(text: Column) -> tuple[Column, Column]:
    """Hazard with the most keyword hits (ties: registry order; null without a hit), and its hits."""
    graded = F.array(*(F.struct(keyword_hits(text, KEYWORDS[k]).alias("hits"), F.lit(-i).alias("back"), F.lit(k).alias("hazard")) for i, k in enumerate(KEYWORDS)))
    best = F.array_max(graded)
    return F.when(best["hits"] > 0, best["hazard"]), best["hits"]


def event_to_hazard(event: Column) -> Column:
    """First registry keyword that an official event name contains."""
    low = F.lower(event)
    cases = [F.when(F.contains(low, F.lit(w)), F.lit(key)) for key, _, _, words, _ in HAZARDS for w in words]
    return F.coalesce(*cases)


def normal_phone(phone: Column) -> Column:
    return F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(10))


def normal_lang(tag: Column, known: tuple[str, ...] = ("en", "hi", "ta")) -> Column:
    base = F.lower(F.split(tag, "-")[0])
    return F.when(base.isin(*known), base).otherwise("en")
