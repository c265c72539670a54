"""Confidence components and state rules, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CERTAINTY, EDGES, OFFICIAL_DEFAULT, WATER, WEIGHTS


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def coherence(n_independent: Column, is_hearsay: Column) -> Column:
    score = F.when(n_independent <= 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 + 0.2 * (n_independent - 1)))
    return F.when(is_hearsay, score * 0.5).otherwise(score)


def instrument(strongest: Column) -> Column:
    """From the largest |z| that bears on the hazard; null: none."""
    return F.coalesce(clamp((F.abs(strongest) - 2.5) / 2.5), F.lit(0.0))


def media(has_media: Column, reused: Column, gps_km: Column, offset_hours: Column) -> Column:
    return (
        F.when(~has_media, 0.5)
        .when(F.coalesce(reused, F.lit(False)), 0.0)
        .when(gps_km > 5.0, 0.2)
        .when(offset_hours > 6.0, 0.4)
        .when(gps_km.isNull() & offset_hours.isNull(), 0.6)
        .otherwise(1.0)
    )


def official(certainty: Column, covered: Column) -> Column:
    score = reduce(lambda w, kv: w.when(certainty == kv[0], kv[1]), CERTAINTY.items(), F.when(F.lit(False), 0.0)).otherwise(OFFICIAL_DEFAULT)
    return F.when(covered, score).otherwise(0.0)


def account_device(age_hours: Column, recent: Column) -> Column:
    burst = F.least(F.lit(0.5), F.greatest(F.lit(0), recent - 1) * 0.15)
    return F.round(F.greatest(F.lit(0.0), clamp(age_hours / 168.0) - burst), 4)


def combine(**components: Column) -> Column:
    total = reduce(lambda a, b: a + b, (F.coalesce(components[k], F.lit(0.0)) * w for k, w in WEIGHTS.items() if k in components))
    return F.round(clamp(total), 4)


def corroborated(confidence: Column, *evidence: Column) -> Column:
    """Reports alone never corroborate: one kind of outside evidence is needed too."""
    return (confidence >= 0.6) & reduce(lambda a, b: a | b, (e > 0 for e in evidence))


def eligible_tier(status: Column, reporters: Column, instrument_max: Column, min_watch: int = 3) -> Column:
    return F.when(status.isin("corroborated", "verified"), F.when((instrument_max > 0) & (reporters >= min_watch), "watch").otherwise("advisory"))


def damage(water: Column, edges: Column) -> tuple[Column, Column, Column]:
    """Damage class, severity and confidence from image statistics."""
    flooded, debris = water >= WATER[0], edges >= EDGES[0]
    kind = F.when(flooded, "flooding").when(debris, "structural_or_debris").otherwise("minor_or_none")
    severity = (
        F.when(flooded, F.when(water >= WATER[2], "destroyed").when(water >= WATER[1], "severe").otherwise("moderate"))
        .when(debris, F.when(edges >= EDGES[1], "severe").otherwise("moderate"))
        .otherwise("minor")
    )
    sure = F.when(flooded, F.least(F.lit(0.55), 0.25 + water * 0.4)).when(debris, F.least(F.lit(0.5), 0.2 + edges)).otherwise(0.3)
    return kind, severity, F.round(sure, 3)


def backoff_ms(attempts: Column) -> Column:
    return F.least(F.lit(900_000.0), 5000 * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempts - 1)))


def clamp_observed(observed: Column, now: Column, max_age_hours: int = 24) -> Column:
    """Event times into [now - max_age, now]; null becomes now."""
    return F.greatest(now - F.expr(f"INTERVAL {max_age_hours} HOURS"), F.least(F.coalesce(observed, now), now))
