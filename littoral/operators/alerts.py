"""Alert texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import ALERT_TEXTS, HAZARDS, SPOKEN_LABELS, TIER_MARKS


def _fill(template: str, **parts: Column) -> Column:
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def _lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    return reduce(lambda w, kv: w.when(key == kv[0], kv[1]), values.items(), F.when(F.lit(False), "")).otherwise(default)


def message(hazard: Column, tier: Column, n: Column, note: Column | None = None) -> Column:
    """Struct by language of the standard and the short text. A note goes after the English standard text alone."""
    plain = F.initcap(F.replace(hazard, F.lit("_"), F.lit(" ")))
    labels = {"en": {k: label for k, _, _, _, label in HAZARDS}, **SPOKEN_LABELS}
    out = []
    for lang, (standard, short) in ALERT_TEXTS.items():
        plural = F.when(n == 1, "").otherwise("s") if lang == "en" else F.lit("")
        parts = {"emoji": _lookup(tier, TIER_MARKS, F.lit("")), "tier": F.upper(tier), "label": _lookup(hazard, labels[lang], plain), "n": n.cast("string"), "plural": plural}
        long = _fill(standard, **parts)
        if note is not None and lang == "en":
            long = F.concat(long, F.coalesce(F.concat(F.lit(" "), note), F.lit("")))
        out.append(F.struct(long.alias("standard"), _fill(short, **parts).alias("short")).alias(lang))
    return F.struct(*out)


def pick(texts: Column, lang: Column, channel: Column) -> Column:
    """The text to show: the language's, else English; short for channels that count characters."""
    own = reduce(lambda w, x: w.when(lang == x, texts[x]), ALERT_TEXTS, F.when(F.lit(False), texts["en"])).otherwise(texts["en"])
    return F.when(channel.isin("sms", "whatsapp"), own["short"]).otherwise(own["standard"])
