"""Scoring ladders, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import text as tx

#: Patterns that mark boilerplate, in Arabic texts and in others.
BOILERPLATE = [r"subscribe\s+(now|today|here)", r"click\s+here\s+to", r"(buy\s+now|order\s+today|limited\s+offer)"]
BOILERPLATE_ARABIC = [r"اشترك\s+(الآن|هنا)", r"انقر\s+هنا", r"(اشتر\s+الآن|عرض\s+محدود|سجل\s+الآن)", r"تابعنا\s+على", r"جميع\s+الحقوق\s+محفوظة"]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value found once for a row, however often it is used: the optimizer writes an expression out
    wherever a filter or a projection names it, but not the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def half_even(value: Column, places: int = 2) -> Column:
    """Rounded half to even, by whole millionths, so that what a double can't hold makes no difference."""
    return F.bround(F.round(value * 1_000_000).cast("long"), places - 6) / 1_000_000


def half_even_sql(value: str, places: int = 2) -> str:
    """The same for the oracles."""
    unit = 10 ** (6 - places)
    low = f"floor(round(({value}) * 1000000) / {unit})"
    rest = f"(round(({value}) * 1000000) - {low} * {unit})"
    return f"(({low} + CASE WHEN {rest} * 2 > {unit} OR ({rest} * 2 = {unit} AND {low} % 2 = 1) THEN 1 ELSE 0 END) / {10**places})"


def safe_decimal(value: Column) -> Column:
    """Clamped to [0, 1], two places; null is 0."""
    return half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)))))


def verification_status(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "verified").when(confidence >= 0.65, "likely_true").when(confidence >= 0.45, "unverified").when(confidence >= 0.25, "likely_misleading").otherwise("misleading")


def relevance(mentions: Column, length: Column) -> Column:
    """By mentions per 500 characters; texts of less than 100 say nothing."""
    density = mentions / (length / 500)
    return F.when(length < 100, 0.5).when(density >= 2, 1.0).when(density >= 1, 0.8).when(density >= 0.5, 0.6).otherwise(0.4)


def ladder(value: Column, steps: list[tuple[float, float]], top: float) -> Column:
    """The score of the first step whose bound the value is below, else `top`."""
    out = None
    for bound, score in steps:
        out = F.when(value < bound, F.lit(score)) if out is None else out.when(value < bound, F.lit(score))
    return out.otherwise(F.lit(top))


def length_score(content: Column) -> Column:
    return ladder(F.char_length(content), [(50, 0.0), (100, 0.2), (300, 0.5), (800, 0.8)], 1.0)


def title_score(title: Column) -> Column:
    """Stripped for the least length, as it stands for the greatest."""
    given = F.coalesce(title, F.lit(""))
    return F.when(F.char_length(F.trim(given)) < 5, 0.0).when(F.char_length(given) > 300, 0.4).otherwise(1.0)


def unique_score(content: Column) -> Column:
    def score(own: Column) -> Column:
        return F.when(F.size(own) < 5, 0.0).otherwise(once(F.size(F.array_distinct(own)) / F.size(own), lambda ratio: ladder(ratio, [(0.2, 0.1), (0.4, 0.5)], 1.0)))

    return once(tx.words(content), score)


def caps_score(content: Column) -> Column:
    capitals = lambda letters: F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]+", ""))
    score = lambda letters: F.when(letters == "", 0.5).when(capitals(letters) / F.char_length(letters) > 0.6, 0.1).otherwise(1.0)
    return once(F.regexp_replace(content, r"[^\p{L}]+", ""), score)


def boilerplate_score(content: Column, arabic: Column) -> Column:
    def found(patterns: list[str]) -> Column:
        return sum((F.regexp_like(content, F.lit("(?i)" + p)).cast("int") for p in patterns), F.lit(0))

    hits = F.when(arabic, found(BOILERPLATE_ARABIC)).otherwise(found(BOILERPLATE))
    return once(hits, lambda n: F.when(n == 0, 1.0).when(n == 1, 0.6).otherwise(0.2))


def recency(age_hours: Column) -> Column:
    return F.when(age_hours.isNull(), 0.2).when(age_hours < 1, 1.0).when(age_hours < 6, 0.8).when(age_hours < 24, 0.5).otherwise(0.2)


def frequency(count: Column) -> Column:
    return F.when(count <= 1, 0.1).when(count <= 2, 0.3).when(count <= 5, 0.6).when(count <= 10, 0.8).otherwise(1.0)


def severity(deviation: Column) -> Column:
    return F.when(deviation >= 4, "critical").when(deviation >= 3, "high").when(deviation >= 2, "medium").otherwise("low")


def anomaly_confidence(deviation: Column) -> Column:
    return F.greatest(F.lit(0.2), F.bround(F.least(F.lit(1.0), 0.4 + (deviation - 1.5) * 0.15), 2))


def strength(score: Column) -> Column:
    return F.when(score >= 0.7, "strong").when(score >= 0.45, "moderate").otherwise("weak")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius 6371."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
