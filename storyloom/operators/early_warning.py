"""Early warning over time windows: spikes, diversity, surges, bursts, velocity and places.

Windows are explicit: the recent one is [as_of - recent, as_of], the baseline [as_of - long, as_of - recent),
scaled to the recent one's length and at least 1. All counts of both windows come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import scores
from storyloom.sources import tables as tb


def _within(ts: str, as_of: Column, hours: int) -> Column:
    return (F.col(ts) >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(ts) <= as_of)


def _deviation(out: DataFrame, threshold: float, least: int) -> DataFrame:
    dev = (F.col("recent") - F.col("baseline")) / F.greatest(F.sqrt("baseline"), F.lit(1.0))
    out = out.withColumn("deviation", F.round(dev, 6)).where((F.col("deviation") >= threshold) & (F.col("recent") >= least))
    return out.withColumn("severity", scores.severity(F.col("deviation")))


def surges(rows: DataFrame, by: str, as_of: Column, recent_hours: int = 6, long_hours: int = 168, threshold: float = 2.0, least: int = 3, ts: str = "ts") -> DataFrame:
    """Keys whose recent count exceeds the baseline: (key, recent, baseline, deviation, severity)."""
    recent = _within(ts, as_of, recent_hours)
    out = rows.where(_within(ts, as_of, long_hours)).groupBy(by).agg(F.sum(recent.cast("int")).alias("recent"), F.sum((~recent).cast("int")).alias("earlier"))
    scaled = F.col("earlier") / (long_hours - recent_hours) * recent_hours
    return _deviation(out.withColumn("baseline", F.round(F.greatest(scaled, F.lit(1.0)), 6)).drop("earlier"), threshold, least)


def source_diversity(rows: DataFrame, by: str, source: str, as_of: Column, recent_hours: int = 6, long_hours: int = 168, threshold: float = 2.0, least: int = 3) -> DataFrame:
    """Keys whose recent distinct sources exceed the baseline's, divided by its days."""
    recent = _within("ts", as_of, recent_hours)
    # Distinct pairs first, so that a hot key is pre-aggregated on every side.
    pairs = rows.where(_within("ts", as_of, long_hours)).groupBy(by, source).agg(F.max(recent.cast("int")).alias("r"), F.max((~recent).cast("int")).alias("e"))
    out = pairs.groupBy(by).agg(F.sum("r").alias("recent"), F.sum("e").alias("earlier"))
    days = (long_hours - recent_hours) / 24
    return _deviation(out.withColumn("baseline", F.round(F.greatest(F.col("earlier") / days, F.lit(1.0)), 6)).drop("earlier"), threshold, least)


def velocity(rows: DataFrame, by: str, as_of: Column) -> DataFrame:
    """The six-hour rate against that of the 18 hours before, as a ladder."""
    recent = _within("ts", as_of, 6)
    out = rows.where(_within("ts", as_of, 24)).groupBy(by).agg(F.sum(recent.cast("int")).alias("recent"), F.sum((~recent).cast("int")).alias("earlier"))
    ratio = (F.col("recent") / 6) / F.greatest(F.col("earlier") / 18, F.lit(0.1))
    factor = F.when(F.col("earlier") == 0, F.least(F.lit(1.0), F.col("recent") / 5))
    factor = factor.when(ratio >= 3, 0.9).when(ratio >= 2, 0.7).when(ratio >= 1.5, 0.5).when(ratio >= 1, 0.3).otherwise(0.1)
    return out.withColumn("velocity", F.round(factor, 6))


def bursts(anomalies: DataFrame, least: int = 3, least_types: int = 2, seconds: int = 7200) -> DataFrame:
    """Anchors with `least` anomalies of `least_types` types in the two hours from them on, by day so that windows stay bounded.

    Anomalies are counted by second and type first. Each such count begins to be ahead of an anchor `seconds` before it
    and ends behind itself, and its type is new to anchors behind the one before of that type: both numbers are sums of
    such steps up to the anchor's second, over no more rows than a day has seconds and types. A window that passes
    midnight is looked at from both days: the first hours of a day are given to the day before as well, and a day
    answers for its own seconds.
    """
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = anomalies.where("ts IS NOT NULL").groupBy(at.alias("at"), "subject").agg(F.count("*").alias("c"))
    own, before = F.floor(F.col("at") / 86400), F.floor((F.col("at") - seconds) / 86400)
    dealt = counts.select("at", "subject", "c", F.explode(F.sequence(before, own)).alias("day"))
    last = F.lag("at").over(Window.partitionBy("day", "subject").orderBy("at"))
    known, ahead = F.col("subject").isNotNull().cast("int"), F.col("at") - seconds
    step = lambda second, n, types: F.struct(second.alias("second"), n.alias("n"), types.alias("types"))
    zero = F.lit(0).cast("long")
    steps = F.array(step(ahead, F.col("c"), F.lit(0)), step(F.greatest(ahead, F.coalesce(last + 1, ahead)), zero, known), step(F.col("at") + 1, -F.col("c"), -known))
    spread = dealt.select("day", "at", steps.alias("steps")).select("day", F.explode("steps").alias("s"), "at")
    sums = spread.select("day", "s.*").unionByName(dealt.select("day", F.col("at").alias("second"), zero.alias("n"), F.lit(0).alias("types")))
    sums = sums.groupBy("day", "second").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    until = Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    found = sums.select("day", "second", F.sum("n").over(until).alias("n"), F.sum("types").over(until).cast("int").alias("types"))
    found = found.where((F.floor(F.col("second") / 86400) == F.col("day")) & (F.col("n") >= least) & (F.col("types") >= least_types))
    return anomalies.select("report_id", at.alias("second")).join(found, "second").select("report_id", "n", "types", F.round(F.least(F.lit(1.0), F.col("n") / 8 + 0.3), 6).alias("score"))


def geo_radar(located: DataFrame, as_of: Column, hours: int = 48, grid: float = 0.5, least: int = 3) -> DataFrame:
    """Zones of events on a grid: centre, count, radius (10 km at least), density, most common country and trend."""
    cell = [F.bround(F.col(c) / grid) * grid for c in ("lat", "lon")]
    near = located.where(_within("ts", as_of, hours)).select("ts", "country", "lat", "lon", cell[0].alias("cell_lat"), cell[1].alias("cell_lon"))
    centre = near.groupBy("cell_lat", "cell_lon").agg(
        F.count("*").alias("events"), F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"), F.sum(_within("ts", as_of, 12).cast("int")).alias("recent")
    )
    kept = centre.where(F.col("events") >= least)
    far = near.join(kept, ["cell_lat", "cell_lon"]).groupBy("cell_lat", "cell_lon").agg(
        F.max(scores.haversine(F.col("lat"), F.col("lon"), F.col("centre_lat"), F.col("centre_lon"))).alias("far"), F.mode("country", deterministic=True).alias("country")
    )
    older = F.col("events") - F.col("recent")
    trend = F.when(F.col("recent") > older * 1.5, "rising").when(F.col("recent") < older * 0.5, "falling").otherwise("stable")
    out = kept.join(far, ["cell_lat", "cell_lon"]).withColumn("radius_km", F.greatest(F.lit(10.0), F.col("far")))
    density = F.col("events") / (3.141592653589793 * F.col("radius_km") ** 2) * 10000
    return out.select("cell_lat", "cell_lon", "events", F.round("centre_lat", 6).alias("centre_lat"), F.round("centre_lon", 6).alias("centre_lon"), F.round("radius_km", 4).alias("radius_km"), F.round(density, 4).alias("density"), "country", trend.alias("trend"))


def spikes(series: DataFrame, by: str, at: str, value: str, z: float = 1.5) -> DataFrame:
    """Points of a series more than z population deviations above its mean; at least three points."""
    stats = series.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("points")).where("points >= 3")
    score = (F.col(value) - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    out = series.join(stats, by).withColumn("z", F.round(score, 6)).where(F.col("z") > z)
    return out.select(by, at, value, "z", F.when(F.col("z") > 3, "high").when(F.col("z") > 2, "medium").otherwise("low").alias("level"))


#: What an anomaly's severity and a correlation's strength weigh.
SEVERITY_WEIGHTS = {"low": 0.2, "medium": 0.4, "high": 0.7, "critical": 1.0}
STRENGTH_WEIGHTS = {"weak": 0.2, "moderate": 0.5, "strong": 1.0}


def _weight(column: str, weights: dict[str, float], other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(column)), F.lit(other))


def anomaly_factor(anomalies: DataFrame, by: str) -> DataFrame:
    """(by, anomaly): the summed weights of the severities over 3, at most 1."""
    total = F.sum(_weight("severity", SEVERITY_WEIGHTS, 0.3))
    return anomalies.groupBy(by).agg(F.round(F.least(F.lit(1.0), total / 3), 6).alias("anomaly"))


def correlation_factor(correlations: DataFrame, by: str) -> DataFrame:
    """(by, correlation): the summed weights of the strengths at either end over 2, at most 1."""
    ends = correlations.select(F.explode(F.array("a", "b")).alias(by), "strength")
    return ends.groupBy(by).agg(F.round(F.least(F.lit(1.0), F.sum(_weight("strength", STRENGTH_WEIGHTS, 0.2)) / 2), 6).alias("correlation"))


def historical_factor(patterns: DataFrame, by: str) -> DataFrame:
    return patterns.groupBy(by).agg(F.round(F.least(F.lit(1.0), F.avg("similarity")), 6).alias("historical"))


def diversity_factor(sources: Column) -> Column:
    return F.when(sources >= 10, 0.9).when(sources >= 5, 0.7).when(sources >= 3, 0.5).when(sources >= 2, 0.3).otherwise(0.1)


def misleading_factor(diversity: Column, conflict: Column, credibility: Column) -> Column:
    """Few sources, a conflict and a low credibility (null: not assessed) add up."""
    low = F.when(credibility < 0.4, 0.3).when(credibility < 0.6, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(diversity < 0.3, 0.3).otherwise(0.0) + F.when(conflict, 0.2).otherwise(0.0) + low)


def risk_trend(rows: DataFrame, anomalies: DataFrame, by: str, as_of: Column) -> DataFrame:
    """(by, recent, earlier, trend) from six hours, the 18 before, and the anomalies of the six."""
    recent = _within("ts", as_of, 6)
    counts = rows.where(_within("ts", as_of, 24)).groupBy(by).agg(F.sum(recent.cast("int")).alias("recent"), F.sum((~recent).cast("int")).alias("earlier"))
    marked = anomalies.where(recent).groupBy(by).agg(F.count("*").alias("marked"))
    rising = (F.col("recent") > 0) & ((F.col("recent") * 3 > F.col("earlier")) | (F.coalesce("marked", F.lit(0)) > 0))
    trend = F.when(rising, "rising").when((F.col("recent") == 0) & (F.col("earlier") > 0), "declining").otherwise("stable")
    return counts.join(marked, by, "left").select(by, "recent", "earlier", trend.alias("trend"))


def predictive_scores(rows: DataFrame, anomalies: DataFrame, correlations: DataFrame, patterns: DataFrame, by: str, as_of: Column) -> DataFrame:
    """(by, escalation, continuation, misleading, priority), in hundredths, for keys with rows in the last day."""
    sources = rows.where(_within("ts", as_of, 24)).groupBy(by).agg(F.count_distinct("source_id").alias("sources"))
    out = sources.join(velocity(rows, by, as_of).select(by, "velocity"), by)
    for factor in (anomaly_factor(anomalies, by), correlation_factor(correlations, by), historical_factor(patterns, by)):
        out = out.join(factor, by, "left")
    a, c, h = (F.coalesce(x, F.lit(0.0)) for x in ("anomaly", "correlation", "historical"))
    s, v = diversity_factor(F.col("sources")), F.col("velocity")
    out = out.select(
        by, a.alias("a"), c.alias("c"),
        scores.safe_decimal(a * 0.30 + c * 0.20 + h * 0.20 + v * 0.20 + s * 0.10).alias("escalation"),
        scores.safe_decimal(v * 0.35 + s * 0.25 + a * 0.20 + c * 0.20).alias("continuation"),
        scores.safe_decimal(misleading_factor(s, F.lit(False), F.lit(None).cast("double"))).alias("misleading"),
    )
    priority = F.greatest("escalation", "continuation") * 0.60 + F.col("a") * 0.25 + F.col("c") * 0.15
    return out.select(by, "escalation", "continuation", "misleading", scores.safe_decimal(priority).alias("priority"))


def cross_location(anomalies: DataFrame, by: str, least: int = 2) -> DataFrame:
    out = anomalies.groupBy(by).agg(F.count("*").alias("anomalies")).where(F.col("anomalies") >= least)
    return out.withColumn("score", F.round(F.least(F.lit(1.0), F.col("anomalies") / 10 + 0.3), 6))


def cross_entity(anomalies: DataFrame, links: DataFrame, least: int = 2, least_articles: int = 3) -> DataFrame:
    """(a, b, articles, score) for entities of `least` anomalies or more that share `least_articles` articles."""
    able = anomalies.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("entity_id")
    own = links.join(able, "entity_id", "left_semi").select("article_id", "entity_id").distinct()
    left, right = own.select("article_id", F.col("entity_id").alias("a")), own.select("article_id", F.col("entity_id").alias("b"))
    met = tb.dealt(left.join(right, "article_id").where("a < b").select("a", "b"), links, "a", "b")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("articles")).where(F.col("articles") >= least_articles)
    return pairs.withColumn("score", F.round(F.least(F.lit(1.0), F.col("articles") / 20 + 0.3), 6))


def upsert(active: DataFrame, found: DataFrame, key: list[str], as_of: Column, hours: int = 12) -> DataFrame:
    """found with `action`: update where the same key was active within the hours, else insert; one row for each key, the latest."""
    latest = found.groupBy(*key).agg(F.max(F.struct("ts", "report_id", "value")).alias("f")).select(*key, "f.*")
    known = active.where(_within("ts", as_of, hours)).select(*key).distinct().withColumn("known", F.lit(True))
    return latest.join(known, key, "left").select(*key, "report_id", "value", F.when(F.col("known"), "update").otherwise("insert").alias("action"))


def historical_matches(events: DataFrame, members: DataFrame, as_of: Column, days: int = 14, candidates: int = 50, least: float = 0.35) -> DataFrame:
    """(event, match, similarity): events of the last week and those of the same type over `days` days older.

    events: event, type, country, sources, importance, ts; members: event, entity. For each type the most
    important `candidates` old events are tried, which is the reference's rule.
    """
    old = events.where(F.col("ts") < as_of - F.expr(f"INTERVAL {days} DAYS"))
    order = Window.partitionBy("type").orderBy(F.desc("importance"), "event")
    old = old.withColumn("r", F.row_number().over(order)).where(F.col("r") <= candidates).drop("r")
    now = events.where(_within("ts", as_of, 168))
    names = {c: f"{c}_old" for c in ("event", "country", "sources", "importance")}
    pairs = now.join(old.select("type", *[F.col(c).alias(n) for c, n in names.items()]), "type")
    own = members.distinct()
    sizes = own.groupBy("event").agg(F.count("*").alias("size"))
    met = pairs.select("event", "event_old").join(own, "event").join(own.select(F.col("event").alias("event_old"), "entity"), ["event_old", "entity"])
    common = met.groupBy("event", "event_old").agg(F.count("*").alias("common"))
    out = pairs.join(common, ["event", "event_old"], "left").join(sizes, "event").join(sizes.select(F.col("event").alias("event_old"), F.col("size").alias("size_old")), "event_old")
    shared = F.coalesce("common", F.lit(0))
    jaccard = shared / (F.col("size") + F.col("size_old") - shared)
    place = F.when(F.col("country").isNull() | F.col("country_old").isNull(), 0.2).when(F.col("country") == F.col("country_old"), 1.0).otherwise(0.0)
    pattern = 1 - F.abs(F.col("sources") - F.col("sources_old")) / F.greatest("sources", "sources_old")
    weight = 1 - F.least(F.lit(1.0), F.abs(F.col("importance") - F.col("importance_old")))
    total = F.round(0.25 + 0.25 * place + 0.25 * jaccard + 0.15 * pattern + 0.10 * weight, 6)
    return out.select("event", F.col("event_old").alias("match"), total.alias("similarity")).where(F.col("similarity") >= least)
