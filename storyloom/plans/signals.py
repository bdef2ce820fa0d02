"""Queries over report streams and located events."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.operators import early_warning as ew
from storyloom.plans.registry import register
from storyloom.sources import tables as tb

AS_OF = "2024-01-20 00:00:00"
T = f"TIMESTAMP '{AS_OF}'"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


#: Times at which the reference's thresholds are met in the given tables.
VOLUME, ENTITY, PLACE, DIVERSITY = "2024-01-10 12:00:00", "2024-01-11 12:00:00", "2024-01-12 21:00:00", "2024-01-20 06:00:00"


def _at(time: str):
    return F.lit(time).cast("timestamp")


def _surge_sql(by: str, recent: int, threshold: float, least: int, time: str, long: int = 168) -> str:
    T = f"TIMESTAMP '{time}'"
    return f"""WITH {tb.REPORTS}, c AS (SELECT {by}, count(*) FILTER (ts >= {T} - INTERVAL {recent} HOUR) AS recent, count(*) FILTER (ts < {T} - INTERVAL {recent} HOUR) AS earlier
  FROM reports WHERE ts >= {T} - INTERVAL {long} HOUR AND ts <= {T} GROUP BY 1),
b AS (SELECT {by}, recent, round(greatest(earlier / {long - recent} * {recent}, 1.0), 6) AS baseline FROM c),
d AS (SELECT *, round((recent - baseline) / greatest(sqrt(baseline), 1.0), 6) AS deviation FROM b)
SELECT {by}, recent, baseline, deviation, CASE WHEN deviation >= 4 THEN 'critical' WHEN deviation >= 3 THEN 'high' WHEN deviation >= 2 THEN 'medium' ELSE 'low' END AS severity
FROM d WHERE deviation >= {threshold} AND recent >= {least}"""


@register("ews2_volume_spikes", _surge_sql("subject", 6, 2.0, 3, VOLUME))
def volume_spikes(spark, sf):
    return ew.surges(tb.reports(spark, sf), "subject", _at(VOLUME), 6, threshold=2.0, least=3)


@register("ews4_entity_surges", _surge_sql("source_id", 6, 2.5, 5, ENTITY))
def entity_surges(spark, sf):
    return ew.surges(tb.reports(spark, sf), "source_id", _at(ENTITY), 6, threshold=2.5, least=5)


@register("ews5_location_surges", _surge_sql("country", 12, 2.0, 2, PLACE))
def location_surges(spark, sf):
    return ew.surges(tb.reports(spark, sf), "country", _at(PLACE), 12, threshold=2.0, least=2)


@register(
    "ews3_source_diversity",
    f"""WITH {tb.REPORTS}, w AS (SELECT subject || '/' || country AS event, source_id, ts >= TIMESTAMP '{DIVERSITY}' - INTERVAL 6 HOUR AS r FROM reports
  WHERE ts >= TIMESTAMP '{DIVERSITY}' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '{DIVERSITY}'),
c AS (SELECT event, count(DISTINCT source_id) FILTER (r) AS recent, round(greatest(count(DISTINCT source_id) FILTER (NOT r) / 6.75, 1.0), 6) AS baseline FROM w GROUP BY 1),
d AS (SELECT *, round((recent - baseline) / greatest(sqrt(baseline), 1.0), 6) AS deviation FROM c)
SELECT event, recent, baseline, deviation, CASE WHEN deviation >= 4 THEN 'critical' WHEN deviation >= 3 THEN 'high' WHEN deviation >= 2 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE deviation >= 2 AND recent >= 3""",
)
def source_diversity(spark, sf):
    rows = tb.reports(spark, sf).withColumn("event", F.concat_ws("/", "subject", "country"))
    return ew.source_diversity(rows, "event", "source_id", _at(DIVERSITY), threshold=2.0, least=3)


@register(
    "ews20_velocity",
    f"""WITH {tb.REPORTS}, c AS (SELECT country, count(*) FILTER (ts >= {T} - INTERVAL 6 HOUR) AS recent, count(*) FILTER (ts < {T} - INTERVAL 6 HOUR) AS earlier
  FROM reports WHERE ts >= {T} - INTERVAL 24 HOUR AND ts <= {T} GROUP BY 1), r AS (SELECT *, (recent / 6) / greatest(earlier / 18, 0.1) AS ratio FROM c)
SELECT country, recent, earlier, round(CASE WHEN earlier = 0 THEN least(1.0, recent / 5) WHEN ratio >= 3 THEN 0.9 WHEN ratio >= 2 THEN 0.7 WHEN ratio >= 1.5 THEN 0.5 WHEN ratio >= 1 THEN 0.3 ELSE 0.1 END::DOUBLE, 6) AS velocity FROM r""",
)
def velocity(spark, sf):
    return ew.velocity(tb.reports(spark, sf), "country", _as_of())


@register(
    "ews12_bursts",
    f"""WITH {tb.REPORTS}, a AS (SELECT report_id, subject, floor(epoch(ts))::BIGINT AS s FROM reports WHERE value > 40),
n AS (SELECT x.report_id, count(*) AS n, count(DISTINCT y.subject) AS types FROM a x JOIN a y ON y.s BETWEEN x.s AND x.s + 7200 GROUP BY 1)
SELECT report_id, n, types::INTEGER AS types, round(least(1.0, n / 8 + 0.3), 6) AS score FROM n WHERE n >= 3 AND types >= 2""",
)
def bursts(spark, sf):
    return ew.bursts(tb.reports(spark, sf).where("value > 40"))


@register(
    "ews29_geo_radar",
    f"""WITH {tb.REPORTS}, {tb.PLACES}, n AS (SELECT *, round_even(lat / 0.5, 0) * 0.5 AS cell_lat, round_even(lon / 0.5, 0) * 0.5 AS cell_lon FROM places WHERE ts >= {T} - INTERVAL 48 HOUR AND ts <= {T}),
c AS (SELECT cell_lat, cell_lon, count(*) AS events, avg(lat) AS centre_lat, avg(lon) AS centre_lon, count(*) FILTER (ts >= {T} - INTERVAL 12 HOUR) AS recent FROM n GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT cell_lat, cell_lon, country, row_number() OVER (PARTITION BY cell_lat, cell_lon ORDER BY count(*) DESC, country) AS r FROM n GROUP BY 1, 2, 3),
f AS (SELECT cell_lat, cell_lon, greatest(10.0, max(2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(centre_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(centre_lat)) * pow(sin(radians(centre_lon - lon) / 2), 2)))))) AS radius FROM n JOIN c USING (cell_lat, cell_lon) GROUP BY 1, 2)
SELECT cell_lat, cell_lon, events, round(centre_lat, 6) AS centre_lat, round(centre_lon, 6) AS centre_lon, round(radius, 4) AS radius_km, round(events / (3.141592653589793 * radius * radius) * 10000, 4) AS density, country,
  CASE WHEN recent > (events - recent) * 1.5 THEN 'rising' WHEN recent < (events - recent) * 0.5 THEN 'falling' ELSE 'stable' END AS trend
FROM c JOIN f USING (cell_lat, cell_lon) JOIN k USING (cell_lat, cell_lon) WHERE r = 1""",
)
def geo_radar(spark, sf):
    return ew.geo_radar(tb.places(spark, sf), _as_of())


@register(
    "ews32_spikes",
    f"""WITH {tb.REPORTS}, d AS (SELECT subject, date_trunc('day', ts) AS day, count(*) AS n FROM reports GROUP BY 1, 2),
s AS (SELECT subject, avg(n) AS mean, stddev_pop(n) AS std FROM d GROUP BY 1 HAVING count(*) >= 3),
z AS (SELECT subject, day, n, round((n - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) AS z FROM d JOIN s USING (subject))
SELECT subject, day, n, z, CASE WHEN z > 3 THEN 'high' WHEN z > 2 THEN 'medium' ELSE 'low' END AS level FROM z WHERE z > 1.5""",
)
def spikes(spark, sf):
    daily = tb.reports(spark, sf).groupBy("subject", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return ew.spikes(daily, "subject", "day", "n")


@register(
    "qry37_heat_map",
    f"""WITH {tb.REPORTS}, {tb.PLACES} SELECT round_even(lat * 2, 0) / 2 AS lat, round_even(lon * 2, 0) / 2 AS lon, count(*) AS events, round(sum(value), 4) AS weight
FROM places GROUP BY 1, 2 ORDER BY weight DESC, lat, lon LIMIT 500""",
)
def heat_map(spark, sf):
    rows = tb.places(spark, sf).groupBy((F.bround(F.col("lat") * 2) / 2).alias("lat"), (F.bround(F.col("lon") * 2) / 2).alias("lon"))
    return rows.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("weight")).orderBy(F.desc("weight"), "lat", "lon").limit(500)


@register(
    "qry38_country_clusters",
    f"""WITH {tb.REPORTS}, {tb.PLACES} SELECT country, count(*) AS events, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(value), 6) AS importance, count(*) FILTER (value > 90) AS high FROM places GROUP BY 1 ORDER BY events DESC, country LIMIT 100""",
)
def country_clusters(spark, sf):
    out = tb.places(spark, sf).groupBy("country").agg(
        F.count("*").alias("events"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("value"), 6).alias("importance"), F.sum((F.col("value") > 90).cast("int")).alias("high")
    )
    return out.orderBy(F.desc("events"), "country").limit(100)


@register("qry10_hotspots", f"WITH {tb.REPORTS} SELECT country, subject, count(*) AS events, round(avg(value), 6) AS mean, count(*) FILTER (value >= 50) AS important FROM reports GROUP BY 1, 2")
def hotspots(spark, sf):
    return tb.reports(spark, sf).groupBy("country", "subject").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean"), F.sum((F.col("value") >= 50).cast("int")).alias("important"))


@register(
    "qry12_source_breakdown",
    f"WITH {tb.REPORTS} SELECT subject, source_id, count(*) AS reports, min(ts) AS first_ts, max(ts) AS last_ts FROM reports GROUP BY 1, 2",
)
def source_breakdown(spark, sf):
    return tb.reports(spark, sf).groupBy("subject", "source_id").agg(F.count("*").alias("reports"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register(
    "qry40_timeline",
    f"WITH {tb.REPORTS} SELECT report_id, ts, subject, country FROM reports WHERE ts <= {T} ORDER BY ts DESC, report_id LIMIT 500",
)
def timeline(spark, sf):
    return tb.reports(spark, sf).where(F.col("ts") <= _as_of()).select("report_id", "ts", "subject", "country").orderBy(F.desc("ts"), "report_id").limit(500)
