"""Registered queries over sensor series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import series as S
from . import views as V
from .views import Query, oracle

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
KEYS = ["station_id", "variable"]
WEEK = 7 * S.DAY


def r4(x):
    return F.round(x, 4)


def anomaly_scan(spark, d):
    found = S.anomalies(V.readings(spark, d), KEYS)
    return found.select("event_id", *KEYS, "n", r4("z").alias("z"))


QUERIES["anomaly_scan"] = anomaly_scan
ORACLE["anomaly_scan"] = oracle(
    ["readings"],
    "SELECT event_id, station_id, variable, n, round((value - m) / s, 4) AS z FROM based WHERE n >= 30 AND s > 1e-9 AND abs((value - m) / s) >= 3",
    based=f"""SELECT *, count(*) OVER w AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM readings
      WINDOW w AS (PARTITION BY station_id, variable ORDER BY t RANGE BETWEEN {WEEK} PRECEDING AND 1 PRECEDING)""",
)


def anomaly_latest(spark, d):
    return S.latest_scores(V.readings(spark, d), KEYS).select(*KEYS, "event_id", "n", r4("z").alias("z"))


QUERIES["anomaly_latest"] = anomaly_latest
ORACLE["anomaly_latest"] = oracle(
    ["readings"],
    """SELECT l.station_id, l.variable, l.event_id, coalesce(s.n, 0) AS n,
      CASE WHEN s.n >= 30 AND s.sd > 1e-9 THEN round((l.value - s.m) / s.sd, 4) END AS z FROM latest l LEFT JOIN stats s USING (station_id, variable)""",
    latest="SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY station_id, variable ORDER BY t DESC, event_id DESC) = 1",
    stats=f"""SELECT station_id, variable, count(*) AS n, avg(r.value) AS m, stddev_pop(r.value) AS sd FROM readings r JOIN latest l USING (station_id, variable)
      WHERE r.t >= l.t - {WEEK} AND r.t < l.t GROUP BY ALL""",
)


def readings_hourly(spark, d):
    h = S.hourly(V.readings(spark, d), KEYS)
    return h.select(*KEYS, "hour", r4("avg").alias("avg_value"), "min", "max", "n").withColumnsRenamed({"min": "min_value", "max": "max_value"})


QUERIES["readings_hourly"] = readings_hourly
ORACLE["readings_hourly"] = oracle(
    ["readings"],
    f"SELECT station_id, variable, t // {S.HOUR} AS hour, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM readings GROUP BY ALL",
)


def latest_per_variable(spark, d):
    g = V.readings(spark, d).groupBy(*KEYS)
    out = g.agg(F.min(F.struct("t", "event_id", "value")).alias("a"), F.max(F.struct("t", "event_id", "value")).alias("b"), F.count("*").alias("n"))
    return out.select(*KEYS, F.col("a.value").alias("first_value"), F.col("b.value").alias("last_value"), F.col("b.t").alias("last_t"), "n")


QUERIES["latest_per_variable"] = latest_per_variable
ORACLE["latest_per_variable"] = oracle(
    ["readings"],
    "SELECT station_id, variable, arg_min(value, (t, event_id)) AS first_value, arg_max(value, (t, event_id)) AS last_value, max(t) AS last_t, count(*) AS n FROM readings GROUP BY ALL",
)


def readings_dedup(spark, d):
    r = V.readings(spark, d).withColumn("hour", S.bucket_hour(F.col("t")))
    target, incoming = r.filter("event_id % 2 = 0"), r.filter("event_id % 2 = 1")
    return S.insert_if_absent(target, incoming, [*KEYS, "hour"], "event_id").select(*KEYS, "hour", "event_id", "value")


QUERIES["readings_dedup"] = readings_dedup
ORACLE["readings_dedup"] = oracle(
    ["readings"],
    """SELECT station_id, variable, hour, event_id, value FROM r WHERE event_id % 2 = 1
      AND NOT EXISTS (SELECT 1 FROM r x WHERE x.event_id % 2 = 0 AND x.station_id = r.station_id AND x.variable = r.variable AND x.hour = r.hour)
      QUALIFY row_number() OVER (PARTITION BY station_id, variable, hour ORDER BY event_id) = 1""",
    r=f"SELECT *, t // {S.HOUR} AS hour FROM readings",
)


def poll_from(spark, d):
    """Where each station's next incremental scan starts: its newest reading, at most a day before the newest of all."""
    r = V.readings(spark, d)
    newest = r.agg(F.max("t").alias("now"))
    marks = r.groupBy("station_id").agg(F.max("t").alias("mark"))
    return marks.crossJoin(F.broadcast(newest)).select("station_id", F.greatest("mark", F.col("now") - S.DAY).alias("since"))


QUERIES["poll_from"] = poll_from
ORACLE["poll_from"] = oracle(["readings"], f"SELECT station_id, greatest(max(t), (SELECT max(t) FROM readings) - {S.DAY}) AS since FROM readings GROUP BY ALL")


def _forecasts(spark, d):
    """One prediction for every reading, 3 minutes off and a tenth too high."""
    r = V.readings(spark, d)
    return r.select(F.col("event_id").alias("forecast_id"), *KEYS, (F.col("t") + 3 * R.MINUTE).alias("t"), (F.col("value") * 1.1).alias("predicted"))


_FORECASTS = f"SELECT event_id AS forecast_id, station_id, variable, t + {3 * R.MINUTE} AS t, value * 1.1 AS predicted FROM readings"
_MATCHED = f"""SELECT f.forecast_id, f.station_id, f.variable, f.predicted, arg_min(r.value, (abs(r.t - f.t), r.event_id)) AS actual FROM forecasts f
  JOIN readings r ON r.station_id = f.station_id AND r.variable = f.variable AND abs(r.t - f.t) <= {20 * R.MINUTE} GROUP BY ALL"""


def _matched(spark, d):
    return S.nearest_in_time(_forecasts(spark, d), V.readings(spark, d), KEYS, 20 * R.MINUTE, "value", "event_id")


def forecast_asof(spark, d):
    return _matched(spark, d).select("forecast_id", "actual", r4(F.abs(F.col("predicted") - F.col("actual"))).alias("error"))


QUERIES["forecast_asof"] = forecast_asof
ORACLE["forecast_asof"] = oracle(["readings"], "SELECT forecast_id, actual, round(abs(predicted - actual), 4) AS error FROM matched", forecasts=_FORECASTS, matched=_MATCHED)


def forecast_accuracy(spark, d):
    m = _matched(spark, d).groupBy(*KEYS)
    return m.agg(F.count("*").alias("scored"), r4(F.avg(F.abs(F.col("predicted") - F.col("actual")))).alias("mean_abs_error"))


QUERIES["forecast_accuracy"] = forecast_accuracy
ORACLE["forecast_accuracy"] = oracle(["readings"], "SELECT station_id, variable, count(*) AS scored, round(avg(abs(predicted - actual)), 4) AS mean_abs_error FROM matched GROUP BY ALL", forecasts=_FORECASTS, matched=_MATCHED)


def harmonic_forecast(spark, d):
    return S.harmonic_forecast(V.readings(spark, d), KEYS)


QUERIES["harmonic_forecast"] = harmonic_forecast


def forecast_horizon_pick(spark, d):
    """Of each series' forecast points, the one nearest to two hours after its first."""
    f = S.harmonic_forecast(V.readings(spark, d), KEYS)
    aim = f.groupBy(*KEYS).agg((F.min("t") + 2 * S.HOUR).alias("aim"))
    return f.join(aim, KEYS).groupBy(*KEYS).agg(F.min_by(F.struct("t", "value"), F.abs(F.col("t") - F.col("aim"))).alias("p")).select(*KEYS, "p.t", "p.value")


QUERIES["forecast_horizon_pick"] = forecast_horizon_pick


def forecast_backtest(spark, d):
    """Each series' forecast as of two days before the end, against what was then read within half an hour."""
    r = V.readings(spark, d)
    as_of = r.agg(F.max("t").alias("t")).first().t - 2 * S.DAY
    f = S.harmonic_forecast(r, KEYS, as_of=as_of).withColumnRenamed("value", "predicted")
    m = S.nearest_in_time(f, r, KEYS, 30 * R.MINUTE, "value", "event_id").groupBy(*KEYS)
    return m.agg(F.count("*").alias("scored"), r4(F.avg(F.abs(F.col("predicted") - F.col("actual")))).alias("mean_abs_error"))


QUERIES["forecast_backtest"] = forecast_backtest


def front_velocity(spark, d):
    """Fronts of each hazard and day, from the places of its reports."""
    r = V.reports(spark, d).withColumn("day", F.floor(F.col("t") / S.DAY))
    return S.front(r, ["hazard_type", "day"], least_kmh=0.001).select("hazard_type", "day", "n", r4("speed_kmh").alias("speed_kmh"), F.round("bearing_deg", 2).alias("bearing_deg"))


QUERIES["front_velocity"] = front_velocity
ORACLE["front_velocity"] = oracle(
    ["reports"],
    """SELECT hazard_type, day, n, round(sqrt(vx * vx + vy * vy), 4) AS speed_kmh,
      round((degrees(atan2(vx, vy)) + 360) % 360, 2) AS bearing_deg FROM fit WHERE sqrt(vx * vx + vy * vy) >= 0.001""",
    r=f"SELECT *, t // {S.DAY} AS day FROM reports",
    c="SELECT hazard_type, day, avg(lat) AS lat0, avg(lon) AS lon0, min(t) AS t0, max(t) AS t1, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 4 AND max(t) > min(t)",
    fit=f"""SELECT hazard_type, day, any_value(n) AS n, regr_slope((lon - lon0) * 111.320 * cos(radians(lat0)), (t - t0) / {float(S.HOUR)}) AS vx,
      regr_slope((lat - lat0) * 111.320, (t - t0) / {float(S.HOUR)}) AS vy FROM r JOIN c USING (hazard_type, day) GROUP BY hazard_type, day""",
)


def load_percentiles(spark, d):
    return S.nearest_rank(V.readings(spark, d), ["variable"], "value", {"p50": 0.5, "p95": 0.95})


QUERIES["load_percentiles"] = load_percentiles
ORACLE["load_percentiles"] = oracle(
    ["readings"],
    "SELECT variable, count(*) AS n, list_sort(list(value))[(count(*) * 0.5)::INT + 1 - (CASE WHEN (count(*) * 0.5)::INT > count(*) * 0.5 THEN 1 ELSE 0 END)] AS p50, list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95 FROM readings GROUP BY ALL",
)


def rate_limit_session(spark, d):
    r = V.reports(spark, d).select("id", "reporter_id", "t")
    s = S.gap_sessions(r, ["reporter_id"], 6 * S.HOUR, ["t", "id"])
    return s.select("id", F.col("place").cast("long").alias("place"), (F.col("place") > 5).alias("refused"))


QUERIES["rate_limit_session"] = rate_limit_session
ORACLE["rate_limit_session"] = oracle(
    ["reports"],
    "SELECT id, row_number() OVER (PARTITION BY reporter_id, session ORDER BY t, id) AS place, row_number() OVER (PARTITION BY reporter_id, session ORDER BY t, id) > 5 AS refused FROM s",
    g=f"SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY reporter_id ORDER BY t, id) <= {6 * S.HOUR} THEN 0 ELSE 1 END AS new FROM reports",
    s="SELECT *, sum(new) OVER (PARTITION BY reporter_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS session FROM g",
)


def rate_limit_fixed(spark, d):
    r = V.reports(spark, d).select(F.col("reporter_id").alias("key"), "t", "id")
    return S.anchored_windows(r, "key", S.DAY, 2)


QUERIES["rate_limit_fixed"] = rate_limit_fixed
ORACLE["rate_limit_fixed"] = (
    "WITH RECURSIVE r AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t FROM events), "
    f"w AS (SELECT key, min(t) AS s FROM r GROUP BY key UNION ALL SELECT w.key, min(r.t) AS s FROM w JOIN r ON r.key = w.key AND r.t >= w.s + {S.DAY} GROUP BY w.key), "
    "x AS (SELECT r.key, r.t, r.id, row_number() OVER (PARTITION BY r.key, w.s ORDER BY r.t, r.id)::INT AS place FROM r ASOF JOIN w ON r.key = w.key AND r.t >= w.s) "
    "SELECT key, t, id, place, place <= 2 AS allowed FROM x"
)
