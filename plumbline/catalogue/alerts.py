"""Results history, streaks and alerts.

The history is derived from the events: a check per event type, a run per
hour, failing while the hour's mean value is above 60.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalogue.registry import EVENTS_AS_OF, Tables, at, query, sql_at
from plumbline.functions.lineage import fresh_dir
from plumbline.functions.time import seconds_between
from plumbline.plans import alerts
from plumbline.plans.calendar import calendar_due, calendar_frame, missed_moments
from plumbline.plans.results import results_latest as newest_results
from plumbline.sources.sinks import append_results, read_results

NOW = sql_at(EVENTS_AS_OF)
SUSTAINED = 7200

HISTORY_SQL = """
    SELECT event_type AS "check", date_trunc('hour', ts) AS run_at, CASE WHEN avg(value) > 60 THEN 'FAIL' ELSE 'PASS' END AS status,
           count(*) || ' row(s)' AS detail FROM events GROUP BY ALL"""

STREAK_SQL = f"""
    SELECT *, CASE WHEN failing THEN min(CASE WHEN failing THEN run_at END) OVER (PARTITION BY "check", island) END AS since,
           NOT failing AND coalesce(lag(failing) OVER (PARTITION BY "check" ORDER BY run_at), false) AS recovered
    FROM (SELECT *, status IN ('FAIL', 'ERROR') AS failing,
                 count(*) FILTER (WHERE status NOT IN ('FAIL', 'ERROR')) OVER (PARTITION BY "check" ORDER BY run_at) AS island FROM ({HISTORY_SQL}))"""

# Checks routed to one target; the others go to every target.
SUITE_SQL = f"""
    SELECT DISTINCT event_type AS "check", {SUSTAINED} AS sustained_secs,
           CASE WHEN event_type IN ('error', 'purchase') THEN 'ops' END AS on_fail FROM events"""

EVENT_SQL = f"""
    SELECT s."check", s.run_at, CASE WHEN s.recovered THEN 'RECOVERED' ELSE s.status END AS status, s.detail, s.since, c.on_fail
    FROM ({STREAK_SQL}) s JOIN ({SUITE_SQL}) c ON c."check" = s."check"
    WHERE s.recovered OR (s.failing AND epoch(s.run_at) - epoch(s.since) >= c.sustained_secs)"""


def history(t: Tables) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    hourly = t.events.groupBy(F.col("event_type").alias("check"), hour.alias("run_at"))
    return hourly.agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")).select(
        "check", "run_at", F.when(F.col("mean_value") > 60, "FAIL").otherwise("PASS").alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(" row(s)")).alias("detail"),
    )


def suite(t: Tables) -> DataFrame:
    kinds = t.events.select(F.col("event_type").alias("check")).distinct()
    return kinds.select(
        "check", F.lit(SUSTAINED).cast("bigint").alias("sustained_secs"),
        F.when(F.col("check").isin("error", "purchase"), "ops").alias("on_fail"), F.lit(3600).cast("bigint").alias("every_secs"),
    )


@query(
    "alert_should_notify",
    f"""SELECT "check", run_at, failing AND epoch(run_at) - epoch(since) >= {SUSTAINED} AS gated, failing AS ungated,
               failing AND NULL IS NOT NULL AS unknown FROM ({STREAK_SQL})""",
)
def alert_should_notify(t: Tables) -> DataFrame:
    rows = alerts.streaks(history(t))
    held, failing = seconds_between(F.col("since"), F.col("run_at")), F.col("failing")
    none = F.lit(None).cast("double")
    return rows.select(
        "check", "run_at",
        F.coalesce(alerts.should_notify(failing, F.lit(SUSTAINED), F.lit(0), held), F.lit(False)).alias("gated"),
        alerts.should_notify(failing, none, F.lit(0), held).alias("ungated"),
        alerts.should_notify(failing, F.lit(SUSTAINED), none, held).alias("unknown"),
    )


@query("alert_failing_since", f"SELECT \"check\", run_at, since FROM ({STREAK_SQL}) WHERE failing")
def alert_failing_since(t: Tables) -> DataFrame:
    return alerts.streaks(history(t)).where("failing").select("check", "run_at", "since")


@query("alert_recovered", f"SELECT \"check\", run_at FROM ({STREAK_SQL}) WHERE recovered")
def alert_recovered(t: Tables) -> DataFrame:
    return alerts.streaks(history(t)).where("recovered").select("check", "run_at")


@query("alert_events", EVENT_SQL)
def alert_events(t: Tables) -> DataFrame:
    return alerts.alert_events(history(t), suite(t))


@query(
    "alert_routing",
    f"""SELECT e."check", e.run_at, e.status, t.target FROM ({EVENT_SQL}) e JOIN (VALUES ('ops'), ('audit')) t(target)
        ON e.on_fail IS NULL OR e.on_fail = t.target""",
)
def alert_routing(t: Tables) -> DataFrame:
    targets = t.spark.createDataFrame([("ops",), ("audit",)], "target string")
    return alerts.route(alerts.alert_events(history(t), suite(t)), targets).select("check", "run_at", "status", "target")


@query(
    "alert_payload",
    f"""SELECT "check", run_at, '{{"text":"' || CASE status WHEN 'RECOVERED' THEN ':white_check_mark:' ELSE ':red_circle:' END || ' ' || "check" || ' '
               || status || ': ' || detail || '","check":"' || "check" || '","status":"' || status || '","detail":"' || detail || '"}}' AS payload
        FROM ({EVENT_SQL})""",
)
def alert_payload(t: Tables) -> DataFrame:
    return alerts.payload(alerts.alert_events(history(t), suite(t))).select("check", "run_at", "payload")


@query(
    "cadence_due",
    f"""SELECT c."check", h.last_run, coalesce(epoch({NOW}) - epoch(h.last_run) >= 3600, true) AS due,
               round(greatest(epoch({NOW}) - epoch(h.last_run) - 3600, 0), 3) AS overdue_secs
        FROM ({SUITE_SQL}) c LEFT JOIN (SELECT "check", max(run_at) AS last_run FROM ({HISTORY_SQL})
             WHERE run_at <= {NOW} GROUP BY "check") h ON h."check" = c."check\"""",
)
def cadence_due(t: Tables) -> DataFrame:
    now = at(EVENTS_AS_OF)
    seen = history(t).where(F.col("run_at") <= now)
    return alerts.cadence(suite(t), seen, now).select("check", "last_run", "due", F.round("overdue_secs", 3).alias("overdue_secs"))


CALENDARS = {"click": "0 */6 * * *", "view": "30 9-17/4 * jan mon-fri", "signup": "0 0 1,15 * *", "purchase": "15 3 13 * fri", "error": "*/20 22-23,0 * * *"}
MOMENTS_SQL = """
    SELECT c."check", m AS expected_at FROM generate_series(TIMESTAMP '2024-01-03 05:10:00', TIMESTAMP '2024-01-27 21:59:00', INTERVAL 1 MINUTE) g(m),
           (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('error')) c("check")
    WHERE CASE c."check" WHEN 'click' THEN minute(m) = 0 AND hour(m) % 6 = 0 WHEN 'view' THEN minute(m) = 30 AND hour(m) IN (9, 13, 17) AND month(m) = 1 AND dayofweek(m) BETWEEN 1 AND 5
          WHEN 'signup' THEN minute(m) = 0 AND hour(m) = 0 AND day(m) IN (1, 15) WHEN 'purchase' THEN minute(m) = 15 AND hour(m) = 3 AND (day(m) = 13 OR dayofweek(m) = 5)
          ELSE minute(m) % 20 = 0 AND hour(m) IN (22, 23, 0) END"""
FROM, TO = datetime(2024, 1, 3, 5, 10), datetime(2024, 1, 27, 22)


@query(
    "cadence_calendar_missed",
    f"""WITH e AS (SELECT *, coalesce(lead(expected_at) OVER (PARTITION BY "check" ORDER BY expected_at), {sql_at(TO)}) AS until FROM ({MOMENTS_SQL}))
        SELECT e."check", expected_at, min(run_at) AS ran_at, count(run_at) = 0 AS missed
        FROM e LEFT JOIN ({HISTORY_SQL}) h ON h."check" = e."check" AND run_at >= expected_at AND run_at < until GROUP BY e."check", expected_at""",
)
def cadence_calendar_missed(t: Tables) -> DataFrame:
    return missed_moments(calendar_frame(t.spark, CALENDARS), history(t), at(FROM), at(TO))


@query(
    "cadence_calendar_due",
    f"""WITH l AS (SELECT c."check", max(run_at) AS last_run FROM (SELECT DISTINCT "check" FROM ({MOMENTS_SQL})) c
                   LEFT JOIN ({HISTORY_SQL}) h ON h."check" = c."check" AND run_at <= TIMESTAMP '2024-01-20 04:00:00' AND run_at > TIMESTAMP '2024-01-04 00:00:00' AND hour(run_at) < 23 GROUP BY c."check")
        SELECT "check", last_run, last_run IS NULL OR EXISTS (SELECT 1 FROM ({MOMENTS_SQL}) m WHERE m."check" = l."check" AND expected_at > last_run
               AND expected_at <= TIMESTAMP '2024-01-20 22:30:00') AS due FROM l""",
)
def cadence_calendar_due(t: Tables) -> DataFrame:
    seen = history(t).where((F.col("run_at") <= at(datetime(2024, 1, 20, 4))) & (F.col("run_at") > at(datetime(2024, 1, 4))) & (F.hour("run_at") < 23))
    return calendar_due(calendar_frame(t.spark, CALENDARS), seen, at(datetime(2024, 1, 20, 22, 30)))


@query("results_latest", f"SELECT \"check\", max(run_at) AS run_at, arg_max(status, run_at) AS status FROM ({HISTORY_SQL}) GROUP BY \"check\"")
def results_latest(t: Tables) -> DataFrame:
    return newest_results(history(t)).select("check", "run_at", "status")


@query(
    "results_history",
    f"""SELECT run_at::DATE AS run_date, status, count(*) AS n FROM ({HISTORY_SQL})
        WHERE run_at >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL""",
)
def results_history(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "results")
    append_results(history(t), path)
    recent = read_results(t.spark, path).where("run_date >= DATE '2024-01-10'")
    return recent.groupBy("run_date", "status").agg(F.count(F.lit(1)).alias("n"))
