"""Checks over the events as a stream, run over what is available now."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.catalogue.alerts import EVENT_SQL, HISTORY_SQL, history, suite
from plumbline.catalogue.registry import Tables, query
from plumbline.functions.lineage import fresh_dir
from plumbline.model import Check, ColumnRule, Defaults, Suite, Tier
from plumbline.sources import Connection
from plumbline.streaming import jobs
from plumbline.streaming.alerts import read_events, sustained_alerts
from plumbline.streaming.windows import validate_windows

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
RULES = [
    ColumnRule("value", range=(0, 150)), ColumnRule("event_type", allowed=["click", "view", "signup", "purchase"]),
    ColumnRule("user_id", not_null=True),
]


def events(t: Tables) -> DataFrame:
    return jobs.read_stream(t.spark, f"{t.root}/event[s].parquet", EVENT_SCHEMA, "ts")


def finish(run: StreamingQuery) -> None:
    """Wait for an available-now run to end; its failure is raised here."""
    run.awaitTermination()


def table(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a Parquet table and read it back."""
    path = fresh_dir(t.spark, name)
    finish(jobs.write_table(stream, f"{path}/data", f"{path}/checkpoint"))
    return t.spark.read.schema(stream.schema).parquet(f"{path}/data")


def zoneless(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query(
    "stream_validate",
    """SELECT 'events_ok' AS "check", CASE WHEN v + a > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
              CASE WHEN v + a = 0 THEN n || ' row(s), all rules passed' ELSE concat_ws('; ',
                  CASE WHEN v > 0 THEN 'column "value": range=[0,150]: ' || v || ' value(s) out of range' END,
                  CASE WHEN a > 0 THEN 'column "event_type": allowed: ' || a || ' value(s) not in allowed set ["click", "view", "signup", "purchase"]' END)
              END AS detail
       FROM (SELECT count(*) AS n, count(*) FILTER (WHERE value < 0 OR value > 150) AS v,
                    count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')) AS a FROM events)""",
)
def stream_validate(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "stream-validate")
    finish(jobs.validate_stream(events(t), RULES, "events_ok", f"{path}/data", f"{path}/checkpoint", ["event_id"]))
    return t.spark.read.parquet(f"{path}/data").select("check", "status", "detail")


@query(
    "stream_suite",
    """SELECT 0 AS ord, 'arrived' AS "check", CASE WHEN count(*) = 0 THEN 'FAIL' ELSE 'PASS' END AS status, '1 row(s)' AS detail FROM events
       UNION ALL SELECT 1, 'errors', CASE WHEN count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.1 THEN 'WARN' ELSE 'PASS' END, '1 row(s)' FROM events
       UNION ALL SELECT 2, 'unknown_users', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) || ' row(s)'
                 FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def stream_suite(t: Tables) -> DataFrame:
    unknown = "SELECT event_id, user_id FROM events LEFT ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = user_id"

    def with_customers(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        session = tables["events"].sparkSession
        return {**tables, "customer": session.read.parquet(f"{t.root}/customer.parquet")}

    def suite(batch: Connection) -> Suite:
        both = Connection("both", lambda spark: with_customers(batch.load(spark)))
        rate = "SELECT count_if(event_type = 'error') / count(*) AS rate FROM events"
        return Suite([both], [
            Check("arrived", "SELECT count(*) AS n FROM events", fail="row.n == 0"), Check("errors", rate, warn="row.rate > 0.1"),
            Check("unknown_users", unknown, fail=Tier("rows.count > 0", sample=5), order_by=["event_id"]),
        ], Defaults(timeout="10m"))

    path = fresh_dir(t.spark, "stream-suite")
    finish(jobs.watch_suite(events(t), "events", suite, f"{path}/data", f"{path}/checkpoint"))
    return t.spark.read.parquet(f"{path}/data").select("ord", "check", "status", "detail")


@query(
    "stream_window_rules",
    """SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, count(*) AS n_rows, count(*) FILTER (WHERE value < 0 OR value > 150) AS value_range,
              count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'signup', 'purchase')) AS event_type_allowed,
              count(*) FILTER (WHERE user_id IS NULL) AS user_id_not_null
       FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS d, max(ts) OVER () AS newest FROM events)
       WHERE d + INTERVAL 1 DAY <= newest - INTERVAL 1 HOUR GROUP BY d""",
)
def stream_window_rules(t: Tables) -> DataFrame:
    counted = jobs.window_rules(events(t), RULES, "ts", "1 day", "1 hour")
    return zoneless(table(t, counted, "window-rules"), "window_start", "window_end")


@query(
    "stream_window_null_rate",
    """SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, count(*) AS n_rows,
              CASE WHEN count(*) FILTER (WHERE user_id IS NULL) > 0.02 * count(*) THEN count(*) FILTER (WHERE user_id IS NULL) ELSE 0 END AS user_id_null_rate,
              CASE WHEN count(*) FILTER (WHERE value IS NULL) > 0 THEN count(*) FILTER (WHERE value IS NULL) ELSE 0 END AS value_null_rate
       FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS d, max(ts) OVER () AS newest FROM events)
       WHERE d + INTERVAL 1 DAY <= newest - INTERVAL 1 HOUR GROUP BY d""",
)
def stream_window_null_rate(t: Tables) -> DataFrame:
    rules = [ColumnRule("user_id", null_rate=0.02), ColumnRule("value", null_rate=0.0)]
    counted = jobs.window_rules(events(t), rules, "ts", "1 day", "1 hour")
    return zoneless(table(t, counted, "window-null-rate"), "window_start", "window_end")


def closed(inner: str) -> str:
    """DuckDB: the days that a watermark of one hour has passed, as ``d``, with every row's own columns."""
    return f"""(SELECT * FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS d, max(ts) OVER () AS newest FROM events) WHERE d + INTERVAL 1 DAY <= newest - INTERVAL 1 HOUR) {inner}"""


def judged(t: Tables, rules: list[ColumnRule], name: str) -> DataFrame:
    path = fresh_dir(t.spark, name)
    finish(validate_windows(events(t), rules, "ts", "1 day", "1 hour", f"{path}/data", f"{path}/checkpoint"))
    return zoneless(t.spark.read.parquet(f"{path}/data").drop("batch"), "window_start", "window_end")


@query(
    "stream_window_unique",
    f"""SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, count(*) AS n_rows, count(user_id) - count(DISTINCT user_id) AS user_id_unique,
               count(event_id) - count(DISTINCT event_id) AS event_id_unique, count(*) FILTER (WHERE value < 0 OR value > 150) AS value_range
        FROM {closed("")} GROUP BY d""",
)
def stream_window_unique(t: Tables) -> DataFrame:
    return judged(t, [ColumnRule("user_id", unique=True), ColumnRule("event_id", unique=True), ColumnRule("value", range=(0, 150))], "window-unique")


@query(
    "stream_window_outliers",
    f"""WITH e AS (SELECT * FROM {closed("")}),
             s AS (SELECT d, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                          quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3 FROM e GROUP BY d)
        SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, count(*) AS n_rows,
               count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS value_outliers,
               count(*) FILTER (WHERE user_id < u1 - 1.5 * (u3 - u1) OR user_id > u3 + 1.5 * (u3 - u1)) AS user_id_outliers
        FROM e JOIN s USING (d) GROUP BY d""",
)
def stream_window_outliers(t: Tables) -> DataFrame:
    return judged(t, [ColumnRule("value", outliers="iqr"), ColumnRule("user_id", outliers="iqr")], "window-outliers")


@query(
    "stream_window_normal",
    f"""WITH e AS (SELECT *, value AS x, avg(value) OVER (PARTITION BY d) AS mu, stddev_pop(value) OVER (PARTITION BY d) AS sd FROM {closed("")}),
             s AS (SELECT d, count(*) AS n_rows, count(x) AS n, avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4,
                          count(*) FILTER (WHERE abs((x - mu) / sd) > 3) AS far FROM e GROUP BY d)
        SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, n_rows, far AS value_outliers,
               CASE WHEN n < 8 OR m2 = 0 THEN NULL WHEN exp(-(n / 6.0) * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4) / 2) < 0.05 THEN 1 ELSE 0 END AS value_distribution
        FROM s""",
)
def stream_window_normal(t: Tables) -> DataFrame:
    return judged(t, [ColumnRule("value", outliers="zscore", distribution="normal")], "window-normal")


@query(
    "stream_sliding_volume",
    """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS n_rows
       FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS w, max(ts) OVER () AS newest FROM events, range(4) r(k))
       WHERE w + INTERVAL 1 HOUR <= newest - INTERVAL 1 HOUR GROUP BY w""",
)
def stream_sliding_volume(t: Tables) -> DataFrame:
    counted = jobs.sliding_volume(events(t), "ts", "1 hour", "15 minutes", "1 hour")
    return zoneless(table(t, counted, "sliding-volume"), "window_start", "window_end")


@query(
    "stream_session_gaps",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_rows
       FROM (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
             FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS fresh,
                          max(ts) OVER () AS newest FROM events))
       GROUP BY user_id, session, newest HAVING max(ts) + INTERVAL 6 HOUR <= newest - INTERVAL 1 HOUR""",
)
def stream_session_gaps(t: Tables) -> DataFrame:
    sessions = jobs.silent_gaps(events(t), "user_id", "ts", "6 hours", "1 hour")
    return zoneless(table(t, sessions, "session-gaps"), "session_start", "session_end")


@query("stream_sustained_alerts", EVENT_SQL)
def stream_sustained_alerts(t: Tables) -> DataFrame:
    """The history arrives in two parts; the second run continues the first one's streaks."""
    path, runs = fresh_dir(t.spark, "alerts"), history(t)
    later = F.col("run_at") >= F.lit("2024-01-16 07:00:00").cast("timestamp_ntz")
    for part in (~later, later):
        runs.where(part).write.mode("append").parquet(f"{path}/history")
        arriving = jobs.read_stream(t.spark, f"{path}/history", "check string, run_at timestamp_ntz, status string, detail string")
        finish(sustained_alerts(arriving, suite(t), f"{path}/out", f"{path}/checkpoint"))
    return read_events(t.spark, f"{path}/out")


LATE_SQL = EVENT_SQL + f""" AND s.run_at <= (SELECT max(run_at) - INTERVAL 90 MINUTE FROM ({HISTORY_SQL}))"""


@query("stream_late_alerts", LATE_SQL.replace("WHERE s.recovered OR", "WHERE (s.recovered OR").replace(">= c.sustained_secs)", ">= c.sustained_secs))"))
def stream_late_alerts(t: Tables) -> DataFrame:
    """Runs arrive up to an hour late, in three micro-batches of mixed hours; events are those of the ordered history."""
    path, runs = fresh_dir(t.spark, "late-alerts"), history(t)
    first, last = F.lit("2024-01-10 03:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 16:00:00").cast("timestamp_ntz")
    late = F.pmod(F.hash("check", "run_at"), F.lit(2)) == 0  # half of a batch's newest runs come with the next
    hour = F.expr("INTERVAL 1 HOUR")
    batch = F.when((F.col("run_at") < first - hour) | ((F.col("run_at") < first) & ~late), 0).when((F.col("run_at") < last - hour) | ((F.col("run_at") < last) & ~late), 1).otherwise(2)
    for part in range(3):
        runs.where(batch == part).write.mode("append").parquet(f"{path}/history")
        arriving = jobs.read_stream(t.spark, f"{path}/history", "check string, run_at timestamp_ntz, status string, detail string")
        finish(sustained_alerts(arriving, suite(t), f"{path}/out", f"{path}/checkpoint", delay="90 minutes"))
    return read_events(t.spark, f"{path}/out")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    kept = jobs.drop_repeats(events(t), ["user_id", "event_type"], "ts", "40 days")
    return table(t, kept, "dedup").select("user_id", "event_type")


@query(
    "stream_orphans",
    """SELECT e.event_id, e.user_id FROM events e LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = e.user_id
       WHERE c.c_custkey IS NULL""",
)
def stream_orphans(t: Tables) -> DataFrame:
    stream, known = events(t), t.customer.where("c_acctbal > 0").select("c_custkey")
    return table(t, jobs.stream_orphans(stream, known, "user_id", "c_custkey"), "orphans").select("event_id", "user_id")


