"""Registered queries of scheduled jobs: users stand for jobs, their events for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlake.operators import jobs
from civlake.plans.adapter import table
from civlake.plans.registry import query

#: Schedules by a user's number modulo 5; the last has two.
EXPRS = (["17 7 * * *"], ["0 12 8 * *"], ["30 5 * * 1,4"], ["0 0 29 2 *"], ["15 3 * * *", "45 20 15 * 1"])
AS_OF = "2024-01-31 00:00:00"


def _runs(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "cancelled").otherwise("success")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("job"), F.when(F.col("event_type") == "click", "workflow_dispatch").otherwise("schedule").alias("event"), F.col("ts").cast("timestamp").alias("started"),
        kind.alias("conclusion"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("sha"),
    )


def _schedules(spark, d):
    by_kind = jobs.schedule_table(spark, [(str(k), x) for k, xs in enumerate(EXPRS) for x in xs]).withColumnRenamed("job", "kind")
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job"), (F.col("user_id") % 5).cast("string").alias("kind")).distinct()
    return users.join(by_kind, "kind").drop("kind")


_R = """WITH r AS (SELECT event_id AS id, user_id::VARCHAR AS job, user_id % 5 AS kind, CASE WHEN event_type = 'click' THEN 'workflow_dispatch' ELSE 'schedule' END AS event, ts AS started,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'cancelled' ELSE 'success' END AS conclusion, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS sha FROM events),
days AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2032-12-31', INTERVAL 1 DAY)) AS d),
slot AS (SELECT 0 AS kind, d + INTERVAL '7 hours 17 minutes' AS due FROM days UNION ALL SELECT 1, d + INTERVAL 12 HOURS FROM days WHERE day(d) = 8 UNION ALL SELECT 2, d + INTERVAL '5 hours 30 minutes' FROM days WHERE dayofweek(d) IN (1, 4)
  UNION ALL SELECT 3, d FROM days WHERE month(d) = 2 AND day(d) = 29 UNION ALL SELECT 4, d + INTERVAL '3 hours 15 minutes' FROM days UNION ALL SELECT 4, d + INTERVAL '20 hours 45 minutes' FROM days WHERE day(d) = 15 OR dayofweek(d) = 1),
w AS (SELECT r.*, s.due AS slot FROM r ASOF LEFT JOIN slot s ON r.kind = s.kind AND r.started >= s.due),
delay AS (SELECT * REPLACE (CASE WHEN event = 'schedule' AND slot >= started - INTERVAL 36 HOURS THEN slot END AS slot) FROM w),
dm AS (SELECT *, floor(epoch_us(started - slot) / 60e6 + 0.5)::BIGINT AS delay_min FROM delay)
"""


@query(_R + "SELECT id, strftime(slot, '%Y-%m-%d %H:%M') AS slot, delay_min FROM dm")
def cron_asof_delay(spark, d):
    return jobs.with_delay(_runs(spark, d), _schedules(spark, d)).select("id", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "delay_min")


@query(_R + """SELECT job, count(*) AS runs, count(*) FILTER (event = 'schedule') AS scheduled, count(*) FILTER (event <> 'schedule') AS manual, count(*) FILTER (conclusion = 'success') AS success, count(*) FILTER (conclusion = 'failure') AS failure,
  count(*) FILTER (conclusion = 'cancelled') AS other, count(sha) AS commits, strftime(max(started), '%Y-%m-%d %H:%M:%S') AS last_started, arg_max(sha, (started, sha)) FILTER (sha IS NOT NULL) AS last_commit, floor(quantile_cont(delay_min, 0.5) + 0.5)::BIGINT AS median_delay FROM dm GROUP BY 1""")
def run_summary(spark, d):
    out = jobs.run_summary(jobs.with_delay(_runs(spark, d), _schedules(spark, d)))
    return out.withColumn("last_started", F.date_format("last_started", "yyyy-MM-dd HH:mm:ss"))


@query(_R + f""", l AS (SELECT job, kind, max(started) AS t FROM r WHERE event = 'schedule' GROUP BY 1, 2), n AS (SELECT job, min(due) AS due FROM l JOIN slot s ON l.kind = s.kind AND s.due > l.t GROUP BY 1)
SELECT job, strftime(due, '%Y-%m-%d %H:%M') AS next_slot, coalesce(due + INTERVAL 12 HOURS < TIMESTAMP '{AS_OF}', false) AS missed FROM l LEFT JOIN n USING (job)""")
def missed_runs(spark, d):
    out = jobs.missed_runs(_runs(spark, d), _schedules(spark, d), AS_OF)
    return out.select("job", F.date_format("next_slot", "yyyy-MM-dd HH:mm").alias("next_slot"), "missed")


def _jobs(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    k = F.col("user_id")
    states = F.array(*map(F.lit, ("active", "active", "disabled_manually", "disabled_inactivity", "disabled_fork", "unknown")))
    return u.select(k.cast("string").alias("job"), F.element_at(states, (k % 6 + 1).cast("int")).alias("state"))


_STATE = "['active', 'active', 'disabled_manually', 'disabled_inactivity', 'disabled_fork', 'unknown'][(user_id % 6 + 1)::INTEGER]"


@query(_R + f""", j AS (SELECT DISTINCT user_id::VARCHAR AS job, user_id % 5 AS kind, {_STATE} AS state FROM events)
SELECT job, strftime(due, '%Y-%m-%d %H:%M') AS due FROM (SELECT DISTINCT job, due FROM j JOIN slot USING (kind) WHERE state = 'active' AND due > TIMESTAMP '{AS_OF}' AND due <= TIMESTAMP '{AS_OF}' + INTERVAL 24 HOURS) ORDER BY due, job LIMIT 12""")
def upcoming_slots(spark, d):
    return jobs.upcoming(_jobs(spark, d), _schedules(spark, d), AS_OF).withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm"))


@query(_R + f""", j AS (SELECT DISTINCT user_id::VARCHAR AS job, user_id % 5 AS kind FROM events), n AS (SELECT job, min(due) AS due FROM j LEFT JOIN slot s ON j.kind = s.kind AND due > TIMESTAMP '{AS_OF}' GROUP BY 1)
SELECT job, strftime(due, '%Y-%m-%d %H:%M') AS next_slot, (row_number() OVER (ORDER BY due NULLS LAST, job))::INTEGER AS place FROM n""")
def job_order(spark, d):
    return jobs.job_order(_jobs(spark, d), _schedules(spark, d), AS_OF).withColumn("next_slot", F.date_format("next_slot", "yyyy-MM-dd HH:mm"))


@query(_R + "SELECT job, id, place::INTEGER AS place FROM (SELECT job, id, row_number() OVER (PARTITION BY job ORDER BY started DESC, id DESC) AS place FROM r) WHERE place <= 20")
def newest_runs(spark, d):
    return jobs.newest_runs(_runs(spark, d), 20).select("job", "id", "place")


@query(_R + f""", j AS (SELECT DISTINCT user_id, user_id::VARCHAR AS job, {_STATE} AS state FROM events), l AS (SELECT job, kind, max(started) AS t, arg_max(conclusion, (started, id)) AS c FROM r GROUP BY 1, 2),
n AS (SELECT job, min(due) AS due FROM l JOIN slot s ON l.kind = s.kind AND s.due > l.t GROUP BY 1),
f AS (SELECT job, list_concat(list_filter([CASE WHEN user_id % 17 = 0 THEN 'error:schedule' END, CASE WHEN state = 'disabled_inactivity' THEN 'error:inactive' END, CASE WHEN c NOT IN ('success', 'skipped', 'neutral') THEN 'error:failed' END], lambda x: x IS NOT NULL),
  list_filter([CASE state WHEN 'disabled_manually' THEN 'warn:disabled' WHEN 'unknown' THEN 'warn:unknown' END, CASE WHEN user_id % 7 = 0 THEN 'warn:differs' END, CASE WHEN state = 'active' AND user_id % 7 <> 0 AND due + INTERVAL 12 HOURS < TIMESTAMP '{AS_OF}' THEN 'warn:missed' END,
    CASE WHEN state = 'active' AND user_id % 2 = 1 AND user_id % 3 = 0 THEN 'warn:idle' END, CASE WHEN state = 'disabled_fork' THEN 'info:fork' END], lambda x: x IS NOT NULL)) AS found FROM j JOIN l USING (job) LEFT JOIN n USING (job))
SELECT job, array_to_string(found, ' ') AS warnings, len(list_filter(found, lambda x: x NOT LIKE 'info%')) > 0 AS attention FROM f""")
def job_warnings(spark, d):
    runs = _runs(spark, d)
    last = runs.groupBy("job").agg(F.max("started").alias("last_started"), F.max_by("conclusion", F.struct("started", "id")).alias("last_conclusion"))
    due = F.try_element_at(jobs.next_slots(F.col("last_started")), F.lit(1))
    slots = last.join(_schedules(spark, d), "job").withColumn("due", due).groupBy("job").agg(F.min("due").alias("next_slot"))
    k, now = F.col("job").cast("long"), F.lit(AS_OF).cast("timestamp")
    row = _jobs(spark, d).join(last, "job").join(slots, "job", "left").withColumns(
        {"bad_cron": k % 17 == 0, "differs": k % 7 == 0, "pushed_at": F.when(k % 3 == 0, now - F.expr("interval 46 days")).otherwise(now - F.expr("interval 3 days")), "private": k % 2 == 0, "fork": F.lit(False)}
    )
    found = row.select("job", jobs.warnings_of(now).alias("w"))
    return found.select("job", F.array_join(F.transform("w", lambda w: F.concat_ws(":", w["level"], w["what"])), " ").alias("warnings"), jobs.needs_attention(F.col("w")).alias("attention"))


@query("""WITH d AS (SELECT DISTINCT user_id, day(ts)::INTEGER AS n FROM events WHERE event_type = 'purchase'), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS isle FROM d), i AS (SELECT user_id, min(n) AS a, max(n) AS b FROM g GROUP BY user_id, isle),
s AS (SELECT user_id, a, CASE WHEN b = a + 1 THEN a || '-' || a || ' ' || b || '-' || b ELSE a || '-' || b END AS span FROM i)
SELECT user_id AS id, string_agg(span, ' ' ORDER BY a) AS spans FROM s GROUP BY 1""")
def collapsed_runs(spark, d):
    """The days of a month on which a user bought, as spans."""
    bought = table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_set(F.dayofmonth("ts"))).alias("days"))
    spans = F.transform(jobs.collapsed_runs(F.col("days")), lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string")))
    return bought.select("id", F.array_join(spans, " ").alias("spans"))


@query("""SELECT n_nationkey AS id, 'Job ' || n_name AS name, n_nationkey || ' 7 * * *|daily' || CASE WHEN n_nationkey % 2 = 0 THEN ';0 12 8 * *|' ELSE '' END AS crons, n_nationkey % 3 = 0 AS dispatchable FROM nation""")
def workflow_files(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    text = F.concat(F.lit('name: "Job '), "n_name", F.lit("\"   # what it does\non:\n  schedule:\n    - cron: '"), k.cast("string"), F.lit(" 7 * * *'  # daily\n"), F.when(k % 2 == 0, '    - cron: "0 12 8 * *"\n').otherwise(""), F.when(k % 3 == 0, "  workflow_dispatch:\n").otherwise(""))
    p = n.select(k.alias("id"), jobs.parsed_workflow(text).alias("w"))
    return p.select("id", "w.name", F.array_join(F.transform("w.crons", lambda c: F.concat_ws("|", c["expr"], c["comment"])), ";").alias("crons"), "w.dispatchable")


@query(f"""WITH u AS (SELECT DISTINCT user_id AS id, (user_id % 60)::INTEGER AS mi, (user_id % 24)::INTEGER AS h, (user_id % 28 + 1)::INTEGER AS dom, (user_id % 7)::INTEGER AS dow, (user_id % 12 + 1)::INTEGER AS mon, user_id % 6 AS k FROM events),
n AS (SELECT *, (h + 19) % 24 AS lh, h < 5 AS before FROM u),
t AS (SELECT *, 'at ' || (CASE WHEN lh % 12 = 0 THEN 12 ELSE lh % 12 END) || ':' || lpad(mi::VARCHAR, 2, '0') || CASE WHEN lh < 12 THEN ' AM' ELSE ' PM' END AS time, dom || CASE WHEN dom IN (1, 21) THEN 'st' WHEN dom IN (2, 22) THEN 'nd' WHEN dom IN (3, 23) THEN 'rd' ELSE 'th' END AS nth,
  ['Sundays', 'Mondays', 'Tuesdays', 'Wednesdays', 'Thursdays', 'Fridays', 'Saturdays'][dow + 1] AS days FROM n)
SELECT id, CASE k WHEN 0 THEN 'daily ' || time WHEN 1 THEN days || ' ' || time || CASE WHEN before THEN ' (the evening before, local)' ELSE '' END WHEN 2 THEN 'monthly on the ' || nth || ' ' || time || CASE WHEN before THEN ' (the evening before, local)' ELSE '' END
  WHEN 3 THEN 'hourly at :' || lpad(mi::VARCHAR, 2, '0') WHEN 4 THEN '4 times a day' ELSE 'monthly on the ' || nth || ' or ' || days || ' ' || time || CASE WHEN before THEN ' (the evening before, local)' ELSE '' END END AS words FROM t""")
def described_schedules(spark, d):
    """A schedule a user, of six kinds, with minutes, hours and days from its number; winter time in New York."""
    k = F.col("user_id")
    text = lambda c: c.cast("string")
    minute, hour, dom, dow = text(k % 60), text(k % 24), text(k % 28 + 1), F.element_at(F.array(*map(F.lit, ("SUN", "mon", "2", "wed", "THU", "5", "6"))), (k % 7 + 1).cast("int"))
    star = F.lit("*")
    kinds = [(minute, hour, star, star, star), (minute, hour, star, star, dow), (minute, hour, dom, star, star), (minute, star, star, star, star), (minute, F.lit("1,7-9/2,20"), star, star, star), (minute, hour, dom, F.lit("1-12"), dow)]
    expr = F.coalesce(*[F.when(k % 6 == n, F.concat_ws(" ", *fields)) for n, fields in enumerate(kinds)])
    asked = table(spark, d, "events").select("user_id").distinct().select(k.alias("id"), jobs.cron_fields(expr).alias("f")).select("id", "f.*")
    return jobs.described(asked, "America/New_York", "2024-01-10 00:00:00").select("id", "words")


@query("""SELECT DISTINCT user_id AS id, CASE WHEN user_id % 9 = 0 THEN NULL ELSE (user_id % 60) || ' ' || (user_id % 24) || ' ' || (user_id % 5 + 1) || ',' || (user_id % 5 + 3) || ',' || (user_id % 5 + 5) || ' ' || (user_id % 12 + 1) || ' 0,1' END AS fields FROM events""")
def parsed_schedules(spark, d):
    """Schedules with steps, names and both Sundays, parsed where they stand; every ninth is none."""
    k = F.col("user_id")
    text = lambda c: c.cast("string")
    months = F.element_at(F.array(*map(F.lit, jobs.MONTH_NAMES)), (k % 12 + 1).cast("int"))
    days = F.concat(text(k % 5 + 1), F.lit("-"), text(k % 5 + 5), F.lit("/2"))
    expr = F.concat_ws(" ", text(k % 60), F.when(k % 9 == 0, "25").otherwise(text(k % 24)), days, months, F.lit("mon,7"))
    asked = table(spark, d, "events").select("user_id").distinct().select(k.alias("id"), jobs.cron_fields(expr).alias("f"))
    joined = F.concat_ws(" ", *[F.array_join(F.col(f"f.{c}").cast("array<string>"), ",") for c in ("minutes", "hours", "doms", "months", "dows")])
    return asked.select("id", F.when(F.col("f").isNotNull(), joined).alias("fields"))
