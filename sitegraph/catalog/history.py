"""Queries: link history and visit decisions.

``now`` is the instant of the cut: the log up to it makes the state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.tables import FETCH_EVENTS_SQL, fetch_events
from sitegraph.operators import linkstate as S

NOW = "2024-01-15 12:00:00"
MIDDLE = "2024-01-08 00:00:00"
POLICY = S.Policy(max_failed=3, timeout=259_200, retry=43_200)
INTERVAL = 86_400


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def state_sql(source: str, name: str = "state") -> str:
    return f"""
    {name} AS (
      SELECT url, max(ts) FILTER (kind = 'start') AS last_start_ts, max(ts) FILTER (kind = 'end') AS last_end_ts,
        coalesce(arg_max(status_code, ts) FILTER (kind = 'end'), '') AS last_status_code,
        count(*) FILTER (kind = 'end' AND status_code <> '' AND ts > coalesce(ok, TIMESTAMP '1900-01-01')) AS failed_cnt
      FROM (SELECT *, max(CASE WHEN kind = 'end' AND status_code = '' THEN ts END) OVER (PARTITION BY url) AS ok FROM {source})
      GROUP BY url)"""


_STAMPED = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
STATE_ROWS = ("SELECT url, " + _STAMPED.format("last_start_ts") + ", " + _STAMPED.format("last_end_ts")
              + ", last_status_code, failed_cnt FROM ")
_UPTO = f"past AS (SELECT * FROM fetch_events WHERE ts <= TIMESTAMP '{NOW}')"
_DECISION = f"""
decided AS (
  SELECT *, CASE WHEN failed_cnt > 3 THEN 'drop_failed' WHEN last_start_ts IS NULL THEN 'start_new'
    WHEN last_status_code = '' AND last_end_ts IS NOT NULL THEN CASE WHEN age > {INTERVAL} THEN 'revisit' ELSE 'skip_fresh' END
    WHEN last_status_code = '' THEN CASE WHEN running > {POLICY.timeout} THEN 'restart_timeout' ELSE 'defer_running' END
    WHEN age > 2 ** failed_cnt * {POLICY.retry} THEN 'retry' ELSE 'defer_retry' END AS decision
  FROM (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_end_ts)) / 1e6 AS age,
               (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_start_ts)) / 1e6 AS running FROM state))
"""


def with_events(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([FETCH_EVENTS_SQL, *parts]) + "\n" + select


def state_rows(state):
    return state.select("url", stamp("last_start_ts").alias("last_start_ts"), stamp("last_end_ts").alias("last_end_ts"),
                        "last_status_code", F.col("failed_cnt").cast("bigint"))


def past(spark, sf):
    return fetch_events(spark, sf).filter(F.col("ts") <= now())


def past_state(spark, sf):
    return S.link_state_fold(past(spark, sf))


@query("link_state_fold", with_events(STATE_ROWS + "state", state_sql("fetch_events")))
def _link_state_fold(spark, sf):
    return state_rows(S.link_state_fold(fetch_events(spark, sf)))


@query("link_status", with_events("""
    SELECT a.event_id, a.url, strftime(coalesce(last_start_ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS last_start_ts,
      strftime(coalesce(last_end_ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS last_end_ts,
      coalesce(last_status_code, '') AS last_status_code, coalesce(failed_cnt, 0) AS failed_cnt
    FROM (SELECT event_id, 'https://shop.example/item/' || user_id || '-' || (event_id % 9) AS url FROM events) a
    LEFT JOIN state s ON s.url = a.url""", _UPTO, state_sql("past")))
def _link_status(spark, sf):
    from sitegraph.catalog.tables import table

    asked = table(spark, sf, "events").select("event_id", F.concat(
        F.lit("https://shop.example/item/"), F.col("user_id").cast("string"), F.lit("-"),
        (F.col("event_id") % 9).cast("string")).alias("url"))
    status = S.link_status(asked, past_state(spark, sf))
    # epoch zero stands for "never"; written in UTC whatever the session's zone
    def text(c):
        return F.when(F.unix_micros(c) == 0, "1970-01-01 00:00:00.000000").otherwise(stamp(c)).alias(c)

    return status.select("event_id", "url", text("last_start_ts"), text("last_end_ts"), "last_status_code",
                         F.col("failed_cnt").cast("bigint").alias("failed_cnt"))


_HALVES = (f"early AS (SELECT * FROM fetch_events WHERE ts <= TIMESTAMP '{MIDDLE}')",
           f"late AS (SELECT * FROM fetch_events WHERE ts > TIMESTAMP '{MIDDLE}')")


def _halves(spark, sf):
    e = fetch_events(spark, sf)
    cut = F.lit(MIDDLE).cast("timestamp")
    return S.link_state_fold(e.filter(F.col("ts") <= cut)), e.filter(F.col("ts") > cut)


@query("mark_started", with_events(STATE_ROWS + "merged", *_HALVES, state_sql("early"), """
    merged AS (SELECT coalesce(s.url, l.url) AS url, coalesce(l.ts, s.last_start_ts) AS last_start_ts, s.last_end_ts,
      coalesce(s.last_status_code, '') AS last_status_code, coalesce(s.failed_cnt, 0) AS failed_cnt
      FROM state s FULL JOIN (SELECT url, max(ts) AS ts FROM late WHERE kind = 'start' GROUP BY url) l ON l.url = s.url)"""))
def _mark_started(spark, sf):
    state, late = _halves(spark, sf)
    return state_rows(S.mark_started(state, late.filter("kind = 'start'").select("url", "ts")))


@query("mark_ended", with_events(STATE_ROWS + "state", *_HALVES, """
    joined AS (SELECT * FROM early UNION ALL SELECT * FROM late WHERE kind = 'end')""", state_sql("joined")))
def _mark_ended(spark, sf):
    state, late = _halves(spark, sf)
    return state_rows(S.mark_ended(state, late.filter("kind = 'end'").select("url", "ts", "status_code")))


@query("merge_events", with_events(STATE_ROWS + "state", state_sql("fetch_events")))
def _merge_events(spark, sf):
    state, late = _halves(spark, sf)
    return state_rows(S.merge_events(state, late))


@query("visit_decision", with_events("SELECT url, decision FROM decided", _UPTO, state_sql("past"), _DECISION))
def _visit_decision(spark, sf):
    decision = S.visit_decision(now(), F.lit(INTERVAL), POLICY)
    return past_state(spark, sf).select("url", decision.alias("decision"))


@query("decide", with_events("""
    SELECT t.event_id, t.url, coalesce(d.decision, 'start_new') AS decision FROM (SELECT event_id, 'https://shop.example/item/' || user_id || '-' || (event_id % 9) AS url FROM events) t
    LEFT JOIN decided d ON d.url = t.url""", _UPTO, state_sql("past"), _DECISION))
def _decide(spark, sf):
    from sitegraph.catalog.tables import table

    tasks = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("https://shop.example/item/"), F.col("user_id").cast("string"), F.lit("-"),
                             (F.col("event_id") % 9).cast("string")).alias("url"),
        F.lit(INTERVAL).cast("bigint").alias("revisit_interval"))
    return S.decide(tasks, past_state(spark, sf), now(), POLICY).select("event_id", "url", "decision")


def _due(condition: str) -> str:
    return with_events(f"SELECT url FROM decided WHERE {condition}", _UPTO, state_sql("past"), _DECISION)


@query("revisit_due", _due(f"age > {INTERVAL}"))
def _revisit_due(spark, sf):
    return past_state(spark, sf).filter(S.revisit_due(now(), F.lit(INTERVAL))).select("url")


@query("retry_due", _due(f"age > 2 ** failed_cnt * {POLICY.retry}"))
def _retry_due(spark, sf):
    return past_state(spark, sf).filter(S.retry_due(now(), POLICY)).select("url")


@query("timeout_due", _due(f"running > {POLICY.timeout}"))
def _timeout_due(spark, sf):
    return past_state(spark, sf).filter(S.timeout_due(now(), POLICY)).select("url")


@query("give_up", _due("failed_cnt > 3"))
def _give_up(spark, sf):
    return past_state(spark, sf).filter(S.give_up(POLICY)).select("url")


@query("link_counters", with_events("""
    SELECT count(*) FILTER (kind = 'start') AS started, count(*) FILTER (kind = 'end' AND status_code = '') AS succeeded,
      count(*) FILTER (kind = 'end' AND status_code <> '') AS failed FROM fetch_events"""))
def _link_counters(spark, sf):
    return S.link_counters(fetch_events(spark, sf))
