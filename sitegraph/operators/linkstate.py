"""Link history: folding fetch events into per-URL state, and what to do next.

A URL may own a large share of all events: raw events are combined by a partial
aggregate before they move, and joins are of a kind that splits a large key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_COLUMNS = ("url", "last_start_ts", "last_end_ts", "last_status_code", "failed_cnt")


@dataclass(frozen=True)
class Policy:
    """Seconds; a link is given up after more than ``max_failed`` failures in a row."""

    max_failed: int = 3
    timeout: int = 30
    retry: int = 10


def link_state_fold(events: DataFrame) -> DataFrame:
    """Event log to state: last start, last end, last status, failures in a row.

    The last times of a URL are a partial aggregate. Failures are combined by
    (URL, time) before they move, meet the URL's last success, one row each, in
    a join that splits large sides, and are counted by a partial aggregate again.
    """
    end = F.col("kind") == "end"
    last = events.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "start", F.col("ts"))).alias("last_start_ts"),
        F.max(F.when(end, F.struct("ts", "status_code"))).alias("last"),
        F.max(F.when(end & (F.col("status_code") == ""), F.col("ts"))).alias("ok_at"))
    failed = events.filter(end & (F.col("status_code") != "")).groupBy("url", "ts").agg(F.count("*").alias("n"))
    since = failed.join(last.select("url", "ok_at"), "url").filter("ok_at IS NULL OR ts > ok_at") \
        .groupBy("url").agg(F.sum("n").cast("int").alias("failed_cnt"))
    return last.join(since, "url", "left").select(
        "url", "last_start_ts", F.col("last.ts").alias("last_end_ts"),
        F.coalesce("last.status_code", F.lit("")).alias("last_status_code"),
        F.coalesce("failed_cnt", F.lit(0)).alias("failed_cnt"))


def link_status(urls: DataFrame, state: DataFrame) -> DataFrame:
    """State of the asked URLs; unknown ones read as never visited.

    A URL asked for many times is looked up once and handed back by a join whose
    small side is one row per URL.
    """
    known = state.join(urls.select("url").distinct(), "url", "left_semi")
    epoch = F.lit(0).cast("timestamp")
    return urls.join(known, "url", "left").select(
        *urls.columns,
        F.coalesce("last_start_ts", epoch).alias("last_start_ts"),
        F.coalesce("last_end_ts", epoch).alias("last_end_ts"),
        F.coalesce("last_status_code", F.lit("")).alias("last_status_code"),
        F.coalesce("failed_cnt", F.lit(0)).alias("failed_cnt"),
    )


def _upsert(state: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
    merged = state.alias("s").join(changes.alias("c"), F.col("s.url") == F.col("c.url"), "full_outer")
    return merged.select(
        F.coalesce("s.url", "c.url").alias("url"),
        *[values.get(c, F.col(f"s.{c}")).alias(c) for c in STATE_COLUMNS[1:]],
    ).withColumns({
        "last_status_code": F.coalesce("last_status_code", F.lit("")),
        "failed_cnt": F.coalesce("failed_cnt", F.lit(0)),
    })


def mark_started(state: DataFrame, started: DataFrame) -> DataFrame:
    """Record starts ``(url, ts)``; end time, status and failures stay."""
    last = started.groupBy("url").agg(F.max("ts").alias("ts"))
    return _upsert(state, last, {"last_start_ts": F.coalesce("c.ts", "s.last_start_ts")})


def mark_ended(state: DataFrame, ended: DataFrame) -> DataFrame:
    """Record ends ``(url, ts, status_code)``: failures add up, a success resets."""
    events = ended.select("url", "ts", F.lit("end").alias("kind"), "status_code")
    fold = link_state_fold(events)
    had_ok = ended.groupBy("url").agg(F.max(F.col("status_code") == "").alias("had_ok"))
    changes = fold.join(had_ok, "url")
    before = F.when(F.col("c.had_ok"), F.lit(0)).otherwise(F.coalesce("s.failed_cnt", F.lit(0)))
    return _upsert(state, changes, {
        "last_end_ts": F.coalesce("c.last_end_ts", "s.last_end_ts"),
        "last_status_code": F.coalesce("c.last_status_code", "s.last_status_code"),
        "failed_cnt": F.when(F.col("c.url").isNull(), F.col("s.failed_cnt"))
        .otherwise(before + F.col("c.failed_cnt")),
    })


def merge_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Fold a later batch of events into the state."""
    starts = events.filter("kind = 'start'").select("url", "ts")
    ends = events.filter("kind = 'end'").select("url", "ts", "status_code")
    return mark_ended(mark_started(state, starts), ends)


def seconds_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(then)) / F.lit(1_000_000)


def revisit_due(now: Column, interval: Column) -> Column:
    """Last success is older than the interval; without an interval never."""
    return F.coalesce((interval > 0) & (seconds_between(now, F.col("last_end_ts")) > interval), F.lit(False))


def retry_due(now: Column, policy: Policy = Policy()) -> Column:
    """Waiting time doubles with every failure in a row."""
    wait = F.pow(F.lit(2.0), F.col("failed_cnt")) * policy.retry
    return F.coalesce(seconds_between(now, F.col("last_end_ts")) > wait, F.lit(False))


def timeout_due(now: Column, policy: Policy = Policy()) -> Column:
    """A fetch that started but never ended counts as lost after the timeout."""
    return F.coalesce(seconds_between(now, F.col("last_start_ts")) > policy.timeout, F.lit(False))


def give_up(policy: Policy = Policy()) -> Column:
    return F.col("failed_cnt") > policy.max_failed


def visit_decision(now: Column, interval: Column, policy: Policy = Policy()) -> Column:
    """One of eight outcomes from the stored state columns; NULL times mean never."""
    never_started = F.col("last_start_ts").isNull()
    clean = F.coalesce("last_status_code", F.lit("")) == ""
    return (
        F.when(F.coalesce(give_up(policy), F.lit(False)), "drop_failed")
        .when(never_started, "start_new")
        .when(clean & F.col("last_end_ts").isNotNull(),
              F.when(revisit_due(now, interval), "revisit").otherwise("skip_fresh"))
        .when(clean, F.when(timeout_due(now, policy), "restart_timeout").otherwise("defer_running"))
        .otherwise(F.when(retry_due(now, policy), "retry").otherwise("defer_retry"))
    )


VISITED_NOW = ("start_new", "revisit", "restart_timeout", "retry")
DEFERRED = ("defer_running", "defer_retry")


def decide(tasks: DataFrame, state: DataFrame, now: Column, policy: Policy = Policy()) -> DataFrame:
    """Tasks with their ``decision``; state is looked up by URL."""
    joined = tasks.join(state.select(*STATE_COLUMNS), "url", "left")
    joined = joined.withColumn("failed_cnt", F.coalesce("failed_cnt", F.lit(0)))
    return joined.withColumn("decision", visit_decision(now, F.col("revisit_interval"), policy)) \
        .select(*tasks.columns, "decision")


def link_counters(events: DataFrame) -> DataFrame:
    ok = (F.col("kind") == "end") & (F.col("status_code") == "")
    bad = (F.col("kind") == "end") & (F.col("status_code") != "")
    return events.agg(
        F.count_if(F.col("kind") == "start").alias("started"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(bad).alias("failed"),
    )
