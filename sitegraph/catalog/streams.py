"""Queries: the streaming operators, run to the end of the given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.catalog import query
from sitegraph.catalog.history import STATE_ROWS, state_rows, state_sql, stamp, with_events
from sitegraph.catalog.tables import FETCH_EVENTS_SQL, as_fetch_events, table
from sitegraph.session import run_folder
from sitegraph.sources.sinks import custom_output
from sitegraph.streaming import history as H


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return as_fetch_events(files.parquet(sf))


def _finish(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("link_state_stream", with_events(STATE_ROWS + "state", state_sql("fetch_events")))
def _link_state_stream(spark, sf):
    root = run_folder(spark, "stream")
    _finish(H.link_state_stream(_stream(spark, sf), f"{root}/state", f"{root}/checkpoint"))
    return state_rows(H.read_states(spark, f"{root}/state"))


@query("link_state_updates", with_events(STATE_ROWS + "state", state_sql("fetch_events")))
def _link_state_updates(spark, sf):
    root = run_folder(spark, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    updates = H.link_states(_stream(spark, sf))
    _finish(custom_output(updates, save, f"{root}/checkpoint").outputMode("update"))
    rows = spark.read.parquet(f"{root}/out")
    latest = rows.groupBy("url").agg(F.max_by(F.struct(*rows.columns[1:]), "batch").alias("s")).select("url", "s.*")
    return state_rows(latest)


@query("status_stream", with_events("""
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) FILTER (kind = 'start') AS started,
      count(*) FILTER (kind = 'end' AND status_code = '') AS succeeded, count(*) FILTER (kind = 'end' AND status_code <> '') AS failed
    FROM fetch_events GROUP BY 1"""))
def _status_stream(spark, sf):
    root = run_folder(spark, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    _finish(custom_output(H.status_stream(_stream(spark, sf), "1 hour"), save, f"{root}/checkpoint").outputMode("update"))
    rows = spark.read.parquet(f"{root}/out")
    latest = rows.groupBy("at").agg(F.max_by(F.struct("started", "succeeded", "failed"), "batch").alias("s"))
    return latest.select(F.date_format("at", "yyyy-MM-dd HH").alias("hour"), "s.*")


@query("revisit_stream", "WITH RECURSIVE " + FETCH_EVENTS_SQL + """,
    due(url, ts) AS (
      SELECT url, min(ts) FROM fetch_events GROUP BY url UNION
      SELECT d.url, min(e.ts) FROM due d JOIN fetch_events e ON e.url = d.url AND e.ts > d.ts + INTERVAL 86400 SECOND GROUP BY d.url, d.ts)
    SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS due FROM due""")
def _revisit_stream(spark, sf):
    root = run_folder(spark, "stream")
    due = H.revisit_stream(_stream(spark, sf), 86400)
    _finish(due.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint"))
    return spark.read.schema("url STRING, ts TIMESTAMP").parquet(f"{root}/out").select("url", stamp("ts").alias("due"))


@query("write_products_stream", with_events("SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen FROM fetch_events WHERE kind = 'end' AND status_code = ''"))
def _write_products_stream(spark, sf):
    root = run_folder(spark, "stream")
    products = _stream(spark, sf).filter("kind = 'end' AND status_code = ''").select("url", stamp("ts").alias("seen"))
    _finish(H.write_products_stream(products, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.schema("url STRING, seen STRING").json(f"{root}/out")


@query("custom_output", with_events("SELECT status_code, count(*) AS n FROM fetch_events GROUP BY status_code"))
def _custom_output(spark, sf):
    root = run_folder(spark, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy("status_code").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    _finish(custom_output(_stream(spark, sf), save, f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").groupBy("status_code").agg(F.sum("n").alias("n"))
