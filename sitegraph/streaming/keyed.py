"""Keyed state of links in Spark's state store: history, and revisits with event-time timers.

Rows of a batch are combined by (URL, second or time) inside the tasks that read them, so
a URL that owns half of all rows sends its distinct times only. State lives in RocksDB.
A call of Python per URL costs tens of milliseconds, so link history is kept by buckets
of URLs, each folded as columns; a batch touches the buckets of its own URLs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitegraph.schemas import LINK_STATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: rows a task combines before it sends them on
COMBINED = 1 << 16


def state_store(spark: SparkSession) -> None:
    """Keyed state needs the store that knows several columns and timers; it is the session's setting."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _combined(by: list[str], how: dict[str, str]):
    """Batches with equal keys put together: what a task has read so far, sent on when it is much."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # texts go by the numbers of their order: pandas takes the greatest of numbers much faster
            code, names = pd.factorize(rows["status"], sort=True)
            held = rows.assign(status=code).groupby(by, as_index=False, sort=False).agg(how)
            held["status"] = np.asarray(names, dtype=object)[held["status"]]
            if len(held) > COMBINED:
                yield held
                held = None
        if held is not None and len(held):
            yield held

    return run


#: groups of URLs that share a state, by the URL's hash; part of a checkpoint's layout
BUCKETS = 4096
#: the time of what has not been yet, among times in microseconds
_NEVER = -(1 << 63)
_LINK = "url STRING, started BIGINT, ended BIGINT, status STRING, failed INT"
_LINKS = "url ARRAY<STRING>, started ARRAY<BIGINT>, ended ARRAY<BIGINT>, status ARRAY<STRING>, failed ARRAY<BIGINT>"


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per URL: last times, and the greatest status of its last end."""
    last = rows["ended"] == rows.groupby("url", sort=False)["ended"].transform("max")
    code, names = pd.factorize(rows["status"].where(last, ""), sort=True)
    found = rows.assign(status=code).groupby("url", as_index=False, sort=False).max()
    return found.assign(status=np.asarray(names, dtype=object)[found["status"]])


def _history(key: tuple, chunks: Iterator[pd.DataFrame], links: GroupState) -> Iterator[pd.DataFrame]:
    """Last start, last end, last status and failures in a row of the URLs of a bucket."""
    # chunks come in any order: only what can be combined in any order is kept of them
    new, bad = None, []
    for chunk in chunks:
        at = chunk["at"].to_numpy()
        rows = pd.DataFrame({"url": chunk["url"], "status": chunk["status"], **{
            to: np.where(chunk[c].to_numpy() > 0, at, _NEVER) for c, to in (("starts", "started"), ("ends", "ended"), ("good", "ok"))}})
        new = _newest(rows if new is None else pd.concat([new, rows], ignore_index=True))
        bad.append(chunk.loc[chunk["bad"] > 0, ["url", "at", "bad"]])
    bad, ok = pd.concat(bad, ignore_index=True), new.set_index("url")["ok"]
    bad = bad[bad["at"].to_numpy() > ok.reindex(bad["url"]).to_numpy()].groupby("url")["bad"].sum()
    failed = bad.reindex(new["url"], fill_value=0).to_numpy()
    new = new.assign(fresh=1, failed=failed)
    if links.exists:
        old = pd.DataFrame(dict(zip(("url", "started", "ended", "status", "failed"), links.get, strict=True)))
        before = old.set_index("url")["failed"].reindex(new["url"], fill_value=0).to_numpy()
        new["failed"] += np.where(new["ok"] == _NEVER, before, 0)
        kept = old[~old["url"].isin(new["url"])].assign(ok=_NEVER, fresh=0)
        met = _newest(pd.concat([old.assign(ok=_NEVER, fresh=0, failed=0), new], ignore_index=True))
        new = pd.concat([kept, met[met["fresh"] > 0]], ignore_index=True)
    links.update(tuple(new[c].tolist() for c in ("url", "started", "ended", "status", "failed")))
    new = new[new["fresh"] > 0]
    times = {c: pd.arrays.IntegerArray(new[c].to_numpy(dtype=np.int64), (new[c] == _NEVER).to_numpy()) for c in ("started", "ended")}
    yield new[["url", "started", "ended", "status", "failed"]].assign(**times)


def link_states(events: DataFrame) -> DataFrame:
    """Link state from a stream of fetch events (``url, ts, kind, status_code``): the new
    state of every URL that a batch has events of, and of no other.

    The same fold as ``operators.linkstate.link_state_fold``. Batches follow each other in
    time; inside a batch the order does not matter. Start the query with output mode
    ``update``. Rows without URL or time are passed over.
    """
    state_store(events.sparkSession)
    end = F.col("kind") == "end"
    rows = events.filter("url IS NOT NULL AND ts IS NOT NULL").select(
        "url", F.unix_micros("ts").alias("at"), (F.col("kind") == "start").cast("int").alias("starts"), end.cast("int").alias("ends"),
        (end & (F.col("status_code") == "")).cast("int").alias("good"), (end & (F.col("status_code") != "")).cast("int").alias("bad"),
        F.when(end, F.coalesce("status_code", F.lit(""))).otherwise("").alias("status"))
    shape = "url STRING, at BIGINT, starts INT, ends INT, good INT, bad INT, status STRING"
    combine = _combined(["url", "at"], {"starts": "sum", "ends": "sum", "good": "sum", "bad": "sum", "status": "max"})
    bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS))
    found = rows.mapInPandas(combine, shape).withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _history, _LINK, _LINKS, "update", GroupStateTimeout.NoTimeout)
    return found.select("url", F.timestamp_micros("started").alias("last_start_ts"), F.timestamp_micros("ended").alias("last_end_ts"),
                        F.col("status").alias("last_status_code"), F.col("failed").alias("failed_cnt"))


def link_state_stream(events: DataFrame, root: str, checkpoint: str):
    """Keep link state up to date: each batch adds the states it has changed below ``root``,
    as a part of its own that a repeated batch replaces. Read them with ``read_states``."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return link_states(events).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of every URL."""
    rows = spark.read.schema(f"{LINK_STATE}, batch BIGINT").parquet(root)
    columns = [c for c in rows.columns if c not in ("url", "batch")]
    return rows.groupBy("url").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("url", "s.*")


class _Revisits(StatefulProcessor):
    """The second of a URL's last due task, until no later task can depend on it."""

    def __init__(self, interval: int):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()[0] if self.last.exists() else None
        times = np.unique(np.concatenate([chunk["at"].to_numpy() for chunk in rows]))
        last, found, wait = held, [], self.interval * 1_000_000
        at = 0 if last is None else int(np.searchsorted(times, last + wait, side="right"))
        while at < len(times):
            last = int(times[at])
            found.append(last)
            at = int(np.searchsorted(times, last + wait, side="right"))
        if found:
            if held is not None:
                self.handle.deleteTimer(self._expiry(held))
            self.last.update((last,))
            self.handle.registerTimer(self._expiry(last))
        yield pd.DataFrame({"url": [key[0]] * len(found), "at": np.array(found, dtype=np.int64)})

    def _expiry(self, at: int) -> int:
        """The first millisecond at which a task is due whether the state is there or not."""
        return at // 1000 + self.interval * 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"url": np.array([], dtype=object), "at": np.array([], dtype=np.int64)})

    def close(self) -> None:
        pass


def revisit_stream(tasks: DataFrame, interval: int, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Tasks to visit: a URL is due at its first task, and again at the first one more
    than ``interval`` seconds after the last due one.

    Batches may be cut anywhere; tasks older than the last due one are not due, and those
    more than ``late`` behind the newest are dropped by the watermark. A URL's state goes
    by a timer once the watermark is past its interval: what comes then is due anyway. Of
    equal times one is due. Rows without URL or time are never due. Output mode ``append``.
    """
    state_store(tasks.sparkSession)
    rows = tasks.filter(f"url IS NOT NULL AND {time} IS NOT NULL").select("url", F.col(time).alias("ts")).withWatermark("ts", late)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    found = rows.mapInPandas(combine, "url STRING, ts TIMESTAMP").select("url", "ts", F.unix_micros("ts").alias("at")).groupBy("url")
    found = found.transformWithStateInPandas(statefulProcessor=_Revisits(interval), outputStructType="url STRING, at BIGINT", outputMode="Append", timeMode="EventTime")
    return found.select("url", F.timestamp_micros("at").alias(time))
