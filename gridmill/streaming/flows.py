"""Flows over time, as streams and, where order decides, as windows over a finished table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# -- token streams ----------------------------------------------------------

TOKENS = "request_id long, seq int, token string, logprob double, char_offset int, finish_reason string"
STATE = "buffer string, seq int, char_offset int"
#: Fixed value: what an event stream ends with.
LAST_LINE = "data: [DONE]"


def tokens_of_line(line: str) -> tuple[list[tuple[str, float | None]], str | None]:
    """Tokens and finish reason of one line of an event stream."""
    if not line.startswith("data: ") or (body := line[6:].strip()) in ("", "[DONE]"):
        return [], None
    try:
        choice = json.loads(body)["choices"][0]
    except (ValueError, KeyError, IndexError, TypeError):
        return [], None
    listed = (choice.get("logprobs") or {}).get("content") or []
    if listed:
        number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
        found = [(x.get("token") or "", number(x.get("logprob"))) for x in listed]
    else:
        found = [((choice.get("delta") or {}).get("content") or "", None)]
    return [x for x in found if x[0]], choice.get("finish_reason") or None


def with_timers(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose streams keep state that timers and lifetimes can end: they need the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows


class TokenReader(StatefulProcessor):
    """A request's open line, count and offset, until its stream says that it ends or nothing has come for ``idle`` seconds."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        buffer, seq, offset = self.open.get() if self.open.exists() else ("", 0, 0)
        out, ended = [], False
        for chunk in pd.concat(list(rows)).sort_values("chunk_no")["chunk"]:
            *done, buffer = (buffer + chunk).split("\n")
            for line in done:
                ended = ended or line.strip() == LAST_LINE
                found, reason = tokens_of_line(line)
                for token, logprob in found:
                    out.append((key[0], seq, token, logprob, offset, None))
                    seq, offset = seq + 1, offset + len(token)
                if reason:
                    out.append((key[0], seq, None, None, offset, reason))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if ended:
            self.open.clear()
        else:
            self.open.update((buffer, seq, offset))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + round(self.idle * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOKENS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield from ()

    def close(self) -> None:
        pass


def read_tokens(chunks: DataFrame, idle: float = 600.0) -> DataFrame:
    """Token rows of streams that arrive in chunks (request_id, chunk_no, chunk): state keeps a request's open line, count and offset.

    A line counts once its end has come, so a last line without one is dropped. A row without a token carries a finish reason.
    A request's state ends with the stream's last line, or when none of its chunks has come for ``idle`` seconds; what comes
    after is a new stream.
    """
    return with_timers(chunks).groupBy("request_id").transformWithStateInPandas(TokenReader(idle), TOKENS, "append", "processingTime")


# -- progress, feeds --------------------------------------------------------


def progress(events: DataFrame) -> DataFrame:
    """The furthest page of each session (session_id, run_id, current, total), of its newest run only; a stale run's events count for nothing."""
    newest = F.max(F.struct("run_id", "current", "total"))
    return events.groupBy("session_id").agg(newest.alias("m")).select("session_id", "m.run_id", "m.current", "m.total")


def after_changes(sessions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open sessions (session_id, seq) after change events (seq, kind, session_id), and one row ``due``: whether a refresh is.

    The latest event of a session decides; 'delete_all' ends all before it. A refresh is due if what was open went, or if
    something else was updated than the session that leads already.
    """
    end = changes.agg(F.max(F.when(F.col("kind") == "delete_all", F.col("seq"))).alias("_end"))
    last = changes.filter("kind != 'delete_all'").groupBy("session_id").agg(F.max(F.struct("seq", "kind")).alias("e")).select("session_id", "e.seq", "e.kind")
    known = sessions.withColumn("kind", F.lit("update")).select("session_id", "seq", "kind")
    newest = known.unionByName(last).groupBy("session_id").agg(F.max(F.struct("seq", "kind")).alias("e")).select("session_id", "e.seq", "e.kind")
    open_ = newest.join(end, F.col("_end").isNull() | (F.col("seq") > F.col("_end"))).filter("kind = 'update'").select("session_id", "seq")  # ``end`` is one row
    leader = sessions.agg(F.max_by("session_id", "seq").alias("_leader"), F.count("*").alias("_n"))
    gone = changes.filter("kind = 'delete'").join(sessions.select("session_id"), "session_id", "left_semi").agg((F.count("*") > 0).alias("_gone"))
    moved = changes.join(leader).agg(F.coalesce(F.bool_or((F.col("kind") == "update") & ~F.col("session_id").eqNullSafe(F.col("_leader")) | (F.col("kind") == "delete_all") & (F.col("_n") > 0)), F.lit(False)).alias("_moved"))
    return open_, gone.join(moved).select((F.col("_gone") | F.col("_moved")).alias("due"))


def watch_feed(events: DataFrame, on_change: Callable[[DataFrame], None], folder: str) -> StreamingQuery:
    """Keeps the open sessions of a change feed (seq, kind, session_id), and calls back with them when a refresh is due. A batch is one round of changes.

    The sessions after each batch lie in ``folder``, under the batch's number, beside the checkpoint: a restart goes on from
    there, and a batch that runs again reads and writes the same places.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fields = "session_id string, seq long"
        known = spark.read.schema(fields).parquet(f"{folder}/open/{number - 1}") if number else spark.createDataFrame([], fields)
        open_, due = after_changes(known, batch.select(F.col("seq").cast("long"), "kind", F.col("session_id").cast("string")))
        open_.write.mode("overwrite").parquet(f"{folder}/open/{number}")
        if due.first()[0]:
            on_change(spark.read.schema(fields).parquet(f"{folder}/open/{number}"))

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def uncancelled(pages: DataFrame, runs: DataFrame, cancels: DataFrame) -> DataFrame:
    """Pages (session_id, run_id, at) that were done before a cancel of their run: the first of the session (session_id, at) after the run began.

    Runs: session_id, run_id, started. A cancel counts for runs that had begun, never for a later one.
    """
    ends = runs.join(cancels.select("session_id", F.col("at").alias("_at")), "session_id").filter("_at > started").groupBy("session_id", "run_id").agg(F.min("_at").alias("_end"))
    return pages.join(ends, ["session_id", "run_id"], "left").filter(F.col("_end").isNull() | (F.col("at") < F.col("_end"))).drop("_end")


def uncancelled_stream(pages: DataFrame, cancels: DataFrame, longest: str, late: str) -> DataFrame:
    """``uncancelled`` of running streams: pages (session_id, run_id, started, at) and cancels (session_id, at), each in any order up to ``late``.

    A page passes once no cancel of its run can come any more: none between the start of its run and itself. State is kept for
    ``longest``, the longest that a run may last, and ``late``; a cancel that comes later than ``late`` is not heard.
    """
    p = pages.withWatermark("at", late)
    c = cancels.select(F.col("session_id").alias("_session"), F.col("at").alias("_cancelled")).withWatermark("_cancelled", late)
    meets = F.expr(f"session_id = _session and _cancelled > started and _cancelled <= at and _cancelled >= at - interval {longest}")
    return p.join(c, meets, "left_outer").filter("_session is null").drop("_session", "_cancelled")


def idle_unloads(jobs: DataFrame, key: str, idle: int = 90) -> DataFrame:
    """``at``: when a warm server of each key was given up, ``idle`` after the end of a job (key, start, end; seconds) with none begun until then."""
    order = Window.partitionBy(key).orderBy("start", "end")
    busy_until = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.lead("start").over(order)
    return jobs.select(key, busy_until.alias("_end"), after.alias("_next")).filter(F.col("_next").isNull() | (F.col("_next") > F.col("_end") + idle)).select(key, (F.col("_end") + idle).alias("at"))


def readiness(polls: DataFrame, key: str, limit: int = 180) -> DataFrame:
    """``state`` and ``at`` of each start (key, t in seconds since, status): 'ready' or 'exited' by the first poll that says so within the limit, else 'timeout'."""
    first = F.min(F.when((F.col("t") < limit) & F.col("status").isin("healthy", "exited"), F.struct("t", "status"))).alias("f")
    found = polls.groupBy(key).agg(first)
    state = F.when(F.col("f").isNull(), "timeout").when(F.col("f.status") == "exited", "exited").otherwise("ready")
    return found.select(key, state.alias("state"), F.coalesce(F.col("f.t"), F.lit(limit)).alias("at"))


def debounced_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """The end of each burst of a key (key, ts, value) with a quiet ``gap`` after it: session windows under a watermark."""
    burst = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap))
    return burst.agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n")).select("key", F.col("session_window.start").alias("start"), "value", "n")


def windowed_counts(events: DataFrame, size: str, slide: str | None, late: str) -> DataFrame:
    """Counts and sums by event time in tumbling or sliding windows, each event once. An addition of our own."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class Throttle(StatefulProcessor):
    """When a key's last event was let through; forgotten ``idle`` seconds after the key's last event."""

    def __init__(self, least: float, idle: float):
        self.least, self.idle = least, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double", ttlDurationMs=round(self.idle * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, kept = (self.last.get()[0] if self.last.exists() else None), []
        for row in pd.concat(list(rows)).sort_values("t").itertuples(index=False):
            if last is None or row.t - last >= self.least:
                kept.append((key[0], row.t, row.value))
                last = row.t
        self.last.update((last,))
        yield pd.DataFrame(kept, columns=["key", "t", "value"])

    def close(self) -> None:
        pass


def throttled_stream(events: DataFrame, least: float, idle: float = 3600.0) -> DataFrame:
    """Events (key, t, value; seconds) that come ``least`` seconds or more after the one before that was let through. A key of which nothing came for ``idle`` seconds, which must be more than ``least``, begins anew."""
    if idle <= least:
        raise ValueError("a key must be remembered for longer than it is held back")
    return with_timers(events).groupBy("key").transformWithStateInPandas(Throttle(least, idle), "key long, t double, value double", "append", "processingTime")


# -- the same over finished tables ------------------------------------------


def debounced(events: DataFrame, key: str, at: Column, gap: int, tie: str) -> DataFrame:
    """Events with nothing of their key within ``gap`` after them."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    return events.withColumn("_after", after - at).filter(F.col("_after").isNull() | (F.col("_after") > gap)).drop("_after")


def throughput(samples: DataFrame, key: str, window: int, least_span: int) -> DataFrame:
    """``rate`` at each sample (key, t, done): growth over the trailing window, of two samples at least; where the span is too short or nothing grew, the last rate stays."""
    order = Window.partitionBy(key).orderBy("t")
    first = F.min(F.struct("t", "done")).over(order.rangeBetween(-window, 0))
    before = F.lag(F.struct("t", "done")).over(order)
    start = F.when(first["t"] == F.col("t"), F.coalesce(before, first)).otherwise(first)
    with_start = samples.withColumn("_s", start)
    span, grown = F.col("t") - F.col("_s.t"), F.col("done") - F.col("_s.done")
    fresh = F.when((span >= least_span) & (grown > 0), grown / span)
    return with_start.withColumn("_fresh", fresh).withColumn("rate", F.last("_fresh", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_fresh")


def eta(rate: Column, done: Column, total: Column) -> Column:
    """Whole seconds that are left, one at least; 0 once all is there, null while no rate is known."""
    left = total - done
    return F.when(left <= 0, F.lit(0)).when(rate > 0, F.greatest(F.lit(1), F.round(left / rate))).cast("long")


def weighted_progress(parts: DataFrame, key: str) -> DataFrame:
    """``percent`` of the bytes of all parts (bytes, got, status); what is done or skipped counts in full."""
    full = F.when(F.col("status").isin("done", "skipped"), F.col("bytes")).otherwise(F.least("got", "bytes"))
    return parts.groupBy(key).agg(F.round(F.coalesce(F.sum(full) * 100.0 / F.sum("bytes"), F.lit(0.0)), 6).alias("percent"))


def throttled(events: DataFrame, key: str, least: float) -> DataFrame:
    """As ``throttled_stream``, over a finished table (key, t): events stream by in order of key and time, and only the last that was let through is held."""
    kind = dict(events.dtypes)[key]
    schema = pa.schema([(key, pa.null()), ("t", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, begun = None, 0.0, False
        for b in batches:
            keys, t, kept = b.column(0).to_pylist(), b.column(1).to_numpy(), []
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for start, end in zip([0, *ends], [*ends, len(keys)], strict=True) if keys else ():
                at = start
                if not begun or keys[start] != own:
                    own, last, begun = keys[start], t[start], True
                    kept.append(start)
                while (at := at + int(np.searchsorted(t[at:end], last + least - 1e-6))) < end:
                    if t[at] - last >= least:
                        kept.append(at)
                        last = t[at]
                    at += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(t[kept], pa.float64())], names=schema.names)

    rows = events.select(key, F.col("t").cast("double").alias("t")).repartition(F.col(key)).sortWithinPartitions(key, "t")
    return rows.mapInArrow(run, f"{key} {kind}, t double")


def newest_only(results: DataFrame, key: str, request: str) -> DataFrame:
    """Results of each key's newest request; older ones came too late to be shown."""
    return results.withColumn("_newest", F.max(request).over(Window.partitionBy(key))).filter(F.col(request) == F.col("_newest")).drop("_newest")
