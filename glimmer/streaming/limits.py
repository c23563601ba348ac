"""Sliding-window rate limits: per key, several (count, seconds) bounds; a refused event is not recorded."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds by kind of request. Fixed values.
LIMITS = {"login": [(5, 60.0), (20, 3600.0)], "ingest": [(3, 3600.0)], "query": [(10, 60.0)], "general": [(600, 60.0)]}


def _wait(seen: list[float], t: float, limits: list[tuple[int, float]]) -> float:
    """Seconds until an event at t is allowed, after the recorded times ``seen``; 0 if it is."""
    wait = 0.0
    for count, window in limits:
        recent = len(seen) - bisect.bisect_right(seen, t - window)
        if recent >= count:
            wait = max(wait, seen[-count] + window - t)
    return wait


def decide(events: DataFrame, key: str, seconds: str, tie: str, limits: list[tuple[int, float]]) -> DataFrame:
    """Batch form: (key, tie, wait); wait is null for an allowed event, else whole seconds, at least one.

    Keys are dealt to tasks and each task's events sorted by key and time, so a task reads them as a stream and carries
    only the last recorded times of the key at hand, as many as the largest count: a hot key costs time, not memory."""
    most = max(c for c, _ in limits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = object(), []
        for batch in batches:
            waits = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != at:
                    at, seen = k, []
                wait = _wait(seen, t, limits)
                if wait > 0:
                    waits.append(max(1.0, float(math.ceil(wait))))
                else:
                    seen = [*seen[-most + 1 :], t] if most > 1 else [t]
                    waits.append(None)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(waits, pa.float64())], names=[key, tie, "wait"])

    types = dict(events.dtypes)
    rows = events.select(F.col(key), F.col(seconds).cast("double").alias("__t"), F.col(tie)).filter(F.col("__t").isNotNull())
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "__t", tie)
    return ordered.mapInArrow(task, f"`{key}` {types[key]}, `{tie}` {types[tie]}, wait double")


def make_processor(limits: list[tuple[int, float]], expire: bool = True):
    """Streaming form for transformWithStateInPandas: input (key, tie, t), output (key, tie, wait).

    The state is the list of recorded times inside the longest window. With ``expire`` it goes when a key has had no
    event for twice that window of processing time, so idle keys leave the store."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    longest = max(w for _, w in limits)

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.seen = handle.getListState("seen", "t double", ttlDurationMs=int(2000 * longest) if expire else None)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            seen = sorted(x[0] for x in self.seen.get())
            data = pd.concat(list(rows)).sort_values(["t", "tie"])
            out = []
            for t, tie in zip(data["t"], data["tie"]):
                seen = seen[bisect.bisect_right(seen, t - longest) :]
                wait = _wait(seen, t, limits)
                if wait > 0:
                    out.append((key[0], tie, max(1.0, float(math.ceil(wait)))))
                else:
                    seen.append(t)
                    out.append((key[0], tie, None))
            self.seen.put([(s,) for s in seen])
            yield pd.DataFrame(out, columns=["key", "tie", "wait"])

        def close(self) -> None:
            pass

    return Limiter()


def limit_stream(events: DataFrame, limits: list[tuple[int, float]], expire: bool = True) -> DataFrame:
    """events(key, tie, t) as a stream. State that expires makes Spark plan batches for ever, so a run that is to end by
    itself (``availableNow``) goes without."""
    return events.groupBy("key").transformWithStateInPandas(make_processor(limits, expire), "key long, tie long, wait double", "Append", "ProcessingTime" if expire else "none")


def active_cap(requests: DataFrame, key: str, start: str, stop: str, tie: str, most: int = 2) -> DataFrame:
    """Concurrency cap: requests with a start and a stop time; one is refused (``admitted`` false) while ``most``
    admitted ones of its key are active. Read as a sorted stream, as in ``decide``; null times never start."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, active = object(), []
        for batch in batches:
            out = []
            for k, a, z in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != at:
                    at, active = k, []
                active = [x for x in active if x > a]
                out.append(len(active) < most)
                if out[-1]:
                    active.append(z)
            yield pa.record_batch([batch.column(0), batch.column(3), pa.array(out, pa.bool_())], names=[key, tie, "admitted"])

    types = dict(requests.dtypes)
    rows = requests.select(F.col(key), F.col(start).cast("double").alias("__a"), F.col(stop).cast("double").alias("__z"), F.col(tie)).filter("__a is not null and __z is not null")
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "__a", tie).mapInArrow(task, f"`{key}` {types[key]}, `{tie}` {types[tie]}, admitted boolean")


def progress_stream(updates: DataFrame, key: str, time: str, state: str, terminal: tuple[str, ...] = ("ready", "failed"), expire: bool = True) -> DataFrame:
    """Change detection over a stream of status rows: (key, state, seen_at) whenever a key's state differs from the one
    before; after a terminal state a key is silent. With ``expire``, a key's state goes after a week without a row."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Progress(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "state string", ttlDurationMs=7 * 86_400_000 if expire else None)

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last = self.last.get()[0] if self.last.exists() else None
            out = []
            for now, at in pd.concat(list(rows)).sort_values(["seen_at", "state"])[["state", "seen_at"]].itertuples(index=False):
                if last in terminal:
                    break
                if now != last:
                    last = now
                    out.append((k[0], now, at))
            if last is not None:
                self.last.update((last,))
            yield pd.DataFrame(out, columns=["key", "state", "seen_at"])

        def close(self) -> None:
            pass

    rows = updates.select(F.col(key).cast("long").alias("key"), F.col(state).alias("state"), F.col(time).cast("double").alias("seen_at"))
    return rows.groupBy("key").transformWithStateInPandas(Progress(), "key long, state string, seen_at double", "Append", "ProcessingTime" if expire else "none")


def staged_answers(questions: DataFrame, answer, sink, checkpoint: str | None = None):
    """Staged query stream: for every micro-batch of questions ``answer(batch)`` gives the selected rows, and ``sink``
    receives (stage, rows) for started, selected and done, or error with the failure's text; a failed batch does not
    end the stream. Returns the running query."""

    def each(batch: DataFrame, _: int) -> None:
        sink("started", batch)
        try:
            rows = answer(batch)
            sink("selected", rows)
        except Exception as e:  # noqa: BLE001 - the stream reports any failure of a batch and goes on
            sink("error", batch.withColumn("error", F.lit(str(e))))
        else:
            sink("done", batch)

    writer = questions.writeStream.foreachBatch(each)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def windowed_counts(events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """An extension: tumbling or sliding counts and sums over an event-time stream with a watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """An extension: sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def changes(events: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """Batch change detection: rows whose columns differ from the key's row before."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(time)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return events.withColumn("__same", same & (F.row_number().over(w) > 1)).filter("not __same").drop("__same")
