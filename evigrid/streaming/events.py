"""Event-log operators, as batch plans and as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fusion import keep_first


def progress_fold(events: DataFrame, job: str, stage: str, order: list[str]) -> DataFrame:
    """EVT-01: (job, order, event, stage): done of the last stage and start of the new one, where the stage changes."""
    prev = F.lag(stage).over(Window.partitionBy(job).orderBy(*order))
    rows = events.withColumn("_prev", prev).where(~F.col("_prev").eqNullSafe(F.col(stage)))
    emitted = F.array(F.when(F.col("_prev").isNotNull(), F.struct(F.lit("stage_done").alias("event"), F.col("_prev").alias("stage"))), F.struct(F.lit("stage_start").alias("event"), F.col(stage).alias("stage")))
    return rows.select(job, *order, F.posexplode(F.array_compact(emitted)).alias("step", "_e")).select(job, *order, "step", "_e.event", "_e.stage")


def latest(events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """EVT-04, SNK-12: the last row of each job."""
    return keep_first(events, [job], [F.col(c).desc() for c in order])


def reconcile(jobs: DataFrame) -> DataFrame:
    """EVT-04: what was running at a restart has failed."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def queued(jobs: DataFrame) -> DataFrame:
    """EVT-04: jobs to resume, oldest first."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job")


def replay(events: DataFrame, job: str, order: list[str], payload: str) -> DataFrame:
    """EVT-02: the ordered event list of each job."""
    return events.groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, payload))), lambda x: x[payload]).alias("events"))


def unsent_stages(events: DataFrame, stages: DataFrame, job: str, stage: str) -> DataFrame:
    """EVT-05: for each failed job an error for every stage that it hasn't sent. stages is a fixed list of a few names."""
    names = F.array(*[F.lit(r[0]) for r in stages.select(stage).collect()])
    failed = events.where("status = 'error'").select(job).distinct()
    return failed.withColumn(stage, F.explode(names)).join(events.select(job, stage).distinct(), [job, stage], "left_anti").withColumn("event", F.lit("stage_error"))


def admit(times: list[float], kept: list[float], limit: int, window: float) -> tuple[list[bool], list[int], list[float]]:
    """EVT-03 rule: a hit passes if fewer than `limit` passed within the window; rejected hits don't count."""
    ok, retry = [], []
    for now in times:
        kept = [t for t in kept if t > now - window]
        if len(kept) < limit:
            kept.append(now)
            ok.append(True)
            retry.append(0)
        else:
            ok.append(False)
            retry.append(int(window - (now - kept[0])) + 1)
    return ok, retry, kept


def rate_limit(hits: DataFrame, key: str, ts: str, tie: str, limit: int = 10, window: int = 3600) -> DataFrame:
    """EVT-03 in batch: (key, tie, ts, accepted, retry_after).

    A decision depends on earlier decisions, so each key is replayed in order in bounded pieces of Arrow batches: rows
    come sorted by key and time, and only the last accepted hits (at most `limit`) are carried on.
    """
    kinds = dict(hits.dtypes)
    rows = hits.select(key, tie, F.col(ts).cast("timestamp").alias("ts")).repartition(F.col(key)).sortWithinPartitions(key, "ts", tie)

    def replay_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[float] = []
        last = None
        for pdf in batches:
            parts = []
            for k, own in pdf.groupby(key, sort=False, dropna=False):
                kept = kept if k == last else []
                ok, retry, kept = admit([t.timestamp() for t in own["ts"]], kept, limit, window)
                parts.append(own.assign(accepted=ok, retry_after=retry))
                last = k
            if parts:
                yield pd.concat(parts)

    return rows.mapInPandas(replay_sorted, f"{key} {kinds[key]}, {tie} {kinds[tie]}, ts timestamp, accepted boolean, retry_after int")


def rate_limit_stream(hits: DataFrame, key: str, ts: str, limit: int = 10, window: int = 3600) -> DataFrame:
    """EVT-03 as a stream: the state of a key is its accepted hits, at most `limit`; it is dropped when the window passes."""
    kind = dict(hits.dtypes)[key]

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(ts)
        ok, retry, kept = admit([t.timestamp() for t in rows[ts]], kept, limit, window)
        state.update((kept,))
        state.setTimeoutDuration(window * 1000)
        yield pd.DataFrame({key: rows[key], "ts": rows[ts], "accepted": ok, "retry_after": retry})

    return hits.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, accepted boolean, retry_after int", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def read_events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events in tumbling windows with a watermark for late ones; an extension, for live dashboards of the event log."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def retry_seconds(first: Column, now: Column, window: int) -> Column:
    return (F.lit(window) - (now.cast("double") - first.cast("double"))).cast("int") + 1
