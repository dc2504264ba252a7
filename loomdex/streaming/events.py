"""Structured Streaming: windows over event time, a stateful rate limit, and micro-batch refresh."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomdex.sources.files import publish, read_published


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Counts and sums by window and key; works on a stream, with a watermark, and on a table."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def admitted(times: list[float], recent: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which of the requests pass: fewer than `limit` admitted ones in the seconds before. Rejected ones are not recorded."""
    out, kept = [], list(recent)
    for t in times:
        kept = [x for x in kept if x > t - seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def rate_limit(events: DataFrame, limit: int = 30, seconds: int = 60, key: str = "user_id") -> DataFrame:
    """event_id, user_id, ts, admitted. On a table, each key's requests in order; on a stream, with state by key.

    A hot key is one sequence by definition, as each admission depends on those before it; its state is `limit` times.
    """
    schema = "event_id long, user_id long, ts timestamp, admitted boolean"
    rows = events.select("event_id", F.col(key).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))

    def decide(pdf: pd.DataFrame, recent: list[float]) -> tuple[pd.DataFrame, list[float]]:
        pdf = pdf.sort_values(["ts", "event_id"])
        times = [x.timestamp() for x in pdf["ts"]]
        passed, recent = admitted(times, recent, limit, seconds)
        return pdf.assign(admitted=passed)[["event_id", "user_id", "ts", "admitted"]], recent

    if not events.isStreaming:
        return rows.groupBy("user_id").applyInPandas(lambda pdf: decide(pdf, [])[0], schema)

    def update(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        out, recent = decide(pd.concat(list(batches)), recent)
        state.update((recent,))
        yield out

    return rows.groupBy("user_id").applyInPandasWithState(update, schema, "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def refresh(stream: DataFrame, root: str, key: str, checkpoint: str):
    """Upserts each micro-batch into the published snapshot at root; the last row of a key in a batch (by ts) counts."""

    def apply(batch: DataFrame, _: int) -> None:
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        try:
            old = read_published(batch.sparkSession, root)
        except Exception as e:  # no snapshot yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        publish(new if old is None else old.join(new, key, "left_anti").unionByName(new.select(*old.columns)), root)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
