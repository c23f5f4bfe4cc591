"""The metric operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of event files as a stream, `files` a micro-batch."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumnsRenamed({"event_type": "metric", "user_id": "client"})


def tumbling(df: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.withWatermark("ts", late).groupBy(w, "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_windows(df: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "client").agg(F.count("*").alias("n"))


def alerts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream-static join with the rules."""
    from ..operators.metrics import alerts as batch

    return batch(df, F.broadcast(rules))  # rules are a hand-made table


def deduplicated(df: DataFrame, late: str = "1 hour") -> DataFrame:
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(df: DataFrame, limit: int, seconds: int = 60, late: str = "1 hour") -> DataFrame:
    """Sliding-window limiter with state: a key's last allowed times, at most `limit` of them,
    dropped a day of event time after its last request."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"]:
            now = t.timestamp()
            held = [h for h in held if now - h < seconds]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(now)
        state.update((held,))
        state.setTimeoutTimestamp(int(max(rows["ts"]).timestamp() * 1000) + 24 * 3600 * 1000)
        yield pd.DataFrame({"client": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return df.withWatermark("ts", late).groupBy("client").applyInPandasWithState(step, "client bigint, event_id bigint, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All available input in micro-batches through the sink; restarts go on where they stopped."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
