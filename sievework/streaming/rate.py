"""The rate limiter on a stream, with state per key and a timer that forgets idle keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, event_id long, allowed boolean, remaining long"


def stream_rate_limit(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_ms: int, delay: str = "10 minutes") -> DataFrame:
    """Allowed or not, for each event of a stream; the same decisions as the batch fold on ordered input.

    State is one window per key; it times out once the watermark has passed the window, which is the
    sweep of expired keys.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, count = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"], kind="stable")
        allowed, remaining = [], []
        for ms in rows["ms"].tolist():
            if reset < ms:
                reset, count = ms + window_ms, 0
            count += 1
            allowed.append(count <= limit)
            remaining.append(max(0, limit - count))
        state.update((reset, count))
        state.setTimeoutTimestamp(max(reset + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": group[0], "event_id": rows["event_id"], "allowed": allowed, "remaining": remaining})

    plain = events.withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return plain.groupBy("key").applyInPandasWithState(step, OUT, "reset long, count long", "append", GroupStateTimeout.EventTimeTimeout)
