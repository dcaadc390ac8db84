"""Operators with state per key: folds of event logs, in batch and on streams.

A key's events are read in order by one sorted pass with constant state, never gathered, so a hot key
costs time in one task but no memory. The folds are sequential by definition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int, window_ms: int) -> DataFrame:
    """Fixed windows that begin at a key's first event: adds allowed, remaining and retry_after_ms.

    A new window begins with the first event after the old one has ended (strictly); events count up
    to the limit, denied ones included.
    """
    columns = events.columns
    stamped = events.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    dealt = stamped.repartition(F.col(key)).sortWithinPartitions(key, "_ms", order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reset, count = object(), 0, 0
        for batch in batches:
            allowed, remaining, retry = [], [], []
            for k, ms in zip(batch[key].tolist(), batch["_ms"].tolist(), strict=True):
                if k != now or reset < ms:
                    now, reset, count = k, ms + window_ms, 0
                count += 1
                allowed.append(count <= limit)
                remaining.append(max(0, limit - count))
                retry.append(0 if count <= limit else reset - ms)
            yield batch.drop(columns="_ms").assign(allowed=allowed, remaining=remaining, retry_after_ms=retry)

    schema = events.schema.add("allowed", "boolean").add("remaining", "long").add("retry_after_ms", "long")
    return dealt.mapInPandas(fold, schema).select(*columns, "allowed", "remaining", "retry_after_ms")


def lease_states(events: DataFrame) -> DataFrame:
    """(id, status, job_id) after a log (id, seq, action, job_id) of acquire, done, error and recover.

    A lease is taken unless it is held; done and error count for the job that holds it; recover fails
    what is held. Only the last acquisition that found the lease free matters.
    """
    dealt = events.repartition("id").sortWithinPartitions("id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, status, job = None, "none", None
        for batch in batches:
            out = []
            for row in batch[["id", "action", "job_id"]].itertuples(index=False):
                if now is not None and row.id != now:
                    out.append((now, status, job))
                if row.id != now:
                    now, status, job = row.id, "none", None
                if row.action == "acquire" and status != "parsing":
                    status, job = "parsing", row.job_id
                elif row.action in ("done", "error") and status == "parsing" and row.job_id == job:
                    status = row.action
                elif row.action == "recover" and status == "parsing":
                    status = "error"
            yield pd.DataFrame(out, columns=["id", "status", "job_id"])
        if now is not None:
            yield pd.DataFrame([(now, status, job)], columns=["id", "status", "job_id"])

    return dealt.mapInPandas(fold, "id long, status string, job_id long")


def last_n(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return events.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def consume_once(uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, use_id) of the first use of each token, if that was of its kind and before it expired (inclusive)."""
    right = uses.join(tokens, "token").where((F.col("kind") == F.col("wanted")) & (F.col("at") <= F.col("expires_at")))
    return right.groupBy("token").agg(F.min_by("use_id", F.struct("at", "use_id")).alias("use_id"))


def share_expiry(created: str, hours: str) -> Column:
    """Expiry of a share: whole hours, 1 to 720, 168 where not given."""
    whole = F.floor(F.coalesce(F.col(hours), F.lit(168)))
    return F.col(created) + F.make_interval(hours=F.greatest(F.lit(1), F.least(F.lit(720), whole)).cast("int"))
