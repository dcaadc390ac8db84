"""Queries of operators with state (X) over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from ..sources.shared import new_path
from ..streaming import sinks
from .bridge import manuscripts, sql, table
from .registry import query


@query("x01_rate_limit", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
w AS (
    SELECT event_id, user_id, k, ms + 86400000 AS reset, 1 AS n FROM e WHERE k = 1
    UNION ALL
    SELECT e.event_id, e.user_id, e.k, CASE WHEN w.reset < e.ms THEN e.ms + 86400000 ELSE w.reset END, CASE WHEN w.reset < e.ms THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1
)
SELECT w.event_id, n <= 2 AS allowed, greatest(0, 2 - n)::BIGINT AS remaining, CASE WHEN n <= 2 THEN 0 ELSE reset - ms END::BIGINT AS retry_after_ms FROM w JOIN e USING (event_id)""")
def x01(spark, d):
    found = S.rate_limit(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", limit=2, window_ms=86_400_000)
    return found.select("event_id", "allowed", "remaining", "retry_after_ms")


@query("x02_lease_states", """
WITH RECURSIVE e AS (
    SELECT user_id AS id, CASE event_type WHEN 'view' THEN 'acquire' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'recover' WHEN 'click' THEN 'acquire' ELSE 'error' END AS action, event_id % 3 AS job_id,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
),
w AS (
    SELECT id, k, CASE WHEN action = 'acquire' THEN 'parsing' ELSE 'none' END AS status, CASE WHEN action = 'acquire' THEN job_id END AS job_id FROM e WHERE k = 1
    UNION ALL
    SELECT w.id, e.k, CASE WHEN e.action = 'acquire' AND w.status <> 'parsing' THEN 'parsing' WHEN e.action IN ('done', 'error') AND w.status = 'parsing' AND e.job_id = w.job_id THEN e.action WHEN e.action = 'recover' AND w.status = 'parsing' THEN 'error' ELSE w.status END,
           CASE WHEN e.action = 'acquire' AND w.status <> 'parsing' THEN e.job_id ELSE w.job_id END
    FROM w JOIN e ON e.id = w.id AND e.k = w.k + 1
)
SELECT id, status, job_id FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def x02(spark, d):
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "click"), "acquire").when(kind == "purchase", "done").when(kind == "error", "recover").otherwise("error")
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") % 3).alias("job_id"))
    return S.lease_states(log)


@query("x03_stale_recovery", sql("SELECT id, CASE WHEN status = 'parsing' THEN 'error' ELSE status END AS status FROM manuscripts", "manuscripts"))
def x03(spark, d):
    return manuscripts(spark, d).select("id", F.when(F.col("status") == "parsing", "error").otherwise(F.col("status")).alias("status"))


@query("x05_progress_replay", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 200")
def x05(spark, d):
    return S.last_n(table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 200)


@query("x08_one_shot_tokens", """SELECT user_id AS token, arg_min(event_id, (ts, event_id)) AS use_id FROM events JOIN customer ON user_id = c_custkey
WHERE event_type = CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END AND ts <= TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 20) GROUP BY user_id""")
def x08(spark, d):
    uses = table(spark, d, "events").select(F.col("user_id").alias("token"), F.col("event_id").alias("use_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    start = F.lit("2024-01-01").cast("timestamp")
    tokens = table(spark, d, "customer").select(F.col("c_custkey").alias("token"), F.when(F.col("c_custkey") % 2 == 0, "click").otherwise("view").alias("wanted"), (start + F.make_interval(days=(F.col("c_custkey") % 20).cast("int"))).alias("expires_at"))
    return S.consume_once(uses, tokens)


@query("x09_workspace_cascade", sql("SELECT id, CASE WHEN workspace_id = 'w4' THEN NULL ELSE workspace_id END AS workspace_id, archived OR coalesce(workspace_id = 'w4', false) AS archived FROM manuscripts", "manuscripts"))
def x09(spark, d):
    gone = F.coalesce(F.col("workspace_id") == "w4", F.lit(False))
    return manuscripts(spark, d).select("id", F.when(~gone, F.col("workspace_id")).alias("workspace_id"), (F.col("archived") | gone).alias("archived"))


@query("x11_notes_setter", "SELECT doc_id, nullif(substring(trim(text), 1, 4000), '') AS notes, length(trim(text)) > 4000 AS truncated FROM documents")
def x11(spark, d):
    note = F.trim("text")
    return table(spark, d, "documents").select("doc_id", F.nullif(F.substring(note, 1, 4000), F.lit("")).alias("notes"), (F.length(note) > 4000).alias("truncated"))


@query("x12_share_expiry", "SELECT event_id, ts + INTERVAL 1 HOUR * CASE WHEN event_id % 4 = 0 THEN 168 ELSE greatest(1, least(720, floor(value * 10)))::INT END AS expires_at FROM events")
def x12(spark, d):
    asked = F.when(F.col("event_id") % 4 != 0, F.col("value") * 10)
    return table(spark, d, "events").withColumn("asked", asked).select("event_id", S.share_expiry("ts", "asked").alias("expires_at"))


@query("x13_share_views", "SELECT c_custkey AS share_id, count(*) AS view_count, max(ts) AS last_viewed_at FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'view' AND c_custkey % 7 <> 0 GROUP BY c_custkey")
def x13(spark, d):
    """Views of shares that are still active."""
    active = table(spark, d, "customer").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("share_id"))
    views = table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("share_id"), "ts")
    return views.join(active, "share_id").groupBy("share_id").agg(F.count("*").alias("view_count"), F.max("ts").alias("last_viewed_at"))


@query("x10_audit_batches", "SELECT event_id, user_id, (event_id % 3)::INT AS batch FROM events")
def x10(spark, d):
    """Audit rows of three micro-batches, each of them tried twice."""
    path, events = new_path(spark, "audit"), table(spark, d, "events").select("event_id", "user_id")
    for batch in (0, 1, 1, 2, 0, 2):
        sinks.append_batch(events.where(F.col("event_id") % 3 == batch), batch, path)
    return sinks.audit_rows(spark, path).select("event_id", "user_id", "batch")


@query("x07_retention_sweep", "SELECT event_id, (event_id % 3)::INT AS batch FROM events WHERE epoch_us(ts) // 1000 > epoch_us(TIMESTAMP '2024-01-31') // 1000 - 20 * 86400000")
def x07(spark, d):
    """What a table of three batches holds after a sweep of what is older than twenty days, made twice."""
    path, events = new_path(spark, "audit"), table(spark, d, "events").select("event_id", "ts")
    for batch in range(3):
        sinks.append_batch(events.where(F.col("event_id") % 3 == batch), batch, path)
    now = 1_706_659_200_000  # 2024-01-31 in UTC
    for _ in range(2):
        sinks.sweep(spark, path, "ts", now, 20 * 24)
    return sinks.audit_rows(spark, path).select("event_id", "batch")
