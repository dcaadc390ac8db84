"""Keyset pages: opaque cursors over (created_at, id), newest first."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_cursor(created_at: datetime, row_id: int) -> str:
    raw = json.dumps({"t": created_at.isoformat(), "id": row_id}).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> tuple[datetime, int] | None:
    """None for a missing or malformed cursor, which is ignored."""
    try:
        raw = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return datetime.fromisoformat(raw["t"]), raw["id"]
    except (TypeError, ValueError, KeyError, binascii.Error):
        return None


def keyset_page(rows: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """limit + 1 rows after the cursor by (created_at, id), both descending: a filter and a bounded top-k."""
    after = decode_cursor(cursor)
    if after:
        at, row_id = F.lit(after[0]), F.lit(after[1])
        rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < row_id)))
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit + 1)


def request_filters(verdicts: Column, limit: Column, offset: Column, cursor: Column) -> Column:
    """struct<verdicts, limit, offset, cursor> of raw request values, for a table of requests.

    Verdicts that are none go, and none left means any (null). The limit is held to 1..200, 50 where it is missing or no
    number; the offset is 0 or more, and null where a cursor that is not empty takes its place.
    """
    known = F.filter(verdicts, lambda v: v.isin("PASS", "REVIEW", "FAIL"))
    size = F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(limit.try_cast("double"), F.lit(50.0)))).cast("int")
    after = F.nullif(cursor, F.lit(""))
    skipped = F.greatest(F.lit(0), F.coalesce(offset.try_cast("long"), F.lit(0)))
    return F.struct(F.when(F.size(known) > 0, known).alias("verdicts"), size.alias("limit"), F.when(after.isNull(), skipped).alias("offset"), after.alias("cursor"))
