"""Query registry, the shared parameters and the shared SQL fragments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Parameters of the driver tables: calendar, forecast day, closed station.
HOLIDAYS = [dt.date(2024, 1, 1)]
FIRST_DAY = dt.date(2024, 1, 1)
PREVIOUS_DAY = dt.date(2024, 1, 29)
FORECAST_DAY = dt.date(2024, 1, 30)
CLOSED = [4]
ORIGIN = dt.date(2024, 1, 2)  # first business day, index 1


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, the statement to compare with."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def day_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, the form both engines hand over alike."""
    dates = [f.name for f in df.schema if f.dataType.typeName() == "date"]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})


# Swipe columns over the event table.
SWIPE = """swipe AS (
  SELECT event_id, ts AS time, CAST(user_id % 10 AS INTEGER) AS stationID,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS deviceID,
         CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS status,
         CAST(user_id AS VARCHAR) AS userID,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS payType,
         CASE user_id % 10 % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS lineID,
         value, event_type,
         CAST(ts AS DATE) AS day,
         CAST(hour(ts) * 6 + minute(ts) // 10 AS INTEGER) AS slot,
         CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
         CAST(hour(ts) AS INTEGER) AS hour,
         CAST(minute(ts) // 10 * 10 AS INTEGER) AS minute
  FROM events)"""

# Sparse entries and exits per station and slot.
FLOW = SWIPE + """, flow AS (
  SELECT stationID, day, slot, weekday, hour, minute,
         CAST(sum(status) AS BIGINT) AS inNums, CAST(count(*) - sum(status) AS BIGINT) AS outNums
  FROM swipe GROUP BY ALL)"""

# The same on every station, day and slot.
DENSE = FLOW + """, days AS (
  SELECT CAST(d AS DATE) AS day, CAST(isodow(d) - 1 AS INTEGER) AS weekday
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(d)),
cells AS (
  SELECT s.stationID, d.day, d.weekday, CAST(k AS INTEGER) AS slot
  FROM (SELECT DISTINCT stationID FROM swipe) s, days d, generate_series(0, 143) g(k)),
dense AS MATERIALIZED (
  SELECT c.stationID, c.day, c.weekday, c.slot, CAST(c.slot // 6 AS INTEGER) AS hour,
         CAST(c.slot % 6 * 10 AS INTEGER) AS minute,
         coalesce(f.inNums, 0) AS inNums, coalesce(f.outNums, 0) AS outNums
  FROM cells c LEFT JOIN flow f USING (stationID, day, slot))"""

# Business days with their dense index.
BUSINESS = """business AS (
  SELECT day, CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS idx FROM days
  WHERE weekday < 5 AND day <> DATE '2024-01-01')"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
