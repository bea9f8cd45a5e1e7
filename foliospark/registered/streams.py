"""Queries on event times (an extra beside the document analyses)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.binding import table
from ..streaming.events import sessions, windowed_counts
from . import Registry

REG = Registry()
REG.add("event_windows", lambda s, d: windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 4)), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
REG.add("event_sessions", lambda s, d: sessions(table(s, d, "events")).select("user_id", "start", "n"),
        "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
