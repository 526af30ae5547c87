"""Batch twins of the streaming jobs, on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberlode.operators import history
from amberlode.plans.fixtures import ASSERTIONS_SQL, assertions
from amberlode.plans.registry import query
from amberlode.sources import imports
from amberlode.streaming import jobs


@query("x1_chunk_upsert")
def _(t):
    return jobs.chunk_stream(t("documents").select("doc_id", "text")).select("doc_id", "seq", "page", "text_hash")


ROUTES = {"click": "fact", "view": "relationship", "purchase": "historical_name"}
_ROUTE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items()) + " ELSE 'entity' END"


@query("x2_bounded_batch", f"SELECT event_id, {_ROUTE_SQL} AS route, CASE WHEN value / 100 < 0.6 THEN 'low_confidence' ELSE 'in_review' END AS state FROM (SELECT * FROM events WHERE event_type <> 'error' ORDER BY event_id LIMIT 500)")
def _(t):
    """The first 500 pending candidates, as a scheduled run takes them, with their route and state."""
    return jobs.routed(t("events").where("event_type <> 'error'").orderBy("event_id").limit(500), ROUTES).select("event_id", "route", "state")


@query("x3_hourly_quality", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    return jobs.hourly_quality(t("events"))


@query("x4_distinct_content", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"))


@query("x5_conflict_state", f"WITH {ASSERTIONS_SQL} SELECT entity_id, property, qualifier, count(DISTINCT value) AS n_values, count(DISTINCT source_id) AS n_sources, count(DISTINCT value) > 1 AS in_conflict FROM assertions WHERE status <> 'rejected' GROUP BY ALL")
def _(t):
    g = assertions(t).where("status <> 'rejected'").groupBy("entity_id", "property", "qualifier").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("source_id").alias("n_sources"))
    return g.withColumn("in_conflict", F.col("n_values") > 1)


@query("x6_evidence", f"WITH {ASSERTIONS_SQL} SELECT property, value, CAST(count(DISTINCT source_id) AS INTEGER) AS evidence, CASE WHEN count(DISTINCT source_id) >= 2 THEN 'in_review' ELSE 'needs_evidence' END AS state FROM assertions GROUP BY ALL")
def _(t):
    return jobs.evidence(assertions(t))


@query("x7_fetch_throttle", """WITH RECURSIVE e AS (SELECT user_id % 40 AS host, event_id, floor(epoch(ts))::DOUBLE AS arrival, 30.0 + user_id % 40 * 10 AS delay, row_number() OVER (PARTITION BY user_id % 40 ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
s AS (SELECT host, event_id, i, arrival AS start FROM e WHERE i = 1 UNION ALL SELECT e.host, e.event_id, e.i, greatest(e.arrival, s.start + e.delay) FROM s JOIN e ON e.host = s.host AND e.i = s.i + 1)
SELECT event_id, round(start, 3) AS start FROM s""")
def _(t):
    """When each request may start, as every host keeps its distance."""
    host = F.col("user_id") % 40
    r = t("events").select(host.alias("host"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("arrival"), (F.lit(30.0) + host * 10).alias("delay"))
    return imports.fetch_times(r).select(F.col("id").alias("event_id"), F.round("start", 3).alias("start"))


@query("x8_cache_version", """WITH v AS (SELECT *, 1 + count(*) FILTER (WHERE event_type = 'purchase') OVER (ORDER BY ts, event_id) AS version FROM events)
SELECT event_id, 'v' || version || ':' || (user_id % 5) AS cache_key, row_number() OVER (PARTITION BY version, user_id % 5 ORDER BY ts, event_id) > 1 AS hit FROM v WHERE event_type <> 'purchase'""")
def _(t):
    """Lookups of a cache that every purchase makes stale: the versioned key, and whether it is filled."""
    seen = history.versions(t("events"), F.col("event_type") == "purchase", "ts", "event_id").where("event_type <> 'purchase'")
    return history.cache_hits(seen.withColumn("k", (F.col("user_id") % 5).cast("string")), "k", "ts", "event_id").select("event_id", "cache_key", "hit")


@query("x9_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


@query("x9_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '1 hour']) AS s FROM events) GROUP BY s")
def _(t):
    return t("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("x9_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return jobs.sessions(t("events"))
