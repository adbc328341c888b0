"""Queries on rows near each other and on logs of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import intervals, ledger
from tessella.registry import query
from tessella.tables import load

#: Earlier rows looked at, told, and the seconds they may lie back; seconds of a session's and of a throttle's gap.
LOOK, TELL, BACK, SESSION, THROTTLE = 4, 2, 900, 6 * 3600, 3 * 3600


@query(f"""
WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t FROM events),
x AS (SELECT event_id, user_id, t, {', '.join(f'lag(t, {k}) OVER w AS a{k}, lag(user_id, {k}) OVER w AS u{k}' for k in range(1, LOOK + 1))} FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
n AS (SELECT event_id, user_id, [x FOR x IN [{', '.join(f"CASE WHEN t - a{k} <= {BACK}000000 THEN u{k} END" for k in range(1, LOOK + 1))}] IF x IS NOT NULL] AS near FROM x)
SELECT event_id, len(near) AS n_near, array_to_string([u FOR u IN near IF u <> user_id][1:{TELL}], ',') AS others FROM n""")
def earlier_writes_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The up to four events of the same type within a quarter of an hour before each event, and the nearest two of other users."""
    own = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = intervals.earlier_within(own, "event_type", "at", ["event_id"], BACK * 1_000_000, LOOK, ["user_id"])
    others = F.slice(F.transform(F.filter("earlier", lambda e: e["user_id"] != F.col("user_id")), lambda e: e["user_id"].cast("string")), 1, TELL)
    return found.select("event_id", F.size("earlier").cast("long").alias("n_near"), F.array_join(others, ",").alias("others"))


@query(f"""
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL {SESSION} SECOND, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL {SESSION} SECOND AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sessions(load(spark, sf_dir, "events"), "user_id", "ts", f"{SESSION} seconds")


@query(f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(event_id, user_id, k, last, allowed) AS (SELECT event_id, user_id, k, t, true FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - f.last >= {THROTTLE}000000 THEN e.t ELSE f.last END, e.t - f.last >= {THROTTLE}000000 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, user_id, allowed FROM f""")
def event_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return intervals.throttled(own, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), ["event_id"], THROTTLE * 1_000_000).select("event_id", "user_id", "allowed")


@query("""
WITH RECURSIVE e AS (SELECT o_custkey AS name, o_orderkey AS version, CASE o_orderstatus WHEN 'F' THEN 'promote' WHEN 'O' THEN 'rollback' ELSE 'reject' END AS event, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
s(name, k, current, target, n, r) AS (SELECT name, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT name FROM e)
 UNION ALL SELECT s.name, e.k, CASE WHEN event = 'promote' THEN version WHEN event = 'rollback' AND target IS NOT NULL THEN target ELSE current END,
  CASE WHEN event = 'promote' OR event = 'rollback' AND target IS NOT NULL THEN current ELSE target END, n + (event = 'promote')::INT, r + (event = 'reject')::INT FROM s JOIN e ON e.name = s.name AND e.k = s.k + 1)
SELECT name, arg_max(coalesce(current, -1), k) AS current, arg_max(coalesce(target, -1), k) AS target, max(n) AS n_promoted, max(r) AS n_rejected FROM s GROUP BY name""")
def registry_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a log of promotions, rollbacks and rejections, and the state it leaves."""
    event = F.when(F.col("o_orderstatus") == "F", "promote").when(F.col("o_orderstatus") == "O", "rollback").otherwise("reject")
    log = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderdate", F.col("o_orderkey").alias("version"), event.alias("event"))
    return ledger.registry_state(log, "name", ["o_orderdate", "version"]).na.fill(-1, ["current", "target"])
