"""Session queries: users of ``events`` stand for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as s
from ._register import read, registry

QUERIES, ORACLES, query = registry()

_KINDS = {"view": "read", "click": "mcp", "error": "bash", "signup": "prompt", "purchase": "pack"}
_EV = "ev AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'mcp' WHEN 'error' THEN 'bash' WHEN 'signup' THEN 'prompt' WHEN 'purchase' THEN 'pack' END AS kind, coalesce(value, 0) AS value, (props->>'k')::bigint AS k, props FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", kind.alias("kind"), F.coalesce("value", F.lit(0.0)).alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"), "props")


_METRICS = f"""{_EV}, m AS (SELECT user_id, count(*) FILTER (kind = 'prompt') AS prompts, count(*) FILTER (kind IN ('read','bash','mcp','edit')) AS tool_calls, count(DISTINCT CASE WHEN kind = 'read' THEN k END) AS files_read,
 coalesce(sum(value) FILTER (kind = 'read'), 0) AS tok_read, coalesce(sum(value) FILTER (kind = 'bash'), 0) AS tok_bash, coalesce(sum(value) FILTER (kind = 'mcp'), 0) AS tok_mcp, coalesce(sum(value) FILTER (kind = 'pack'), 0) AS injected FROM ev GROUP BY user_id)"""
_ROUND = "user_id, prompts, tool_calls, files_read, round(tok_read, 3) AS tok_read, round(tok_bash, 3) AS tok_bash, round(tok_mcp, 3) AS tok_mcp, round(injected, 3) AS injected"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.metrics(_events(spark, sf_dir), "user_id", "kind", F.col("k"), "value")


@query("session_metrics", f"WITH {_METRICS} SELECT {_ROUND} FROM m")
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("user_id", "prompts", "tool_calls", "files_read", *[F.round(c, 3).alias(c) for c in ("tok_read", "tok_bash", "tok_mcp", "injected")])


@query("ab_net_saved", f"""WITH {_METRICS} SELECT count(*) FILTER (user_id % 2 = 0) AS n_base, count(*) FILTER (user_id % 2 = 1) AS n_treated,
 round(sum(CASE WHEN user_id % 2 = 0 THEN tok_read + tok_bash ELSE 0 END) - sum(CASE WHEN user_id % 2 = 1 THEN tok_read + tok_bash + injected + tok_mcp ELSE 0 END), 3) AS net_saved FROM m""")
def ab_net_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.net_saved(_metrics(spark, sf_dir), F.col("user_id") % 2 == 1).withColumn("net_saved", F.round("net_saved", 3))


@query("session_means", f"WITH {_METRICS} SELECT count(*) AS n, round(avg(prompts), 6) AS prompts, round(avg(tool_calls), 6) AS tool_calls, round(avg(files_read), 6) AS files_read FROM m")
def session_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("prompts", "tool_calls", "files_read")])


@query("pack_overlap", f"""WITH {_EV}, w AS (SELECT *, sum((kind = 'pack')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS win FROM ev),
 g AS (SELECT user_id, win, list(DISTINCT k) FILTER (kind = 'read' AND k IS NOT NULL) AS reads, max(k) FILTER (kind = 'pack') AS p FROM w WHERE win > 0 GROUP BY user_id, win)
 SELECT user_id, win::bigint AS "window", len(list_intersect(reads, [p, p+1, p+2, p+3, p+4]))::double / least(5, len(reads)) AS overlap FROM g WHERE len(reads) > 0""")
def pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack with k offers the items k .. k + 6, of which the first five count."""
    ev = _events(spark, sf_dir).withColumn("offered", F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.col("k") + i))
    return s.pack_overlap(ev, "user_id", ["ts", "event_id"], "kind", "k", "offered")


_STREAK = f"""WITH {_EV}, i AS (SELECT *, sum((kind = 'mcp')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM ev),
 k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::int AS streak FROM i WHERE kind = 'read')"""


@query("read_streak", f"{_STREAK} SELECT * FROM k")
def read_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.read_streak(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "kind").select("event_id", "user_id", "streak")


@query("cascade_nudge", f"{_STREAK} SELECT * FROM k WHERE streak IN (3, 6)")
def cascade_nudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nudges(read_streak(spark, sf_dir), 3)


@query("distill_sessions", f"""WITH {_EV}, h AS (SELECT user_id, arg_min(substr(props, 1, 200), event_id) FILTER (kind = 'prompt') AS task, max(event_id) AS ended_at, count(*) FILTER (kind = 'bash') AS n_commands FROM ev GROUP BY user_id),
 e AS (SELECT user_id, list(k ORDER BY o, k) AS edited FROM (SELECT user_id, k, min(event_id) AS o FROM ev WHERE kind = 'mcp' GROUP BY user_id, k) GROUP BY user_id),
 r AS (SELECT user_id, list(k ORDER BY rn) AS inspected FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, k NULLS FIRST) AS rn FROM ev WHERE kind = 'read' GROUP BY user_id, k) WHERE rn <= 10 GROUP BY user_id)
 SELECT h.user_id, task, ended_at, n_commands, coalesce(edited, []) AS edited, coalesce(inspected, []) AS inspected FROM h LEFT JOIN e USING (user_id) LEFT JOIN r USING (user_id)""")
def distill_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "mcp", "edit").otherwise(F.col("kind")))
    return s.distill(ev, "user_id", "event_id", "kind", "props", "k")


@query("latest_summaries", "SELECT user_id, max(event_id) AS ended_at FROM events GROUP BY user_id ORDER BY ended_at DESC, user_id LIMIT 5")
def latest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.latest(read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("ended_at")), "user_id", "ended_at")


@query("reads_cap", f"""WITH {_EV}, c AS (SELECT user_id, k, count(*) AS n, min(event_id) AS since FROM ev WHERE kind = 'read' AND k IS NOT NULL GROUP BY user_id, k)
 SELECT user_id, k, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, since DESC, k DESC) <= 5""")
def reads_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.reads_kept(_events(spark, sf_dir).where("kind = 'read' AND k IS NOT NULL"), "user_id", "k", "event_id", 5)


@query("surfaced_fifo", f"""WITH {_EV}, c AS (SELECT user_id, k, max(event_id) AS "at" FROM ev WHERE kind = 'mcp' AND k IS NOT NULL GROUP BY user_id, k)
 SELECT user_id, k, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, k DESC)::int AS pos FROM c QUALIFY pos <= 5""")
def surfaced_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.surfaced_kept(_events(spark, sf_dir).where("kind = 'mcp' AND k IS NOT NULL"), "user_id", "k", "event_id", 5)
