"""Session analytics over event tables: metrics, windows between packs, streaks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(ev: DataFrame, session: str, kind: str, item: Column, tokens: str) -> DataFrame:
    """Per session: prompts, tool calls, different items read, tokens by kind.  Kinds are read,
    mcp, bash, edit, prompt, pack.  Partial sums are combined before the shuffle."""
    is_ = lambda *k: F.col(kind).isin(*k)
    tok = lambda k: F.sum(F.when(F.col(kind) == k, F.col(tokens)).otherwise(0.0)).alias(f"tok_{k}")
    return ev.groupBy(session).agg(
        F.count_if(is_("prompt")).alias("prompts"), F.count_if(is_("read", "bash", "mcp", "edit")).alias("tool_calls"),
        F.countDistinct(F.when(is_("read"), item)).alias("files_read"), tok("read"), tok("bash"), tok("mcp"), F.sum(F.when(is_("pack"), F.col(tokens)).otherwise(0.0)).alias("injected"),
    )


def net_saved(m: DataFrame, treated: Column) -> DataFrame:
    """One row: (read + bash) of the base arm less (read + bash + injected + mcp) of the treated."""
    base = F.sum(F.when(~treated, F.col("tok_read") + F.col("tok_bash")).otherwise(0.0))
    cost = F.sum(F.when(treated, F.col("tok_read") + F.col("tok_bash") + F.col("injected") + F.col("tok_mcp")).otherwise(0.0))
    return m.agg(F.count_if(~treated).alias("n_base"), F.count_if(treated).alias("n_treated"), (base - cost).alias("net_saved"))


def pack_overlap(ev: DataFrame, session: str, order: list[str], kind: str, item: str, offered: str) -> DataFrame:
    """(session, window, overlap): share of a window's read items among the first five that its pack
    offered.  A window opens at a pack and ends at the next one; windows without reads are left out."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    win = ev.withColumn("window", F.sum(F.when(F.col(kind) == "pack", 1).otherwise(0)).over(w)).where(F.col("window") > 0)
    got = win.groupBy(session, "window").agg(F.collect_set(F.when(F.col(kind) == "read", F.col(item))).alias("reads"), F.first(F.when(F.col(kind) == "pack", F.col(offered)), ignorenulls=True).alias("top"))
    top5 = F.slice("top", 1, 5)
    return got.where(F.size("reads") > 0).select(session, "window", (F.size(F.array_intersect("reads", top5)) / F.least(F.lit(5), F.size("reads"))).alias("overlap"))


def read_streak(ev: DataFrame, session: str, order: list[str], kind: str) -> DataFrame:
    """Reads with ``streak``: how many reads since the session's last index query (kind mcp)."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = ev.withColumn("island", F.sum(F.when(F.col(kind) == "mcp", 1).otherwise(0)).over(w)).where(F.col(kind) == "read")
    v = Window.partitionBy(session, "island").orderBy(*order)
    return island.withColumn("streak", F.row_number().over(v))


def nudges(streaks: DataFrame, limit: int) -> DataFrame:
    """Reads at which a session is told to query the index: at the limit and at twice the limit."""
    return streaks.where(F.col("streak").isin(limit, 2 * limit))


def distill(ev: DataFrame, session: str, order: str, kind: str, text: str, item: str, top: int = 10) -> DataFrame:
    """Per session: first prompt, edited items in order of the first edit, the most-read items."""
    head = ev.groupBy(session).agg(F.min_by(F.when(F.col(kind) == "prompt", F.substring(text, 1, 200)), F.when(F.col(kind) == "prompt", F.col(order))).alias("task"), F.max(order).alias("ended_at"), F.count_if(F.col(kind) == "bash").alias("n_commands"))
    edits = ev.where(F.col(kind) == "edit").groupBy(session, item).agg(F.min(order).alias("o")).groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", item))), lambda x: x[item]).alias("edited"))
    w = Window.partitionBy(session).orderBy(F.desc("n"), item)
    reads = ev.where(F.col(kind) == "read").groupBy(session, item).agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    reads = reads.groupBy(session).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", item))), lambda x: x[item]).alias("inspected"))
    empty = F.array().cast(f"array<{ev.schema[item].dataType.simpleString()}>")
    return head.join(edits, session, "left").join(reads, session, "left").select(session, "task", "ended_at", "n_commands", F.coalesce("edited", empty).alias("edited"), F.coalesce("inspected", empty).alias("inspected"))


def latest(summaries: DataFrame, key: str, ended: str, n: int = 5) -> DataFrame:
    """The n newest summaries."""
    return summaries.orderBy(F.desc(ended), key).limit(n)


def reads_kept(ev: DataFrame, session: str, item: str, order: str, most: int) -> DataFrame:
    """Read counts of a session, at most ``most`` items: the least read, oldest first, are evicted."""
    own = ev.groupBy(session, item).agg(F.count("*").alias("n"), F.min(order).alias("since"))
    w = Window.partitionBy(session).orderBy(F.desc("n"), F.desc("since"), F.desc(item))
    return own.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select(session, item, "n")


def surfaced_kept(ev: DataFrame, session: str, item: str, order: str, most: int) -> DataFrame:
    """The last ``most`` surfaced items of a session (an item that returns moves to the end)."""
    own = ev.groupBy(session, item).agg(F.max(order).alias("at"))
    w = Window.partitionBy(session).orderBy(F.desc("at"), F.desc(item))
    return own.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)
