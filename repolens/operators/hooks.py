"""What a coding session is told, as DataFrame operators: injected packs, unread tests, intercepted
searches, stale files, reasons, snippets and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_query


def pack_form(confidence: Column, n_files: Column, gate: bool = True) -> Column:
    """How a pack is shown: in full if confidence is high (or there is no gate), compact if medium, one
    line if low; null for an empty pack."""
    form = F.when(confidence == "high", "full").when(confidence == "medium", "compact").otherwise("line") if gate else F.lit("full")
    return F.when(n_files > 0, form)


def pack_events(packs: DataFrame, confidence: str, n_files: str, tokens: str, gate: bool = True, shadow: bool = False) -> DataFrame:
    """``packs`` with form, injected and tok: in shadow mode all is computed and nothing injected."""
    form = pack_form(F.col(confidence), F.col(n_files), gate)
    return packs.withColumn("form", form).withColumn("injected", F.col("form").isNotNull() & F.lit(not shadow)).withColumn("tok", F.when(F.col("form").isNotNull(), F.col(tokens)).otherwise(0))


def unread_tests(edits: DataFrame, tests: DataFrame, reads: DataFrame, reminded: DataFrame | None = None) -> DataFrame:
    """(session, file, tests): edited files all of whose tests the session has not read and of which it
    has not been reminded.  ``edits``, ``reads`` and ``reminded`` are (session, file), ``tests``
    (source, test)."""
    own = edits.select("session", "file").distinct()
    if reminded is not None:
        own = own.join(reminded.select("session", "file").distinct(), ["session", "file"], "left_anti")
    asked = own.join(tests.select(F.col("source").alias("file"), "test").distinct(), "file")
    seen = reads.select("session", F.col("file").alias("test"), F.lit(1).alias("seen")).distinct()
    return asked.join(seen, ["session", "test"], "left").groupBy("session", "file").agg(F.sort_array(F.collect_set("test")).alias("tests"), F.count("seen").alias("n_seen")).where("n_seen = 0").drop("n_seen")


def search_gate(query: Column, partial: Column, n_files: Column) -> Column:
    """The words that a search is answered for; null if they are too short, the index is missing or
    partial, or nothing was found."""
    words = clean_query(query)
    return F.when((F.length(words) >= 3) & ~F.coalesce(partial, F.lit(True)) & (n_files > 0), words)


def stale(files: DataFrame, path: str, mtime: str, indexed_at: int, slack: int = 2, most: int = 30) -> DataFrame:
    """Of the first ``most`` probed paths those that are missing (null time) or changed since."""
    return files.orderBy(path).limit(most).where(F.col(mtime).isNull() | (F.col(mtime) > indexed_at + slack)).select(path)


def top_reasons(rows: DataFrame, key: str, points: str, pos: str, n: int = 3) -> DataFrame:
    """Each key's ``n`` reasons of most points, equal ones by position, with ``rank``."""
    w = Window.partitionBy(key).orderBy(F.desc(points), pos)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def snippets(refs: DataFrame, contents: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """``refs`` with the line they point to (null if there is none), trimmed, 120 characters at most."""
    asked = refs.groupBy(file).agg(F.collect_set(line).alias("wanted"))  # no more than the file has lines
    lines = contents.join(asked, F.col("path") == F.col(file)).select(file, F.explode("wanted").alias(line), F.split("content", "\n").alias("l"))
    text = F.trim(F.get("l", F.col(line) - 1))
    found = lines.select(file, line, F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 119), F.lit("…"))).otherwise(text).alias("snippet"))
    return refs.join(found, [file, line], "left")


def latest(files: DataFrame, group: list[str], path: str, mtime: str) -> DataFrame:
    """Each group's newest file, the first in name order of equally new ones."""
    return files.groupBy(*group).agg(F.min_by(path, F.struct(-F.col(mtime).cast("long"), F.col(path))).alias(path), F.max(mtime).alias(mtime))


def catalog(repos: DataFrame, branches: DataFrame, meta: DataFrame) -> DataFrame:
    """(repo, branch, current, indexed_at): every repository with its branches (null if it has none) and
    what is known of their indexes."""
    return repos.join(branches, "repo", "left").join(meta, ["repo", "branch"], "left").select("repo", "branch", F.coalesce(F.col("branch") == F.col("head"), F.lit(False)).alias("current"), "indexed_at")


def breadth(results: DataFrame, key: str, file: str) -> DataFrame:
    """(key, n_files, n_rows): how many different files a result spans."""
    return results.groupBy(key).agg(F.countDistinct(file).alias("n_files"), F.count("*").alias("n_rows"))


def usable_vectors(vectors: DataFrame, header: DataFrame, want: dict) -> DataFrame:
    """``vectors``, or no row if the one-row header differs from what the query needs in any of its
    fields (schema version, repository, branch, model, dimension): ranking is lexical then."""
    same = header.where(" AND ".join(f"{k} <=> {v!r}" for k, v in sorted(want.items()))).limit(1).select(F.lit(1).alias("ok"))
    return vectors.crossJoin(F.broadcast(same)).drop("ok")  # one row or none


def tree_rows(nodes: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """(key, name, chain, depth, path): nodes with the names above them (empty ones left out) and their
    place, which sorts them in pre-order.  A level is one equi-join."""
    from .graph import kept

    at = nodes.select(key, parent, F.coalesce(name, F.lit("")).alias(name))
    level = at.where(F.col(parent).isNull()).select(key, name, F.array().cast("array<string>").alias("chain"), F.lit(0).alias("depth"), F.array(F.col(key)).alias("path"))
    out = level
    while True:
        up = level.select(F.col(key).alias("_up"), F.when(F.col(name) != "", F.concat("chain", F.array(name))).otherwise(F.col("chain")).alias("chain"), "depth", "path")
        level = kept(at.join(up, F.col(parent) == F.col("_up")).select(key, name, "chain", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(key)).alias("path")))
        if not level.limit(1).count():
            return out
        out = out.union(level)


def symbol_chunk(path: Column, chain: Column, kind: Column, name: Column, doc: Column, body: Column) -> Column:
    """What is embedded for a symbol: path words and names above it, kind and name, its leading comment
    (16 lines), 1000 characters of the body; 1400 characters in all."""
    from ..functions.text import split_identifier

    head = F.concat_ws(" ", F.concat_ws(" ", split_identifier(path)), F.concat_ws(" ", chain))
    return F.substring(F.concat_ws("\n", head, F.concat_ws(" ", kind, name), F.array_join(F.slice(F.split(F.coalesce(doc, F.lit("")), "\n"), 1, 16), "\n"), F.substring(body, 1, 1000)), 1, 1400)


def shrink(parts: dict[str, list[str]], budget: int, order: tuple[str, ...] = ("tree", "commands", "session", "entrypoints", "packages", "rules")) -> dict[str, list[str]]:
    """An overview cut to about ``budget`` tokens: lines go from the end of each part in turn, the tree
    first.  (A report of some dozen lines: driver work.)"""
    out = {k: list(v) for k, v in parts.items()}
    for part in order:
        while out.get(part) and sum(len(x) + 1 for v in out.values() for x in v) > 4 * budget:
            out[part].pop()
    return out
