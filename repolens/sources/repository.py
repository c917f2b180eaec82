"""Sources: a working tree, its history, session logs, pending queues, evaluation queries.

Listing a tree and asking git are driver work (a tree is a few thousand names); contents are read by
Spark's own readers where the tree lies in a store that executors see.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import glob_to_regex
from .schemas import SCHEMAS

#: Folders that are never entered.
EXCLUDED = ("node_modules", ".git", ".repolens")
FILE_ROW = "path string, content binary, size long, mtime long"


def _ignore_rules(folder: Path) -> list[tuple[re.Pattern, bool]]:
    out = []
    path = folder / ".gitignore"
    for line in path.read_text(errors="replace").splitlines() if path.is_file() else ():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.lstrip("!")
        glob = line.strip("/")
        anchored = "/" in line.rstrip("/")
        out.append((re.compile(glob_to_regex(glob if anchored else f"**/{glob}")), keep))
    return out


def walk(root: str) -> tuple[list[str], int]:
    """Relative paths under ``root`` in order, and how many were skipped (links, special files).
    The last rule of any level that matches decides; ignored files aren't counted."""
    found, skipped = [], 0

    def enter(folder: Path, rules: list) -> None:
        nonlocal skipped
        rules = [*rules, *((folder, p, keep) for p, keep in _ignore_rules(folder))]
        for x in sorted(folder.iterdir(), key=lambda p: p.name):
            rel = x.relative_to(root).as_posix()
            hit = [keep for base, p, keep in rules if p.match(x.relative_to(base).as_posix())]
            if x.name in EXCLUDED or (hit and not hit[-1]) or (x.name == "target" and ((Path(root) / "Cargo.toml").is_file() or (folder / "Cargo.toml").is_file())):
                continue
            if x.is_symlink() or not (x.is_dir() or x.is_file()):
                skipped += 1
            elif x.is_dir():
                enter(x, rules)
            else:
                found.append(rel)

    enter(Path(root), [])
    return sorted(found), skipped


def git(root: str, *args: str) -> str | None:
    """Output of a git command; null where it fails or takes more than ten seconds."""
    try:
        done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout


def list_files(root: str) -> tuple[list[str], int, bool]:
    """(paths, skipped, is_git): git's own list inside a repository, else a walk."""
    listed = git(root, "ls-files", "-co", "--exclude-standard", "-z") if (Path(root) / ".git").exists() else None
    if listed is not None:
        return sorted(x for x in listed.split("\0") if x and not set(x.split("/")) & set(EXCLUDED)), 0, True
    paths, skipped = walk(root)
    return paths, skipped, False


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_kb: int = 512, max_files: int = 20_000) -> tuple[DataFrame, int]:
    """(rows (path, content, size, mtime), skipped): regular files up to ``max_kb``, in path order,
    ``max_files`` at most; larger and further ones count as skipped."""
    paths, skipped, _ = list_files(root)
    unwanted = [re.compile(glob_to_regex(g)) for g in exclude]
    paths = [p for p in paths if not any(u.match(p) for u in unwanted)]
    skipped += max(0, len(paths) - max_files)
    rows = []
    for p in paths[:max_files]:
        x = Path(root) / p
        try:
            s = x.lstat()
            if not x.is_file() or x.is_symlink() or s.st_size > max_kb * 1024:
                skipped += 1
                continue
            rows.append((p, x.read_bytes(), s.st_size, int(s.st_mtime)))
        except FileNotFoundError:
            continue  # it went meanwhile: not counted
    return spark.createDataFrame(rows, FILE_ROW), skipped


def scan_store(spark: SparkSession, path: str, max_kb: int = 512) -> DataFrame:
    """The same rows from a folder of any store that Spark reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_kb * 1024)
    return df.select(F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/")) + "/", "").alias("path"), "content", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def commits(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(ord, commit, ts, subject, file), newest commit first; empty where git has no answer."""
    out, ord_, head = [], -1, None
    for line in (git(root, "log", "--name-only", "--pretty=%H%x09%ct%x09%s", "-n", str(most)) or "").splitlines():
        if m := re.match(r"([0-9a-f]{40})\t(\d+)\t(.*)", line):
            ord_, head = ord_ + 1, m
        elif line and head:
            out.append((ord_, head[1], int(head[2]), head[3][:80], line))
    return spark.createDataFrame(out, SCHEMAS["commits"])


def identity(root: str) -> dict:
    """Branch, head commit, remote and whether the tree has changes."""
    one = lambda *a: (git(root, *a) or "").strip() or None
    return {"branch": one("symbolic-ref", "--short", "-q", "HEAD"), "head_commit": one("rev-parse", "HEAD"), "remote_url": one("remote", "get-url", "origin"), "dirty": bool(one("status", "--porcelain"))}


def repositories(root: str, depth: int = 8) -> list[str]:
    """Folders that hold a ``.git``, to a depth, in order; found ones are entered as well."""
    out = []

    def enter(folder: Path, left: int) -> None:
        if (folder / ".git").exists():
            out.append(folder.as_posix())
        if left:
            for x in sorted(p for p in folder.iterdir() if p.is_dir() and not p.is_symlink() and p.name not in (*EXCLUDED, "dist", "build", "target", "vendor")):
                enter(x, left - 1)

    enter(Path(root), depth)
    return out


def session_events(spark: SparkSession, path: str) -> DataFrame:
    """Session logs (JSON lines); torn lines and rows without a kind are left out.  ``log`` is the
    file's name."""
    df = spark.read.schema(SCHEMAS["session_events"]).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("log", F.col("_metadata.file_name")).where("e is not null")


def pending(spark: SparkSession, path: str) -> DataFrame:
    """(f, since) of a pending queue; torn lines are left out."""
    return spark.read.schema(SCHEMAS["pending"]).json(path).where("f is not null").groupBy("f").agg(F.min("ts").alias("since"))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["eval_queries"]).option("multiLine", "true").json(path).where("query is not null")


def content_search(files: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Paths of files that hold a text as it is."""
    return files.where(F.contains(F.col("content").cast("string"), F.lit(text))).select("path").orderBy("path").limit(limit)
