"""Index build: contents -> files, symbols, calls, fields, import edges, tests, postings.

One ``mapInArrow`` pass parses each content once; everything after it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import split_identifier
from ..operators import graph, lookup

_PARSED = "file string, kind string, name string, line int, exported boolean, parent string, detail string"
# Endings tried for an import, in order.
SUFFIXES = ("", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def parsed(files: DataFrame) -> DataFrame:
    """Rows of all parsers over (path, content); secret and binary files are never read as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.parsers import parse

        for b in batches:
            rows = [(p, *r) for p, lang, c in zip(b.column("path").to_pylist(), b.column("lang").to_pylist(), b.column("content").to_pylist(), strict=True) if c and b"\0" not in c[:8192] for r in parse(lang, c.decode("utf-8", "replace"))]
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["file", "kind", "name", "line", "exported", "parent", "detail"])

    readable = files.where(F.coalesce(classify.risk_kind(F.col("path")), F.lit("")) != "secret")
    return readable.select("path", classify.language_of(F.col("path")).alias("lang"), "content").mapInArrow(run, _PARSED)


def file_records(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One record a file: hash, lines, language, kind, exports (30), external packages (15), headings (10)."""
    risk = classify.risk_kind(F.col("path"))
    text = F.col("content").cast("string")
    binary = F.expr("position(X'00', substring(content, 1, 8192)) > 0")
    base = files.select(
        "path", F.when(F.coalesce(risk, F.lit("")) == "secret", "").otherwise(F.substring(F.sha1("content"), 1, 12)).alias("h"), "mtime", "size",
        F.when(F.length("content") == 0, 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("lines"), classify.language_of(F.col("path")).alias("lang"),
        F.when(risk == "secret", "secret").when(binary, "asset").when(risk.isNotNull(), risk).when(classify.is_test(F.col("path")), "test").when(F.col("path").rlike("\\.md$"), "doc").otherwise("source").alias("kind"),
        risk.alias("risk"), classify.is_test(F.col("path")).alias("is_test"),
    )
    ordered = lambda cond, n: F.slice(F.transform(F.sort_array(F.collect_set(F.when(cond, F.struct("line", "name")))), lambda x: x["name"]), 1, n)
    grouped = rows.groupBy(F.col("file").alias("path")).agg(
        ordered(F.col("exported"), 30).alias("exports"), F.slice(F.sort_array(F.collect_set(F.when(F.col("kind") == "import", classify.external_package(F.col("name"))))), 1, 15).alias("external_deps"), ordered(F.col("kind") == "heading", 10).alias("doc_headings"),
    )
    return base.join(grouped, "path", "left")


def import_edges(rows: DataFrame, paths: DataFrame, aliases: list[tuple[str, str, str]] = (), packages: list[tuple[str, str]] = ()) -> DataFrame:
    """(src, dst): relative imports, then path aliases (folder, prefix, target; longest prefix first),
    then workspace packages (name, entry), resolved by trying endings in order; Rust ``mod`` rows name
    the files beside or below them."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    target = F.when(F.col("name").startswith("."), F.concat_ws("/", F.when(folder != "", folder), F.col("name")))
    for where, prefix, to in aliases:
        target = target.when(F.col("name").startswith(prefix) & (F.col("file").startswith(f"{where}/") if where else F.lit(True)), F.concat(F.lit(f"{to}/" if to else ""), F.substring("name", len(prefix) + 1, 1 << 20)))
    for name, entry in packages:
        target = target.when(F.col("name") == name, F.lit(entry))
    imports = rows.where("kind = 'import'").withColumn("joined", target).where("joined is not null").select("file", "name", "joined", F.monotonically_increasing_id().alias("id"))
    joined = F.col("joined")
    parts = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda a, x: F.when((x == ".") | (x == ""), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    path = F.array_join(parts, "/")
    typed = F.when(path.rlike("\\.(m|c)?jsx?$"), F.regexp_replace(path, "js(x?)$", "ts$1"))
    tried = imports.withColumn("p", path).withColumn("t", typed)
    candidates = [F.col("p"), F.col("t"), *[F.concat("p", F.lit(s)) for s in SUFFIXES[1:]]]
    hit = lookup.resolve(tried, "id", candidates, paths.select(F.col("path").alias("dst")), "dst")
    found = imports.join(hit, "id").select("file", "dst")
    mods = rows.where("kind = 'module' and file like '%.rs'").select("file", "name", F.monotonically_increasing_id().alias("id")).withColumn("d", folder).withColumn("stem", F.regexp_replace("file", "\\.rs$", ""))
    at = lambda *x: F.concat_ws("/", *x)
    here = F.when(F.col("d") != "", F.col("d"))
    rust = lookup.resolve(mods, "id", [F.concat(at("stem", "name"), F.lit(".rs")), F.concat(at(here, F.col("name")), F.lit(".rs")), F.concat(at(here, F.col("name")), F.lit("/mod.rs"))], paths.select(F.col("path").alias("dst")), "dst")
    return graph.edges(found.union(mods.join(rust, "id").select("file", "dst")), "file", "dst")


def tests_of(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, test): siblings by stem, then imports of a test file."""
    stem = F.regexp_replace(F.regexp_replace("path", "(^|/)__tests__/", "$1"), "(\\.(test|spec))?\\.[a-z]+$", "")
    by_name = lookup.test_links(files, "path", stem, F.col("is_test"))
    tests = files.where("is_test").select(F.col("path").alias("test"))
    sources = files.where("not is_test").select(F.col("path").alias("source"))
    by_import = edges.join(tests, edges.src == tests.test).join(sources, F.col("dst") == F.col("source")).select("source", "test")
    return by_name.union(by_import).distinct()


#: Rows of the parsers from which edges are resolved.
IMPORT_ROWS = "kind = 'import' OR kind = 'module'"


def postings_of(symbols: DataFrame) -> DataFrame:
    key = F.concat_ws(":", "file", "line", "name")
    return lookup.inverted_index(symbols.withColumn("key", key), "key", F.concat(F.array(F.lower("name")), split_identifier(F.col("name"))))


def tables_of(files: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The tables that each file gives by itself, from the parsers' rows."""
    symbols = rows.where("kind not in ('import', 'call', 'field', 'heading')").select("file", "kind", "name", "line", "exported", "parent", "detail")
    return {
        "files": file_records(files, rows), "symbols": symbols, "postings": postings_of(symbols),
        "calls": rows.where("kind = 'call'").select("file", F.col("name").alias("callee"), "line", F.col("parent").alias("caller")),
        "fieldaccess": rows.where("kind = 'field'").select("file", F.col("name").alias("field"), "line", F.col("detail").alias("kind"), F.col("parent").alias("caller")),
    }


def build(files: DataFrame, aliases: list[tuple[str, str, str]] = (), packages: list[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """All tables of an index over (path, content, size, mtime)."""
    rows = graph.kept(parsed(files))
    tables = tables_of(files, rows)
    edges = import_edges(rows, files, aliases, packages)
    return tables | {"edges": edges, "tests": tests_of(tables["files"], edges)}
