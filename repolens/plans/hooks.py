"""Queries of the session operators and of the index tables over generated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import classify, guard
from ..operators import hooks
from . import index
from ._register import read, registry
from .sessions import _EV, _events

QUERIES, ORACLES, query = registry()

_CONFIDENCE = "CASE WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END"


@query("pack_events", f"SELECT event_id, CASE WHEN k % 4 > 0 THEN CASE {_CONFIDENCE} WHEN 'high' THEN 'full' WHEN 'medium' THEN 'compact' ELSE 'line' END END AS form, k % 4 > 0 AS injected, CASE WHEN k % 4 > 0 THEN k ELSE 0 END AS tok FROM (SELECT event_id, coalesce(value, 0) AS value, (props->>'k')::bigint AS k FROM events) WHERE k IS NOT NULL")
def pack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of each event's pack; its value stands for the confidence, k % 4 for the files."""
    ev = _events(spark, sf_dir).where("k is not null").select("event_id", F.expr(_CONFIDENCE).alias("confidence"), (F.col("k") % 4).alias("n"), "k")
    return hooks.pack_events(ev, "confidence", "n", "k").select("event_id", "form", "injected", F.col("tok").cast("long").alias("tok"))


@query("unread_tests", f"""WITH {_EV}, e AS (SELECT DISTINCT user_id, k FROM ev WHERE kind = 'pack' AND k IS NOT NULL), r AS (SELECT DISTINCT user_id, k FROM ev WHERE kind = 'read' AND k IS NOT NULL),
 t AS (SELECT i AS source, (i * 7 + 1) % 100 AS test FROM range(100) x(i) UNION SELECT i, (i + 13) % 100 FROM range(100) x(i)),
 a AS (SELECT e.user_id, e.k, list_sort(list(t.test)) AS tests, count(r.k) AS seen FROM e JOIN t ON t.source = e.k LEFT JOIN r ON r.user_id = e.user_id AND r.k = t.test GROUP BY e.user_id, e.k)
 SELECT user_id AS session, k AS file, tests FROM a WHERE seen = 0""")
def unread_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a user buys without having seen any of the two items which stand for their tests."""
    ev = _events(spark, sf_dir).where("k is not null").select(F.col("user_id").alias("session"), F.col("k").alias("file"), "kind")
    n = spark.range(100)
    tests = n.select(F.col("id").alias("source"), ((F.col("id") * 7 + 1) % 100).alias("test")).union(n.select("id", (F.col("id") + 13) % 100))
    return hooks.unread_tests(ev.where("kind = 'pack'"), tests, ev.where("kind = 'read'"))


@query("stale_files", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE epoch(o_orderdate::timestamp)::bigint END AS t FROM orders ORDER BY o_orderkey LIMIT 30) WHERE t IS NULL OR t > 800000002")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 orders as probed files: dates as times, every fifth is missing."""
    at = F.when(F.col("o_orderkey") % 5 != 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return hooks.stale(read(spark, sf_dir, "orders").select("o_orderkey", at.alias("t")), "o_orderkey", "t", 800_000_000)


@query("top_reasons", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0) DESC, event_id)::int AS rank FROM events) WHERE rank <= 3")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.top_reasons(_events(spark, sf_dir), "user_id", "value", "event_id").select("user_id", "event_id", "rank")


@query("reference_snippets", "SELECT doc_id AS file, line::int AS line, CASE WHEN length(s) > 120 THEN substr(s, 1, 119) || '…' ELSE s END AS snippet FROM (SELECT doc_id, doc_id % 7 + 1 AS line, trim(string_split(text, chr(10))[doc_id % 7 + 1]) AS s FROM documents)")
def reference_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference into each document, to one of its first seven lines (null where it is shorter)."""
    docs = read(spark, sf_dir, "documents")
    refs = docs.select(F.col("doc_id").alias("file"), (F.col("doc_id") % 7 + 1).cast("int").alias("line"))
    return hooks.snippets(refs, docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("latest_session", "SELECT event_type, arg_min(user_id, (-epoch_us(ts), user_id)) AS user_id FROM events GROUP BY event_type")
def latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").select("event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return hooks.latest(ev, ["event_type"], "user_id", "t").select("event_type", "user_id")


@query("branch_catalog", """WITH b AS (SELECT n_regionkey AS repo, n_nationkey AS branch FROM nation), m AS (SELECT s_nationkey AS branch, max(s_suppkey) AS indexed_at FROM supplier GROUP BY s_nationkey)
 SELECT r_regionkey AS repo, b.branch, coalesce(b.branch = r_regionkey * 2, false) AS current, m.indexed_at FROM region LEFT JOIN b ON b.repo = r_regionkey LEFT JOIN m ON m.branch = b.branch""")
def branch_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as repositories, nations as branches, a nation's newest supplier as its index's time."""
    repos = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("repo"), (F.col("r_regionkey") * 2).alias("head"))
    branches = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("repo"), F.col("n_nationkey").alias("branch"))
    meta = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("branch")).agg(F.max("s_suppkey").alias("indexed_at")).join(branches, "branch")
    return hooks.catalog(repos, branches, meta.select("repo", "branch", "indexed_at"))


@query("result_breadth", "SELECT user_id, count(DISTINCT (props->>'k')) AS n_files, count(*) AS n_rows FROM events GROUP BY user_id")
def result_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hooks.breadth(_events(spark, sf_dir), "user_id", "k")


@query("vector_header", "SELECT vec_id, label FROM embeddings WHERE (SELECT min(len(embedding)) = 64 AND max(len(embedding)) = 64 FROM embeddings)")
def vector_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose table says what the query needs: this one has 64 components in every row."""
    v = read(spark, sf_dir, "embeddings")
    header = v.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("dim"))
    return hooks.usable_vectors(v.select("vec_id", "label"), header, {"least": 64, "dim": 64})


@query("search_gate", "SELECT conv_id, turn, CASE WHEN length(q) >= 3 AND conv_id % 7 <> 0 AND turn % 5 < 4 THEN q END AS words FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,'\\[[^\\]]*\\]',' ','g'),'\\\\[a-zA-Z]',' ','g'),'[\\\\^$.|?*+(){}]',' ','g'),'\\s+',' ','g')) AS q FROM conversations)")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as searches; every seventh conversation's index is partial, every fifth turn finds nothing."""
    words = hooks.search_gate(F.col("text"), F.col("conv_id") % 7 == 0, F.lit(4) - F.col("turn") % 5)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))


@query("read_warnings", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'low-value' WHEN p_retailprice > 1200 THEN 'huge' WHEN p_size >= 25 THEN 'repeated' END AS warning FROM part")
def read_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    risk = F.when(F.col("p_partkey") % 3 == 0, F.when(F.col("p_partkey") % 2 == 0, "generated").otherwise("vendor"))
    return part.select("p_partkey", classify.read_warning(risk, F.when(F.col("p_retailprice") > 1200, 3001).otherwise(3000), F.when(F.col("p_size") >= 25, 2).otherwise(1)).alias("warning"))


_SEARCHES = ("find . -name x", "rg foo src", "cat a; grep -r foo /", "trace_symbol x", "ls && rg foo", "rm -rf build && find /")
_BROAD = (("find-broad", 0), None, ("broad-grep", 1), ("index-cli-via-shell", 0), ("broad-grep", 1), ("find-broad", 1))


@query("broad_discovery", f"SELECT event_id, rule, seq FROM events JOIN (VALUES {', '.join(f'({i}, {b[0]!r}, {b[1]})' for i, b in enumerate(_BROAD) if b)}) v(i, rule, seq) ON event_id % {len(_SEARCHES)} = i")
def broad_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first verdict of each event's command that a query of the index should replace."""
    command = F.element_at(F.array(*map(F.lit, _SEARCHES)), (F.col("event_id") % len(_SEARCHES) + 1).cast("int"))
    broad = F.filter(guard.verdicts(command), lambda v: v["rule"].isin(*guard.BROAD))
    found = read(spark, sf_dir, "events").select("event_id", F.get(broad, F.lit(0)).alias("v")).where("v is not null")
    return found.select("event_id", "v.rule", "v.seq")


@query("tree_rows", """WITH RECURSIVE n AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 1 THEN (p_partkey - 2) // 8 + 1 END AS up, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS name FROM part),
 w(k, name, chain, depth) AS (SELECT k, name, []::varchar[], 0 FROM n WHERE up IS NULL UNION ALL SELECT n.k, n.name, CASE WHEN w.name <> '' THEN list_append(w.chain, w.name) ELSE w.chain END, w.depth + 1 FROM w JOIN n ON n.up = w.k) SELECT * FROM w""")
def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree of symbols: eight below each, every third without a name."""
    part = read(spark, sf_dir, "part")
    nodes = part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") > 1, F.expr("(p_partkey - 2) div 8 + 1")).alias("up"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")).alias("name"))
    return hooks.tree_rows(nodes, "k", "up", "name").drop("path")


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Index tables of a source file for each part, that imports and calls another one's function; every
    fifth part has a test."""
    key, other = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 50 + 1).cast("string")
    part = read(spark, sf_dir, "part")
    text = F.concat(F.lit("import { f"), other, F.lit(" } from './p"), other, F.lit("'\nexport function f"), key, F.lit("() { return f"), other, F.lit("() }\n"))
    own = part.select(F.concat(F.lit("src/p"), key, F.lit(".ts")).alias("path"), text.alias("text"))
    tests = part.where("p_partkey % 5 = 0").select(F.concat(F.lit("src/p"), key, F.lit(".test.ts")).alias("path"), F.concat(F.lit("import { f"), key, F.lit(" } from './p"), key, F.lit("'\n")).alias("text"))
    files = own.union(tests).select("path", F.col("text").cast("binary").alias("content"), F.length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    return index.build(files)


_P = "p AS (SELECT p_partkey::varchar AS k, (p_partkey % 50 + 1)::varchar AS j, p_partkey AS n FROM part)"


@query("index_edges", f"WITH {_P} SELECT 'src/p' || k || '.ts' AS src, 'src/p' || j || '.ts' AS dst FROM p WHERE j IN (SELECT k FROM p) UNION ALL SELECT 'src/p' || k || '.test.ts', 'src/p' || k || '.ts' FROM p WHERE n % 5 = 0")
def index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)["edges"]


@query("index_files", f"WITH {_P} SELECT 'src/p' || k || '.ts' AS path, 'source' AS kind, 'ts' AS lang, ['f' || k] AS exports, false AS is_test FROM p UNION ALL SELECT 'src/p' || k || '.test.ts', 'test', 'ts', [], true FROM p WHERE n % 5 = 0")
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)["files"].select("path", "kind", "lang", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), "is_test")


@query("index_tests", f"WITH {_P} SELECT 'src/p' || k || '.ts' AS source, 'src/p' || k || '.test.ts' AS test FROM p WHERE n % 5 = 0")
def index_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)["tests"]


@query("index_calls", f"WITH {_P} SELECT 'f' || k AS caller, 'f' || j AS callee, 'src/p' || k || '.ts' AS file, 'src/p' || j || '.ts' AS target, 'import' AS via FROM p WHERE j IN (SELECT k FROM p)")
def index_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the generated sources, resolved to the files they import."""
    return Engine(spark, _sources(spark, sf_dir)).resolved_calls().select("caller", "callee", "file", "target", "via")


@query("index_postings", f"WITH {_P} SELECT 'f' || k AS token, ['src/p' || k || '.ts:2:f' || k] AS ids FROM p UNION ALL SELECT k, ['src/p' || k || '.ts:2:f' || k] FROM p WHERE length(k) >= 2")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir)["postings"].select("token", F.sort_array("ids").alias("ids"))
