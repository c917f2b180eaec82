"""Index build, store, sessions and streaming on small inputs made here."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from repolens.functions.parsers import parse
from repolens.operators import graph, history, lookup, maintenance, ranking, sessions, vectors
from repolens.plans import index
from repolens.sources import repository, store
from repolens.streaming import sessions as stream

FILES = {
    "src/index.ts": "import { createInvoice } from './billing/invoice';\nexport const run = () => createInvoice(1);\n",
    "src/billing/invoice.ts": "import { format } from '../util/format.js';\n// function ghost() {}\nexport interface Invoice { id: number }\nexport function createInvoice(n: number) {\n  const x = format(n);\n  state.total = x.size;\n  return x;\n}\nfunction hidden() {}\nexport class Box {\n  open(a: string) { return createInvoice(2); }\n}\n",
    "src/util/format.ts": "export function format(n: number) { return n; }\n",
    "src/billing/invoice.test.ts": "import { createInvoice } from './invoice';\ncreateInvoice(3);\n",
    "lib.rs": "mod parser;\nuse std::fmt;\npub struct Card;\nimpl Card {\n    pub fn evaluate(&self) -> u32 { parser::parse(1) }\n}\n",
    "parser.rs": "pub fn parse(x: u32) -> u32 { x }\n",
    "tool.py": "import os.path\n__all__ = ['go']\nLIMIT = 3\ndef go():\n    return os.getcwd()\nclass A:\n    def m(self):\n        self.x = go()\n",
    "README.md": "# Title\ntext\n## Part two\n#### deep\n",
    "dist/gen.js": "function createInvoice() {}\n",
    ".env": "SECRET=1\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    (root / ".gitignore").write_text("*.log\n!keep.log\n/out\n")
    (root / "a.log").write_text("x")
    (root / "keep.log").write_text("x")
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("x")
    (root / "link").symlink_to(root / "lib.rs")
    files, skipped = repository.scan(spark, str(root))
    assert skipped == 1 and {r.path for r in files.select("path").collect()} == {*FILES, ".gitignore", "keep.log"}
    return index.build(files)


def test_symbols(built):
    got = {(r.file, r.name, r.kind, r.exported) for r in built["symbols"].collect()}
    assert ("src/billing/invoice.ts", "createInvoice", "function", True) in got and ("src/billing/invoice.ts", "hidden", "function", False) in got
    assert ("src/billing/invoice.ts", "open", "method", False) in got and not any(n == "ghost" for _, n, _, _ in got)
    assert ("lib.rs", "evaluate", "method", True) in got and ("tool.py", "go", "function", True) in got and ("tool.py", "A", "class", False) in got


def test_edges_and_tests(built):
    edges = {(r.src, r.dst) for r in built["edges"].collect()}
    assert edges == {("src/index.ts", "src/billing/invoice.ts"), ("src/billing/invoice.ts", "src/util/format.ts"), ("src/billing/invoice.test.ts", "src/billing/invoice.ts"), ("lib.rs", "parser.rs")}
    assert {(r.source, r.test) for r in built["tests"].collect()} == {("src/billing/invoice.ts", "src/billing/invoice.test.ts")}


def test_records_calls_fields(built):
    files = {r.path: r for r in built["files"].collect()}
    assert files["src/billing/invoice.ts"].exports == ["Invoice", "createInvoice", "Box"] and files[".env"].h == "" and files[".env"].kind == "secret"
    assert files["dist/gen.js"].kind == "generated" and files["README.md"].doc_headings == ["Title", "Part two"] and files["tool.py"].external_deps == ["os"]
    calls = {(r.file, r.callee, r.caller) for r in built["calls"].collect()}
    assert ("src/billing/invoice.ts", "format", "createInvoice") in calls and ("lib.rs", "parse", "evaluate") in calls and ("tool.py", "go", "m") in calls
    fields = {(r.field, r.kind) for r in built["fieldaccess"].where("file like '%invoice.ts'").collect()}
    assert ("total", "write") in fields and ("size", "read") in fields
    assert "invoice" in {r.token for r in built["postings"].collect()}


def test_parsers_never_raise():
    for lang in ("ts", "rust", "python", "md", "json"):
        for text in (None, "", "{", "}}}", "def (", "\"unclosed", "/* open", "é☃" * 50):
            assert isinstance(parse(lang, text), list)


def test_store(spark, tmp_path):
    base = str(tmp_path)
    assert store.load(spark, base, "edges").count() == 0
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    store.commit(spark, base, {"edges": e}, 1)
    store.commit(spark, base, {"edges": e.union(e.select("dst", "src"))}, 2)
    assert store.load(spark, base, "edges").count() == 2 and store.load(spark, base, "calls").count() == 0


def test_history(spark):
    log = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (3, "a")], "c int, f string")
    assert {(r.f, r.n_commits) for r in history.churn(log, "c", "f").collect()} == {("a", 3), ("b", 2), ("c", 1)}
    assert {(r.f, r.partner, r.n) for r in history.co_change(log, "c", "f").collect()} == {("a", "b", 2), ("b", "a", 2)}
    assert history.co_change(log.where("false"), "c", "f").count() == 0


def test_graph(spark):
    e = graph.edges(spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("a", "a")], "s string, t string"), "s", "t")
    assert [r.path for r in graph.shortest_paths(e, "a", "e").orderBy("rank").collect()] == [["a", "b", "d", "e"], ["a", "c", "d", "e"]]
    assert graph.shortest_paths(e, "e", "a").count() == 0 and graph.shortest_paths(e, "a", "a").first().path == ["a"]
    assert {(r.node, r.hops) for r in graph.reachable(e, "a").collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}
    calls = e.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), F.lit(1).alias("ord"))
    assert [(r.caller, r.callee) for r in graph.call_chain(calls, "a").orderBy("ord").collect()] == [("a", "b"), ("b", "d"), ("d", "a"), ("d", "e"), ("a", "c"), ("c", "d")]


def test_ranking(spark):
    df = spark.createDataFrame([("x", ["db", "query"]), ("y", ["query"]), ("z", [])], "k string, terms array<string>")
    r = ranking.bm25f(df, "k", [(F.col("terms"), 4.0)], [("db", 1.0), ("query", 1.0)]).collect()
    assert {x.k for x in r} == {"x", "y"} and max(r, key=lambda x: x.score).k == "x"
    assert ranking.expand([("auth", 1.0)], {"auth": ["authentication"]}) == [("auth", 1.0), ("authentication", 0.5)]
    lex = spark.createDataFrame([("auth", 10.0)], "k string, score double")
    cos = spark.createDataFrame([("auth", 0.5), ("guard", 0.7), ("other", 0.05)], "k string, cos double")
    assert {x.k for x in ranking.fuse(lex, cos, "k").collect()} == {"auth", "guard"}
    cost = spark.createDataFrame([(1, 5), (2, 4), (3, 9), (4, 1)], "k int, c int")
    assert [x.k for x in ranking.budgeted(cost, [F.col("k")], "c", 10).orderBy("k").collect()] == [1, 2]


def test_vectors(spark):
    df = spark.createDataFrame([("a.ts", 1, [0.3, 0.95]), ("a.ts", 2, [1.0, 0.0]), ("b.ts", 3, [0.0, 1.0])], "path string, id int, v array<float>")
    assert [r.id for r in vectors.knn(df, "id", "v", [1.0, 0.0], 2).collect()] == [2, 1]
    assert {(r.path, r.best_key) for r in vectors.group_best(df, "path", "id", "v", [1.0, 0.0]).collect()} == {("a.ts", 2), ("b.ts", 3)}
    e = spark.createDataFrame([("a b a",), (None,)], "t string").select(vectors.hash_embedding(F.col("t"), 8).alias("e")).collect()
    assert sum(x * x for x in e[0].e) == pytest.approx(1) and sum(e[1].e) == 0


def test_lookup(spark):
    df = spark.createDataFrame([(1, "createInvoice"), (2, "invoice"), (3, "toString")], "id int, name string")
    assert [r.id for r in lookup.symbol_search(df, "name", ["name", "id"], "Invoice").collect()] == [2, 1]
    p = spark.createDataFrame([(1, "pkg/a/src/x.ts"), (2, "other.ts")], "id int, path string")
    d = spark.createDataFrame([("pkg",), ("pkg/a",), ("pk",)], "dir string")
    assert {(r.id, r.dir) for r in lookup.longest_prefix(p, "id", F.col("path"), d, "dir").collect()} == {(1, "pkg/a"), (2, None)}


def test_maintenance(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1), ("c", None)], "k string, v int")
    diff = maintenance.changes(old, new, "k", "v")
    assert {(r.k, r.change) for r in diff.collect()} == {("b", "modified"), ("d", "added")} and maintenance.mode(diff) == "full"
    assert maintenance.mode(diff.where("false")) == "noop" and maintenance.patched(old, new.where("k = 'b'"), "k").count() == 3
    hits = spark.createDataFrame([("x", 1), ("x", 4), ("y", None)], "g string, rank int")
    total = maintenance.evaluation(hits, "g").where("is_total = 1").first()
    assert (total.n, total.hit1, total.hit3, total.hitk, total.mrr) == (3, 1, 1, 2, pytest.approx((1 + 0.25) / 3))


EVENTS = [("s1", i, 100 + i, e, f) for i, (e, f) in enumerate([("read", "a"), ("read", "b"), ("read", "c"), ("mcp", None), ("read", "d"), ("edit", "a")])] + [("s2", 0, 100, "read", "a")]


def test_sessions(spark):
    ev = spark.createDataFrame(EVENTS, "session string, seq long, ts long, e string, f string")
    s = sessions.read_streak(ev, "session", ["seq"], "e")
    assert {(r.session, r.f, r.streak) for r in s.collect()} == {("s1", "a", 1), ("s1", "b", 2), ("s1", "c", 3), ("s1", "d", 1), ("s2", "a", 1)}
    assert [r.f for r in sessions.nudges(s, 3).collect()] == ["c"]


def test_stream(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    lines = [json.dumps({"session": s, "seq": q, "ts": t, "e": e, "f": f}) for s, q, t, e, f in EVENTS]
    (src / "1.jsonl").write_text("\n".join(lines[:3]) + "\n{torn\n")
    (src / "2.jsonl").write_text("\n".join(lines[2:]) + "\n")  # one event comes twice
    stream.run_available(stream.session_state(stream.read_events(spark, str(src))), str(tmp_path / "c"), "reads_out")
    got = {(r.session, r.seq, r.streak, r.nudge) for r in spark.sql("select * from reads_out").collect()}
    assert got == {("s1", 0, 1, False), ("s1", 1, 2, False), ("s1", 2, 3, True), ("s1", 4, 1, False), ("s2", 0, 1, False)}
    q = stream.read_events(spark, str(src)).writeStream.foreachBatch(stream.pending_sink(str(tmp_path / "p"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.f for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {"a", "b", "c", "d"}
    assert repository.session_events(spark, str(src)).count() == 8


def test_hash_embedding_counts_each_word_once(spark):
    def fnv(word):
        h = 2166136261
        for x in word.encode():
            h = (h ^ x) * 16777619 % 2**32
        return h

    words = [f"w{k % 997}x{k}" for k in range(20_000)]  # was computed anew for each pair of cells: minutes
    texts = [" ".join(words), "Éa-B9 é!", "", "x" * 5_000]
    got = [r.e for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").coalesce(1).select("k", vectors.hash_embedding(F.col("t"), 32).alias("e")).orderBy("k").collect()]
    for e, own in zip(got, (words, ["a", "b9"], [], ["x" * 5_000]), strict=True):
        counts = [0.0] * 32
        for w in own:
            counts[fnv(w) % 32] += 1
        norm = sum(x * x for x in counts) ** 0.5 or 1.0
        assert e == pytest.approx([x / norm for x in counts])


def test_neighbourhood_of_one_large_group_keeps_few_others(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from repolens.plans import ORACLES, QUERIES

    parts = [(k, f"B{k % 2}" if k < 40 else "B0", f"T{k % 3}" if k < 40 else "T0", 7) for k in range(3_000)]
    parts += [(5, "B1", "T0", 7), (5, "B2", "T0", 7), (6, None, "T0", 7), (None, "B0", "T0", 7), (9_000, "B3", "T0", 7), (9_001, "B0", "T0", 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 5), (1, 7), (2, 7), (2, 7), (2, None)], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["related_neighbourhood"](spark, str(tmp_path))
    assert "dense_rank" in df._jdf.queryExecution().optimizedPlan().toString()  # others are ranked before the join: 9 million pairs without
    got = sorted(map(tuple, df.collect()), key=str)
    c = duckdb.connect()
    for name in ("part", "lineitem"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLES["related_neighbourhood"]).fetchall(), key=str)
