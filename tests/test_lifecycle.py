"""The index command end to end on small trees, and the session operators."""

from __future__ import annotations

import subprocess

from pyspark.sql import functions as F

from repolens.operators import hooks
from repolens.plans import lifecycle
from repolens.sources import store

FILES = {
    "package.json": '{"name": "shop", "main": "src/index.ts", "scripts": {"test": "vitest", "build": "tsc"}}',
    "tsconfig.json": '{"compilerOptions": {"paths": {"@app/*": ["src/*"]}}}',
    "src/index.ts": "import { createInvoice } from '@app/billing/invoice';\nexport const run = () => createInvoice(1);\n",
    "src/billing/invoice.ts": "import { format } from '../util/format';\nexport function createInvoice(n: number) {\n  return format(n);\n}\n",
    "src/billing/invoice.test.ts": "import { createInvoice } from './invoice';\ncreateInvoice(3);\n",
    "src/util/format.ts": "export function format(n: number) { return n; }\n",
    "src/api/client.gen.ts": "export const x = 1;\n", "Dockerfile": "FROM x\n", ".env": "SECRET=1\n", "bin.dat": "P\n\0x",
}


def test_index_command(spark, tmp_path):
    root, base = tmp_path / "tree", str(tmp_path / "index")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for subject in ("one", "two"):
        (root / "src/util/format.ts").write_text(FILES["src/util/format.ts"] + f"// {subject}\n")
        (root / "src/billing/invoice.ts").write_text(FILES["src/billing/invoice.ts"] + f"// {subject}\n")
        git("add", "-A")
        git("commit", "-qm", subject)
    repo = lifecycle.Repository(spark, str(root), base)
    assert lifecycle.root_of(str(root / "src/util")) == root.as_posix() and store.current(spark, base) is None
    assert repo.ensure() == "fresh" and repo.ensure() == "fresh"
    files = {r.path: r for r in repo.load("files").collect()}
    assert files["src/billing/invoice.ts"].churn == 2 and files["src/billing/invoice.ts"].last_ts > 0 and files["src/index.ts"].entry and files["src/index.ts"].pkg == 0
    assert files[".env"].kind == "secret" and files[".env"].h == "" and files["Dockerfile"].risk == "infra" and files["src/api/client.gen.ts"].risk == "generated" and files["bin.dat"].kind == "asset"
    edges = {(r.src, r.dst) for r in repo.load("edges").collect()}
    assert ("src/index.ts", "src/billing/invoice.ts") in edges and ("src/billing/invoice.ts", "src/util/format.ts") in edges
    assert {(r.file, r.partner, r.n) for r in repo.load("cochange").collect()} == {("src/util/format.ts", "src/billing/invoice.ts", 2), ("src/billing/invoice.ts", "src/util/format.ts", 2)}
    meta = repo.load("meta").first()
    assert meta.project_type == "ts-app" and meta.is_git and not meta.partial and meta.file_count == len(FILES)
    engine = repo.engine()
    assert engine.rank("fix createInvoice rounding", meta.indexed_at).orderBy("rank").first().path == "src/billing/invoice.ts"
    assert lifecycle.brief(engine)["entrypoints"] == ["src/index.ts"] and "invoice" in {r.token for r in repo.load("postings").collect()}
    assert repo.refresh() == "noop"
    (root / "src/util/format.ts").write_text("export function money(n: number) { return n; }\n")
    assert repo.refresh() == "incremental"
    names = {r.name for r in repo.load("symbols").collect()}
    assert "money" in names and "format" not in names and "createInvoice" in names and {(r.src, r.dst) for r in repo.load("edges").collect()} == edges
    git("commit", "-qam", "three")
    assert repo.refresh() == "git" and repo.load("meta").first().head_commit != meta.head_commit and repo.refresh() == "noop"
    (root / "src/util/new.ts").write_text("export const y = 2;\n")
    assert repo.refresh() == "full" and "src/util/new.ts" in {r.path for r in repo.load("files").collect()}


def test_settings_and_lock(tmp_path):
    (tmp_path / "a.json").write_text('{"max_kb": 1, "inject": {"shadow": true}}')
    (tmp_path / "b.json").write_text("{broken")
    got = lifecycle.settings(str(tmp_path / "a.json"), str(tmp_path / "b.json"), str(tmp_path / "c.json"))
    assert got["max_kb"] == 1 and got["inject"] == {"gate": True, "shadow": True}
    lock = lifecycle.Lock(str(tmp_path))
    assert not lock.held()
    with lock:
        assert lock.held()
    (tmp_path / "lock.json").write_text('{"pid": 1, "started": 0}')
    assert not lock.held()


def test_session_operators(spark):
    pair = lambda rows: spark.createDataFrame(rows, "session string, file string")
    tests = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1")], "source string, test string")
    got = hooks.unread_tests(pair([("s", "a"), ("s", "b"), ("t", "a"), ("t", "c")]), tests, pair([("s", "b1"), ("t", "x")]), pair([("u", "a")])).collect()
    assert {(r.session, r.file, tuple(r.tests)) for r in got} == {("s", "a", ("a1", "a2")), ("t", "a", ("a1", "a2"))}
    packs = spark.createDataFrame([("high", 2, 9), ("medium", 1, 9), ("low", 1, 9), ("high", 0, 9)], "c string, n int, t int")
    assert [(r.form, r.injected, r.tok) for r in hooks.pack_events(packs, "c", "n", "t").collect()] == [("full", True, 9), ("compact", True, 9), ("line", True, 9), (None, False, 0)]
    assert not any(r.injected for r in hooks.pack_events(packs, "c", "n", "t", shadow=True).collect())
    probe = spark.createDataFrame([("a", 5), ("b", None), ("c", 13)], "path string, mtime long")
    assert [r.path for r in hooks.stale(probe, "path", "mtime", 10).orderBy("path").collect()] == ["b", "c"]
    refs = spark.createDataFrame([("f", 2), ("f", 9), ("g", 1)], "file string, line int")
    contents = spark.createDataFrame([("f", "a\n  b  \nc")], "path string, content string")
    assert {(r.file, r.line, r.snippet) for r in hooks.snippets(refs, contents).collect()} == {("f", 2, "b"), ("f", 9, None), ("g", 1, None)}
    header = spark.createDataFrame([(1, "m", 64)], "version int, model string, dim int")
    assert hooks.usable_vectors(refs, header, {"version": 1, "model": "m", "dim": 64}).count() == 3 and hooks.usable_vectors(refs, header, {"version": 1, "model": "n", "dim": 64}).count() == 0
    nodes = spark.createDataFrame([(1, None, "A"), (2, 1, ""), (3, 2, "f"), (4, None, "g")], "id int, up int, name string")
    assert [(r.id, r.chain, r.depth) for r in hooks.tree_rows(nodes, "id", "up", "name").orderBy("path").collect()] == [(1, [], 0), (2, ["A"], 1), (3, ["A"], 2), (4, [], 0)]
    assert hooks.shrink({"tree": ["x" * 40] * 3, "rules": ["keep"]}, 12) == {"tree": ["x" * 40], "rules": ["keep"]}
    chunk = spark.range(1).select(hooks.symbol_chunk(F.lit("src/taxRate.ts"), F.array(F.lit("Box")), F.lit("method"), F.lit("open"), F.lit("doc"), F.lit("x" * 2000)).alias("c")).first().c
    assert chunk.startswith("src tax rate ts Box\nmethod open\ndoc\nxxx") and len(chunk) < 1100
