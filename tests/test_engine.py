"""The engine over a small in-memory index: ranking, packs and lookups."""

from __future__ import annotations

import pytest

from repolens.engine import EMPTY, Engine, task_terms

NOW = 1_750_000_000
DAY = 86_400


@pytest.fixture(scope="module")
def engine(spark):
    f = lambda path, exports=(), risk=None, pkg=0, entry=False, days=None, kind="source", heads=(): (path, 100, "ts", pkg, kind, risk, entry, list(exports), list(heads), NOW - days * DAY if days is not None else None)
    files = [
        f("src/billing/invoice.ts", ["createInvoice", "Invoice"], days=2), f("src/billing/customer.ts", ["Customer"], days=60), f("src/api/billing.ts", ["billingRouter"], entry=True), f("src/billing/invoice.test.ts", kind="test", days=1),
        f("dist/gen.js", ["createInvoice"], "generated", -1), f("Dockerfile", risk="infra", pkg=-1), f("README.md", pkg=-1, kind="doc", heads=["Billing pipeline"]), f("src/util/format.ts", ["formatDate", "formatMoney"]), f("src/core/db.ts", ["query", "connect"]),
    ]
    s = lambda n, k, p, l: (p, k, n, l, True, None, None)
    symbols = [s("createInvoice", "function", "src/billing/invoice.ts", 42), s("Invoice", "interface", "src/billing/invoice.ts", 10), s("Customer", "interface", "src/billing/customer.ts", 3), s("billingRouter", "const", "src/api/billing.ts", 8), s("formatDate", "function", "src/util/format.ts", 2), s("formatMoney", "function", "src/util/format.ts", 9), s("query", "function", "src/core/db.ts", 5), s("connect", "function", "src/core/db.ts", 1)]
    edges = [("src/api/billing.ts", "src/billing/invoice.ts"), ("src/api/billing.ts", "src/core/db.ts"), ("src/billing/invoice.ts", "src/billing/customer.ts"), ("src/billing/invoice.ts", "src/core/db.ts"), ("src/billing/invoice.test.ts", "src/billing/invoice.ts")]
    rows = {
        "files": files, "symbols": symbols, "edges": edges, "tests": [("src/billing/invoice.ts", "src/billing/invoice.test.ts")], "centrality": [("src/billing/invoice.ts", 2), ("src/billing/customer.ts", 1), ("src/core/db.ts", 12)],
        "cochange": [("src/billing/invoice.ts", "src/api/billing.ts", 4), ("src/api/billing.ts", "src/billing/invoice.ts", 4)], "contents": [("src/billing/invoice.ts", "\n".join(f"line {i}" for i in range(1, 61)))],
        "calls": [("src/api/billing.ts", "createInvoice", 9, "billingRouter"), ("src/billing/invoice.ts", "query", 44, "createInvoice"), ("src/billing/invoice.ts", "gone", 45, "createInvoice")], "commands": [("npm test", "package.json", "test", 0), ("npm run build", "package.json", "build", 0)],
        "recent": [("src/billing/invoice.ts", NOW - 2 * DAY, "fix"), ("src/billing/customer.ts", NOW - 60 * DAY, "old")],
    }
    return Engine(spark, {k: spark.createDataFrame(v, EMPTY[k]) for k, v in rows.items()})


def ranked(engine, task, **options):
    return engine.rank(task, NOW, **options).orderBy("rank").collect()


def test_flagship_task(engine):
    got = ranked(engine, "fix invoice rounding in createInvoice")
    assert got[0].path == "src/billing/invoice.ts" and "changed 2d ago" in got[0].reasons and any("createinvoice" in r for r in got[0].reasons)
    by = {r.path: r for r in got}
    assert "dist/gen.js" not in by and any(r.startswith("test of") for r in by["src/billing/invoice.test.ts"].reasons)


def test_infrastructure_task_scores_100(engine):
    got = {r.path: r for r in ranked(engine, "update docker deploy workflow")}
    assert got["Dockerfile"].score == 100 and "infra file" not in got["Dockerfile"].reasons


def test_central_file(engine):
    got = ranked(engine, "optimize db query connection pool")
    assert got[0].path == "src/core/db.ts" and "imported by 12 files" in got[0].reasons


def test_order_cutoff_and_cochange(engine):
    got = ranked(engine, "billing invoice api")
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and all(r.score >= 25 for r in got)
    assert any(r.startswith("co-changes with") for x in got if x.path == "src/api/billing.ts" for r in x.reasons)


def test_inspected_and_empty(engine):
    got = ranked(engine, "customer rounding logic", reads={"src/billing/customer.ts": 2})
    assert got[0].path == "src/billing/customer.ts" and "already inspected this session" in got[0].reasons
    assert ranked(engine, "") == []


def test_semantic_admission(spark):
    f = lambda p, e: (p, 10, "ts", 0, "source", None, False, [e], [], None)
    e = Engine(spark, {"files": spark.createDataFrame([f("auth.ts", "authenticate"), f("session_guard.ts", "verifyCredentials"), f("unrelated.ts", "pancakeRecipe")], EMPTY["files"])})
    cos = spark.createDataFrame([("auth.ts", 0.5), ("session_guard.ts", 0.7), ("unrelated.ts", 0.05)], "path string, cos double")
    got = {r.path: r for r in e.rank("fix auth flow", NOW, cosine=cos).collect()}
    assert "semantically similar" in got["session_guard.ts"].reasons and "unrelated.ts" not in got
    assert "session_guard.ts" not in {r.path for r in e.rank("fix auth flow", NOW).collect()}


def test_pack(engine):
    p = engine.pack("fix invoice rounding in createInvoice", NOW)
    assert p["confidence"] == "high" and ("src/billing/invoice.test.ts", "src/billing/invoice.ts") in p["links"]
    assert p["files"][0]["symbols"][0] == {"name": "createInvoice", "file": "src/billing/invoice.ts", "line": 42} and p["excerpt"].split("\n")[0] == "line 40" and len(p["excerpt"].split("\n")) == 12
    for budget in (300, 80):
        assert len(engine.render(engine.pack("fix invoice rounding in createInvoice", NOW, budget))) <= 4 * budget
    low = engine.pack("zzqq blorp wibble", NOW)
    assert low["confidence"] == "low" and low["files"] == [] and "blorp" in low["missing"]


def test_lookups(engine):
    assert [r.name for r in engine.symbol_search("invoice").collect()] == ["Invoice", "createInvoice"]
    assert engine.definition("query").first().file == "src/core/db.ts"
    assert {(r.role, r.file) for r in engine.references("createInvoice").collect()} == {("def", "src/billing/invoice.ts"), ("call", "src/api/billing.ts")}
    chain = [(r.caller, r.callee) for r in engine.call_chain("billingRouter").orderBy("ord").collect()]
    assert chain == [("billingRouter", "createInvoice"), ("createInvoice", "query"), ("createInvoice", "gone")]
    assert {(r.callee, r.via) for r in engine.resolved_calls().collect()} == {("createInvoice", "import"), ("query", "import"), ("gone", "external")}
    groups = {(r.group, r.other) for r in engine.related("src/billing/invoice.ts").collect()}
    assert {("imports", "src/core/db.ts"), ("importers", "src/api/billing.ts"), ("same folder", "src/billing/customer.ts"), ("co-changed", "src/api/billing.ts"), ("tests", "src/billing/invoice.test.ts")} <= groups
    assert [r.path for r in engine.dep_trace("src/billing/invoice.test.ts", "src/core/db.ts").collect()] == [["src/billing/invoice.test.ts", "src/billing/invoice.ts", "src/core/db.ts"]]
    assert [(r.test, r.command) for r in engine.find_tests("src/billing/invoice.ts").collect()] == [("src/billing/invoice.test.ts", "npm test")]
    assert [r.file for r in engine.recent_changes(NOW).collect()] == ["src/billing/invoice.ts"]
    assert engine.risk_check("dist/gen.js").first().tier == "destructive" and engine.risk_check("src/core/db.ts").first().risk is None
    assert engine.symbol_body("createInvoice").first().body.startswith("line 42") and engine.tree().first().folder == "src/billing"
    assert engine.overview()["commands"].first().cmd == "npm test" and set(engine.trace_symbol("createInvoice")) == {"definition", "references", "callees", "related", "paths"}


def test_terms(spark):
    assert dict(task_terms(spark, "fix `createInvoice` for BM25 données")) == {"fix": 1.0, "createinvoice": 2.0, "bm25": 1.0, "donnees": 1.0, "bm": 1.0, "25": 1.0, "database": 0.5}
    assert dict(task_terms(spark, "auth"))["authentication"] == 0.5
