"""Schemas of the index tables; readers never infer."""

from __future__ import annotations

SCHEMAS = {
    "meta": "version int, root string, indexed_at long, file_count long, skipped_count long, is_git boolean, project_type string, head_commit string, partial boolean",
    "files": "path string, h string, mtime long, size long, lines long, lang string, kind string, risk string, exports array<string>, external_deps array<string>, doc_headings array<string>, is_test boolean, pkg int, entry boolean, last_ts long, churn long",
    "symbols": "file string, kind string, name string, line int, exported boolean, parent string, detail string",
    "imports": "file string, kind string, name string, line int, exported boolean, parent string, detail string",
    "packages": "id int, name string, dir string, kind string",
    "commands": "cmd string, src string, kind string, pkg int",
    "centrality": "path string, importers long",
    "cochange": "file string, partner string, n long",
    "recent": "file string, ts long, subject string",
    "edges": "src string, dst string",
    "calls": "file string, callee string, line int, caller string",
    "fieldaccess": "file string, field string, line int, kind string, caller string",
    "commits": "ord long, commit string, ts long, subject string, file string",
    "postings": "token string, ids array<string>, n long",
    "tests": "source string, test string",
    "session_events": "session string, seq long, ts long, e string, text string, f string, tok long, tool string, cmd string, exit int, outTok long, kind string, target string, confidence string, files array<string>, injected boolean",
    "pending": "f string, ts long",
    "eval_queries": "query string, repo string, expect array<string>, `group` string",
}
