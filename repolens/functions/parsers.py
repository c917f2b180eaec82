"""Source parsers: symbols, imports, calls and field accesses of one file.

Each parser maps a text to rows (kind, name, line, exported, parent, detail); kinds of symbols are
function, class, interface, type, enum, const, method, struct, trait, impl, macro, module; the other
rows are import, call, field and heading.  TypeScript and Rust are scanned with regular expressions over text
whose comments and strings are blanked (line numbers stay); Python uses its own ``ast`` and falls
back to line patterns where a file doesn't parse.  A parser never raises: what it can't read gives
no row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

Row = tuple[str, str, int, bool, str | None, str | None]

_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.S)
_TS_DECL = re.compile(r"^(?P<pad>[ \t]*)(?P<x>export\s+)?(?P<d>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?P<k>function\*?|class|interface|type|enum|const|let|var|namespace)\s+(?P<n>[A-Za-z_$][\w$]*)", re.M)
_TS_METHOD = re.compile(r"^[ \t]+(?:public |private |protected |static |async |readonly |get |set )*(?P<n>[A-Za-z_$][\w$]*)\s*\([^;{}]*\)\s*(?::[^{;=]+)?\{", re.M)
_TS_IMPORT = re.compile(r"""(?:import|export)\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]|(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)""")
_TS_LIST = re.compile(r"^export\s*\{([^}]*)\}", re.M)
_CALL = re.compile(r"(?<![\w$.])(?:[A-Za-z_$][\w$]*\s*\.\s*)*([A-Za-z_$][\w$]*)\s*\(")
_FIELD = re.compile(r"\.([A-Za-z_$][\w$]*)\b(?!\s*\()(\s*(?:[-+*/%&|^]|<<|>>|\*\*|\?\?)?=(?!=))?")
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "super", "constructor", "await", "match", "fn", "import", "require"}
_KIND = {"function": "function", "function*": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "const", "let": "const", "var": "const", "namespace": "module"}
_RS_DECL = re.compile(r"^(?P<pad>[ \t]*)(?P<x>pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?(?:extern\s+\"[^\"]*\"\s+)?(?P<k>fn|struct|enum|trait|mod|type|const|static|union|macro_rules!)\s*(?P<n>[A-Za-z_]\w*)", re.M)
_RS_IMPL = re.compile(r"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>[A-Za-z_]\w*)", re.M)
_RS_USE = re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M)
_RS_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "type", "const": "const", "static": "const", "union": "struct", "macro_rules!": "macro"}
_HEADING = re.compile(r"^#{1,3} +(.+?)\s*$", re.M)


def _blank(text: str, *patterns: re.Pattern) -> str:
    """The text with matches replaced by spaces; line ends stay."""
    for p in patterns:
        text = p.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return text


def _lines(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c == "\n"]


class _Place:
    """Line numbers, and the nearest enclosing definition by braces."""

    def __init__(self, text: str, definitions: list[tuple[int, str]]) -> None:
        from bisect import bisect_right

        self._find, self._ends = bisect_right, _lines(text)
        self.spans = []
        for at, name in definitions:
            start = text.find("{", at)
            depth, end = 0, len(text)
            if start < 0 or ";" in text[at:start]:
                continue
            for m in re.finditer(r"[{}]", text[start:]):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    end = start + m.start()
                    break
            self.spans.append((start, end, name))

    def line(self, at: int) -> int:
        return self._find(self._ends, at - 1) + 1

    def owner(self, at: int) -> str | None:
        inside = [(e - s, n) for s, e, n in self.spans if s < at < e]
        return min(inside)[1] if inside else None


def _uses(code: str, place: _Place) -> Iterator[Row]:
    for m in _CALL.finditer(code):
        before = code[max(0, m.start() - 12) : m.start()]
        if m[1] not in _WORDS and not re.search(r"\b(function\*?|fn|class|def)\s*$", before):
            yield "call", m[1], place.line(m.start(1)), False, place.owner(m.start()), None
    for m in _FIELD.finditer(code):
        yield "field", m[1], place.line(m.start(1)), False, place.owner(m.start()), "write" if m[2] else "read"


def typescript(text: str) -> Iterator[Row]:
    plain = _blank(text, _COMMENT)
    code = _blank(plain, _STRING)
    found = list(_TS_DECL.finditer(code))
    listed = {x.split(" as ")[0].strip() for m in _TS_LIST.finditer(code) for x in m[1].split(",")}
    methods = [m for m in _TS_METHOD.finditer(code) if m["n"] not in _WORDS]
    place = _Place(code, [(m.start("n"), m["n"]) for m in found if m["k"] not in ("type",)] + [(m.start("n"), m["n"]) for m in methods])
    for m in found:
        if not m["pad"]:
            yield _KIND[m["k"]], m["n"], place.line(m.start("n")), bool(m["x"]) or m["n"] in listed, None, text.split("\n")[place.line(m.start("n")) - 1].strip()[:120]
    for m in methods:
        yield "method", m["n"], place.line(m.start("n")), False, place.owner(m.start()), None
    for m in _TS_IMPORT.finditer(plain):
        yield "import", m[1] or m[2], place.line(m.start()), False, None, None
    yield from _uses(code, place)


def rust(text: str) -> Iterator[Row]:
    plain = _blank(text, _COMMENT)
    code = _blank(plain, re.compile(r"\"(?:\\.|[^\"\\])*\"", re.S))
    found = list(_RS_DECL.finditer(code))
    impls = [(m.start("n"), m["n"]) for m in _RS_IMPL.finditer(code)]
    place = _Place(code, [(m.start("n"), m["n"]) for m in found if m["k"] in ("fn", "mod", "trait")] + impls)
    for m in found:
        owner = place.owner(m.start())
        yield ("method" if owner and m["k"] == "fn" else _RS_KIND[m["k"]]), m["n"], place.line(m.start("n")), bool(m["x"]), owner, code.split("\n")[place.line(m.start("n")) - 1].strip()[:120]
    for m in _RS_USE.finditer(code):
        yield "import", re.sub(r"\s+", "", m[1]), place.line(m.start()), False, None, None
    yield from _uses(code, place)


def python(text: str) -> Iterator[Row]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        for i, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"(\s*)(?:async )?(def|class) (\w+)", line):
                yield ("class" if m[2] == "class" else "method" if m[1] else "function"), m[3], i, not m[3].startswith("_"), None, line.strip()[:120]
            elif m := re.match(r"(?:from|import) (\w+)", line):
                yield "import", m[1], i, False, None, None
        return
    named = next((ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, ast.List | ast.Tuple)), None)

    def walk(node: ast.AST, owner: str | None, inside_class: bool) -> Iterator[Row]:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(n, ast.ClassDef)
                yield ("class" if is_class else "method" if inside_class else "function"), n.name, n.lineno, n.name in named if named is not None else not n.name.startswith("_") and owner is None, owner, None
                yield from walk(n, n.name, is_class)
                continue
            if isinstance(n, ast.Assign) and owner is None:
                for t in n.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        yield "const", t.id, n.lineno, t.id in named if named is not None else not t.id.startswith("_"), None, None
            if isinstance(n, ast.Import):
                for a in n.names:
                    yield "import", a.name.split(".")[0], n.lineno, False, None, None
            elif isinstance(n, ast.ImportFrom):
                yield "import", "." * n.level + (n.module or ""), n.lineno, False, None, None
            elif isinstance(n, ast.Call):
                name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
                if name:
                    yield "call", name, n.lineno, False, owner, None
            elif isinstance(n, ast.Attribute):
                yield "field", n.attr, n.lineno, False, owner, "write" if isinstance(n.ctx, ast.Store) else "read"
            yield from walk(n, owner, inside_class)

    yield from walk(tree, None, False)


def markdown(text: str) -> Iterator[Row]:
    ends = _Place(text, [])
    for m in list(_HEADING.finditer(text))[:10]:
        yield "heading", m[1], ends.line(m.start()), False, None, None


PARSERS = {"ts": typescript, "tsx": typescript, "js": typescript, "jsx": typescript, "rust": rust, "python": python, "md": markdown}


def parse(lang: str, text: str | None) -> list[Row]:
    """Rows of a file, symbols first in line order; none for languages without a parser."""
    if not text or lang not in PARSERS:
        return []
    return sorted(PARSERS[lang](text), key=lambda r: (r[0] in ("call", "field", "import"), r[2], r[1]))
