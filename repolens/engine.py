"""The engine's queries over one index: ranking, packs, symbols, traces, neighbourhoods, reports.

``Engine`` holds lazy DataFrames (the tables of ``plans.index.build`` and of the history operators).
Every query returns a DataFrame in a total order, except ``pack`` and ``render``, whose result is a
few rows and is assembled on the driver from a ranked top.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import classify
from .functions.text import bm25_idf, generic_damp, redact, round1, split_identifier, tokenize
from .operators import graph, lookup, ranking

#: Words of a task that is about generated, vendored or infrastructure files.
RISK_WORDS = ("docker", "deploy", "ci", "cd", "migration", "migrations", "terraform", "k8s", "kubernetes", "helm", "workflow", "pipeline", "infra", "env", "dockerfile", "compose", "jenkins", "lock")
#: Words that mean the same in a task.
ALIASES = {"donnees": ["database"], "connexion": ["connection"], "deploiement": ["deployment"], "auth": ["authentication"], "authentication": ["auth"]}
DAY = 86_400
EMPTY = {
    "files": "path string, lines long, lang string, pkg int, kind string, risk string, entry boolean, exports array<string>, doc_headings array<string>, last_ts long",
    "symbols": "file string, kind string, name string, line int, exported boolean, parent string, detail string",
    "edges": "src string, dst string", "tests": "source string, test string", "cochange": "file string, partner string, n long", "calls": "file string, callee string, line int, caller string",
    "fieldaccess": "file string, field string, line int, kind string, caller string", "contents": "path string, content string", "recent": "file string, ts long, subject string",
    "packages": "id int, name string, dir string, kind string", "commands": "cmd string, src string, kind string, pkg int", "centrality": "path string, importers long",
}
COMMAND_ORDER = ("test", "build", "dev", "typecheck", "lint", "run", "other")


def task_terms(spark: SparkSession, task: str, aliases: dict[str, list[str]] | None = None) -> list[tuple[str, float]]:
    """Terms of a task with weights: words and the parts of letter-digit words weigh 1, words spelt as
    code (in back-ticks, or with an underscore) 2, aliases half.  The task is one short string."""
    row = spark.createDataFrame([(task,)], "s string").select(tokenize(F.col("s")).alias("t"), F.regexp_extract_all("s", F.lit("`([^`]+)`|(\\w*_\\w*)"), F.lit(0)).alias("code"), F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("s", F.lit("[A-Za-z]+[0-9]+[A-Za-z0-9]*"), F.lit(0)), split_identifier))).alias("p")).first()
    code = {w for c in row.code for w in re.split("[^a-z0-9]+", c.lower())}
    terms = {t: 2.0 if t in code else 1.0 for t in row.t}
    for p in row.p:
        if len(p) >= 2:
            terms.setdefault(p, 1.0)
    return ranking.expand(list(terms.items()), ALIASES | (aliases or {}))


@dataclass
class Engine:
    """Tables by name; a missing one is empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in EMPTY:
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], EMPTY[name])
            return self.tables[name]
        raise AttributeError(name)

    # ranking

    def _fields(self) -> tuple[DataFrame, Column, list[tuple[str, float]]]:
        """Files with their term fields; document length; (field, boost), strongest first."""
        named = self.symbols.groupBy(F.col("file").alias("path")).agg(F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("exported"), F.lower("name"))).alias("public"))
        none = F.array().cast("array<string>")
        f = self.files.join(named, "path", "left")
        base = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "(.)\\.[^.]*$", "$1")
        exports, all_names = F.coalesce("exports", none), F.array_union(F.coalesce("names", none), F.coalesce("exports", none))
        parts = lambda c: F.array_distinct(F.flatten(F.transform(c, split_identifier)))
        f = f.select(
            "path", F.array_distinct(F.array(F.lower(base), F.array_join(split_identifier(base), ""))).alias("f_base"), F.array_distinct(F.concat(F.coalesce("public", none), F.transform(exports, F.lower))).alias("f_exact"),
            F.array_distinct(F.split(F.lower("path"), "/")).alias("f_segs"), parts(all_names).alias("f_sub"), parts(F.coalesce("doc_headings", none)).alias("f_head"), "lines", "pkg", "risk", "entry", "last_ts",
        ).withColumn("f_base", F.filter("f_base", lambda x: x != ""))
        fields = [("f_base", 5.0), ("f_exact", 4.0), ("f_segs", 3.0), ("f_sub", 2.0), ("f_head", 1.5)]
        return f, reduce(lambda a, b: a + b, [F.size(n) * w for n, w in fields]), fields

    def rank(self, task: str, now: int, reads: dict[str, int] | None = None, cosine: DataFrame | None = None, weight: float = 0.6, aliases: dict[str, list[str]] | None = None) -> DataFrame:
        """(path, score, matched, reasons, rank): at most 40 files of 25 points or more.  ``cosine``
        (path, cos) adds semantic points, and admits files without a lexical hit."""
        terms = task_terms(self.spark, task, aliases)
        schema = "path string, score double, matched array<string>, reasons array<string>, rank int"
        if not terms:
            return self.spark.createDataFrame([], schema)
        f, length, fields = self._fields()
        tf, top_field = [], []
        for t, _ in terms:
            own = reduce(lambda a, b: a + b, [F.when(F.array_contains(n, t), w).otherwise(0.0) for n, w in fields])
            if len(t) >= 4:
                own = F.when(own == 0, F.when(F.contains(F.lower("path"), F.lit(t)), 1.0).otherwise(0.0)).otherwise(own)
            tf.append(own)
            top_field.append(reduce(lambda a, nw: a.when(F.array_contains(nw[0], t), nw[0][2:]), fields, F.when(F.lit(False), "")).otherwise("path"))
        rows = f.select("*", length.cast("double").alias("len"), F.array(*tf).alias("tf"), F.array(*top_field).alias("via"))
        stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0).cast("double") for i in range(len(terms))]).alias("df"))
        norm = 1.5 * (0.25 + 0.75 * F.col("len") / F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0))
        part = lambda i, q: F.when(F.col("tf")[i] > 0, bm25_idf(F.col("df")[i], F.col("n")) * generic_damp(F.col("df")[i], F.col("n")) * q * F.col("tf")[i] * 2.5 / (F.col("tf")[i] + norm)).otherwise(0.0)
        scored = rows.crossJoin(F.broadcast(stats)).withColumn("L", reduce(lambda a, b: a + b, [part(i, q) for i, (_, q) in enumerate(terms)]))
        names = F.array(*[F.lit(t) for t, _ in terms])
        scored = scored.withColumn("matched", F.filter(F.transform(names, lambda t, i: F.when(F.get("tf", i) > 0, t)), lambda x: x.isNotNull()))
        scored = scored.withColumn("why", F.filter(F.transform(names, lambda t, i: F.when(F.get("tf", i) > 0, F.concat(F.lit("matches "), t, F.lit(" ("), F.get("via", i), F.lit(")")))), lambda x: x.isNotNull()))
        if cosine is not None:
            st = cosine.agg(F.greatest(F.max("cos"), F.lit(0.0)).alias("mx"), F.avg("cos").alias("mean"))
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cos") - F.col("mean")) / F.greatest(F.lit(0.01), F.col("mx") - F.col("mean"))))
            active = (F.col("mx") >= 0.15) & (F.col("mx") - F.col("mean") >= 0.03)
            scored = scored.join(cosine.crossJoin(F.broadcast(st)).select("path", F.when(active, share).otherwise(0.0).alias("sem")), "path", "left")
        else:
            scored = scored.withColumn("sem", F.lit(0.0))
        scored = scored.withColumn("sem", F.coalesce("sem", F.lit(0.0))).where((F.col("L") > 0) | (F.col("sem") >= 0.6))
        best = scored.agg(F.greatest(F.max("L"), F.lit(0.0)).alias("best"))
        degree = self.centrality if "centrality" in self.tables else graph.centrality(self.edges).select(F.col("node").alias("path"), "importers")
        seen = [p for p, n in (reads or {}).items() if n > 0]
        age = F.lit(now) - F.col("last_ts")
        points = {
            "semantically similar": round1(F.col("sem") * weight * 80), "recent": F.when(age <= 7 * DAY, 15.0).when(age <= 30 * DAY, 8.0), "entrypoint": F.when(F.col("entry"), 10.0),
            "imported": F.when(F.col("importers") > 0, F.least(F.lit(10.0), 2 * F.log2(1 + F.col("importers")))), "already inspected this session": F.when(F.col("path").isin(seen), 4.0) if seen else F.lit(None).cast("double"), "huge": F.when(F.col("lines") > 3000, -10.0),
        }
        if not {t for t, _ in terms} & set(RISK_WORDS):
            points["risk"] = F.when(F.col("risk") == "generated", -75.0).when(F.col("risk") == "vendor", -90.0).when(F.col("risk") == "infra", -15.0)
        text = {"recent": F.concat(F.lit("changed "), F.greatest(F.lit(0), F.floor(age / DAY)).cast("string"), F.lit("d ago")), "imported": F.concat(F.lit("imported by "), F.col("importers").cast("string"), F.lit(" files")), "risk": F.concat("risk", F.lit(" file")), "huge": F.concat(F.lit("huge file ("), F.col("lines").cast("string"), F.lit(" lines)"))}
        s = scored.crossJoin(F.broadcast(best)).join(degree, "path", "left")
        base = F.when(F.col("best") > 0, F.col("L") * 100 / F.col("best")).otherwise(0.0) + reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in points.values()])
        reasons = F.concat("why", F.filter(F.array(*[F.when(F.coalesce(p, F.lit(0.0)) != 0, text.get(k, F.lit(k))) for k, p in points.items()]), lambda x: x.isNotNull()))
        first = s.select("path", "pkg", "matched", base.alias("base"), reasons.alias("reasons")).persist()
        top = first.orderBy(F.desc("base"), F.length("path"), "path").limit(5).select("path", "pkg").collect()  # five rows
        five = [r.path for r in top]
        if not five:
            return self.spark.createDataFrame([], schema)
        co = self.cochange.where((F.col("n") >= 3) & F.col("partner").isin(five) & (F.col("file") != F.col("partner"))).groupBy(F.col("file").alias("path")).agg(F.concat(F.lit("co-changes with "), F.max_by("partner", "n")).alias("r_co"))
        link = self.tests.where(F.col("source").isin(five)).select(F.col("test").alias("path"), F.concat(F.lit("test of "), "source").alias("r")).union(self.tests.where(F.col("test").isin(five)).select("source", F.concat(F.lit("tested by "), "test")))
        link = link.groupBy("path").agg(F.min("r").alias("r_test"))
        out = first.join(co, "path", "left").join(link, "path", "left")
        same = (F.col("path") != five[0]) & (F.col("pkg") != -1) & (F.col("pkg") == top[0].pkg)
        more = F.filter(F.array("r_co", "r_test", F.when(same, F.lit(f"same package as {five[0]}"))), lambda x: x.isNotNull())
        total = F.col("base") + F.when(F.col("r_co").isNotNull(), 6.0).otherwise(0.0) + F.when(F.col("r_test").isNotNull(), 5.0).otherwise(0.0) + F.when(same, 3.0).otherwise(0.0)
        out = out.select("path", round1(total).alias("score"), "matched", F.concat("reasons", more).alias("reasons")).where("score >= 25")
        return ranking.top(out, [F.desc("score"), F.length("path"), F.col("path")], 40)

    def pack(self, task: str, now: int, budget: int = 1500, **options) -> dict:
        """Files, their symbols, links, an excerpt and the next step for a task, within a token budget."""
        found = self.rank(task, now, **options).orderBy("rank").limit(8).collect()
        terms = task_terms(self.spark, task, options.get("aliases"))
        three = {t for r in found[:3] for t in r.matched}
        best = found[0].score if found else 0.0
        confidence = "high" if best >= 70 and len(three) >= 2 else "medium" if best >= 40 else "low"
        paths = [r.path for r in found]
        low = [t for t, _ in terms]
        exact = F.lower("name").isin(low)
        order = [exact.desc(), F.when(exact, -F.length("name")).otherwise(0), F.col("line"), F.col("name")]
        hit = exact | F.arrays_overlap(split_identifier(F.col("name")), F.array(*map(F.lit, low))) if low else F.lit(False)
        own = self.symbols.where(F.col("file").isin(paths) & F.col("exported") & hit).withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where("rn <= 3")
        symbols: dict[str, list] = {}
        for r in own.orderBy("file", "rn").collect() if paths else []:
            symbols.setdefault(r.file, []).append({"name": r.name, "file": r.file, "line": r.line})
        links = [(r.src, r.dst) for r in self.edges.where(F.col("src").isin(paths) & F.col("dst").isin(paths)).orderBy("src", "dst").limit(6).collect()] if paths else []
        missing = [t for t, q in sorted(terms, key=lambda x: (-x[1], -len(x[0]), x[0])) if t not in three and (confidence == "low" or q >= 2)][:5]
        unmatched = [t for t, _ in sorted(terms, key=lambda x: (-x[1], -len(x[0]), x[0])) if t not in {m for r in found for m in r.matched}]
        excerpt = None
        if found and best >= 80 and symbols.get(paths[0]):
            line = symbols[paths[0]][0]["line"]
            excerpt = self.body_lines(paths[0], max(1, line - 2), 12)
        step = f"open {paths[0]}" if confidence == "high" else f"search for {unmatched[0]}" if unmatched else f"read {paths[0]}" if paths else "search the repository"
        out = {"task": task, "confidence": confidence, "files": [], "links": [], "excerpt": None, "missing": missing, "next_step": step}
        cost = lambda p: math.ceil(len(self.render(p)) / 4)
        for r in found:
            trial = out | {"files": [*out["files"], {"path": r.path, "score": r.score, "why": r.reasons[:3], "symbols": symbols.get(r.path, [])}]}
            if cost(trial) > budget:
                break
            out = trial
        for link in links:
            if {*link} <= {f["path"] for f in out["files"]} and cost(trial := out | {"links": [*out["links"], link]}) <= budget:
                out = trial
        if excerpt and cost(trial := out | {"excerpt": excerpt}) <= budget:
            out = trial
        return out

    @staticmethod
    def render(pack: dict) -> str:
        lines = [f"task: {pack['task'][:80]} ({pack['confidence']})"]
        for f in pack["files"]:
            lines.append(f"{f['path']} {f['score']:.1f}: {'; '.join(f['why'])}")
            lines += [f"  {s['name']} {s['file']}:{s['line']}" for s in f["symbols"]]
        lines += [f"{a} -> {b}" for a, b in pack["links"]]
        lines += [pack["excerpt"]] if pack["excerpt"] else []
        lines += [f"missing: {', '.join(pack['missing'])}"] if pack["missing"] else []
        return "\n".join([*lines, f"next: {pack['next_step']}"])

    # symbols

    def symbol_search(self, query: str, kind: str | None = None, exported_only: bool = False, limit: int = 20) -> DataFrame:
        where = (F.col("kind") == kind if kind else F.lit(True)) & (F.col("exported") if exported_only else F.lit(True))
        return lookup.symbol_search(self.symbols, "name", ["file", "line"], query, where, limit)

    def definition(self, name: str, file: str | None = None) -> DataFrame:
        """One row: the definition of a name, in ``file`` first, exported ones first."""
        own = self.symbols.where(F.col("name") == name)
        return own.orderBy(*([(F.col("file") != file).cast("int")] if file else []), F.desc("exported"), "line", "file").limit(1)

    def references(self, name: str, kind: str = "all") -> DataFrame:
        """(file, line, role, caller): definitions, calls and, unless ``kind`` is calls, other uses."""
        calls = self.calls.where(F.col("callee") == name).select("file", "line", F.lit("call").alias("role"), "caller")
        if kind == "calls":
            return calls.orderBy("file", "line")
        defs = self.symbols.where(F.col("name") == name).select("file", "line", F.lit("def").alias("role"), F.lit(None).cast("string").alias("caller"))
        uses = self.contents.select(F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("p", "s")).where(F.col("s").rlike(rf"(^|[^\w$]){re.escape(name)}([^\w$]|$)")).select("file", (F.col("p") + 1).cast("int").alias("line"))
        uses = uses.join(defs.select("file", "line").union(calls.select("file", "line")).distinct(), ["file", "line"], "left_anti").select("file", "line", F.lit("use").alias("role"), F.lit(None).cast("string").alias("caller"))
        return defs.union(calls).union(uses).orderBy("file", "line", "role")

    def symbol_tree(self, path: str) -> DataFrame:
        return self.symbols.where(F.col("file") == path).select("line", "kind", "name", "parent", "exported").orderBy("line", "name")

    def calls_of(self, path: str) -> DataFrame:
        """(caller, callees) of a file; calls outside functions are (top level)."""
        own = self.calls.where(F.col("file") == path)
        return own.groupBy(F.coalesce("caller", F.lit("(top level)")).alias("caller")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "callee"))), lambda x: x["callee"]).alias("callees")).orderBy("caller")

    def resolved_calls(self) -> DataFrame:
        """(caller, callee, file, target, via, ord): a call's definition in its own file, in an
        imported one, the first exported one anywhere, else external.  Equi-joins with one row a name."""
        defs = self.symbols.select(F.col("name").alias("callee"), F.col("file").alias("target"), "exported")
        own = defs.select("callee", F.col("target").alias("file"), F.lit(True).alias("own")).distinct()
        imported = self.edges.join(defs, F.col("dst") == F.col("target")).groupBy(F.col("src").alias("file"), "callee").agg(F.min("target").alias("near"))
        anywhere = defs.groupBy("callee").agg(F.min_by("target", F.struct(~F.col("exported"), "target")).alias("first"))
        c = self.calls.where("caller is not null").join(own, ["file", "callee"], "left").join(imported, ["file", "callee"], "left").join(anywhere, "callee", "left")
        via = F.when(F.col("own"), "same-file").when(F.col("near").isNotNull(), "import").when(F.col("first").isNotNull(), "heuristic").otherwise("external")
        return c.select("caller", "callee", "file", F.when(F.col("own"), F.col("file")).otherwise(F.coalesce("near", "first")).alias("target"), via.alias("via"), F.col("line").alias("ord"))

    def call_chain(self, name: str, depth: int = 3) -> DataFrame:
        return graph.call_chain(self.resolved_calls().select("caller", "callee", "ord"), name, depth)

    def field_refs(self, name: str, file: str | None = None) -> DataFrame:
        """Accesses of a field: writes first, then reads (found by name)."""
        own = self.fieldaccess.where((F.col("field") == name) & (F.col("file") == file if file else F.lit(True)))
        return own.orderBy((F.col("kind") != "write").cast("int"), "file", "line")

    def body_lines(self, path: str, start: int, count: int) -> str | None:
        """``count`` lines from ``start`` on, without secrets; longer files end with a marker."""
        lines = F.split("content", "\n")
        row = self.contents.where(F.col("path") == path).select(redact(F.array_join(F.slice(lines, start, count), "\n")).alias("s"), F.size(lines).alias("n")).first()
        return row and row.s

    def symbol_body(self, name: str, file: str | None = None, max_lines: int = 80) -> DataFrame:
        """(file, line, name, body): from the definition to the line before the next one of the file."""
        d = self.definition(name, file).select("file", "line", "name")
        after = self.symbols.select(F.col("file").alias("f2"), F.col("line").alias("l2"), "parent").where("parent is null")
        end = d.join(after, (F.col("file") == F.col("f2")) & (F.col("l2") > F.col("line")), "left").groupBy("file", "line", "name").agg(F.min("l2").alias("next"))
        lines = F.split("content", "\n")
        n = F.coalesce(F.col("next"), F.size(lines) + 1) - F.col("line")
        cut = F.array_join(F.slice(lines, F.col("line"), F.least(n, F.lit(max_lines))), "\n")
        return end.join(self.contents, F.col("path") == F.col("file")).select("file", "line", "name", F.when(n > max_lines, F.concat(redact(cut), F.lit("\n… +"), (n - max_lines).cast("string"), F.lit(" more"))).otherwise(redact(F.rtrim(cut))).alias("body"))

    def trace_symbol(self, name: str, file: str | None = None, paths: int = 3) -> dict[str, DataFrame]:
        """Definition, references, callees, related files of a name, by title."""
        d = self.definition(name, file).first()
        out = {"definition": self.definition(name, file), "references": self.references(name)}
        if d:
            out["callees"] = self.resolved_calls().where((F.col("caller") == name) & (F.col("file") == d.file)).select("callee", "target", "via").distinct().orderBy("callee")
            out["related"] = self.related(d.file)
            users = [r.file for r in out["references"].where(F.col("file") != d.file).select("file").distinct().orderBy("file").limit(paths).collect()]
            found = [graph.shortest_paths(self.edges, u, d.file, paths) for u in users]
            if found:
                out["paths"] = reduce(DataFrame.union, found).orderBy("hops", "path").limit(paths)
        return out

    # files

    def related(self, path: str, most: int = 10) -> DataFrame:
        """(group, other, pos): imports, importers, co-changed, tests, same folder, same stem."""
        folder = F.regexp_replace("path", "/?[^/]*$", "")
        stem = lambda c: F.regexp_replace(F.regexp_extract(c, "([^/]+)$", 1), "\\..*$", "")
        one = self.files.where(F.col("path") == path).select(F.col("path").alias("key"), folder.alias("d"), stem(F.col("path")).alias("s"))
        others = self.files.select(F.col("path").alias("other"), folder.alias("od"), stem(F.col("path")).alias("os"))
        near = one.join(F.broadcast(one.select("d").distinct()), "d").join(others, F.col("d") == F.col("od")).where("other <> key").select("key", "other")
        alike = one.join(others, F.col("s") == F.col("os")).where("other <> key and d <> od").select("key", "other")
        at = lambda df, a, b: df.where(F.col(a) == path).select(F.col(a).alias("key"), F.col(b).alias("other"))
        groups = {"imports": at(self.edges, "src", "dst"), "importers": at(self.edges, "dst", "src"), "co-changed": at(self.cochange, "file", "partner"), "tests": at(self.tests, "source", "test").union(at(self.tests, "test", "source")), "same folder": near, "same stem": alike}
        return lookup.neighbourhood(groups, "key", "other", most).select("group", "other", "pos").orderBy("group", "pos")

    def dep_trace(self, start: str, goal: str | None = None) -> DataFrame:
        """Shortest import paths to ``goal``, or the direct neighbours of a file."""
        if goal:
            return graph.shortest_paths(self.edges, start, goal)
        out = self.edges.where(F.col("src") == start).select(F.lit("imports").alias("direction"), F.col("dst").alias("file"))
        return out.union(self.edges.where(F.col("dst") == start).select(F.lit("imported by"), "src")).orderBy("direction", "file")

    def find_tests(self, path: str) -> DataFrame:
        """(test, command): tests of a file, with the best test command (its package's first)."""
        pkg = self.files.where(F.col("path") == path).select("pkg")
        best = self.commands.where("kind = 'test'").crossJoin(F.broadcast(pkg.withColumnRenamed("pkg", "own"))).orderBy((F.col("pkg") != F.col("own")).cast("int"), "cmd").limit(1).select(F.col("cmd").alias("command"))
        return self.tests.where(F.col("source") == path).select("test").join(best, F.lit(True), "left").orderBy("test")

    def recent_changes(self, now: int, days: int = 7, limit: int = 20) -> DataFrame:
        return self.recent.where(F.col("ts") >= now - days * DAY).orderBy(F.desc("ts"), "file").limit(limit)

    def risk_check(self, path: str) -> DataFrame:
        """(path, risk, tier): the path's own rule, else the stored record's."""
        asked = self.spark.createDataFrame([(path,)], "path string")
        found = asked.join(self.files.select("path", F.col("risk").alias("stored")), "path", "left")
        risk = F.coalesce(classify.risk_kind(F.col("path")), F.col("stored"))
        return found.select("path", risk.alias("risk"), classify.edit_verdict(F.col("path"), F.col("stored")).alias("tier"))

    def tree(self, folder: str = "", most: int = 60) -> DataFrame:
        """(folder, n, names): files of the first two levels, fullest first."""
        own = self.files.where(F.col("path").startswith(f"{folder}/") if folder else F.lit(True))
        rest = F.split(F.substring("path", len(folder) + 2 if folder else 1, 1 << 20), "/")
        two = F.array_join(F.slice(rest, 1, F.least(F.lit(2), F.greatest(F.size(rest) - 1, F.lit(0)))), "/")
        return own.groupBy(two.alias("folder")).agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set(F.element_at(rest, -1))), 1, 3).alias("names")).orderBy(F.desc("n"), "folder").limit(most)

    def overview(self) -> dict[str, DataFrame]:
        """Languages, packages, entry points, commands, risky files and tree, by title."""
        rank = F.array_position(F.array(*map(F.lit, COMMAND_ORDER)), F.col("kind"))
        return {
            "languages": self.files.groupBy("lang").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).orderBy(F.desc("n"), "lang"), "packages": self.packages.orderBy("id").limit(8), "entrypoints": self.files.where("entry").select("path").orderBy("path").limit(6),
            "commands": self.commands.orderBy(rank, "pkg", "cmd").limit(15), "risky": self.files.where("risk is not null").groupBy("risk").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("path")), 1, 6).alias("paths")).orderBy("risk"), "tree": self.tree(),
        }
