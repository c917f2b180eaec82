"""Path rules: language, risk, tests, external packages; globs become regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name endings and their language.
LANGUAGES = {
    "ts": "ts", "tsx": "tsx", "mts": "ts", "cts": "ts", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "rs": "rust", "py": "python",
    "md": "md", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "sql": "sql", "html": "html",
}
#: Path rules of each kind, first kind first.
RISK_RULES = {
    "secret": (
        "**/.env", "**/.env.*", "**/*.pem", "**/*.key", "**/*_rsa*", "**/*.p12", "**/*.pfx", "**/credentials*", "**/secrets*", "**/secret*",
        "**/.npmrc", "**/.netrc", "**/*.tfvars", "**/service-account*.json", "**/.aws/**",
    ),
    "generated": (
        "**/dist/**", "**/build/**", "**/target/**", "**/out/**", "**/.next/**", "**/coverage/**", "**/*.gen.*", "**/*_generated.*",
        "**/*.min.js", "**/*.min.css", "**/*.snap", "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/Cargo.lock", "**/*.map",
    ),
    "vendor": ("**/vendor/**", "**/third_party/**", "**/node_modules/**"),
    "infra": (
        "**/Dockerfile*", "**/docker-compose*", "**/*.tf", "**/terraform/**", "**/k8s/**", "**/kubernetes/**", "**/helm/**", "**/.github/workflows/**",
        "**/.gitlab-ci*", "**/Jenkinsfile*", "**/*migration*/**", "**/migrations/**", "**/Procfile", "**/*.sql",
    ),
}


def glob_to_regex(glob: str) -> str:
    """``**`` spans folders, ``*`` and ``?`` stay within one; dot files match as well.  Sets ``[abc]``,
    ``[!abc]`` and alternatives ``{a,b}`` are those of shells."""
    out, i, open_braces = "", 0, 0
    while i < len(glob):
        if glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + ("[^/" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        elif glob[i] == "{" and glob.find("}", i) > 0:
            out, i, open_braces = out + "(?:", i + 1, open_braces + 1
        elif open_braces and glob[i] in ",}":
            out, open_braces = out + ("|" if glob[i] == "," else ")"), open_braces - (glob[i] == "}")
            i += 1
        elif glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if glob[i] == "*" else "[^/]" if glob[i] == "?" else "\\" + glob[i] if glob[i] in ".+^$()[]{}|\\" else glob[i]
            i += 1
    return f"^{out}$"


def matches_any(path: Column, globs) -> Column:
    return path.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)


def risk_kind(path: Column, extra_secret=(), extra_risky=()) -> Column:
    """secret, generated, vendor, infra, risky or null: the first rule that holds."""
    out = F.when(matches_any(path, (*RISK_RULES["secret"], *extra_secret)), "secret")
    for kind in ("generated", "vendor", "infra"):
        out = out.when(matches_any(path, RISK_RULES[kind]), kind)
    return out.when(matches_any(path, extra_risky), "risky")


def language_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ending), F.lit("other"))


def is_test(path: Column) -> Column:
    return path.rlike("\\.(test|spec)\\.[a-z]+$|(^|/)__tests__/|(^|/)tests/")


def external_package(spec: Column) -> Column:
    """Package of an import: two parts of a scoped name, else the first; null for relative ones."""
    return F.when(spec.rlike("^[./]"), None).when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(spec, "^([^/]+)", 1))


def is_embeddable(kind: Column, risk: Column) -> Column:
    return ~kind.isin("secret", "asset", "vendor", "test") & ~F.coalesce(risk, F.lit("")).isin("generated", "vendor")


def edit_verdict(path: Column, record_risk: Column, globs=()) -> Column:
    """severe, destructive or null for an edit of the path."""
    risk = F.coalesce(risk_kind(path, extra_risky=globs), record_risk)
    return F.when(risk == "secret", "severe").when(risk.isin("generated", "vendor", "infra", "risky"), "destructive")


def read_warning(risk: Column, lines: Column, reads: Column) -> Column:
    """Why reading a file as a whole is little use: low-value, huge, repeated, else null."""
    return F.when(risk.isin("generated", "vendor"), "low-value").when(lines > 3000, "huge").when(reads >= 2, "repeated")


def decision(tier: Column, mode: str) -> Column:
    """What a hook answers to a verdict's tier."""
    if mode == "warn":
        return F.when(tier.isNotNull(), "warn")
    if mode == "off":
        return F.lit(None).cast("string")
    return F.when(tier == "severe", "deny").when(tier == "destructive", "ask").when(tier.isNotNull(), "warn")
