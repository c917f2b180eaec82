"""Text functions as Column expressions: identifiers, tokens, entropy, redaction, weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Words that carry no meaning in a question; short words are dropped anyway.
NOISE = ("id", "to", "the", "and", "for", "with", "from", "that", "this", "into", "der", "die", "das", "les", "des", "une", "los", "las", "que")


def fold_accents(c: Column) -> Column:
    """Letters with diacritics become plain ones; null stays null."""
    return F.translate(c, ACCENTED, PLAIN)


def split_identifier(c: Column) -> Column:
    """Lower-case parts of an identifier: camelCase, ACRONYMWord, snake, kebab, letter-digit."""
    s = fold_accents(c)
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Za-z])([0-9])", "$1 $2")
    s = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: x != "")


def tokenize(c: Column) -> Column:
    """Folded lower-case tokens of two characters or more, noise words dropped; duplicates stay."""
    return F.filter(F.split(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+"), lambda x: (F.length(x) >= 2) & ~x.isin(*NOISE))


def estimate_tokens(c: Column) -> Column:
    """About four characters a token, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def round1(c: Column) -> Column:
    """One decimal, halves towards plus infinity."""
    return F.floor(c * 10 + 0.5) / 10


def bm25_idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def generic_damp(df: Column, n: Column) -> Column:
    """1 for terms of at most 8 % of the files, 0.12 from 30 % on, linear between."""
    share = df / F.nullif(n, F.lit(0))
    return F.when(n <= 0, 1.0).when(share <= 0.08, 1.0).when(share >= 0.30, 0.12).otherwise(1.0 - (share - 0.08) / 0.22 * 0.88)


def shannon_entropy(c: Column) -> Column:
    """Bits a character; 0 for the empty string.  A character's count is what the text loses with it."""
    n = F.length(c)
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    chars = F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(chars, F.lit(0.0), lambda a, x: a - share(x) * F.log2(share(x))))


def _entropies(texts: pa.Array) -> pa.Array:
    def bits(text: str) -> float:
        n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)[1] / max(1, len(text))
        return float(-(n * np.log2(n)).sum()) + 0.0

    return pa.array([None if x is None else bits(x) for x in texts.to_pylist()], pa.float64())


def text_entropy(c: Column) -> Column:
    """``shannon_entropy`` of whole texts: one pass over the characters, whatever their number (no higher-order
    function can call it)."""
    return F.arrow_udf(_entropies, "double")(c)


REDACTED = "[REDACTED]"
#: Patterns of secrets that stand on their own, in the order of their use.
TOKEN_PATTERNS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*\z",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bghp_[A-Za-z0-9]{36}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}",
    r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}",
    r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
)
#: Schemes of addresses with credentials, and words of keys whose values are secret.
URL_SCHEMES = r"postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|https?"
VALUE_KEYS = "password|passwd|secret|token|api[_-]?key|access[_-]?key"
ENV_KEYS = VALUE_KEYS + "|client[_-]?secret|private[_-]?key"
#: Quoted stretches of this length without white space and with more bits a character are secrets.
QUOTED, BITS = 20, 4.0
_QUOTED = "\"[^'\"\\n]{%d,}\"|'[^'\"\\n]{%d,}'" % (QUOTED, QUOTED)


def quoted_secrets(c: Column) -> Column:
    """The quoted stretches (with their quotes) that look random: long, contiguous, of high entropy."""
    body = lambda x: F.substring(x, 2, F.length(x) - 2)
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(0)), lambda x: ~x.rlike(r"\s") & (shannon_entropy(body(x)) > BITS)))


def redact(c: Column) -> Column:
    """Secrets replaced by a marker: PEM blocks (an unterminated one to the end), known token shapes,
    credentials in addresses, values of ``KEY=value`` lines and of quoted assignments to
    secret-looking keys, quoted stretches of high entropy.  Redacting twice changes nothing; null
    stays null.  Texts without any sign of a secret pass one test only."""
    sign = F.coalesce(c.rlike(f"(?i)-----BEGIN|AKIA|gh[p]_|github_pat_|sk-|[sr]k_|AIza|xox|eyJ|://|{ENV_KEYS}|[\"'][^'\"\\s]{{{QUOTED}}}"), F.lit(False))
    out = c
    for pattern in TOKEN_PATTERNS:
        out = F.regexp_replace(out, pattern, REDACTED)
    out = F.regexp_replace(out, rf"(?i)\b((?:{URL_SCHEMES})://)[^\s:@/]+:[^\s@/]+@", f"$1{REDACTED}@")
    out = F.regexp_replace(out, rf"(?im)^([A-Z][A-Z0-9_]*(?:{ENV_KEYS})[A-Z0-9_]*)=[^\s'\"]\S*", f"$1={REDACTED}")
    for quote in "'\"":
        out = F.regexp_replace(out, rf"(?i)({VALUE_KEYS})(\s*[:=]\s*){quote}[^'\"]{{8,}}{quote}", f"$1$2{quote}{REDACTED}{quote}")
    out = F.aggregate(quoted_secrets(out), out, lambda a, x: F.replace(a, x, F.concat(F.substring(x, 1, 1), F.lit(REDACTED), F.substring(x, 1, 1))))
    return F.when(sign, out).otherwise(c)


def clean_query(c: Column) -> Column:
    """A search pattern as plain words: classes and metacharacters go, spaces collapse."""
    c = F.regexp_replace(c, "\\[[^\\]]*\\]", " ")
    c = F.regexp_replace(c, "\\\\[a-zA-Z]", " ")
    c = F.regexp_replace(c, "[\\\\^$.|?*+(){}]", " ")
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def is_conversational(c: Column) -> Column:
    """Short replies that ask for nothing."""
    return F.lower(F.trim(c)).rlike("^(thanks|thank you|ok|okay|yes|no|yep|nope|sure|great|merci|oui|non|go|continue|hello|hi)[.! ]*$")


def sanitize_branch(c: Column) -> Column:
    """A branch name as a path part of at most 40 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(fold_accents(c), "[^A-Za-z0-9_]+", "-"), "^-+|-+$", ""), 1, 40)


def path_identity(c: Column) -> Column:
    """Base name and 12 hex digits of the path's sha-256."""
    return F.concat(F.regexp_extract(c, "([^/]*)/*$", 1), F.lit("-"), F.substring(F.sha2(c.cast("binary"), 256), 1, 12))


def chunk_text(path: Column, exports: Column, body: Column) -> Column:
    """What is embedded for a file: path words, at most 20 names, 800 characters of the body
    without import lines, 1200 characters in all."""
    words = F.concat_ws(" ", split_identifier(path))
    own = F.substring(F.trim(F.regexp_replace(body, "(?m)^(import|from|use|#include) [^\\n]*\\n?", "")), 1, 800)
    return F.substring(F.concat_ws("\n", words, F.concat_ws(" ", F.slice(exports, 1, 20)), own), 1, 1200)
