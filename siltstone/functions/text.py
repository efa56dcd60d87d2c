"""Scalar expressions: paths, hashes, redaction, escaping. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word boundary and white space as wide as the expected results need.
LETTER = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))"
# Shapes of secrets, in the order in which they are replaced.
VALUE_PATTERNS = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "payment_key": r"\b(?:pk|sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\b",
    "forge_token": r"\bghp_[A-Za-z0-9]{36}\b",
    "forge_login": r"\bgho_[A-Za-z0-9]{36}\b",
    "maps_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "chat_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "signed_token": r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
}
SECRET_KEYS = r"password|passwd|secret|api_key|apikey|access_key|auth_token|credential"
SECRET_NAME = rf"(?:{SECRET_KEYS}|token)"
ASSIGNMENT = rf"(\b[A-Za-z_]*{SECRET_NAME}[A-Za-z_]*)(\s*[:=]\s*)(['\"])([^'\"\n]{{6,}})\3"
#: By pattern, text without which it cannot match: looked for before the pattern is tried.
LITERALS = {
    "aws_key": ["AKIA"], "api_key": ["sk-"], "payment_key": ["_live_", "_test_"], "forge_token": ["ghp_"], "forge_login": ["gho_"],
    "maps_key": ["AIza"], "chat_token": ["xox"], "signed_token": ["eyJ"], "private_key": ["-----BEGIN "],
}
MARK = "[REDACTED]"
#: extension -> language
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}


def sha256_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")


def language_of(path: Column) -> Column:
    """Language by the path's last extension; null for others."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return table[F.nullif(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1), F.lit(""))]


def glob_regex(pattern: str) -> str:
    """A shell pattern over a whole path as a regular expression; * crosses slashes."""
    parts = re.split(r"(\*|\?)", pattern)
    return "^" + "".join({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(p) or re.sub(r"([^\w/])", r"\\\1", p) for p in parts) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a component of the path is a pattern, or the whole path matches one."""
    parts = F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(p) for p in patterns)))
    whole = F.lit(False)
    for p in patterns:
        whole = whole | path.rlike(glob_regex(p))
    return parts | whole


def _wide(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def _assignment() -> str:
    return "(?U)(?i)" + _wide(ASSIGNMENT).replace(r"\s", r"[\s\x1c-\x1f]")


def redact_assignments(text: Column) -> tuple[Column, Column]:
    """(text with the values of secret-named assignments replaced, how many). Texts without such a name are not searched further."""
    pattern = F.lit(_assignment())
    named = text.rlike("(?U)(?i)" + SECRET_NAME)
    return F.when(named, F.regexp_replace(text, pattern, F.lit("$1$2$3" + MARK + "$3"))).otherwise(text), F.when(named, F.regexp_count(text, pattern)).otherwise(F.lit(0)).cast("long")


def _redacted(text: Column) -> Column:
    """(t, places) of a text: redacted, and an array of (kind, n, line) with an entry a kind of secret.

    Each step is a function of the value that the one before it made, so the expression grows with the number of steps
    alone, wherever the optimizer puts it.
    """

    def place(kind: str, n: Column, held: Column, pattern: str) -> Column:
        line = F.when(n > 0, line_count(F.split(held, pattern, 2)[0]))  # what stands before the first match
        return F.array(F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n"), line.alias("line")))

    def first(held: Column) -> Column:
        whole, n = redact_assignments(held)
        return F.struct(whole.alias("t"), place("assignment", n, held, _assignment()).alias("places"))

    def step(name: str, pattern: str):
        def on(x: Column) -> Column:
            there = F.lit(False)
            for literal in LITERALS[name]:
                there = there | F.contains(x["t"], F.lit(literal))
            n = F.when(there, F.regexp_count(x["t"], F.lit(pattern))).otherwise(F.lit(0))
            new = F.when(there, F.regexp_replace(x["t"], F.lit(pattern), F.lit(MARK))).otherwise(x["t"])
            return F.struct(new.alias("t"), F.concat(x["places"], place(name, n, x["t"], pattern)).alias("places"))

        return on

    state = F.transform(F.array(text), first)
    for name, p in VALUE_PATTERNS.items():
        state = F.transform(state, step(name, _wide(p)))
    return state[0]


def redact(df: DataFrame, text: str, count: str) -> DataFrame:
    """df with `text` redacted and `count`, how many places: assignments first, then the value patterns one after another."""
    out = df.withColumn("_r", _redacted(F.col(text)))
    total = F.aggregate("_r.places", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    return out.withColumns({text: F.col("_r.t"), count: total}).drop("_r")


def redact_places(df: DataFrame, text: str, places: str) -> DataFrame:
    """df with `text` redacted as redact() does and `places`, an array of (kind, n, line): of each kind of secret found how
    often it stood there and the line of the first. Lines count from 1 in the text as it was."""
    out = df.withColumn("_r", _redacted(F.col(text)))
    return out.withColumns({text: F.col("_r.t"), places: F.filter("_r.places", lambda x: x["n"] > 0)}).drop("_r")


def island(payload: Column) -> Column:
    """JSON that cannot end the script element it stands in."""
    return F.replace(payload, F.lit("</"), F.lit("<\\/"))


def size_class(size: Column, warn: int, refuse: int) -> Column:
    return F.when(size > refuse, "refuse").when(size > warn, "warn").otherwise("ok")


def quickfix_line(path: Column, line: Column, column: Column, severity: Column, claim: Column) -> Column:
    """path:line:column: [SEVERITY] claim, columns from 1, white space folded; missing places are 1."""
    folded = F.trim(F.regexp_replace(claim, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.concat(path, F.lit(":"), F.coalesce(line, F.lit(1)).cast("string"), F.lit(":"), (F.coalesce(column, F.lit(0)) + 1).cast("string"), F.lit(": ["), F.upper(severity), F.lit("] "), folded)
