"""The jobs as registered queries: each runs twice into one new folder of the shared directory and returns what then stands there."""

from __future__ import annotations

import json
import uuid

from siltstone.catalogue import PASS
from siltstone.functions import text as T
from siltstone.operators import graph as G
from siltstone.registry import ORACLE, QUERIES

from jobs import publish, review

PUBLISH = {"warn_bytes": 5242880, "refuse_bytes": 15728640, "max_files_per_trigger": 1000}
REVIEW = {"blocking": 3, "warning": 5}


def _folder(spark, name: str) -> str:
    return f"{G.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_publish(spark, sf_dir: str):
    root = _folder(spark, "job1")
    for _ in range(2):
        publish.run(spark, f"{sf_dir}/documents.parquet", f"{root}/out", f"{root}/mark", PUBLISH)
    return publish.read(spark, f"{root}/out")


def job2_review(spark, sf_dir: str):
    root = _folder(spark, "job2")
    for _ in range(2):
        review.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", root, REVIEW)
    return review.read(spark, root)


def _steps() -> str:
    """Texts redacted step by step, with n and line columns of each step: how often its pattern stands in what the steps before it
    left, and the line of the first."""
    steps = {"quoted": (f"(?i){PASS}\"[^''\"\\n]{{6,}}\"", "\\1\\2\"[REDACTED]\""), "ticked": (f"(?i){PASS}''[^''\"\\n]{{6,}}''", "\\1\\2''[REDACTED]''")}
    steps |= {name: (p, "[REDACTED]") for name, p in T.VALUE_PATTERNS.items()}
    sql = "SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(text, '') AS text, lang FROM documents"
    for name, (p, to) in steps.items():
        n = f"len(regexp_extract_all(text, '{p}'))"
        before = f"regexp_split_to_array(text, '{p}')[1]"
        line = f"CASE WHEN {n} > 0 THEN length({before}) - length(replace({before}, chr(10), '')) + 1 END"
        sql = f"SELECT * REPLACE (regexp_replace(text, '{p}', '{to}', 'g') AS text), {n} AS n_{name}, {line} AS line_{name} FROM ({sql})"
    return sql


def _quickfix() -> str:
    kinds = {"assignment": ("n_quoted + n_ticked", "least(line_quoted, line_ticked)")} | {k: (f"n_{k}", f"line_{k}") for k in T.VALUE_PATTERNS}
    lines = [f"CASE WHEN {n} > 0 THEN source || '/' || doc_id || ':' || {line} || ':1: [BLOCKING] {k} in text, ' || ({n}) || ' replaced' END" for k, (n, line) in kinds.items()]
    return f"concat_ws(chr(10), {', '.join(lines)})"


TOTAL = " + ".join(f"n_{k}" for k in ("quoted", "ticked", *T.VALUE_PATTERNS))
SIZE = f"CASE WHEN strlen(text) > {PUBLISH['refuse_bytes']} THEN 'refuse' WHEN strlen(text) > {PUBLISH['warn_bytes']} THEN 'warn' ELSE 'ok' END"
LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT"

PUBLISH_SQL = f"""SELECT doc_id, source, text, 'sha256:' || sha256(text) AS sha256, {LINES} AS n_lines, strlen(text)::BIGINT AS n_bytes, {SIZE} AS size,
 ({TOTAL})::BIGINT AS n_redacted, {_quickfix()} AS quickfix, lang FROM ({_steps()})"""

REVIEW_SQL = rf"""WITH redacted AS ({_steps()}), docs AS (SELECT DISTINCT d.doc_id, d.source, 'sha256:' || sha256(coalesce(d.text, '')) AS content_hash, length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), chr(10), '')) + 1 AS n_lines,
 len(regexp_extract_all(coalesce(d.text, ''), '{review.WORD}')) AS n_words, n_redacted FROM documents d JOIN (SELECT doc_id, {TOTAL} AS n_redacted FROM redacted) USING (doc_id)),
 found AS (SELECT l.doc_id, l.quality::INTEGER AS quality, l.toxic::INTEGER AS toxic, source, CASE WHEN toxic = 1 THEN 'blocking' WHEN quality = 0 THEN 'warning' ELSE 'spotlight' END AS severity, content_hash, n_lines::BIGINT AS n_lines, n_words::BIGINT AS n_words,
 n_redacted::BIGINT AS n_redacted, CASE WHEN content_hash IS NULL THEN 'orphan' ELSE 'new' END AS status FROM labels l LEFT JOIN docs USING (doc_id)),
 items AS (SELECT *, coalesce(source, 'unknown') || '/' || coalesce(doc_id::VARCHAR, 'null') || ':1:1: [' || upper(severity) || '] ' || status || ' label of ' || coalesce(n_words, 0) || ' words' AS quickfix FROM found),
 brief AS (SELECT * FROM items WHERE status <> 'orphan' AND severity <> 'spotlight' QUALIFY row_number() OVER (PARTITION BY source, severity ORDER BY n_redacted DESC, n_words DESC, doc_id, content_hash) <= CASE severity WHEN 'blocking' THEN {REVIEW['blocking']} ELSE {REVIEW['warning']} END)
 SELECT 'items' AS part, * FROM items UNION ALL SELECT 'brief', * FROM brief"""

QUERIES |= {"job1_publish": job1_publish, "job2_review": job2_review}
ORACLE |= {"job1_publish": PUBLISH_SQL, "job2_review": REVIEW_SQL}


def configured(path: str) -> dict:
    """A configuration file of the jobs."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
