"""The jobs: their queries against SQL, and runs over inputs that grow, change and shrink."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import publish, queries, review
from siltstone.functions import text as T

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["job1_publish", "job2_review"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE[name])
    assert plain(df.columns, df.collect()) == plain(rel.columns, rel.fetchall())


def test_configurations_are_those_of_the_queries():
    assert queries.configured(ROOT / "jobs/publish.json") == queries.PUBLISH and queries.configured(ROOT / "jobs/review.json") == queries.REVIEW


def test_places_of_secrets(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"
    texts = ["a\nb\ndb_password = 'hunter22'\nAKIA" + "A" * 16 + "\nAKIA" + "B" * 16, f"x\n{key}\nghp_" + "a" * 36, "plain", "", None]
    df = T.redact_places(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "p")
    got = {r.i: [tuple(x) for x in r.p] for r in df.filter("t is not null").collect()}
    # the key of three lines stands until its own step, so lines are those of the text as it was
    assert got == {0: [("assignment", 1, 3), ("aws_key", 2, 4)], 1: [("forge_token", 1, 5), ("private_key", 1, 2)], 2: [], 3: []}
    whole = T.redact(spark.createDataFrame([(t,) for t in texts if t], "t string"), "t", "n")
    assert sorted(r.t for r in whole.collect()) == sorted(r.t for r in df.filter("i < 3").collect())


def parquet(spark, rows, schema, path, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


DOCS = "doc_id long, text string, lang string, source string"


def test_publish_takes_only_what_is_new(spark, tmp_path):
    docs, out, mark = (str(tmp_path / x) for x in ("docs", "out", "mark"))
    rows = [(1, "token = 'abcdef99'", "en", "s"), (1, "token = 'abcdef99'", "en", "s"), (2, None, None, None), (None, "naïve\ntext", "fr", "s")]
    parquet(spark, rows, DOCS, docs)
    assert publish.run(spark, docs, out, mark, queries.PUBLISH) == {"rows": 4, "batches": 1}
    first = plain(publish.read(spark, out).columns, publish.read(spark, out).collect())
    assert publish.run(spark, docs, out, mark, queries.PUBLISH) == {"rows": 0, "batches": 0}
    assert plain(publish.read(spark, out).columns, publish.read(spark, out).collect()) == first
    parquet(spark, [(5, "AKIA" + "Z" * 16, "en", "t/ü")], DOCS, docs)
    assert publish.run(spark, docs, out, mark, queries.PUBLISH)["rows"] == 1
    got = publish.read(spark, out).collect()
    assert len(got) == 5 and {r.lang for r in got} == {"en", "fr", None}
    new = [r for r in got if r.doc_id == 5][0]
    assert (new.text, new.n_redacted, new.quickfix) == ("[REDACTED]", 1, "t/ü/5:1:1: [BLOCKING] aws_key in text, 1 replaced")
    assert [(r.source, r.text, r.n_lines, r.n_bytes) for r in got if r.doc_id == 2] == [("unknown", "", 1, 0)]
    # what one run over all files publishes is the same
    whole = str(tmp_path / "whole")
    publish.run(spark, docs, whole, str(tmp_path / "mark2"), queries.PUBLISH | {"max_files_per_trigger": 1})
    assert plain(got[0].__fields__, got) == plain(publish.read(spark, whole).columns, publish.read(spark, whole).collect())


def test_publish_of_an_empty_folder(spark, tmp_path):
    parquet(spark, [], DOCS, str(tmp_path / "docs"))
    assert publish.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark"), queries.PUBLISH)["rows"] == 0


LABELS = "doc_id long, quality int, toxic int"


def statuses(spark, out):
    return {(r.doc_id, r.status) for r in review.read(spark, out).filter("part = 'items'").collect()}


def test_review_of_a_corpus_that_changes(spark, tmp_path):
    docs, labels, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    parquet(spark, [(1, "one", "en", "s"), (2, "two", "en", "s"), (3, "two", "en", None), (None, "x", None, None)], DOCS, docs)
    parquet(spark, [(1, 1, 0), (2, 0, 0), (3, 0, 1), (9, 1, 1), (None, 0, 0)], LABELS, labels)
    run = lambda: review.run(spark, docs, labels, out, queries.REVIEW)
    assert run() == {"run": 0, "documents": 3, "labels": 5, "changed": 3, "computed": 2}
    assert statuses(spark, out) == {(1, "new"), (2, "new"), (3, "new"), (9, "orphan"), (None, "orphan")}
    assert {(r.severity, r.doc_id) for r in review.read(spark, out).filter("part = 'brief'").collect()} == {("warning", 2), ("blocking", 3)}
    before = plain(review.read(spark, out).columns, review.read(spark, out).collect())
    assert run() == {"run": 0, "documents": 3, "labels": 5, "changed": 0, "computed": 0}
    assert plain(review.read(spark, out).columns, review.read(spark, out).collect()) == before
    # 1 changes to a text that is known, 3 goes, 4 comes
    parquet(spark, [(1, "two", "en", "s"), (2, "two", "en", "s"), (4, "four", "en", "s")], DOCS, docs, "overwrite")
    assert run() == {"run": 1, "documents": 3, "labels": 5, "changed": 3, "computed": 1}
    assert statuses(spark, out) == {(1, "stale"), (2, "reusable"), (3, "orphan"), (9, "orphan"), (None, "orphan")}
    changes = spark.read.parquet(f"{out}/changes/run=1")
    assert {(r.doc_id, r.change) for r in changes.collect()} == {(1, "modified"), (3, "removed"), (4, "added")}
    # a run that died before its row in runs/ is done again
    spark.read.parquet(f"{out}/runs").filter("run = 0").drop("run").coalesce(1).write.parquet(f"{out}/kept")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/runs/run=1")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    assert run() == {"run": 1, "documents": 3, "labels": 5, "changed": 3, "computed": 0}
    assert statuses(spark, out) == {(1, "stale"), (2, "reusable"), (3, "orphan"), (9, "orphan"), (None, "orphan")}


def test_review_measures_each_text_once(spark, tmp_path):
    docs, labels, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    for i in range(3):
        parquet(spark, [(10 * i + j, f"text {min(j, 3)} of all", "en", "s") for j in range(10)], DOCS, docs)
        parquet(spark, [(10 * i, 1, 0)], LABELS, labels)
        assert review.run(spark, docs, labels, out, queries.REVIEW)["computed"] == (4 if i == 0 else 0)
    assert spark.read.parquet(f"{out}/facts").count() == 4
    assert {r.n_words for r in review.read(spark, out).select(F.col("n_words")).collect()} == {4}


def test_review_of_empty_tables(spark, tmp_path):
    docs, labels, out = (str(tmp_path / x) for x in ("docs", "labels", "out"))
    parquet(spark, [], DOCS, docs)
    parquet(spark, [], LABELS, labels)
    assert review.run(spark, docs, labels, out, queries.REVIEW)["documents"] == 0
    assert review.read(spark, out).collect() == []


def test_command_lines(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(queries.REVIEW))
    argv = [sys.executable, "-m", "jobs.review", "--documents", f"{DIR}/documents.parquet", "--labels", f"{DIR}/labels.parquet", "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    for said in ("run 0:", "no changes"):
        done = subprocess.run(argv, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and said in done.stderr


def test_command_line_of_the_stream(spark, tmp_path):
    argv = [sys.executable, "-m", "jobs.publish", "--documents", f"{DIR}/documents.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run(argv, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 200 new rows" in done.stderr
    assert publish.read(spark, str(tmp_path / "out")).count() == 200 and list((tmp_path / "out").glob("lang=*"))
