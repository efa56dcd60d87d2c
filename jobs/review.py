"""Reviews labelled documents and keeps the review up to date.

    python -m jobs.review --documents DOCS --labels LABELS --out OUT [--config jobs/review.json]

DOCS (doc_id, text, source) is the corpus as it stands, LABELS (doc_id, quality, toxic) are findings of people that cite its
documents. A run compares DOCS with the snapshot of the run before and writes, under OUT:

    facts/           lines, bytes, words and secrets of each distinct text ever seen, by its hash; only new texts are measured
    runs/run=N/      one row: what the run read, written last; a run counts when this is there
    snapshot/run=N/  (doc_id, source, content_hash) of the corpus
    changes/run=N/   (doc_id, content_hash), partitioned by change: added, modified or removed
    items/run=N/     each label with its document's facts, partitioned by status: `new` (the document came with this run),
                     `stale` (it changed, so the label is to be looked at again), `reusable` (it did not) or `orphan` (there
                     is none), with a severity and a quickfix line
    brief/run=N/     of each source the first blocking and warning items that are no orphans, as many as the configuration
                     says, partitioned by severity

A run on unchanged input finds that out by the mark and leaves no run; the snapshot that it took is overwritten by the next one, as
are the folders of a run that died before its row in runs/. Documents of one id are told apart by their texts: each text of an id counts once. Null ids are no
document's. A null text is an empty one.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions import text as T
from siltstone.operators import diff as D
from siltstone.operators import keyed as K
from siltstone.sources import store

SNAPSHOT = "doc_id long, source string, content_hash string"
RUN = "documents long, labels long, fingerprint string, changed long, computed long"
ITEM = "doc_id long, quality int, toxic int, source string, severity string, content_hash string, n_lines long, n_words long, n_redacted long, quickfix string, status string"
WORD = r"[^\x20\x09-\x0D]+"
log = logging.getLogger(__name__)


def measured(texts: DataFrame) -> DataFrame:
    """(content_hash, n_lines, n_bytes, n_words, n_redacted) of texts (content_hash, text)."""
    rows = texts.select("content_hash", "text", T.line_count(F.col("text")).alias("n_lines"), F.octet_length("text").cast("long").alias("n_bytes"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    return T.redact(rows, "text", "n_redacted").select("content_hash", "n_lines", "n_bytes", "n_words", "n_redacted")


def fingerprint(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and a sum of their hashes that no order or partitioning changes."""
    n, h = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return n, str(h or 0)


def last_run(spark: SparkSession, out: str):
    """The last finished run's row, or None."""
    rows = store.opened(spark, f"{out}/runs", StructType.fromDDL(f"{RUN}, run long"))
    return rows.orderBy(F.desc("run")).first()


def changes_of(before: DataFrame, now: DataFrame) -> DataFrame:
    """(doc_id, content_hash, change): ids that came, went or stand for other texts than before."""
    of = lambda rows: rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("content_hash")), " ").alias("content_hash"))
    now = of(now)
    return D.snapshot_diff(of(before), now, ["doc_id"], "content_hash").join(now, "doc_id", "left").select("doc_id", "content_hash", "change")


def items_of(labels: DataFrame, snapshot: DataFrame, changes: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ITEM: labels beside the documents they cite."""
    c = F.col
    rows = labels.join(snapshot, "doc_id", "left").join(facts.drop("n_bytes"), "content_hash", "left").join(changes.select("doc_id", "change"), "doc_id", "left")
    severity = F.when(c("toxic") == 1, "blocking").when(c("quality") == 0, "warning").otherwise("spotlight")
    status = F.when(c("content_hash").isNull(), "orphan").when(c("change") == "added", "new").when(c("change") == "modified", "stale").otherwise("reusable")
    path = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce(c("doc_id").cast("string"), F.lit("null")))
    claim = F.concat(status, F.lit(" label of "), F.coalesce(c("n_words"), F.lit(0)).cast("string"), F.lit(" words"))
    rows = rows.withColumns({"severity": severity, "status": status, "quickfix": T.quickfix_line(path, F.lit(1), F.lit(0), severity, claim)})
    return rows.select(*(f.split()[0] for f in ITEM.split(", ")))


def brief_of(items: DataFrame, config: dict) -> DataFrame:
    """The first items of each source and severity: those with most secrets, then most words, then by id."""
    found = items.filter("status <> 'orphan'").withColumns({"_secrets": -F.col("n_redacted"), "_words": -F.col("n_words")})
    order = ["_secrets", "_words", "doc_id", "content_hash"]
    parts = [K.first_per_key(found.filter(F.col("severity") == s), ["source", "severity"], order, config[s]) for s in ("blocking", "warning")]
    return parts[0].union(parts[1]).drop("_secrets", "_words")


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> dict[str, int]:
    """Bring the review up to date; returns what was read, found changed and measured."""
    docs = spark.read.parquet(documents).select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("content_hash", T.sha256_text(F.col("text")))
    found = spark.read.parquet(labels).select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    last = last_run(spark, out)
    n = last["run"] + 1 if last else 0
    place = {name: f"{out}/{name}/run={n}" for name in ("snapshot", "changes", "items", "brief", "runs")}
    docs.filter("doc_id is not null").select("doc_id", "source", "content_hash").distinct().write.mode("overwrite").parquet(place["snapshot"])
    snapshot = spark.read.schema(SNAPSHOT).parquet(place["snapshot"])
    (n_docs, mark_docs), (n_labels, mark_labels) = fingerprint(snapshot), fingerprint(found)
    mark = f"{mark_docs} {mark_labels} {json.dumps(config, sort_keys=True)}"
    if last and (last["documents"], last["labels"], last["fingerprint"]) == (n_docs, n_labels, mark):
        log.info("read %d documents and %d labels: no changes, the review is up to date", n_docs, n_labels)
        return {"run": last["run"], "documents": n_docs, "labels": n_labels, "changed": 0, "computed": 0}
    before = spark.read.schema(SNAPSHOT).parquet(f"{out}/snapshot/run={n - 1}") if last else spark.createDataFrame([], SNAPSHOT)
    changes_of(before, snapshot).write.mode("overwrite").partitionBy("change").parquet(place["changes"])
    changes = spark.read.schema("doc_id long, content_hash string, change string").parquet(place["changes"])
    texts = docs.filter("doc_id is not null").select("content_hash", "text")
    reuse = store.reused(texts, ["content_hash"], measured, f"{out}/facts")
    facts = store.opened(spark, f"{out}/facts", measured(texts.limit(0)).schema)
    items_of(found, snapshot, changes, facts).write.mode("overwrite").partitionBy("status").parquet(place["items"])
    items = spark.read.schema(ITEM).parquet(place["items"])
    brief_of(items, config).write.mode("overwrite").partitionBy("severity").parquet(place["brief"])
    changed = changes.count()
    spark.createDataFrame([(n_docs, n_labels, mark, changed, reuse.computed)], RUN).coalesce(1).write.mode("overwrite").parquet(place["runs"])
    log.info("run %d: read %d documents and %d labels; %d ids changed, %d texts measured, %d known; wrote %s", n, n_docs, n_labels, changed, reuse.computed, reuse.known, ", ".join(place.values()))
    return {"run": n, "documents": n_docs, "labels": n_labels, "changed": changed, "computed": reuse.computed}


def read(spark: SparkSession, out: str) -> DataFrame:
    """The last finished run's items, and its brief, told apart by `part`."""
    n = last_run(spark, out)["run"]
    columns = [f.split()[0] for f in ITEM.split(", ")]
    parts = [spark.read.schema(ITEM).parquet(f"{out}/{part}/run={n}").select(F.lit(part).alias("part"), *columns) for part in ("items", "brief")]
    return parts[0].union(parts[1])


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default="jobs/review.json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("review").getOrCreate()
    try:
        run(spark, a.documents, a.labels, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
