"""Publishes a growing folder of texts without their secrets.

    python -m jobs.publish --documents IN --out OUT --checkpoint MARK [--config jobs/publish.json]

Files of IN (Parquet: doc_id, text, lang, source) that came since the last run are read once, as a stream that ends when all
are taken; MARK is the stream's checkpoint. Each text is redacted as artifacts are before they are published. OUT has a row
a document, partitioned by lang: the redacted text, its hash, lines, bytes and size class, how many secrets were
replaced, and one quickfix line a kind of secret, with the line where it first stood.

A run that finds nothing new changes nothing. One that died is taken up where it stopped: OUT's log of finished
batches and MARK make each file count once. Rows that repeat in IN are published each; a null text is published as an empty one, a
null source is called `unknown`. OUT is to be read by Spark, which honours that log.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

SCHEMA = "doc_id long, text string, lang string, source string"
OUT = "doc_id long, source string, text string, sha256 string, n_lines long, n_bytes long, size string, n_redacted long, quickfix string, lang string"
log = logging.getLogger(__name__)


def quickfix(path: Column, places: str) -> Column:
    """One line a kind of secret."""
    claim = lambda x: F.concat(x["kind"], F.lit(" in text, "), x["n"].cast("string"), F.lit(" replaced"))
    return F.array_join(F.transform(places, lambda x: T.quickfix_line(path, x["line"], F.lit(0), F.lit("blocking"), claim(x))), "\n")


def published(documents: DataFrame, config: dict) -> DataFrame:
    """Rows of OUT for documents."""
    c = F.col
    rows = documents.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    found = T.redact_places(rows, "text", "places")
    total = F.aggregate("places", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    found = found.withColumns({"n_redacted": total, "quickfix": quickfix(F.concat("source", F.lit("/"), c("doc_id").cast("string")), "places")})
    bytes_ = F.octet_length("text").cast("long")
    sized = found.withColumns({"sha256": T.sha256_text(c("text")), "n_lines": T.line_count(c("text")), "n_bytes": bytes_})
    sized = sized.withColumn("size", T.size_class(c("n_bytes"), config["warn_bytes"], config["refuse_bytes"]))
    return sized.select(*(f.split()[0] for f in OUT.split(", ")))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Publish what is new; returns how many rows and batches that was."""
    files = documents.rstrip("/")
    files = f"{files[:-1]}[{files[-1]}]"  # a pattern of one name: by a plain name a stream reads folders only, by this one files too
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["max_files_per_trigger"]).parquet(files)
    write = published(source, config).writeStream.format("parquet").partitionBy("lang").option("checkpointLocation", checkpoint)
    stream = write.outputMode("append").trigger(availableNow=True).start(out)
    stream.awaitTermination()
    steps = [p for p in stream.recentProgress if p["numInputRows"]]
    done = {"rows": sum(p["numInputRows"] for p in steps), "batches": len(steps)}
    log.info("read %d new rows of %s in %d batches, wrote them to %s", done["rows"], documents, done["batches"], out)
    return done


def read(spark: SparkSession, out: str) -> DataFrame:
    """What has been published so far."""
    return spark.read.schema(OUT).parquet(out)


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default="jobs/publish.json")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("publish").getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
