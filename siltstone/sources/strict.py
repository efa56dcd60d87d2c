"""Checks of artifacts beyond their schema and integrity, for those who ask for them: what pointers' hashes say of the texts that they
point at, ranges the wrong way round, ids given twice, and more findings than a review publishes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import graph as G
from siltstone.sources import artifacts as A

#: Findings of a severity that a review publishes at most.
MOST = {"blocking": 3, "warning": 5}
KEYS = ["id", "path"]


def line_offsets(files: DataFrame) -> DataFrame:
    """(id, path, line, offset): the byte at which each line of the files (id, path, source) begins; lines count from 1."""
    lines = files.select(*KEYS, F.posexplode(F.split("source", "\n", -1)).alias("line", "text"))
    before = Window.partitionBy(*KEYS).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long") + 1
    return lines.select(*KEYS, (F.col("line") + 1).alias("line"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"))


def cut_ranges(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """pointers (id, path, range, ...) with `cut`, the bytes that the range takes of the file; null where a line is beyond it."""
    c = F.col
    wanted = files.join(pointers.select(*KEYS).distinct(), KEYS, "left_semi")
    offsets = G.written(line_offsets(wanted), "offsets")
    at = lambda end: offsets.select(*KEYS, c("line").alias(f"_{end}"), c("offset").alias(f"_{end}_offset"))
    rows = pointers.withColumns({"_start": c("range.start_line"), "_end": c("range.end_line")})
    rows = rows.join(at("start"), [*KEYS, "_start"], "left").join(at("end"), [*KEYS, "_end"], "left")
    first, last = c("_start_offset") + c("range.start_character"), c("_end_offset") + c("range.end_character")
    cut = F.substring(F.encode("source", "UTF-8"), (first + 1).cast("int"), F.greatest(F.lit(0), last - first).cast("int"))
    rows = rows.withColumns({"_first": first, "_last": last}).join(wanted.select(*KEYS, "source"), KEYS, "left")
    return rows.withColumn("cut", F.when(c("_first").isNotNull() & c("_last").isNotNull(), cut)).select(*pointers.columns, "cut")


def strict(of: DataFrame) -> DataFrame:
    """(id, location, message) of parsed documents, one a breach:

    * a pointer's content_hash is not that of the text in its range (pointers without one, or beyond the file, are passed over);
    * a range that begins after its end; an id that several items of one list have; more findings of a severity than MOST.
    """
    c, lit = F.col, F.lit
    of = G.written(of.select("id", "a"), "parsed")
    pointers = G.written(A.evidence(of), "pointers")
    listed = of.select("id", F.posexplode("a.index.files").alias("pos", "f"))
    files = listed.groupBy("id", c("f.path").alias("path")).agg(F.max_by("f", "pos").alias("f")).select("id", "path", F.coalesce("f.source", lit("")).alias("source"))
    hashed = pointers.filter("content_hash is not null and range is not null").select("id", "path", "location", "range", "content_hash")
    found = cut_ranges(hashed, files).filter("cut is not null")
    other = found.filter(F.concat(lit("sha256:"), F.sha2("cut", 256)) != c("content_hash"))
    place = F.concat(lit(" L"), c("range.start_line").cast("string"), lit("-L"), c("range.end_line").cast("string"))
    wrong = other.select("id", "location", F.concat(lit("content_hash is not that of "), "path", place).alias("message"))
    start, end = F.struct("range.start_line", "range.start_character"), F.struct("range.end_line", "range.end_character")
    turned = pointers.filter(start > end).select("id", "location", F.concat(lit("range begins after its end:"), place).alias("message"))
    ids = lambda name: of.select("id", lit(name).alias("location"), F.explode(F.transform(f"a.{name}", lambda x: x["id"])).alias("x"))
    every = reduce(DataFrame.union, [ids(n) for n in ("flows", "concepts", "invariants", "findings")])
    twice = every.filter("x is not null").groupBy("id", "location", "x").agg(F.count("*").alias("n")).filter("n > 1")
    twice = twice.select("id", "location", F.concat(lit("id "), "x", lit(" is given "), c("n").cast("string"), lit(" times")).alias("message"))
    severities = of.select("id", F.explode("a.findings").alias("f")).groupBy("id", c("f.severity").alias("severity")).agg(F.count("*").alias("n"))
    most = F.create_map(*(lit(x) for pair in MOST.items() for x in pair))[c("severity")]
    many = severities.filter(c("n") > most).select("id", lit("findings").alias("location"), F.concat(c("n").cast("string"), lit(" "), "severity", lit(" findings, published are at most "), most.cast("string")).alias("message"))
    return wrong.union(turned).union(twice).union(many)
