"""Site-relative line dedup: drop the lines that stand on too large a share of a host's pages.

DataFrame operations only. Per host, pages that contain a line are divided by the host's page total; lines above
`ratio` on at least `min_pages` pages go. Lines are compared by md5 of their exact bytes, so the counting shuffle moves
16 bytes a line and partial aggregation folds hot lines before it; texts do not move: the hosts' lists come to them.

Defined cases: a null text stays null and counts as a page without lines; a null host is a host of its own; lines
without a word are never counted or dropped; repeated lines in a page count once and all go; a page may end up empty
and is kept; an empty table gives an empty result; ids are not used; other columns pass through, helper names carry a
prefix, and where the input has an n_lines or n_dropped the new one ends in an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, table, written

RATIO, MIN_PAGES = 0.1, 5
#: Dropped lines that are broadcast, some 50 bytes each on every executor; text of a host that one salt of the join takes
#: where there are more.
MAX_BROADCAST, SALT_BYTES = 500_000, 1 << 30


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_ld_host, _ld_line md5, pages, total) for each line of a host above the ratio."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), _has_word), lambda x: F.unhex(F.md5(x))))
    pages = docs.select(F.col(host).alias("_ld_host"), F.explode(lines).alias("_ld_line")).groupBy("_ld_host", "_ld_line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("_ld_h")).agg(F.count("*").alias("total"))
    return pages.join(totals, F.col("_ld_host").eqNullSafe(F.col("_ld_h"))).drop("_ld_h").filter(F.col("pages") > ratio * F.col("total"))


def _has_word(line):
    return F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]", "")) > 0


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, most: int = MAX_BROADCAST) -> DataFrame:
    """All rows and columns of docs, `text` without the host's boilerplate lines, plus n_lines and n_dropped (bigint).

    A dropped line stands on more than `ratio` of its host's pages, so a host's list has at most 1 / ratio * (lines a
    page) entries. All lists together are broadcast up to `most` lines; beyond that they are joined by host and salt,
    each list once a salt. A host has a salt for each SALT_BYTES of its texts; those with several, of which there are at most as many
    as the corpus has SALT_BYTES, are broadcast to the pages.
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    found = written(boilerplate_lines(docs, host, text, ratio, min_pages).select("_ld_host", "_ld_line"), "boilerplate")
    drops = found.groupBy("_ld_host").agg(F.collect_list("_ld_line").alias("_ld_drop"))
    same = F.col(host).eqNullSafe(F.col("_ld_host"))
    if found.limit(most + 1).count() <= most:
        joined = docs.join(F.broadcast(drops), same, "left")
    else:
        size = F.sum(F.octet_length(text).cast("long"))
        large = docs.groupBy(F.col(host).alias("_ld_h")).agg(F.ceil(size / SALT_BYTES).cast("int").alias("_ld_salts")).filter("_ld_salts > 1")
        salts = F.coalesce("_ld_salts", F.lit(1))
        mixed = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]  # copies of a text go apart
        salted = docs.join(F.broadcast(large), F.col(host).eqNullSafe(F.col("_ld_h")), "left").withColumn("_ld_salt", F.pmod(F.xxhash64(*mixed), salts).cast("int")).drop("_ld_h", "_ld_salts")
        each = drops.join(F.broadcast(large), F.col("_ld_host").eqNullSafe(F.col("_ld_h")), "left").withColumn("_ld_s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_ld_h", "_ld_salts")
        joined = salted.join(each.hint("merge"), same & (F.col("_ld_salt") == F.col("_ld_s")), "left").drop("_ld_salt", "_ld_s")
    split = F.split(F.col(text), "\n")
    # the lists' lines that the page has: a set operation, so the list is not searched line by line
    here = F.array_intersect(F.transform(split, lambda x: F.unhex(F.md5(x))), F.coalesce("_ld_drop", F.array().cast("array<binary>")))
    joined = joined.withColumn("_ld_here", here)
    kept = F.when(F.size("_ld_here") > 0, F.filter(split, lambda x: ~(F.array_contains(F.col("_ld_here"), F.unhex(F.md5(x))) & _has_word(x)))).otherwise(split)
    out = joined.withColumn("_ld_kept", kept)
    count = lambda lines: F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    out = out.withColumn(n_lines, count(split)).withColumn(n_dropped, count(split) - count(F.col("_ld_kept")))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join("_ld_kept", "\n"))).drop("_ld_host", "_ld_drop", "_ld_here", "_ld_kept")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, source, text after the operator, n_lines, n_dropped, n_chars (code points left; null text: null)."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"))


SQL = rf"""
WITH pages AS (SELECT source, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM documents),
 totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
 found AS (SELECT source, line, count(*) AS pages FROM pages GROUP BY source, line HAVING count(*) >= {MIN_PAGES}),
 gone AS (SELECT f.source, list(f.line) AS gone FROM found f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source WHERE f.pages > {RATIO} * t.total GROUP BY f.source),
 cut AS (SELECT d.doc_id, d.source, d.text AS whole, string_split(d.text, chr(10)) AS before,
   list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(g.gone, x), false)) AS kept
   FROM documents d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, CASE WHEN whole IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
 CASE WHEN whole IS NULL THEN 0 ELSE len(before) END::BIGINT AS n_lines,
 CASE WHEN whole IS NULL THEN 0 ELSE len(before) - len(kept) END::BIGINT AS n_dropped,
 length(CASE WHEN whole IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END)::BIGINT AS n_chars FROM cut
"""
