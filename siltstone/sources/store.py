"""Content-addressed stores: what was computed of a content once is read again wherever that content stands.

A store is a folder of Parquet files, one row a key. A run joins its contents against the keys that are there, computes only
the rest and appends it. A run that stopped half way has appended nothing or all, by Spark's commit, and the next run takes
what is missing. One run at a time may write to a store.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators import graph as G
from siltstone.sources import snapshot as S

FACT_KEY = ["language", "module", "sha256"]


@dataclass
class Reuse:
    """rows with what the store holds of them, and how many distinct contents were known before and computed now."""

    rows: DataFrame
    known: int
    computed: int

    @property
    def rate(self) -> float:
        """The share of contents that were not computed again; 1 of none."""
        return self.known / (self.known + self.computed) if self.known + self.computed else 1.0


def opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path; an empty one where there is none yet."""
    try:
        spark.read.schema(schema).parquet(path).schema  # noqa: B018  analysis looks for the path
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def reused(rows: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame], path: str) -> Reuse:
    """rows joined with compute's columns of their key, from the store at path.

    compute takes unseen rows, one of each key, and returns the key and columns that depend on it alone. Copies are
    folded in each task before they are shuffled, so a content that most rows hold costs one row a task. Rows with a null
    in the key are left out.
    """
    spark, schema = rows.sparkSession, compute(rows.limit(0)).schema
    known, contents = opened(spark, path, schema).select(*key), rows.dropna(subset=key)
    unseen = G.written(contents.dropDuplicates(key).join(known, key, "left_anti"), "unseen")
    computed = unseen.count()
    before = contents.select(*key).distinct().count() - computed
    if computed:
        compute(unseen).write.mode("append").parquet(path)
    G.removed(unseen)
    logging.getLogger(__name__).info("%s: %d contents known, %d computed", path, before, computed)
    return Reuse(contents.join(opened(spark, path, schema), key), before, computed)


def facts(files: DataFrame, path: str, repeats: bool = True) -> Reuse:
    """Facts of files from a store: a file is parsed if its language, module or text is new.

    Facts name symbols by language and module, so those belong to the key; where a file lies and its order do not.
    """
    own = [f.name for f in S.unwritten_facts(files, repeats).schema if f.name not in files.columns]

    def parse(rows: DataFrame) -> DataFrame:
        return S.unwritten_facts(rows, repeats).select(*FACT_KEY, *own)

    out = reused(files, FACT_KEY, parse, f"{path}/repeats={str(repeats).lower()}")
    return Reuse(out.rows.select("path", "language", "module", "file_ord", "source", "sha256", "n_bytes", *own), out.known, out.computed)
