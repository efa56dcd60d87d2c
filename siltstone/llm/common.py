"""Shared helpers: tables, written checkpoints and the word rule of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run without space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Words in a text as bigint; 0 for null. `bytes.split()` in Python follows the same rule."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it where df has such a column already (in any case): input columns are never replaced."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a private one, for a local master only: executors elsewhere
    could not read it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if not getattr(context, "_siltstone_dir", None):
        context._siltstone_dir = tempfile.mkdtemp(prefix="siltstone-")
    return context._siltstone_dir


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and lost executors cost no recomputation.

    The files go by release(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_quiet, _remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, and have Spark drop the shuffle files of finished plans, which it
    does once neither side's garbage holds them."""
    spark = tables[0].sparkSession
    for t in tables:
        if path := getattr(t, "_siltstone_path", None):
            _remove(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(docs: DataFrame, number: str, name: str, order: list, doc_id: str = "doc_id") -> DataFrame | None:
    """docs with a written row number in that order, the column to tell rows by where ids repeat, are null or no integers;
    None where the id tells them already."""
    if docs.schema[doc_id].dataType.typeName() in ("long", "integer", "short", "byte"):
        ids = docs.agg(F.count("*").alias("n"), F.countDistinct(doc_id).alias("k")).first()
        if ids["n"] == ids["k"]:
            return None
    return written(docs.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), name)


def _quiet(f, *args) -> None:
    try:
        f(*args)
    except Exception:  # noqa: BLE001  the session is gone already; the cluster's own cleaning applies
        pass


#: What clears each kind of cache that the loaded modules keep in a worker process.
CACHES: dict = {}


def trim() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def working(kind: str) -> None:
    """Called as a task begins: caches of other kinds of work in this process go, and their memory with them."""
    for name, clear in CACHES.items():
        if name != kind:
            clear()
    trim()
