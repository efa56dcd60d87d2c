"""Graph operators: adjacency, bounded search, entry matching, the byte budget and boundary admission."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a private one, kept for the session, for a local master
    only: executors elsewhere could not read it."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if not getattr(context, "_siltstone_core_dir", None):
        context._siltstone_core_dir = tempfile.mkdtemp(prefix="siltstone-")
    return context._siltstone_core_dir


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of spark.checkpoint.dir; to a private one only where that is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder, by columns, and read back: what reads it again takes only the columns it needs.

    The files go when the application ends, or by removed().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def dealt(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df written once to the shared folder in buckets of the keys, so that a join on them does not shuffle it again."""
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    atexit.register(_remove, spark, path)
    return spark.table(table)


def removed(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._siltstone_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone already; the cluster's own cleaning applies
        pass


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected neighbours (a, b) of edges (src, dst)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def khop(neighbours: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within `hops` of the seeds, each at its least distance; ends when a layer is empty."""
    seen = frontier = cut(seeds.select(F.col("node")).distinct().withColumn("hop", F.lit(0).cast("long")))
    for h in range(1, hops + 1):
        layer = frontier.join(neighbours, frontier["node"] == neighbours["a"]).select(F.col("b").alias("node")).distinct()
        frontier = cut(layer.join(seen, "node", "left_anti").withColumn("hop", F.lit(h).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def match_entries(entries: DataFrame, names: DataFrame, fallback: DataFrame) -> DataFrame:
    """(entry, node): nodes named exactly by the entry; for entries without one, nodes of fallback (name, node)."""
    first = entries.join(names, entries["entry"] == names["name"]).select("entry", "node")
    rest = entries.join(first.select("entry").distinct(), "entry", "left_anti")
    return first.union(rest.join(fallback, rest["entry"] == fallback["name"]).select("entry", "node"))


def budget_fold(items: DataFrame, order: list[str], size: str, key: str, limit: int, parts: int | None = None) -> DataFrame:
    """(key, kept): in order, an item stays if it still fits; one that does not is passed over. Ties in order go by key.

    Items are dealt by ranges of the order. Of what fits alone, sums by range and their prefix sums show the first range
    that holds a misfit: all before it stays; its own items are gone through one by one, in one task as each range is;
    what then no longer fits alone goes, and the next round looks at the ranges after it. So there are at most as many rounds as ranges,
    and few where sizes grow along the order. The driver holds a number a range.
    """
    spark, kind = items.sparkSession, items.schema[key].dataType
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_bf_{i}" for i in range(len(order))]
    rows = items.select(*(F.col(c).alias(a) for c, a in zip(order, names, strict=True)), F.col(size).cast("long").alias("_bf_size"), F.col(key).alias("_bf_key"))
    by = [*names, "_bf_key"]
    rows = written(rows.repartitionByRange(n, *by).withColumn("_bf_part", F.spark_partition_id()), "fold")
    ranges, left, start, rounds = {}, limit, 0, 0  # of a range: what fits in it, and whether its items must be gone through
    while True:
        rounds += 1
        fits = rows.filter((F.col("_bf_part") >= start) & (F.col("_bf_size") <= left)).groupBy("_bf_part").agg(F.sum("_bf_size"))
        sums, before = dict(tuple(r) for r in fits.collect()), left
        misfit = None
        for p in sorted(sums):
            if sums[p] > left:
                misfit = p
                break
            left -= sums[p]
        stop = max(sums, default=start - 1) + 1 if misfit is None else misfit
        ranges |= {p: (before, False) for p in range(start, stop)}
        if misfit is None:
            break
        ranges[misfit] = (left, True)
        one = rows.filter(F.col("_bf_part") == misfit)
        left -= _folded(one, ranges, by, kind, key).filter("kept").agg(F.sum("_bf_size")).first()[0] or 0
        start = misfit + 1
    logging.getLogger(__name__).info("budget: %d rounds over %d ranges", rounds, n)
    return _folded(rows.repartition(n, "_bf_part"), ranges, by, kind, key).select(key, "kept")


def _folded(rows: DataFrame, ranges: dict, by: list[str], kind, key: str) -> DataFrame:
    """(key, kept, _bf_size) of rows whose ranges each lie in one partition: by size alone, or one by one where ranges says so."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, single = None, -1, False
        for b in batches:
            kept = []
            for part, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != now:
                    now, (left, single) = part, ranges.get(part, (-1, False))
                kept.append(n <= left)
                left -= n if single and kept[-1] else 0
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(kept, pa.bool_()), b.column(1)], names=[key, "kept", "_bf_size"])

    sorted_ = rows.sortWithinPartitions("_bf_part", *by).select("_bf_part", "_bf_size", "_bf_key")
    return sorted_.mapInArrow(fold, StructType([StructField(key, kind), StructField("kept", BooleanType()), StructField("_bf_size", LongType())]))


def boundary(edges: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept edges, stubs) of ordered edges (seq, src, dst) about the nodes inside.

    An edge is kept if an end is inside or was admitted by an earlier kept edge; its other end is then admitted. The
    admission time of a node is the least sequence number that reaches it in increasing order. Only nodes whose time
    fell in a round are joined with their edges in the next, and edges are dealt by their ends once.
    """
    ends = edges.select("seq", F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("seq", F.col("dst").alias("x"), F.col("src").alias("y")))
    both = dealt(ends.filter("x <> y"), "ends", "x")
    front = time = cut(inside.select(F.col("node").alias("x"), F.lit(-1).cast("long").alias("t")).distinct())
    joined = 0
    while True:
        reached = front.join(both, "x").filter("seq > t").groupBy("y").agg(F.min("seq").alias("t"), F.count("*").alias("n")).withColumnRenamed("y", "x")
        new = reached.join(time.withColumnRenamed("t", "t0"), "x", "left").filter("t0 is null or t < t0")
        front = cut(new.select("x", "t", "n"))
        found = front.agg(F.count("*"), F.sum("n")).first()
        if not found[0]:
            break
        joined += found[1]
        front = front.select("x", "t")
        time = cut(time.union(front).groupBy("x").agg(F.min("t").alias("t")))
    logging.getLogger(__name__).info("boundary: %d edges brought a node an earlier time", joined)
    held = both.join(time, "x").filter("t < seq").select("seq").distinct()
    loops = edges.filter("src = dst").join(time.select(F.col("x").alias("src"), "t"), "src").filter("t < seq").select("seq")
    return edges.join(held.union(loops), "seq", "left_semi"), time.filter("t >= 0").select(F.col("x").alias("node"), "t")
