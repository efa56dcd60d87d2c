"""Keyed operators: first and last of a key, unique-name resolution, innermost intervals, imports, references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.operators import graph as G


def _ranked(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k_rank", F.row_number().over(w)).filter(F.col("_k_rank") <= most).drop("_k_rank")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order (a span keeps the reference that came first)."""
    return _ranked(df, keys, [F.col(c).asc() for c in order], 1)


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in order (a redefinition replaces what it redefines)."""
    return _ranked(df, keys, [F.col(c).desc() for c in order], 1)


def first_per_key(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each key, in order: a request budget.

    Of a small budget Spark keeps each task's first rows before they are shuffled. Beyond that keys may hold more than a task
    should: rows are ranked in pieces of a range sort, after the counts of their key's pieces before.
    """
    if most <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return _ranked(df, keys, [F.col(c).asc() for c in order], most)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = G.written(df.repartitionByRange(n, *keys, *order).withColumn("_k_piece", F.spark_partition_id()), "pieces")
    counts = held.groupBy(*keys, "_k_piece").agg(F.count("*").alias("_k_n"))
    above = Window.partitionBy(*keys).orderBy("_k_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)), F.col("_k_piece").alias("_k_at"), F.coalesce(F.sum("_k_n").over(above), F.lit(0)).alias("_k_before"))
    ranked = held.withColumn("_k_rank", F.row_number().over(Window.partitionBy(*keys, "_k_piece").orderBy(*order)))
    same = F.col("_k_piece") == F.col("_k_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return ranked.join(counts, same).filter(F.col("_k_rank") + F.col("_k_before") <= most).select(*df.columns)


def unique_names(symbols: DataFrame, keys: list[str], symbol: str) -> DataFrame:
    """Keys that name exactly one symbol, with it."""
    one = symbols.groupBy(*keys).agg(F.count("*").alias("_u_n"), F.min(symbol).alias("target"))
    return one.filter("_u_n = 1").drop("_u_n")


def resolve_unique(calls: DataFrame, symbols: DataFrame, keys: list[str], symbol: str, blocked: Column | None = None) -> DataFrame:
    """calls with `target`: the only symbol of the same keys, null where there is none or more than one, and for blocked calls."""
    rows = calls.withColumn("_blocked", F.lit(False) if blocked is None else F.coalesce(blocked, F.lit(False)))
    rows = rows.join(unique_names(symbols, keys, symbol), keys, "left")
    return rows.withColumn("target", F.when(~F.col("_blocked"), F.col("target"))).drop("_blocked")


def _sweep(n: int, value: pa.DataType):
    """What sweeps events (part, block, n numbers of a place, is_point, n numbers of an end, value) sorted by part, place and
    spans first.

    Open spans lie on a stack in the order they begin, so the last that has not ended holds the point; one that has
    ended holds no later point either, and goes when it comes to lie on top.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = row[2 : 2 + n]
                if row[:2] != now:
                    now, stack = row[:2], []
                if not row[2 + n]:
                    stack.append((row[3 + n : 3 + 2 * n], row[-1], at))
                    continue
                while stack and stack[-1][0] < at:
                    stack.pop()
                if stack:
                    out.append((row[0], *at, stack[-1][1], *stack[-1][2]))
            columns = list(zip(*out, strict=True)) if out else [[]] * (2 + 2 * n)
            kinds = [pa.string(), *[pa.int64()] * n, value, *[pa.int64()] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])

    return sweep


#: Lines (or other first numbers of places) of a part that one task sweeps.
BLOCK = 4096


def innermost(points: DataFrame, spans: DataFrame, part: str, at: list[str], start: list[str], end: list[str], order: str, value: str) -> DataFrame:
    """points with `value` of the span of their part (a file) that holds each, ends included, and where it begins (span_ and
    the names of `at`); null where none does.

    Innermost is what begins last, of those what ends first, of those the first by order. One sweep over a part's spans and
    points in order of their places finds them. Long parts are dealt by the first number of places, and spans go to each piece
    that they reach into.
    """
    c, n = F.col, len(at)
    block = lambda x: F.floor(c(x) / BLOCK).cast("long")
    kind = spans.schema[value].dataType
    numbers = lambda names, to: [c(x).cast("long").alias(f"{to}{i}") for i, x in enumerate(names)]
    begins = spans.select(c(part).cast("string").alias("part"), F.explode(F.sequence(block(start[0]), F.greatest(block(start[0]), block(end[0])))).alias("block"), *numbers(start, "a"), F.lit(False).alias("is_point"), *numbers(end, "b"), c(value).alias("value"), c(order).alias("order"))
    nulls = [F.lit(None).cast("long").alias(f"b{i}") for i in range(n)]
    asked = points.select(c(part).cast("string").alias("part"), block(at[0]).alias("block"), *numbers(at, "a")).distinct()
    asked = asked.select("*", F.lit(True).alias("is_point"), *nulls, F.lit(None).cast(kind).alias("value"), F.lit(None).cast(spans.schema[order].dataType).alias("order"))
    events = begins.join(asked.select("part", "block").distinct(), ["part", "block"], "left_semi").unionByName(asked)
    places = [f"a{i}" for i in range(n)]
    swept = events.repartition("part", "block").sortWithinPartitions("part", "block", *places, "is_point", *(c(f"b{i}").desc() for i in range(n)), c("order").desc()).drop("order")
    schema = StructType([StructField("_part", StringType()), *(StructField(f"_p{i}", LongType()) for i in range(n)), StructField(value, kind), *(StructField(f"span_{x}", LongType()) for x in at)])
    found = swept.mapInArrow(_sweep(n, to_arrow_type(kind)), schema)
    same = c(part).cast("string") == c("_part")
    for i, x in enumerate(at):
        same = same & (c(x).cast("long") == c(f"_p{i}"))
    return points.join(found, same, "left").drop("_part", *(f"_p{i}" for i in range(n)))


def longest_prefix(targets: DataFrame, modules: DataFrame, target: str, module: str, separator: str) -> DataFrame:
    """targets with the module that is their longest prefix at separators: the prefixes are joined by equality."""
    parts = F.split(F.col(target), separator.replace(".", r"\."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    rows = targets.withColumn("_lp", F.explode(prefixes)).join(modules.select(F.col(module).alias("_lp")).distinct(), "_lp")
    return rows.groupBy(target).agg(F.max_by("_lp", F.length("_lp")).alias("resolved"))


def directory_suffix(targets: DataFrame, modules: DataFrame, target: str, module: str, directory: str, order: str) -> DataFrame:
    """targets with the first module (by order) whose directory is the target or a whole-path end of it.

    The target's path ends are joined by equality rather than by a theta join.
    """
    parts = F.split(F.col(target), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    rows = targets.withColumn("_ds", F.explode(ends)).join(modules.withColumnRenamed(directory, "_ds"), "_ds")
    return rows.groupBy(target).agg(F.min_by(module, order).alias("resolved"))


def utf16_column(line: Column, byte_column: Column) -> Column:
    """UTF-16 units before a UTF-8 byte column of a line."""
    prefix = F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_column)
    return (F.length(F.encode(F.decode(prefix, "UTF-8"), "UTF-16LE")) / 2).cast("long")
