"""Snapshot differences, and what they make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys and change: added, removed or modified; equal rows are left out."""
    b = before.select(*keys, F.col(content).alias("_before"))
    a = after.select(*keys, F.col(content).alias("_after"))
    change = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(F.col("_before") != F.col("_after"), "modified")
    return b.join(a, keys, "full_outer").withColumn("change", change).filter("change is not null").select(*keys, "change")


def _list(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else keys


def stale_split(evidence: DataFrame, touched: DataFrame, item: str | list[str], key: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(stale, reusable) items of evidence (item, key): those with touched evidence, and the others."""
    item, key = _list(item), _list(key)
    stale = evidence.join(touched.select(*key).distinct(), key, "left_semi").select(*item).distinct()
    return stale, evidence.select(*item).distinct().join(stale, item, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str | list[str], parent_key: str | list[str]) -> DataFrame:
    """Rows of children whose key no parent has."""
    child_key, parent_key = _list(child_key), _list(parent_key)
    known = parents.select(*(F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True))).distinct()
    return children.join(known, child_key, "left_anti")


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, n) over a rule table name -> condition that a good row meets, in one pass."""
    counts = df.agg(*(F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(r) for r, c in rules.items()))
    return counts.select(F.explode(F.create_map(*(x for r in rules for x in (F.lit(r), F.coalesce(F.col(r), F.lit(0)))))).alias("rule", "n"))
