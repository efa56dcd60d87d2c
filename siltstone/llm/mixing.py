"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share the words of the corpus; a target stops at
   `repeat` times its source's size and the excess is reshared by weight until none is above.
2. The mix is cut into blocks of equal size, at most half a percent of the smallest target: one tiny source makes the blocks
   of the whole mix small, down to a word, at the cost of more seats and of nothing else. Sainte-Lague gives blocks to sources by the highest target / (2 k + 1).
3. Each source is dealt by a seeded hash into shards of about `shard_words` words, so no hot source meets in one task;
   the source's blocks go to its shards by the same rule.
4. A shard's documents stand in seeded order as a ring of words. Its quota of blocks is taken as whole rounds of the
   ring and then consecutive blocks from a seeded block on. A document's share is closed arithmetic: nothing is
   exploded, and reruns agree.

What reaches the driver is one row a source, as columns: its name and 40 bytes. Shard rows stay distributed; a shard has
`shard_words` words, or so many more that the corpus has SHARDS at most.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own; documents of one id, or
without one, are dealt and ordered by their text too, so only equal rows can trade places; repeated rows are independent documents;
an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, numbered, table, word_count, written

WEIGHTS, REPEAT, BLOCK_WORDS, SHARD_WORDS, SHARDS, SEED = (1, 2, 3), 3, 256, 200_000, 100_000, 17


def capped_targets(sizes: list[int], weights: list[float], repeat: float = REPEAT) -> list[float]:
    """Shares of sum(sizes) by weight, none above repeat * size, the excess reshared by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    left, target, active = sizes.sum(), np.zeros(len(sizes)), np.arange(len(sizes))
    while len(active) and left > 0:
        share = left * weights[active] / weights[active].sum()
        over = share > repeat * sizes[active]
        if not over.any():
            target[active] = share
            break
        full, active = active[over], active[~over]
        target[full] = repeat * sizes[full]
        left -= target[full].sum()
    return target.tolist()


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients w / (2 s + 1), at most caps each; ties go to the earlier index."""
    w, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps.sum()))
    got = np.zeros(len(w), np.int64)
    if seats <= 0 or w.sum() <= 0:
        return got
    # a start that no highest-quotient run passes: every source surely reaches the seats below the final divisor
    low, high = 0.0, 2 * w.max() + 1
    for _ in range(100):
        mid = (low + high) / 2
        n = np.minimum(caps, np.floor(w / mid + 0.5)).sum() if mid > 0 else np.inf
        low, high = (mid, high) if n > seats else (low, mid)
    got = np.minimum(caps, np.floor(w / (high * (1 + 1e-12)) + 0.5)).astype(np.int64)
    left = seats - int(got.sum())
    open_ = np.flatnonzero((got < caps) & (w > 0))
    if len(open_) > left:  # no more than `left` sources can win a seat: those of highest quotients
        open_ = open_[np.lexsort((open_, -w[open_] / (2 * got[open_] + 1)))[:left]]
    heap = [(-w[i] / (2 * got[i] + 1), i) for i in open_.tolist()]
    heapq.heapify(heap)
    for _ in range(left):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * got[i] + 1), i))
    return got


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, repeat: int = REPEAT, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, _mx_at, _mx_start, _mx_take, _mx_ring): one row a document."""
    spark = docs.sparkSession
    base = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_mx_text")), "mix")
    rows = base.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.asc_nulls_last("source")).toArrow()  # by code point
    sizes = rows.column("n").to_numpy()
    targets = capped_targets(sizes, np.resize(np.array(weights, float), len(sizes)), repeat)
    smallest = min([t for t in targets if t > 0], default=1)
    block = int(max(1, min(block_words, smallest // 200)))  # so that a block is at most half a percent of any target
    seats = sainte_lague(targets, round(sum(targets) / block), repeat * sizes // block)
    shard_words = max(shard_words, -(-int(sizes.sum()) // SHARDS))
    columns = {"_mx_source": rows.column("source"), "_mx_i": np.arange(len(sizes)), "source_size": sizes, "target": np.array(targets, float), "_mx_seats": seats, "_mx_shards": np.maximum(1, -(-sizes // shard_words))}
    plan = spark.createDataFrame(pa.table(columns))
    plan = F.broadcast(plan) if len(sizes) <= 10_000 else plan
    at = base.join(plan, F.col("source").eqNullSafe(F.col("_mx_source"))).drop("_mx_source")
    at = at.withColumn("_mx_shard", F.expr(f"pmod(xxhash64({seed}, doc_id, _mx_text, 1), _mx_shards)"))

    def quotas(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_mx_shard")
        got = sainte_lague(pdf["_mx_ring"], int(pdf["_mx_seats"].iloc[0]), repeat * pdf["_mx_ring"] // block)
        return pd.DataFrame({"_q_i": pdf["_mx_i"], "_q_shard": pdf["_mx_shard"], "_mx_ring": pdf["_mx_ring"], "_mx_take": got * block})

    shards = at.groupBy("_mx_i", "_mx_shard").agg(F.sum("size").alias("_mx_ring"), F.first("_mx_seats").alias("_mx_seats"))
    quota = shards.groupBy("_mx_i").applyInPandas(quotas, "_q_i long, _q_shard long, _mx_ring long, _mx_take long")
    ring = Window.partitionBy("_mx_i", "_mx_shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", "_mx_text").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_mx_at", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    at = at.join(quota, (F.col("_mx_i") == F.col("_q_i")) & (F.col("_mx_shard") == F.col("_q_shard")))
    at = at.withColumn("_mx_start", F.expr(f"if(_mx_ring = 0, 0, {block} * pmod(xxhash64({seed}, _mx_i, _mx_shard), greatest(1, _mx_ring div {block})))"))
    at = at.withColumn("_mx_rest", F.expr("if(_mx_ring = 0, 0, _mx_take % _mx_ring)"))
    overlap = lambda a, b: f"greatest(0, least(_mx_at + size, {b}) - greatest(_mx_at, {a}))"
    at = at.withColumn("_mx_first", F.expr(overlap("_mx_start", "least(_mx_start + _mx_rest, _mx_ring)")).cast("long"))
    at = at.withColumn("_mx_wrap", F.expr(overlap("0", "_mx_start + _mx_rest - _mx_ring")).cast("long"))
    at = at.withColumn("_mx_rounds", F.expr("if(_mx_ring = 0, 0, _mx_take div _mx_ring)").cast("long"))
    at = at.withColumn("taken", F.expr("_mx_rounds * size + _mx_first + _mx_wrap").cast("long"))
    return at.select("doc_id", "source", "size", "source_size", "target", "taken", "_mx_at", "_mx_start", "_mx_rest", "_mx_rounds", "_mx_first", "_mx_wrap")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as the mix takes them: a document once for each time it is taken whole; where the ring's first
    or last block cuts a document, a row with only the taken words (joined by one space). Documents not taken go.
    Repeated rows and rows with one or no id are independent documents. n_chars follows a cut text.
    """
    columns, key = docs.columns, "doc_id"
    if (rows := numbered(docs, "_mx_row", "mix_rows", [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"), F.asc_nulls_last("source")])) is not None:
        docs, key = rows, "_mx_row"
    plan = mix(docs, doc_id=key, **options).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_mx_id"), F.col("size").alias("_mx_size"), "_mx_rounds", "_mx_first", "_mx_wrap", F.expr("greatest(0, _mx_start - _mx_at)").alias("_mx_from"))
    rows = docs.join(plan, F.col(key) == F.col("_mx_id"))
    both = F.expr("_mx_first + _mx_wrap = _mx_size").cast("long")
    whole = F.expr("sequence(1L, _mx_rounds + if(_mx_first + _mx_wrap = _mx_size, 1, 0))")
    pieces = F.array_compact(F.array(
        F.when((both == 0) & F.expr("_mx_first > 0"), F.struct(F.col("_mx_from").cast("long").alias("a"), F.col("_mx_first").alias("n"))),
        F.when((both == 0) & F.expr("_mx_wrap > 0"), F.struct(F.lit(0).cast("long").alias("a"), F.col("_mx_wrap").alias("n"))),
    ))
    full = F.when(F.expr("_mx_rounds + if(_mx_first + _mx_wrap = _mx_size, 1, 0) > 0"), F.transform(whole, lambda _: F.struct(F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("n")))).otherwise(F.expr("cast(array() as array<struct<a:bigint,n:bigint>>)"))
    rows = rows.withColumn("_mx_part", F.explode(F.concat(full, pieces)))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, (F.col("_mx_part.a") + 1).cast("int"), F.col("_mx_part.n").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_mx_part.n") < 0, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_mx_part.n") < 0, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
