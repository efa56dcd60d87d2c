"""MinHash near-duplicates with tensored banding.

A document's set of word shingles gets `2 * collections` minhashes, in small collections of two. The keys of the hash
tables are all pairs of collections: 28 minhashes make 91 tables of four minhashes each, where plain banding would need
364. Two documents meet in a table unless fewer than two collections agree: at similarity 0.8 all but 2 in 100,000 meet.
Every candidate link is confirmed on the full sets.

Equal sets are folded first. In each table bucket only what can change the components is confirmed:
1. each document with the smallest of its buckets' smallest documents, then with its other buckets' smallest ones
   where these still lie in other components;
2. for the documents of buckets that still hold several components, an exact join: with shingles ordered from rare to
   frequent, similar sets share one in their prefixes, and what follows it must suffice for the intersection. Rows
   whose place is too late for any set they meet leave first, which clears the far members of large groups of near
   copies without a comparison; tokens left with one component go too.
So copies of one text cost a link each, and no link between different components is lost.

Only collections that agree with another document's make keys. In the exact join a token of many rows is dealt in blocks of
about BLOCK rows, each pair of blocks in its own task's share, so that a frequent token is not one task.

Defined cases: a document with fewer words than a shingle is one shingle of all its words; one without words or text is
empty and linked with nothing; ids of any type, ordered as the type orders them; rows of one id are documents of their own
inside, each with its own text's component, which is the smallest id reachable; a null id is linked with nothing, has a
null component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.blobs import by_bucket, joined
from siltstone.llm.common import numbered, table, working, written
from siltstone.llm.components import components
from siltstone.llm.shingles import M1, mixed, shingle_set, similar

SHINGLE, PERCENT, COLLECTIONS, SEED, BLOCK = 5, 80, 14, 3, 500


def signature(shingles: np.ndarray, count: int = 2 * COLLECTIONS, seed: int = SEED) -> np.ndarray:
    """uint32 minhashes of a non-empty set."""
    salts = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * M1 + np.uint64(seed)).reshape(2, count, 1)
    out = np.full(count, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 4096):
        x = shingles[None, a : a + 4096]
        out = np.minimum(out, (((x ^ salts[0]) * (salts[1] | np.uint64(1))) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


def _signed(batches, k: int, schema: pa.Schema):
    working("shingles")
    for batch in batches:
        n, lo, hi, sig = [], [], [], []
        for x in batch.column(1):
            s = shingle_set(x.as_py(), k)
            n.append(len(s))
            if len(s):
                lo.append(int(mixed(s).sum(dtype=np.uint64).astype(np.int64)))
                hi.append(int(mixed(s ^ M1).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(s).view(np.int32))
            else:
                lo.append(None), hi.append(None), sig.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], schema=schema)


def signatures(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, lo, hi, sig): 128 bits of the set and its minhashes, null for empty sets."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("sig", pa.list_(pa.int32()))])
    return rows.mapInArrow(lambda it: _signed(it, k, schema), f"doc_id {kind.simpleString()}, n_shingles long, lo long, hi long, sig array<int>")


def table_keys(sets: DataFrame) -> DataFrame:
    """(key, u) for the pairs of those collections of a set that agree with some other set's."""
    bands = sets.select("u", F.posexplode(F.expr(f"transform(sequence(0, {COLLECTIONS - 1}), i -> xxhash64(i, sig[2 * i], sig[2 * i + 1]))")).alias("i", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    active = bands.join(shared, "band", "left_semi").groupBy("u").agg(F.sort_array(F.collect_list("band")).alias("b")).filter("size(b) > 1")
    pairs = "flatten(transform(sequence(0, size(b) - 2), i -> transform(slice(b, i + 2, size(b)), x -> xxhash64(b[i], x))))"
    return active.select("u", F.explode(F.expr(pairs)).alias("key"))


def _confirmed(batches, k: int, percent: int):
    working("shingles")
    last, held = None, None
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        keep = []
        for u, v, a, b in zip(*(batch.column(c) for c in ("u", "v", "text_u", "text_v")), strict=True):
            if v != last:
                last, held = v, shingle_set(b.as_py(), k)
            keep.append(similar(shingle_set(a.as_py(), k), held, percent))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], schema=schema).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts' full sets are similar; texts (u, text) holds every node of a pair."""
    # the same plan at every size: texts are never broadcast, nor pairs
    a = pairs.hint("merge").join(texts.withColumnRenamed("text", "text_u"), "u")
    both = a.hint("merge").join(texts.select(F.col("u").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(lambda it: _confirmed(it, k, percent), "u long, v long")


def _labelled(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    l = labels.select(F.col("node").alias(node), F.col("component").alias(out))  # noqa: E741
    return df.join(l, node, "left").withColumn(out, F.coalesce(out, node))


def _several(member: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that hold several components."""
    mixed_keys = member.groupBy(key).agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select(key)
    return member.join(mixed_keys, key, "left_semi")


PARTS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _parts(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=PARTS)


def _token_parts(batches, k: int, buckets: int):
    """Documents -> their shingles, by bucket of the shingle."""
    for batch in batches:
        u, sets = batch.column("u").to_pylist(), [shingle_set(t.as_py(), k) for t in batch.column("text")]
        if u:
            h = np.concatenate(sets)
            yield _parts(by_bucket((h % np.uint64(buckets)).astype(np.int64), h, np.repeat(np.array(u, np.int64), [len(s) for s in sets])))


def _frequencies(batches, buckets: int):
    """Shingles of a bucket -> with the number of documents that have each, by bucket of the document."""
    if blobs := [x.as_py() for batch in batches for x in batch.column("data")]:
        h, d = joined(blobs)
        _, at, n = np.unique(h, return_inverse=True, return_counts=True)
        yield _parts(by_bucket(d % buckets, d, h, n[at].astype(np.uint32)))


def _prefixes(batches, percent: int):
    """Documents' shingles -> (token, u, i): by rarity, the first ones of which a similar set must share one; i from 0.

    Shingles that no other document has keep their places and are left out.
    """
    if blobs := [x.as_py() for batch in batches for x in batch.column("data")]:
        d, h, n = joined(blobs)
        order = np.lexsort((h, n, d))
        d, h, n = d[order], h[order], n[order]
        _, start, size = np.unique(d, return_index=True, return_counts=True)
        i = np.arange(len(d)) - np.repeat(start, size)
        keep = (i <= np.repeat(size - -(-size * percent // 100), size)) & (n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].astype(np.int64)), pa.array(d[keep]), pa.array(i[keep])], names=["token", "u", "i"])


def met(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), v < u, of rows (token, u, n, i, c) with one token and different c whose sets of n shingles can share
    enough after their places i. Tokens of more than BLOCK rows are dealt by pairs of blocks."""
    blocks = member.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = member.join(blocks, "token").withColumn("b", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "b", "u", "n", "i", "c")
    keys = ["token", "low", "high"]
    right = dealt.select(*keys, *(F.col(x).alias(f"{x}2") for x in ("b", "u", "n", "i", "c")))
    near = (F.col("u2") < F.col("u")) & (F.col("c") != F.col("c2")) & ((F.col("b") != F.col("b2")) | (F.col("low") == F.col("high")))
    near &= (100 + percent) * F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= percent * (F.col("n") + F.col("n2"))
    return dealt.join(right, keys).filter(near).select("u", F.col("u2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the smallest id reachable by links of similar sets, one row a row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = numbered(rows, "_nd_row", "near_rows", [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")])
    if named is None:
        return _near(rows, k, percent)
    # numbers in the order of the ids stand for them; a null id's row only counts its shingles
    of_row = _near(named.select("_nd_row", F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text")).withColumnRenamed("_nd_row", "doc_id"), k, percent)
    nulls = signatures(named.filter("doc_id is null").select(F.lit(0).alias("doc_id"), "text"), k).select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "n_shingles", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("component_id"), F.lit(True).alias("kept"))
    names = named.filter("doc_id is not null").select("_nd_row", F.col("doc_id").alias("name"))
    out = of_row.withColumnRenamed("doc_id", "row").join(names.withColumnRenamed("_nd_row", "row"), "row")
    least = names.select(F.col("_nd_row").alias("component_id"), F.col("name").alias("least"))
    out = out.join(least, "component_id").select(F.col("name").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("name") == F.col("least")).alias("kept"))
    return out.union(nulls)


def _near(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates() of rows (doc_id, text) with unique ids that are integers."""
    doc_id, text = "doc_id", "text"
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = written(signatures(docs, k, doc_id, text), "signatures")
    whole = rows.filter("sig is not null")
    # equal sets have equal signatures
    sets = written(whole.groupBy("lo", "hi").agg(F.min("doc_id").alias("u"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "sets")
    keys = written(table_keys(sets), "keys")
    least = keys.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").select("key", "v")
    stars = written(keys.join(least, "key").filter("u <> v").select("u", "v").distinct(), "stars")
    nodes = stars.select("u").union(stars.select("v")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("u"), F.col(text).alias("text")).join(nodes.hint("merge"), "u", "left_semi")
    texts = written(texts, "texts")
    first = stars.groupBy("u").agg(F.min("v").alias("v"))
    links = written(confirm(first, texts, k, percent), "confirmed")
    labels = written(components(links), "labels")
    across = lambda df: _labelled(_labelled(df, labels, "u", "cu"), labels, "v", "cv").filter("cu <> cv").drop("cu", "cv")
    more = written(confirm(across(stars.join(first, ["u", "v"], "left_anti")), texts, k, percent), "confirmed")
    links = links.union(more)
    labels = written(components(links), "labels")
    # buckets that still hold several components
    member = _labelled(keys.join(least.select("key"), "key", "left_semi"), labels, "u", "c")
    open_ = written(_several(member, "key").select("u", "c").distinct().join(sets.select("u", "n"), "u"), "open")
    tokens = open_.select("u").join(texts.hint("merge"), "u").mapInArrow(lambda it: _token_parts(it, k, buckets), "bucket int, data binary")
    tokens = tokens.repartition(buckets, "bucket").mapInArrow(lambda it: _frequencies(it, buckets), "bucket int, data binary")
    tokens = tokens.repartition(buckets, "bucket").mapInArrow(lambda it: _prefixes(it, percent), "token long, u long, i long")
    member = written(tokens.join(open_, "u"), "prefixes")
    # a common prefix token at place i leaves n - i tokens after it; the smallest set with the token decides
    smallest = member.groupBy("token").agg(F.min("n").alias("m"))
    member = member.join(smallest, "token").filter((100 + percent) * (F.col("n") - F.col("i")) >= percent * (F.col("n") + F.col("m"))).drop("m")
    member = written(_several(member, "token"), "across")
    rest = met(member, percent).join(stars, ["u", "v"], "left_anti")
    last = written(confirm(rest, texts, k, percent), "confirmed")
    labels = components(links.union(last)) if last.limit(1).count() else labels
    of_set = _labelled(sets.select("lo", "hi", "u"), labels, "u", "component_id").select("lo", "hi", "component_id")
    out = rows.drop("sig").join(of_set, ["lo", "hi"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row of each component of docs: the one of smallest id, then text. Where ids repeat or are null, each row is
    a document of its own; null ids come last."""
    columns, key = docs.columns, "doc_id"
    if (rows := numbered(docs, "_nd_row", "near_rows", [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")])) is not None:
        docs, key = rows, "_nd_row"
    kept = _near(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), k, percent).filter("kept").select(F.col("doc_id").alias("_nd_id"))
    return docs.join(kept, F.col(key) == F.col("_nd_id"), "left_semi").select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: doc_id, n_shingles, component_id, kept at four-word shingles and 80 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, unnest(s) AS t FROM s),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM pairs JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE 100 * c >= 80 * (len(p.s) + len(q.s) - c)),
 ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
 r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, r.root FROM r JOIN ways ON ways.a = r.node),
 c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, component_id, component_id = s.doc_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""
