"""What a viewer asks of an index: call and import graphs, callers and callees, the symbol tree, references and search.

All take the relations of an index: symbols (symbol_id, kind, name, qualname, path, parent, ...), edges (src, dst, kind) and
references (path, span, symbol_id), and return relations that a viewer can filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import graph as G


def _graph(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind).groupBy("src", "dst").agg(F.count("*").alias("sites"))


def call_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, sites): who calls whom, and from how many places."""
    return _graph(edges, "calls")


def import_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, sites) between modules."""
    return _graph(edges, "imports")


def callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, caller, sites) for each of the symbols (symbol_id)."""
    wanted = symbols.select(F.col("symbol_id").alias("dst")).distinct()
    return call_graph(edges).join(wanted, "dst", "left_semi").select(F.col("dst").alias("symbol_id"), F.col("src").alias("caller"), "sites")


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, callee, sites) for each of the symbols (symbol_id)."""
    wanted = symbols.select(F.col("symbol_id").alias("src")).distinct()
    return call_graph(edges).join(wanted, "src", "left_semi").select(F.col("src").alias("symbol_id"), F.col("dst").alias("callee"), "sites")


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in): edges from and to each node, in one aggregate."""
    end = lambda name, o, i: F.struct(F.col(name).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = edges.select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.o").alias("fan_out"), F.sum("x.i").alias("fan_in"))


def symbol_tree(symbols: DataFrame) -> DataFrame:
    """(symbol_id, ancestor, depth): each symbol with itself at depth 0 and all that parents lead to.

    Paths are doubled each round, so rounds grow with the logarithm of the depth. Parents that are no symbols, as of
    files outside the slice, are ancestors too; a circle of parents ends where it meets a symbol again.
    """
    c = F.col
    rows = symbols.select("symbol_id", "parent").distinct()
    own = rows.select("symbol_id", c("symbol_id").alias("ancestor"), F.lit(0).cast("long").alias("depth"))
    step = rows.filter("parent is not null").select("symbol_id", c("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    known = G.cut(own.union(step).groupBy("symbol_id", "ancestor").agg(F.min("depth").alias("depth")))
    count = known.count()
    while True:
        up = known.filter("depth > 0")
        further = up.alias("x").join(up.alias("y"), c("x.ancestor") == c("y.symbol_id")).select("x.symbol_id", "y.ancestor", (c("x.depth") + c("y.depth")).alias("depth"))
        known = G.cut(known.union(further).groupBy("symbol_id", "ancestor").agg(F.min("depth").alias("depth")))
        before, count = count, known.count()
        if count == before:
            return known


def find_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, refs, paths): how often and in how many files the symbols are named; 0 for those that are not."""
    found = references.groupBy("symbol_id").agg(F.count("*").alias("refs"), F.countDistinct("path").alias("paths"))
    return symbols.select("symbol_id").distinct().join(found, "symbol_id", "left").na.fill(0, ["refs", "paths"])


def search(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols whose qualified name has the text in any case, the shortest first."""
    rows = symbols.filter(F.contains(F.lower("qualname"), F.lower(F.lit(text))))
    return rows.orderBy(F.length("qualname"), "qualname", "symbol_id")


#: Folders that the postings of three characters are dealt to by their hash: a search reads those of its text alone.
FOLDERS = 64


def _folder(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_postings(symbols: DataFrame, path: str) -> None:
    """Write, for search_postings, each three characters of qualified names (in lower case) with the symbols (symbol_id,
    qualname) that have them, under path."""
    low = F.lower("qualname")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))
    rows = symbols.filter(F.length(low) >= 3).select("symbol_id", "qualname", F.explode(grams).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    # a common gram's postings go to several tasks; a task's rows of a folder stand in order of the gram, so files can be passed over
    rows.repartition("folder", F.pmod(F.xxhash64("symbol_id"), F.lit(8))).sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(path)
    symbols.select("symbol_id", "qualname").filter("qualname is not null").write.mode("overwrite").parquet(f"{path}-names")


def search_postings(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(symbol_id, qualname) as search() finds them, from what write_postings wrote: symbols with all grams of the text, of
    which those that have the text itself stay. A text of less than three characters has no gram; then all names are read."""
    low = text.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return search(spark.read.parquet(f"{path}-names"), text)
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    found = spark.read.schema("symbol_id string, qualname string, gram string, folder int").parquet(path).filter(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    both = found.groupBy("symbol_id", "qualname").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(grams))
    return search(both.select("symbol_id", "qualname"), text)


def stats(edges: DataFrame) -> DataFrame:
    """One row: edges, sources, targets."""
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
