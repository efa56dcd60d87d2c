"""The architecture map: modules that import each other in circles are one component, and components stand in layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import graph as G


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those of nodes that nothing leads to or that lead nowhere, until all nodes have both: such nodes lie on no
    circle."""
    while True:
        both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        kept = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")
        before, edges = edges, G.cut(kept.select("src", "dst"))
        n = edges.count()
        if not n or n == before.count():
            return edges


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, color): the greatest color that reaches each node along the edges; only nodes whose color rose go on."""
    colors = front = start
    while True:
        reached = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("color"))
        front = G.cut(reached.join(colors.withColumnRenamed("color", "old"), "node", "left").filter("old is null or color > old").select("node", "color"))
        if front.isEmpty():
            return colors
        colors = G.cut(colors.union(front).groupBy("node").agg(F.max("color").alias("color")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): of nodes that reach each other along edges (src, dst) the least one; a node on no circle is its own.

    Nodes that cannot lie on a circle are trimmed. Of the others each takes the greatest node that reaches it for a color; the nodes of a color
    that reach its own node against the edges are its component. What is left goes through another round.
    """
    edges = G.cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    nodes, found, left = _ends(edges), [], edges.filter("src <> dst")
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        own = _ends(left).withColumn("color", F.col("node"))
        colors = _spread(left, G.cut(own))
        of = lambda end: colors.select(F.col("node").alias(end), F.col("color").alias(f"{end}_color"))
        same = left.join(of("src"), "src").join(of("dst"), "dst").filter("src_color = dst_color")
        back = G.cut(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        member = _spread(back, G.cut(colors.filter("node = color")))
        found.append(G.cut(member))
        gone = found[-1].select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    if not found:
        return nodes.withColumn("component", F.col("node"))
    members = found[0]
    for x in found[1:]:
        members = members.union(x)
    least = members.groupBy("color").agg(F.min("node").alias("component"))
    named = members.join(least, "color").select("node", "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer) of a graph without circles: 0 for what leads nowhere, else one more than the highest that it leads to."""
    known = front = G.cut(nodes.select("node").distinct().withColumn("layer", F.lit(0).cast("long")))
    while True:
        higher = front.join(edges, F.col("node") == F.col("dst")).groupBy(F.col("src").alias("node")).agg((F.max("layer") + 1).alias("layer"))
        front = G.cut(higher.join(known.withColumnRenamed("layer", "old"), "node").filter("layer > old").select("node", "layer"))
        if front.isEmpty():
            return known
        known = G.cut(known.union(front).groupBy("node").agg(F.max("layer").alias("layer")))


def architecture(edges: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of an import graph: members (module, component, size, layer) of all modules (symbol_id), and links
    (src, dst, imports) between components. What imports nothing outside its component stands in layer 0."""
    imports = edges.filter("kind = 'imports'").select("src", "dst")
    component = strong_components(imports)
    every = modules.select(F.col("symbol_id").alias("node")).distinct().join(component, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))
    every = G.cut(every)
    of = lambda end: every.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))
    joined = imports.join(of("src"), "src").join(of("dst"), "dst").filter("src_component <> dst_component")
    links = G.cut(joined.groupBy(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).agg(F.count("*").alias("imports")))
    layer = layers(links, every.select(F.col("component").alias("node")))
    size = every.groupBy("component").agg(F.count("*").alias("size"))
    members = every.join(size, "component").join(layer.withColumnRenamed("node", "component"), "component")
    return members.select(F.col("node").alias("module"), "component", "size", "layer"), links
