"""Connected components and spanning forests of edge tables, by hooking and pointer jumping.

Every round, each component hooks onto its smallest neighbouring component, so the number of components that still
have neighbours at least halves. All steps are joins and map-side aggregates over narrow tables; each round's tables are
stored in the shared folder, which keeps plans short and results recoverable. Only row counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import sized

#: Rows of a file of the narrow tables between rounds.
PART_ROWS = 100_000


def forest(edges: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) -> (labels (node, label), tree edges (a, b)). A label is the least node of its component.

    ``known`` (node, label) gives components to start from; the trees then only join those. Self-loops and repeated
    edges are harmless; without edges both tables are empty.
    """
    edges, left = sized(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    parts = 1 + left // PART_ROWS

    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        """No table here has more rows than twice the edges, so it needs no more files than they do."""
        return sized(df.coalesce(parts))

    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, trees = nodes.withColumn("label", F.col("node")), edges.select("a", "b").limit(0)
    open_edges = edges.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    if known is not None:
        labels, _ = kept(nodes.join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
        for end in ("a", "b"):
            open_edges = open_edges.join(labels.select(F.col("node").alias(end), F.col("label").alias("__own")), end) \
                .withColumn(f"l{end}", F.col("__own")).drop("__own")
        open_edges, left = kept(open_edges.filter("la <> lb"))
    while left:
        hooks, _ = kept(open_edges.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.struct(F.least("la", "lb").alias("to"), "a", "b")).alias("hook"))
                         .select("label", "hook.to", "hook.a", "hook.b"))
        trees = trees.unionByName(hooks.select("a", "b"))
        roots, moved = hooks.select("label", "to"), 1
        while moved:
            over = roots.select(F.col("label").alias("to"), F.col("to").alias("__next"))
            jumped, _ = kept(roots.join(over, "to", "left").select("label", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("__moved")))
            moved = jumped.filter("__moved").limit(1).count()
            roots = jumped.select("label", "to")
        labels = labels.join(roots, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels, _ = kept(labels)
        ends = [roots.select(F.col("label").alias(c), F.col("to").alias(f"to_{c}")) for c in ("la", "lb")]
        open_edges = open_edges.join(ends[0], "la", "left").join(ends[1], "lb", "left") \
            .select("a", "b", F.coalesce("to_la", "la").alias("la"), F.coalesce("to_lb", "lb").alias("lb")).filter("la <> lb")
        open_edges, left = kept(open_edges)
    return labels, trees


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; the label is its component's least node."""
    return forest(edges)[0]
