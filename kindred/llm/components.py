"""Connected components of a graph of links, by labels that shrink along links and jump along pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.frames import cut_once, in_few


def components(links: DataFrame, rows: int) -> DataFrame:
    """``(node, label)`` for each node of ``links`` with columns ``a`` and ``b``; the label is the smallest node reachable.

    ``rows`` is about their number.

    A node's label points to another node. Each round offers the smallest label of a label among neighbours to the
    node and to the node that it points to, and lets every node point to its label's label. Paths halve about once a
    round, whatever the order of the ids. Labels and links stay distributed; the driver sees one count a round.
    Joins on a label meet hubs, nodes with very many links, on one side and single rows on the other, so they are
    sort-merge joins, whose large partitions adaptive execution splits.
    """
    both = cut_once(in_few(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), 2 * rows))
    n = both.df.count()
    edges = in_few(both.df, n)
    last = cut_once(in_few(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), n))
    while n:
        labels = in_few(last.df.select("node", "label"), n)
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        now = in_few(labels.hint("merge").join(above, "label").select("node", "label", "higher"), n)
        seen = edges.hint("merge").join(now.select(F.col("node").alias("b"), "higher"), "b")
        offers = in_few(seen, n).groupBy(F.col("a").alias("node")).agg(F.min("higher").alias("offer"))
        offered = in_few(now.join(offers, "node").select("node", "label", F.least("higher", "offer").alias("best"), "offer"), n)
        # a row for the node itself, which keeps its label, and one for the node that it points to
        told = F.explode(F.array(F.struct("node", F.col("best").alias("label"), F.col("label").alias("was")), F.struct(F.col("label").alias("node"), F.col("offer").alias("label"), F.lit(None).cast("long").alias("was"))))
        better = offered.select(told.alias("x")).groupBy(F.col("x.node").alias("node")).agg(F.min("x.label").alias("better"), F.max("x.was").alias("was"))
        new = cut_once(in_few(better.select("node", F.least("was", "better").alias("label"), (F.col("better") < F.col("was")).alias("moved")), n))
        last.drop()
        last = new
        if not new.df.where("moved").limit(1).count():
            break
    both.drop()
    return last.df.select("node", "label")
