"""Connected components of a table of links, with rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourseflow.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, label)``: the smallest node reachable, for every node with a link.

    Alternates two star operations until nothing changes: every node links its
    larger neighbours to its smallest one, then every node links its smaller
    neighbours and itself to the smallest. The number of links never grows, the
    rounds grow with the logarithm of a component's size, and only minima are
    gathered per node, so a node with very many links is no special case.
    """
    links = cut_lineage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # larger neighbours go to the smallest
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = cut_lineage(small.where("a != b").distinct())
        # settled once no node is both above and below a link: every component is a star
        if small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0:
            most = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
            if most == 0:
                centres = small.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
                return small.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centres)
        links = small
