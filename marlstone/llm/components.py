"""Connected components of a graph given as links, by label propagation to the smallest neighbour with shortcuts.

Each round sends to every node the smallest label in its neighbourhood and then jumps to that label's own label, so
labels run down a path in a logarithmic number of rounds. Rounds are written tables; no link or label comes to the
driver, only each round's count of changes. A node with many links is pre-aggregated by the map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.storage import Cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link. Nodes may be of any ordered type."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    edges = Cut(both, "links")
    start = edges.df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = Cut(start, "labels")
    while True:
        near = edges.df.join(labels.df, edges.df["v"] == labels.df["node"]).groupBy("u").agg(F.min("label").alias("m"))
        own = labels.df.join(near, labels.df["node"] == near["u"]).select("node", "label", F.least("label", "m").alias("new"))
        # Shortcut: the label's label; labels are nodes themselves.
        up = labels.df.select(F.col("node").alias("at"), F.col("label").alias("above"))
        new = own.join(up, own["new"] == up["at"], "left").select("node", F.least("new", F.coalesce("above", "new")).alias("label"), (F.least("new", F.coalesce("above", "new")) < F.col("label")).cast("long").alias("changed"))
        after = Cut(new, "labels")
        changed = after.df.agg(F.sum("changed")).first()[0] or 0
        labels.drop()
        after.df = after.df.drop("changed")
        labels = after
        if not changed:
            edges.drop()
            return labels.df.withColumnRenamed("label", "component")
