"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import rows_in, shared_table


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component): the least node that each node reaches.

    Each round every node takes the least of itself and its neighbours as its
    label, and the links between labels form the next, smaller graph; a star
    around its least node is done in one round. Labels of all rounds are then
    composed. Every step is a grouped minimum or an equi-join, so a hub is
    pre-aggregated on the map side or split by AQE. Nodes without links do not
    appear; an empty table gives an empty one; null ends are dropped.
    """
    links = shared_table(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links"
    )
    rounds: list[DataFrame] = []
    while True:
        both = links.union(links.select("b", "a"))
        label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        label = shared_table(label.select("node", F.least("node", "near").alias("label")), "labels")
        rounds.append(label)
        of_a = label.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        of_b = label.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        joined = links.join(of_a, "a").join(of_b, "b").where("label_a <> label_b")
        links = shared_table(
            joined.select(
                F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")
            ).distinct(),
            "links",
        )
        if rows_in(links) == 0:
            break
    found = rounds.pop().withColumnRenamed("label", "component")
    while rounds:
        later = found.select(F.col("node").alias("label"), "component")
        found = (
            rounds.pop()
            .join(later, "label", "left")
            .select("node", F.coalesce("component", "label").alias("component"))
        )
    return found
