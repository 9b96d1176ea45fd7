"""Connected components of a table of links, by contraction.

Each round, every node points to its smallest neighbour if that is smaller, pointers are followed,
and links are carried over to what their ends point to; links inside one node vanish and equal
links merge, so the table shrinks from round to round. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.storage import materialise, scratch


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b long. Returns id, component (the smallest id reachable) for every id in a link.

    Links to oneself, null ends, repeated links and either direction are all allowed.
    """
    with scratch(links.sparkSession) as made:
        return made.keep(_contracted(links))


def _contracted(links: DataFrame) -> DataFrame:
    links = materialise(links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = materialise(nodes.select("id", F.col("id").alias("component")), "components")
    links = links.where("a <> b")
    while links.limit(1).count():
        # A link's larger end learns of the smaller one; the smallest of several is kept.
        point = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        further = point.select(F.col("id").alias("to"), F.col("to").alias("further"))
        point = materialise(point.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to")), "pointers")
        follow = lambda frame, name: frame.join(point.select(F.col("id").alias(name), "to"), name, "left").withColumn(name, F.coalesce("to", name)).drop("to")
        found = materialise(follow(found, "component").select("id", "component"), "components")
        moved = follow(follow(links, "a"), "b").where("a <> b")
        links = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return found
