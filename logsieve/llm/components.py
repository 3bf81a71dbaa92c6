"""Connected components of a link table, by joins and aggregations alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.work import spread_join, stored


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the smallest id among a and its neighbours."""
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return spread_join(links, least, "a")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long): the smallest id reachable.

    Alternates two steps until nothing changes: every larger neighbour of a node is linked to the node's smallest
    neighbour, then every smaller neighbour is. Each pass writes its links to the shared folder, so lineage stays one
    pass long; the number of passes grows with the logarithm of the longest chain. Nothing but a count and a checksum
    reaches the driver. A node with very many links is split over tasks. Links with a null end and loops are ignored.
    """
    current = stored(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = _state(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large)
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small.select("a", F.col("m").alias("b"))
        )
        current = stored(small.distinct(), "links")
        now = _state(current)
        if now == seen:
            break
        seen = now
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
