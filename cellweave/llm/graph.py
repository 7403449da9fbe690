"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, stored


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, label`` for each end of ``links`` (``a, b``): the component's smallest node.

    Each round links every node's larger neighbours to its smallest one, then every
    node's smaller neighbours likewise, until nothing changes. Stars grow together
    in a logarithmic number of rounds, and no node gathers a list of its neighbours.
    A round's edges are stored in the shared folder and
    deleted when the next round's are there.
    """
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        edges, newer = stored(small)
        removed(links.sparkSession, path)
        path = newer
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("links did not settle; raise most_rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """Two sets of edges are taken to be the same if their sizes and the combined hashes of their edges are."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
