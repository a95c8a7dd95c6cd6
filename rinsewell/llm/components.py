"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import files_for, keep

EDGES = 250_000  # of a file


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least v of its u. Aggregated before the shuffle; the result is dealt anew, so
    that adaptive execution may split the pairs of a u with very many neighbours."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).repartition(parts)
    return pairs.join(least, "u")


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, root for each node of the edges (a, b): root is the least node of its component.

    Alternating stars: each node's larger neighbours are hung on its least one, then its smaller ones, until
    nothing changes; about as many rounds as the logarithm of the longest path. Each round is written to the
    shared folder, by ``files`` tasks at most. Loops (a = a) and repeated edges do no harm; no edges give no rows.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), files)
    state, files = None, files or files_for(edges)
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
        few = min(files, 1 + now[0] // EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        found = _least_neighbour(large)
        small = found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = keep(small.select("e.u", "e.v").where("u > v").distinct(), few)
