"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), u != v, of any orderable type; gives (node, root) for
    each node that has an edge, equal roots for connected nodes.

    A round gives each node the least of itself and its neighbours and replaces
    both ends of each edge by theirs; an edge whose ends become equal is gone.
    The edge (node, least) itself turns into (least, least's least), so what was
    connected stays connected.  The minimum is a partial aggregate (a hub sends
    one row per task) and each round's tables are written to the shared folder.
    """
    edges = write_shared(edges.select("u", "v").distinct(), "cc-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write_shared(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")), "cc-least")
        step = least.select(F.col("u").alias("node"), "root")
        if roots is None:
            roots = step
        else:
            next_of = least.select(F.col("u").alias("root"), F.col("root").alias("next"))
            roots = write_shared(roots.join(next_of, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        at_u, at_v = least.select("u", F.col("root").alias("ru")), least.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        edges = write_shared(edges.join(at_u, "u").join(at_v, "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
                             .filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    if roots is None:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots
