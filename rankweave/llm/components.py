"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable.

    Each round hangs every node under its smallest neighbour, shortens the chains to their
    roots by pointer jumping and contracts the links to links between roots. A round at least
    halves the trees that still have links, so rounds and jumps are logarithmic in the nodes.
    Tables between rounds are written to the shared folder, hence a node of any degree meets
    its label in a plain join that adaptive execution can split.

    Self links, repeated links and either direction are fine; null ends are dropped. No links:
    no rows.
    """
    rest = cut_lineage(_oriented(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    rounds = []
    while not rest.isEmpty():
        parent = _roots(rest)
        rounds.append(parent)
        rest = cut_lineage(_contracted(rest, parent))
    if not rounds:
        return rest.select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = rounds[0]
    for parent in rounds[1:]:
        upper = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = found.join(upper, "root", "left").select(
            "node", F.coalesce("top", "root").alias("root")
        )
    return cut_lineage(found) if len(rounds) > 1 else found


def _oriented(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _roots(links: DataFrame) -> DataFrame:
    """Every node under the root of its tree, after jumping."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    parent = cut_lineage(parent.select("node", F.least("node", "near").alias("root")))
    while True:
        above = parent.where("node <> root").select(
            F.col("node").alias("root"), F.col("root").alias("top")
        )
        jumped = cut_lineage(
            parent.join(above, "root", "left").select(
                "node",
                F.coalesce("top", "root").alias("root"),
                F.col("top").isNotNull().alias("moved"),
            )
        )
        parent = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parent


def _contracted(links: DataFrame, parent: DataFrame) -> DataFrame:
    left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    moved = links.join(left, "a").join(right, "b")
    return _oriented(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
