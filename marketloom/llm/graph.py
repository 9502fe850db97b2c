"""Connected components over an edge table, without collecting links.

Labels start at each node's own id.  A round takes, for every node, the
smallest label in its neighbourhood (a map-side combined minimum) and then the
label of that label; rounds repeat until nothing changes.  Labels are written
to the shared folder each round, so lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import discard, written


#: Copies of a label's row in the step that follows labels.
SALTS = 16


def dealt(rows: DataFrame, node: str) -> DataFrame:
    """rows with a `salt` from their node, to meet a row that stands once for each salt."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))


def copied(rows: DataFrame) -> DataFrame:
    """Each row once for every `salt`."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `node`, numbers that rise with the columns `order` (nulls last), which tell all rows apart."""
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).withColumn("node", F.monotonically_increasing_id())


def named(nodes: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """node and `class`, the column `name` of the node that its component is called by; only nodes with an edge."""
    roots = classes.where("node = component").join(nodes.select("node", F.col(name).alias("class")), "node").select(F.col("node").alias("component"), "class")
    return dealt(classes, "node").join(copied(roots), ["component", "salt"]).select("node", "class")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge.

    Self-links and repeated edges are allowed; no edges give no rows.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        nearer = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        # a large class shares one label: its nodes are dealt over SALTS copies of the label's own row
        jump = copied(nearer.where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("further")))
        moved = written(dealt(nearer, "node").join(jump, ["component", "salt"], "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = moved.where("old <> component").limit(1).count()
        discard(spark, labels)
        labels = moved.select("node", "component")
        if not changed:
            discard(spark, both)
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
