"""Connected components, and splitting of large groups into pairs of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (node, component) for every node with an edge; a component is named by one of its nodes.

    Each round maps every node to the least of itself and its neighbours and keeps the edges between different images.
    Ids should be hashes: then long paths shrink by a constant share each round, whatever order they had.
    """
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not now.isEmpty():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "edge-map")
        maps.append(to)
        left = now.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        both = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        now = stored(both.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = maps[0].select("node", F.col("to").alias("component"))
    for to in maps[1:]:
        step = to.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return found


def block_pairs(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Adds block_a, block_b and home: groups of more than `most` rows are dealt into blocks by the member's hash, and each row goes
    to every pair of blocks that has its own, so that any two rows of a group meet in one pair of blocks and no pair of blocks has
    much more than 2 * most rows. home is the row's own block. Groups of one row are dropped.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_")).filter("rows_ > 1")
    sized = rows.join(sizes, keys)
    blocks = F.ceil(F.col("rows_") / most).cast("int")
    home = F.pmod(F.xxhash64(F.col(member), F.lit(77)), blocks).cast("int")
    dealt = sized.withColumn("blocks_", blocks).withColumn("home", home).withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    # A single block meets itself; of several, blocks meet each other, and the block itself along with its next one.
    dealt = dealt.filter((F.col("blocks_") == 1) | (F.col("home") != F.col("other_")))
    return dealt.withColumn("block_a", F.least("home", "other_")).withColumn("block_b", F.greatest("home", "other_")).drop("rows_", "other_")
