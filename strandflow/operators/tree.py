"""Tree operators on parent-pointer tables: nodes(node_id, parent_id, child_ord, branch_length, is_leaf)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions.storage import kept


def closure(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node_id, anc_id, dist) of each node and each of its ancestors, itself included; kept, as operators use it often.

    Pointer doubling: who knows its ancestors up to 2^k learns those of the one at
    2^k, so a tree of any depth takes as many joins as its depth has bits.
    """
    itself = nodes.select("node_id", F.col("node_id").alias("anc_id"), F.lit(0).alias("dist"))
    parents = nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("anc_id"), F.lit(1).alias("dist"))
    up, reach = kept(itself.unionByName(parents)), 1
    while True:
        far = up.where(F.col("dist") == reach).select("node_id", F.col("anc_id").alias("at"))
        if far.isEmpty():
            return up
        more = up.where("dist > 0").select(F.col("node_id").alias("at"), "anc_id", (F.col("dist") + reach).alias("dist"))
        up, reach = kept(up.unionByName(far.join(more, "at").select("node_id", "anc_id", "dist"))), 2 * reach


def leaf_counts(nodes: DataFrame, up: DataFrame) -> DataFrame:
    leaves = nodes.where("is_leaf").select("node_id")
    counted = up.join(leaves, "node_id", "left_semi").groupBy(F.col("anc_id").alias("node_id")).agg(F.count(F.lit(1)).alias("num_leaves"))
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("num_leaves", F.lit(0)).alias("num_leaves"))


def levels(up: DataFrame) -> DataFrame:
    """Depth from 1 at the root."""
    return up.groupBy("node_id").agg(F.count(F.lit(1)).alias("level"))


def repaired(nodes: DataFrame) -> DataFrame:
    """Root 0; other lengths that aren't positive get the smallest positive one, or 1 if there is none."""
    least = nodes.where("parent_id is not null and branch_length > 0").agg(F.min("branch_length").alias("least"))
    length = F.when(F.col("parent_id").isNull(), 0.0).when(F.col("branch_length") > 0, F.col("branch_length")).otherwise(F.coalesce("least", F.lit(1.0)))
    return nodes.join(F.broadcast(least)).withColumn("branch_length", length).drop("least")


def weights(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """Of each leaf: the lengths on its way up, each shared among the leaves below, over the largest such sum."""
    shares = nodes.join(leaf_counts(nodes, up), "node_id").select(F.col("node_id").alias("anc_id"), (F.col("branch_length") / F.col("num_leaves")).alias("share"))
    sums = up.join(nodes.where("is_leaf").select("node_id"), "node_id", "left_semi").join(shares, "anc_id").groupBy("node_id").agg(F.sum("share").alias("w"))
    most = sums.agg(F.max("w").alias("most"))
    return sums.join(F.broadcast(most)).select("node_id", (F.col("w") / F.col("most")).alias("weight"))


def pruned(nodes: DataFrame, up: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node_id, parent_id, branch_length) of the tree of the kept leaves; unary chains collapse, the root stays."""
    below = up.join(wanted, "node_id", "left_semi").select(F.col("anc_id").alias("node_id")).distinct()
    alive = nodes.join(below, "node_id", "left_semi")
    branching = alive.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("node_id")
    stays = branching.union(alive.where("parent_id is null or is_leaf").select("node_id")).distinct()
    # the nearest ancestor that stays, and the lengths up to it
    above = up.where("dist > 0").join(stays.withColumnRenamed("node_id", "anc_id"), "anc_id", "left_semi").groupBy("node_id").agg(F.min_by("anc_id", "dist").alias("parent_id"), F.min("dist").alias("upto"))
    lengths = up.join(above.select("node_id", "upto"), "node_id").where("dist < upto").join(nodes.select(F.col("node_id").alias("anc_id"), "branch_length"), "anc_id")
    summed = lengths.groupBy("node_id").agg(F.sum("branch_length").alias("branch_length"))
    return stays.join(above.select("node_id", "parent_id"), "node_id", "left").join(summed, "node_id", "left").select("node_id", "parent_id", F.coalesce("branch_length", F.lit(0.0)).alias("branch_length"))


def binarize_round(nodes: DataFrame) -> DataFrame:
    """(node_id, parent_id, pair): the children of polytomies in neighbouring pairs, an odd one out alone (pair null)."""
    family = Window.partitionBy("parent_id")
    ranked = nodes.where("parent_id is not null").select(
        "node_id", "parent_id", (F.row_number().over(family.orderBy("child_ord", "node_id")) - 1).alias("k"), F.count(F.lit(1)).over(family).alias("n")
    )
    alone = (F.col("k") == F.col("n") - 1) & (F.col("n") % 2 == 1)
    return ranked.where("n > 2").select("node_id", "parent_id", F.when(~alone, F.floor(F.col("k") / 2)).alias("pair"))


def centroid(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """The inner node whose leaf count is nearest half of the root's; the first name of equals."""
    total = nodes.where("parent_id is null").join(counts, "node_id").select(F.col("num_leaves").alias("total"))
    inner = nodes.where("not is_leaf").select("node_id").join(counts, "node_id").join(F.broadcast(total))
    gap = F.abs(F.col("total") / 2 - F.col("num_leaves"))
    return inner.agg(F.min_by(F.struct("node_id", "num_leaves"), F.struct(gap, "node_id")).alias("x")).select("x.*")


def nearest_root(up: DataFrame, roots: DataFrame, itself: bool = True) -> DataFrame:
    """(node_id, root_id): the nearest ancestor among the roots."""
    return (up if itself else up.where("dist > 0")).join(roots.select(F.col("node_id").alias("anc_id")), "anc_id", "left_semi").groupBy("node_id").agg(F.min_by("anc_id", "dist").alias("root_id"))


def heights(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """Level of the pair that an inner node's children form in a binary tree: its height less one."""
    leaves = nodes.where("is_leaf").select("node_id")
    return up.join(leaves, "node_id", "left_semi").groupBy(F.col("anc_id").alias("node_id")).agg(F.max("dist").alias("height")).where("height > 0").select("node_id", (F.col("height") - 1).cast("long").alias("level"))
