"""Directory trees as flat tables: one row per directory and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import min_max_normal


def build(files: DataFrame, area: Column, weight: Column, accept: Column | None = None, color_key: Column | None = None, path: Column | None = None) -> DataFrame:
    """repo_id, path, parent_path, name, depth, is_leaf, area, leaves, weight, weight_norm, color_key, sibling_rank.

    Leaves that ``accept`` rejects, or whose area is null, NaN or zero, are dropped before their directories are made, so no empty
    directory appears. A directory's area and leaf count are sums over its leaves: each leaf is exploded to its ancestors and
    aggregated with a partial sum per task.
    """
    leaves = files.where(F.lit(True) if accept is None else accept).select(
        "repo_id", F.regexp_replace(F.col("server_path") if path is None else path, "^/+", "").alias("path"), area.cast("double").alias("area"), weight.cast("double").alias("weight"), (F.lit("") if color_key is None else color_key).alias("color_key")
    )
    return roll_up(leaves.where(F.coalesce(F.col("area"), F.lit(0.0)) != 0).where(~F.isnan("area")))


def roll_up(leaves: DataFrame) -> DataFrame:
    """A tree from its leaves (repo_id, path, area, weight, color_key); also what a filter on leaves is followed by."""
    parts = F.split("path", "/")
    node = F.explode(F.transform(F.sequence(F.lit(0), F.size("p")), lambda i: F.struct(F.array_join(F.slice("p", 1, i), "/").alias("path"), i.alias("depth"))))
    nodes = leaves.withColumn("p", parts).select("repo_id", node.alias("n"), (F.col("n.depth") == F.size("p")).alias("is_leaf"), "area", "weight", "color_key")
    tree = nodes.groupBy("repo_id", "n.path", "n.depth").agg(
        F.max("is_leaf").alias("is_leaf"),
        F.sum("area").alias("area"),
        F.count(F.lit(1)).alias("leaves"),
        F.max(F.when(F.col("is_leaf"), F.col("weight"))).alias("weight"),
        F.max(F.when(F.col("is_leaf"), F.col("color_key"))).alias("color_key"),
    )
    ranges = leaves.groupBy("repo_id").agg(F.min("weight").alias("_lo"), F.greatest(F.max("weight"), F.lit(0.0)).alias("_hi"))
    siblings = W.partitionBy("repo_id", "parent_path").orderBy(F.desc("area"), "name")
    return (
        tree.join(ranges, "repo_id")
        .withColumn("parent_path", F.when(F.col("depth") > 0, F.regexp_replace("path", "/?[^/]*$", "")))
        .withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
        .withColumn("weight_norm", F.when(F.col("is_leaf"), min_max_normal(F.col("weight"), F.col("_lo"), F.col("_hi"))))
        .withColumn("sibling_rank", F.row_number().over(siblings))
        .select("repo_id", "path", "parent_path", "name", "depth", "is_leaf", "area", "leaves", "weight", "weight_norm", "color_key", "sibling_rank")
    )


def leaves_of(tree: DataFrame) -> DataFrame:
    return tree.where("is_leaf").select("repo_id", "path", "area", "weight", "color_key")


def filtered(tree: DataFrame, keep: Column) -> DataFrame:
    """Removes leaves, then empty directories, and sums and normalises again."""
    return roll_up(leaves_of(tree).where(keep))


def shrunk(tree: DataFrame) -> DataFrame:
    """Without the chain of single children at the top: the subtree of the deepest node that holds all leaves."""
    total = tree.where("depth = 0").select("repo_id", F.col("leaves").alias("_all"))
    top = tree.join(total, "repo_id").where("leaves = _all").groupBy("repo_id").agg(F.max("depth").alias("_top"))
    return tree.join(top, "repo_id").where("depth >= _top").drop("_top")


def subtree(tree: DataFrame, path: str) -> DataFrame:
    return tree.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
