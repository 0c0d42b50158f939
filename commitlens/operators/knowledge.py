"""Who wrote what: contributions of developers to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .summary import with_alias

PATH = ["repo_id", "path_key"]


def work_by_developer(lines: DataFrame) -> DataFrame:
    """Blamed lines (repo_id, path_key, developer) to contributions."""
    return lines.groupBy(*PATH, "developer").agg(F.count(F.lit(1)).alias("lines"))


def by_alias(contribution: DataFrame, alias: DataFrame | None) -> DataFrame:
    """Lines of each alias in each file. Dealt by the path, as which what is asked of a file next finds them."""
    return with_alias(contribution, alias, "developer").repartition("path_key").groupBy(*PATH, "developer").agg(F.sum("lines").alias("lines"))


def ownership(contribution: DataFrame) -> DataFrame:
    """Per file: fractal value (1 - sum of squared shares), main developer (ties to the smaller name) and their percentage."""
    total, squares = F.sum("lines").cast("double"), F.sum(F.col("lines").cast("double") * F.col("lines"))
    main = F.min_by("developer", F.struct(-F.col("lines"), F.col("developer")))
    return contribution.groupBy(*PATH).agg(
        F.coalesce(1.0 - F.try_divide(squares, total * total), F.lit(1.0)).alias("fractal_value"), main.alias("main_dev"), (F.try_divide(F.max("lines") * 100.0, total)).alias("main_dev_percent")
    )


def shares(contribution: DataFrame) -> DataFrame:
    """Adds ``percent``: each developer's share of the file."""
    return contribution.withColumn("percent", F.try_divide(100.0 * F.col("lines"), F.sum("lines").over(W.partitionBy(*PATH))))


def main_developers(contribution: DataFrame) -> DataFrame:
    return ownership(contribution).select("repo_id", F.col("main_dev").alias("developer")).distinct()


def commits_per_developer(sets: DataFrame) -> DataFrame:
    return sets.groupBy("repo_id", F.col("committer").alias("developer")).agg(F.count(F.lit(1)).alias("commits"))


def upsert_alias(alias: DataFrame, developers: DataFrame) -> DataFrame:
    """The alias table with an identity row for each developer it does not know; nothing is deleted."""
    new = developers.select(F.col("developer").alias("name")).distinct().join(alias, "name", "left_anti")
    return alias.select("name", "alias").union(new.select("name", F.col("name").alias("alias")))


def names_of(alias: DataFrame) -> DataFrame:
    """Reverse mapping: the names of each alias."""
    return alias.groupBy("alias").agg(F.array_sort(F.collect_list("name")).alias("names"))
