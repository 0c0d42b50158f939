"""Team communication: teams that change the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summary import CHANGESET, FILE

NOT_CLASSIFIED = "NOT_CLASSIFIED"


def with_team(sets: DataFrame, teams: DataFrame) -> DataFrame:
    """Adds ``team``: the committer's team on the day (developer, team, valid_from, valid_to; null ends are open), or NOT_CLASSIFIED.

    One row a changeset: of intervals that overlap the one that began last counts, of those that began together the smaller team's. A
    developer's intervals, as many as the changes of team of one person, come as one array, so changesets meet by equality of the developer
    alone: one who made a third of them is split like any hot key of a join.
    """
    spell = F.struct(F.col("valid_from").cast("timestamp").alias("begins"), F.col("team").alias("name"), F.col("valid_to").cast("timestamp").alias("ends"))
    spells = teams.where("developer is not null").groupBy(F.col("developer").alias("committer")).agg(F.collect_set(spell).alias("_spells"))
    at = F.filter("_spells", lambda s: (s["begins"].isNull() | (F.col("date") >= s["begins"])) & (s["ends"].isNull() | (F.col("date") < s["ends"])))
    last = F.array_max(F.transform(at, lambda s: s["begins"]))
    names = F.transform(F.filter(at, lambda s: s["begins"].eqNullSafe(last)), lambda s: s["name"])
    return sets.join(spells, "committer", "left").withColumn("team", F.coalesce(F.array_min(names), F.lit(NOT_CLASSIFIED))).select(*[c for c in sets.columns if c != "team"], "team")


def commits_per_team(items: DataFrame, sets: DataFrame) -> DataFrame:
    return items.join(sets.select(*CHANGESET, "team"), CHANGESET).groupBy(*FILE, "team").agg(F.count(F.lit(1)).alias("commits"))


def communication(items: DataFrame, sets: DataFrame) -> DataFrame:
    """team1 < team2 and the number of files that both changed."""
    per_file = commits_per_team(items, sets).where(F.col("team") != NOT_CLASSIFIED).select(*FILE, "team")
    a, b = per_file.withColumnRenamed("team", "team1"), per_file.withColumnRenamed("team", "team2")
    return a.join(b, FILE).where("team1 < team2").groupBy("repo_id", "team1", "team2").agg(F.count(F.lit(1)).alias("files"))


def unclassified(sets: DataFrame) -> DataFrame:
    return sets.where(F.col("team") == NOT_CLASSIFIED).groupBy("repo_id", "committer").agg(F.count(F.lit(1)).alias("commits"))
