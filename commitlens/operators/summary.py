"""File summaries and what is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.predicates import is_kind
from ..functions.scalars import min_max_normal
from ..schemas import DELETE, MAX_WORK_ITEMS_PER_CHANGESET

FILE = ["repo_id", "file_id"]
CHANGESET = ["repo_id", "changeset_id"]


def with_alias(df: DataFrame, alias: DataFrame | None, column: str) -> DataFrame:
    """``column`` replaced by its alias (repo-wide table name, alias), or itself if it has none."""
    if alias is None:
        return df
    return df.join(alias.select(F.col("name").alias("_name"), F.col("alias").alias("_alias")), F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_alias", column)).drop("_name", "_alias")


def artifacts(items: DataFrame, sets: DataFrame, alias: DataFrame | None = None, max_work_items: int = MAX_WORK_ITEMS_PER_CHANGESET) -> DataFrame:
    """One row per file id: commits, distinct committers and work items, and the path, date and revision of its latest item.

    Ids whose latest item is a delete are dropped. Filters on paths come after this step, as they look at the latest path only. One
    shuffle on the changeset and one on the file; counts and the latest item are combined before the second.
    """
    # written, as work items are searched for in comments again wherever they are asked for
    sets = sets.select(*CHANGESET, "date", "committer", (F.size("work_items") < max_work_items).alias("few"), F.array_distinct("work_items").alias("work_items"))
    sets = cut(with_alias(sets, alias, "committer")).where("few").drop("few")
    rows = items.join(sets, CHANGESET).select(*FILE, "changeset_id", "item_idx", "date", "committer", "work_items", "server_path", "kind")
    latest = F.max(F.struct("date", "changeset_id", "item_idx", "server_path", "kind"))
    out = rows.groupBy(*FILE).agg(F.count(F.lit(1)).alias("commits"), latest.alias("latest"))
    # names of a file go without its paths: its committers and its work items, each once
    name = lambda of, x: F.struct(F.lit(of).alias("of"), x.alias("name"))
    each = F.concat(F.array(name(0, F.col("committer"))), F.transform(F.coalesce("work_items", F.array().cast("array<string>")), lambda w: name(1, w)))
    names = rows.select(*FILE, F.explode(each).alias("n")).select(*FILE, "n.of", "n.name").where("name is not null").distinct()
    names = names.groupBy(*FILE).agg(F.count_if(F.col("of") == 0).alias("committers"), F.count_if(F.col("of") == 1).alias("work_items"))
    return (
        out.where(~is_kind(F.col("latest.kind"), DELETE))
        .join(names, FILE, "left")
        .select(*FILE, "commits", F.coalesce("committers", F.lit(0)).alias("committers"), F.coalesce("work_items", F.lit(0)).alias("work_items"), F.col("latest.server_path").alias("server_path"), F.col("latest.date").alias("date"), F.col("latest.changeset_id").alias("revision"), F.lower("latest.server_path").alias("path_key"))
    )


def latest_paths(items: DataFrame, sets: DataFrame, by: str = "date") -> DataFrame:
    """repo_id, file_id, server_path: the path of each file's latest item, over all changesets, which are in the order of ``by``, then the id."""
    rows = items.join(sets.select(*CHANGESET, by), CHANGESET)
    return rows.groupBy(*FILE).agg(F.max_by("server_path", F.struct(by, "changeset_id", "item_idx")).alias("server_path"))


def with_lines(files: DataFrame, loc: DataFrame) -> DataFrame:
    """Adds ``code``: lines of code of the file's path, 0 without a metric."""
    return files.join(loc.select("repo_id", "path_key", F.col("code").alias("_code")), ["repo_id", "path_key"], "left").withColumn("code", F.coalesce("_code", F.lit(0))).drop("_code")


def with_hotspot(files: DataFrame) -> DataFrame:
    """Adds ``hotspot``: normalised commits times normalised lines of code, over all files of the repository."""
    ranges = files.groupBy("repo_id").agg(*[f(c).alias(f"_{n}_{c}") for c in ("commits", "code") for n, f in (("lo", F.min), ("hi", F.max))])
    product: Column = min_max_normal(F.col("commits"), F.col("_lo_commits"), F.col("_hi_commits")) * min_max_normal(F.col("code"), F.col("_lo_code"), F.col("_hi_code"))
    return files.join(ranges, "repo_id").withColumn("hotspot", product).drop("_lo_commits", "_hi_commits", "_lo_code", "_hi_code")


def drop_deleted(items: DataFrame) -> DataFrame:
    """Without all ids that were ever deleted."""
    return items.join(items.where(is_kind(F.col("kind"), DELETE)).select(*FILE).distinct(), FILE, "left_anti")


def keep_alive(items: DataFrame, alive: DataFrame) -> DataFrame:
    """Items of ids that are alive, without their deletes."""
    return items.where(~is_kind(F.col("kind"), DELETE)).join(alive, FILE, "left_semi")


def drop_empty(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Changesets that still have items."""
    return sets.join(items, CHANGESET, "left_semi")


def shared_paths(items: DataFrame) -> DataFrame:
    """Items whose path stands more than once in its changeset under different ids."""
    w = W.partitionBy(*CHANGESET, "server_path")
    return items.withColumn("_a", F.min("file_id").over(w)).withColumn("_b", F.max("file_id").over(w)).where("_a <> _b").drop("_a", "_b")


def reconcile(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """repo_id, server_path, problem: paths that only the history (``not tracked``) or only the snapshot (``not in history``) knows."""
    a = files.select("repo_id", "server_path").distinct().withColumn("_a", F.lit(True))
    b = tracked.select("repo_id", "server_path").distinct().withColumn("_b", F.lit(True))
    problem = F.when(F.col("_b").isNull(), "not tracked").when(F.col("_a").isNull(), "not in history")
    return a.join(b, ["repo_id", "server_path"], "full").select("repo_id", "server_path", problem.alias("problem")).where("problem is not null")


def existing(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files whose latest path is in the snapshot; an id whose latest path is gone is dropped with all its history."""
    return files.join(tracked, ["repo_id", "server_path"], "left_semi")
