"""The analyses: what a user asks of a history."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.scalars import color_key, whole_days
from ..operators import knowledge as K
from ..operators import linemetrics as M
from ..operators import summary as S
from ..operators import tree
from ..schemas import MIN_COMMITS_FOR_HOTSPOT, MIN_LINES_FOR_HOTSPOT

PATH = ["repo_id", "path_key"]


def hotspots(items: DataFrame, sets: DataFrame, loc: DataFrame, min_lines: int = MIN_LINES_FOR_HOTSPOT, min_commits: int = MIN_COMMITS_FOR_HOTSPOT) -> DataFrame:
    """Files that are changed often and large; ranges are taken over all files before the thresholds."""
    files = S.with_hotspot(S.with_lines(S.artifacts(items, sets), loc))
    return files.where((F.col("code") >= min_lines) & (F.col("commits") >= min_commits))


def hotspot_tree(*args, **kwargs) -> DataFrame:
    return tree.build(hotspots(*args, **kwargs), F.col("code"), F.col("commits"))


def code_age(items: DataFrame, sets: DataFrame, loc: DataFrame, as_of: Column) -> DataFrame:
    """Files with code and the days since their last change."""
    return S.with_lines(S.artifacts(items, sets), loc).withColumn("age_days", whole_days(F.col("date"), as_of)).where("code > 0")


def fragmentation(items: DataFrame, sets: DataFrame, loc: DataFrame, contribution: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Files of more than one line with their fractal value. Files without contributions are left out."""
    files = S.with_lines(S.artifacts(items, sets, alias), loc).where("code > 1")
    return files.join(K.ownership(K.by_alias(contribution, alias)), PATH)


def without_contribution(files: DataFrame, contribution: DataFrame) -> DataFrame:
    return files.join(contribution, PATH, "left_anti")


def knowledge(items: DataFrame, sets: DataFrame, loc: DataFrame, contribution: DataFrame, alias: DataFrame | None = None, lost: str | None = None) -> DataFrame:
    """Main developer of each file; with ``lost`` only that developer's files keep a colour key."""
    files = S.with_lines(S.artifacts(items, sets, alias), loc).where("code >= 1")
    own = files.join(K.ownership(K.by_alias(contribution, alias)), PATH, "left").withColumns({"main_dev": F.coalesce("main_dev", F.lit("")), "main_dev_percent": F.coalesce("main_dev_percent", F.lit(0.0))})
    return own.withColumn("color_key", color_key(F.col("main_dev"), None if lost is None else F.lit(lost)))


def summary(items: DataFrame, sets: DataFrame, loc: DataFrame, as_of: Column, contribution: DataFrame | None = None, alias: DataFrame | None = None) -> DataFrame:
    """The export: one row per file, with ownership if contributions are given."""
    # written, as the files and their ranges would each go back to all items
    files = S.with_hotspot(cut(S.with_lines(S.artifacts(items, sets, alias), loc))).withColumn("code_age_days", whole_days(F.col("date"), as_of))
    columns = ["repo_id", "server_path", "commits", "committers", "work_items", "code", "hotspot", "code_age_days"]
    if contribution is None:
        return files.select(*columns)
    own = files.join(K.ownership(K.by_alias(contribution, alias)), PATH, "left")
    zero = F.lit(0.0)
    return own.select(*columns, F.coalesce("fractal_value", zero).alias("fractal_value"), F.coalesce("main_dev", F.lit("???")).alias("main_dev"), F.coalesce("main_dev_percent", zero).alias("main_dev_percent"))


def trend(revisions: DataFrame, language: Column) -> DataFrame:
    """Line counts and indentation of each revision (path, revision, content) of each file."""
    keys = ["path", "revision"]
    return M.count_lines(revisions, keys, language).join(M.inverted_space(revisions, keys), keys)


def comments(sets: DataFrame) -> DataFrame:
    return sets.select("comment", "committer")


def hotspot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """new - old of files in both summaries."""
    return old.withColumnRenamed("hotspot", "_old").join(new, "local_path").select("local_path", (F.col("hotspot") - F.col("_old")).alias("delta"))


def work_on_file(contribution: DataFrame, path_key: str, alias: DataFrame | None = None) -> DataFrame:
    return K.shares(K.by_alias(contribution.where(F.col("path_key") == path_key), alias))


def comment_terms(sets: DataFrame, min_share: float = 0.01, min_length: int = 3, stop_words: list[str] | None = None) -> DataFrame:
    """term, n (occurrences), n_comments of terms in more than ``min_share`` of all comments."""
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    words = F.split(F.regexp_replace(F.lower("comment"), r"\p{Punct}", ""), r"\s+")
    rows = sets.select("changeset_id", F.explode(words).alias("term")).where((F.length("term") >= min_length) & ~F.col("term").isin(stop_words))
    total = sets.agg(F.count(F.lit(1)).alias("_all"))  # one row
    terms = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("changeset_id").alias("n_comments"))
    return terms.crossJoin(F.broadcast(total)).where(F.col("n_comments") > F.col("_all") * min_share).drop("_all")
