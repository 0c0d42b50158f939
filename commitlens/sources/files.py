"""Other files: cached JSON, line-count CSV, aliases, component maps, summaries, source trees, revisions; and what is written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import has_extension, is_kind
from ..functions.scalars import LANGUAGES, path_key
from ..schemas import DELETE

HISTORY = "ChangeSets array<struct<Id:string,Committer:string,Date:timestamp,Comment:string,Items:array<struct<Id:string,Kind:int,ServerPath:string,FromServerPath:string,LocalPath:string>>,WorkItems:array<struct<Id:string,Title:string,WorkItemTypeName:string>>>>"


def history_json(spark: SparkSession, path: str, repo_id: str, rank: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(change_set, change_item) of cached histories, newest changeset first; items have their changeset's ``cs_ord``, too.

    A history may be split over documents of one or several files: their order, newest first too, is that of ``rank``, by default the
    file's path. A changeset's number counts those of all later documents and its place in its own, so each number is given once and 0 is the oldest.
    """
    docs = spark.read.schema(HISTORY).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    docs = docs.select("*", F.col("_metadata.file_path").alias("file")).select(F.col("file"), (F.col("file") if rank is None else rank).alias("rank"), F.coalesce("ChangeSets", F.expr("array()")).alias("sets"))
    sizes = docs.groupBy("rank", "file").agg(F.sum(F.size("sets").cast("long")).alias("n"))  # one row a document
    after = W.orderBy("rank", "file")
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = sizes.select("file", (F.sum("n").over(whole) - 1 - F.coalesce(F.sum("n").over(after.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("last"))
    sets = docs.select("file", F.posexplode("sets").alias("pos", "c")).join(last, "file").withColumn("cs_ord", F.col("last") - F.col("pos"))
    out = sets.select(F.lit(repo_id).alias("repo_id"), F.col("c.Id").alias("changeset_id"), F.col("c.Committer").alias("committer"), F.col("c.Date").alias("date"), F.col("c.Comment").alias("comment"), F.transform("c.WorkItems", lambda w: w["Id"]).alias("work_items"), "cs_ord")
    items = sets.select(F.lit(repo_id).alias("repo_id"), F.col("c.Id").alias("changeset_id"), "cs_ord", F.posexplode("c.Items").alias("item_idx", "i"))
    return out, items.select("repo_id", "changeset_id", "cs_ord", "item_idx", F.col("i.Id").alias("file_id"), F.col("i.Kind").alias("kind"), F.col("i.ServerPath").alias("server_path"), F.col("i.FromServerPath").alias("from_server_path"))


def contribution_json(spark: SparkSession, path: str, repo_id: str, whole: bool = True) -> DataFrame:
    """An object a file (``whole``) or a line: {path: {DeveloperToContribution: {developer: lines}}}; of paths that differ in case only, the smallest is kept."""
    raw = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,struct<DeveloperToContribution:map<string,bigint>>>")).alias("path", "d"))
    first = raw.groupBy(path_key(F.col("path")).alias("path_key")).agg(F.min_by("d", "path").alias("d"))
    return first.select(F.lit(repo_id).alias("repo_id"), "path_key", F.explode("d.DeveloperToContribution").alias("developer", "lines"))


def metrics_json(spark: SparkSession, path: str, repo_id: str, whole: bool = True) -> DataFrame:
    """An object a file (``whole``) or a line: {path: {Blanks, Code, Comments}}."""
    raw = spark.read.text(path, wholetext=whole).select(F.explode(F.from_json("value", "map<string,struct<Blanks:int,Code:int,Comments:int>>")).alias("path", "m"))
    return raw.select(F.lit(repo_id).alias("repo_id"), path_key(F.col("path")).alias("path_key"), F.col("m.Blanks").alias("blanks"), F.col("m.Comments").alias("comments"), F.col("m.Code").alias("code"))


def line_count_csv(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """language,filename,blank,comment,code; rows without all five (the sum) go; of repeated files the one with the largest counts stays."""
    rows = spark.read.schema("language string, filename string, blank int, comment int, code int").option("header", False).csv(path).na.drop()
    return rows.groupBy(path_key(F.col("filename")).alias("path_key")).agg(F.max(F.struct("code", "comment", "blank")).alias("m")).select(F.lit(repo_id).alias("repo_id"), "path_key", F.col("m.blank").alias("blanks"), F.col("m.comment").alias("comments"), F.col("m.code").alias("code"))


def alias_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``name >> alias``; # starts a comment, other lines without >> are skipped. A name given twice is an error when read."""
    part = F.split("value", ">>")
    rows = spark.read.text(path).where("not startswith(ltrim(value), '#')").where(F.size(part) == 2).select(F.trim(part[0]).alias("name"), F.trim(part[1]).alias("alias"))
    one = F.when(F.count(F.lit(1)) == 1, F.min("alias")).otherwise(F.raise_error(F.concat(F.lit("alias defined twice: "), F.col("name"))))
    return rows.groupBy("name").agg(one.alias("alias"))


def component_map(spark: SparkSession, path: str, lower_case: bool = False) -> DataFrame:
    """<Mapping key= value=/> rows."""
    rows = spark.read.option("rowTag", "Mapping").schema("_key string, _value string").xml(path)
    return rows.select((F.lower("_key") if lower_case else F.col("_key")).alias("key"), F.col("_value").alias("value"))


def summary_csv(spark: SparkSession, path: str) -> DataFrame:
    """local_path and hotspot of an exported summary; both columns must be there."""
    df = spark.read.option("header", True).csv(path)
    missing = {"LocalPath", "Hotspot"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    return df.groupBy(F.col("LocalPath").alias("local_path")).agg(F.max(F.col("Hotspot").cast("double")).alias("hotspot"))


def packed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files that were packed as the rows of Parquet files: listing and opening millions of small files takes longer than reading them."""
    return spark.read.schema("path string, content string").parquet(path)


def write_packed(df: DataFrame, path: str, by: str | None = None) -> None:
    """Packs files (path, content) as ``packed_files`` reads them, compressed; ``by`` names a boolean column, whose rows are packed below ``by=true`` and ``by=false``."""
    columns = [F.col(c).cast("string").alias(c) for c in ("path", "content")]
    if by is None:
        df.select(*columns).write.option("compression", "zstd").parquet(path)
        return
    df.select(*columns, F.col(by).cast("boolean").alias(by)).write.option("compression", "zstd").partitionBy(by).parquet(path)
    for value in ("true", "false"):  # a side without rows is there, too
        df.sparkSession.createDataFrame([], "path string, content string").write.mode("append").parquet(f"{path}/{by}={value}")


def source_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, name: Column | None = None, packed: str | None = None) -> DataFrame:
    """(path, content) of all files below the root with one of the extensions. ``name`` gives the file's name from ``path`` where that is not its end.

    Files of the tree that are packed below ``packed`` come besides, under the paths that they have there.
    """
    extensions = list(LANGUAGES) if extensions is None else extensions
    if unknown := [e for e in extensions if e.lower() not in LANGUAGES]:
        raise ValueError(f"extensions without a language: {', '.join(unknown)}")
    df = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    df = df if name is None else df.withColumn("path", name)
    return (df if packed is None else df.union(packed_files(spark, packed))).where(has_extension(F.col("path"), extensions))


#: Characters that Spark writes as %XX in the name of a partition's folder.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32)))


def _partition(path: str, repo_id: str) -> str:
    return f"{path.rstrip('/')}/repo_id=" + "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in repo_id)


def write_table(df: DataFrame, path: str, repo_id: str | None = None) -> None:
    """Replaces the rows of the repositories in ``df``, or of ``repo_id``, in a canonical table; other repositories stay.

    Repositories are partitions. Rows are staged and take the old partition's place when all are written. A repository that has no rows
    any more keeps an empty file with the table's schema.
    """
    if repo_id is not None:
        df = df.where(F.col("repo_id") == repo_id)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("repo_id").parquet(path)
    if repo_id is not None and not rows.get["n"]:
        df.limit(0).drop("repo_id").write.mode("overwrite").parquet(_partition(path, repo_id))


def read_table(spark: SparkSession, path: str, schema: StructType | str, repo_id: str | None = None) -> DataFrame:
    """A canonical table with the given schema, which an empty one has, too; repository names stay text."""
    df = spark.read.schema(schema).parquet(path)
    return df if repo_id is None else df.where(F.col("repo_id") == repo_id)


def csv_ready(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles as text with a fixed number of digits."""
    return df.select(*[F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, header: bool = True, digits: int = 3) -> None:
    csv_ready(df, digits).write.mode("overwrite").option("header", header).csv(path)


#: Names of the exports.
EXPORTS = {"couplings": "change_couplings.csv", "component_couplings": "classified_change_couplings.csv", "comments": "comments.csv", "summary": "summary-{date}.csv"}


def export(df: DataFrame, folder: str, kind: str, date: str = "") -> str:
    """Writes one of the named exports below the folder, the summary with its date (yyyy-MM-dd) in the name, and returns where."""
    if kind not in EXPORTS or (kind == "summary" and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date)):
        raise ValueError(f"no export {kind!r} of date {date!r}")
    path = f"{folder.rstrip('/')}/{EXPORTS[kind].format(date=date)}"
    write_csv(df, path)
    return path


def file_revisions(
    spark: SparkSession, path: str, change_item: DataFrame, change_set: DataFrame, revision: Column | None = None, name: Column | None = None, packed: str | None = None
) -> DataFrame:
    """(repo_id, path, revision, date, content): the exported revisions of files that are not deletes, for the trend.

    Contents lie below ``path`` as revision/server path; ``revision`` and ``name`` find both in the relative path otherwise. A file is one
    row, as a source file is read whole; items without an exported file are left out. Files packed below ``packed`` as revision/server path come besides.
    """
    inner = F.regexp_extract(F.col("_metadata.file_path"), re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(.*)$", 1)
    found = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.url_decode(inner).alias("path"), F.col("value").alias("content"))
    found = found.select(
        (F.substring_index("path", "/", 1) if revision is None else revision).alias("changeset_id"),
        (F.regexp_replace("path", "^[^/]*/", "") if name is None else name).alias("server_path"),
        "content",
    )
    if packed is not None:
        more = packed_files(spark, packed)
        found = found.union(more.select(F.substring_index("path", "/", 1), F.regexp_replace("path", "^[^/]*/", ""), "content"))
    items = change_item.where(~is_kind(F.col("kind"), DELETE)).select("repo_id", F.col("changeset_id").cast("string").alias("changeset_id"), "server_path").distinct()
    dates = change_set.select("repo_id", F.col("changeset_id").cast("string").alias("changeset_id"), "date")
    rows = found.join(items, ["changeset_id", "server_path"]).join(dates, ["repo_id", "changeset_id"])
    return rows.select("repo_id", F.col("server_path").alias("path"), F.col("changeset_id").alias("revision"), "date", "content")
