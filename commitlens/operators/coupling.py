"""Change coupling: what is changed together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.scalars import basename, coupling_degree
from ..schemas import MAX_ITEMS_PER_CHANGESET, MIN_COUPLING_DEGREE, MIN_COUPLINGS
from .summary import CHANGESET

#: Letters of the substrings under which keys of components are found.
GRAM = 8
#: Pairs that one task meets, and so holds at most, to count them.
PAIRS_PER_TASK = 1_000_000


def small_changesets(items: DataFrame, most: int = MAX_ITEMS_PER_CHANGESET) -> DataFrame:
    """Items of changesets with at most ``most`` items, counted before any filter. This also bounds the pairs of one changeset."""
    size = items.groupBy(*CHANGESET).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).drop("_n")
    return items.join(size, CHANGESET, "left_semi")


def pairs(items: DataFrame, key: str, count_first: bool = False) -> DataFrame:
    """item1 < item2, couplings, degree for all keys that share a changeset.

    Couplings are common changesets less one, unless ``count_first``. The self-join is on the changeset, so a popular key is spread
    over its changesets; pairs are counted before they shuffle, in as many tasks as there are ``PAIRS_PER_TASK``, as a task holds its pairs.
    """
    seen = cut(items.where(F.col(key).isNotNull()).select(*CHANGESET, F.col(key).alias("item")).distinct())
    met = seen.groupBy(*CHANGESET).agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0] or 0
    seen = seen.repartition(max(met // PAIRS_PER_TASK + 1, int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *CHANGESET)
    counts = seen.groupBy("repo_id", "item").agg(F.count(F.lit(1)).alias("n"))
    a, b = seen.select(*CHANGESET, F.col("item").alias("item1")), seen.select(*CHANGESET, F.col("item").alias("item2"))
    both = a.join(b, CHANGESET).where("item1 < item2").groupBy("repo_id", "item1", "item2").agg((F.count(F.lit(1)) - (0 if count_first else 1)).alias("couplings"))
    n = lambda k: counts.select("repo_id", F.col("item").alias(f"item{k}"), F.col("n").alias(f"n{k}"))
    out = both.join(n(1), ["repo_id", "item1"]).join(n(2), ["repo_id", "item2"])
    return out.withColumn("degree", coupling_degree(F.col("couplings"), F.col("n1"), F.col("n2"))).select("repo_id", "item1", "item2", "couplings", "degree")


def file_coupling(items: DataFrame, accept: Column | None = None, most: int = MAX_ITEMS_PER_CHANGESET, min_couplings: int = MIN_COUPLINGS, min_degree: float = MIN_COUPLING_DEGREE, count_first: bool = False) -> DataFrame:
    """Coupled file ids. ``accept`` looks at each item's own path at that time."""
    kept = small_changesets(items, most)
    kept = kept if accept is None else kept.where(accept)
    return pairs(kept, "file_id", count_first).where((F.col("couplings") >= min_couplings) & (F.col("degree") >= min_degree))


def with_latest_paths(coupled: DataFrame, paths: DataFrame) -> DataFrame:
    """path1 and path2: latest paths of the coupled ids, from a table repo_id, file_id, server_path."""
    p = lambda k: paths.select("repo_id", F.col("file_id").alias(f"item{k}"), F.col("server_path").alias(f"path{k}"))
    return coupled.join(p(1), ["repo_id", "item1"]).join(p(2), ["repo_id", "item2"])


def _grams(text: Column, length: Column | int) -> Column:
    """The distinct substrings of a length; none of a shorter text."""
    length = F.lit(length) if isinstance(length, int) else length
    starts = F.when(F.length(text) >= length, F.sequence(F.lit(1), F.length(text) - length + 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, length)))


def components_of(paths: DataFrame, mapping: DataFrame, gram: int = GRAM) -> DataFrame:
    """Adds ``component``: of the mapping's keys that the lower-cased path contains, the longest one's value; null without one.

    Each key stands under one of its substrings of ``gram`` letters, the one that fewest keys have (a shorter key under itself), and is met
    by equality with the substrings of a path; only such pairs are tested. Keys that begin alike so stand under what tells them apart.
    """
    keys = mapping.where("key is not null").select("key", F.lower("key").alias("_key"), "value").distinct()
    keys = keys.withColumn("_n", F.least(F.length("_key"), F.lit(gram)))
    in_keys = keys.select("_key", F.explode(_grams(F.col("_key"), F.col("_n"))).alias("_gram"))
    held = in_keys.groupBy("_gram").agg(F.countDistinct("_key").alias("_keys"))
    rarest = in_keys.join(held, "_gram").groupBy("_key").agg(F.min(F.struct("_keys", "_gram"))["_gram"].alias("_gram"))
    index = keys.join(rarest, "_key").select("_gram", "_key", "key", "value")

    lengths = [r[0] for r in keys.select("_n").distinct().collect()]  # at most gram + 1 numbers
    distinct = paths.select("server_path").distinct().withColumn("_path", F.lower("server_path"))
    every = F.flatten(F.array(*[_grams(F.col("_path"), n) for n in sorted(lengths)])) if lengths else F.expr("cast(array() as array<string>)")
    met = distinct.select("server_path", "_path", F.explode(every).alias("_gram")).join(index, "_gram").where(F.col("_path").contains(F.col("_key")))
    found = met.groupBy("server_path").agg(F.max_by("value", F.struct(F.length("key"), "key")).alias("component"))
    return paths.join(found, "server_path", "left")


def component_coupling(items: DataFrame, mapping: DataFrame, count_first: bool = False) -> DataFrame:
    """Coupling of components, without thresholds."""
    return pairs(components_of(items, mapping).where(F.col("component") != ""), "component", count_first)


def edges(coupled: DataFrame) -> DataFrame:
    """Graph edges with short display names, from path1, path2 and degree."""
    return coupled.select("repo_id", F.col("path1").alias("node1"), F.col("path2").alias("node2"), basename(F.col("path1")).alias("name1"), basename(F.col("path2")).alias("name2"), F.col("degree").alias("strength"))


def neighbourhood(coupled: DataFrame, vertex: object) -> DataFrame:
    return coupled.where((F.col("item1") == vertex) | (F.col("item2") == vertex))
