"""The commit graph as an edge table (repo_id, child, parent, parent_idx)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoint import cut, large
from ..functions.scalars import kind_of_tree_diff
from ..ship import ship
from .fold import fold

#: Arcs that one task folds.
FOLD = 1 << 18


def edges_of(commits: DataFrame) -> DataFrame:
    """From (repo_id, changeset_id, parents), parents separated by white space."""
    parents = F.filter(F.split(F.coalesce("parents", F.lit("")), r"[ \t]+"), lambda p: p != "")
    return commits.select("repo_id", F.col("changeset_id").alias("child"), F.posexplode(parents).alias("parent_idx", "parent")).select("repo_id", "child", "parent", "parent_idx")


def roots(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """Commits without parents."""
    return commits.join(large(edges.select("repo_id", F.col("child").alias("changeset_id"))), ["repo_id", "changeset_id"], "left_anti")


def _folded(arcs: DataFrame, sources: DataFrame, longest: bool) -> tuple[DataFrame, DataFrame]:
    """Arcs (repo_id, node, prev, steps) as (the arcs that are left, where other nodes hang (repo_id, node, to, steps)).

    Nodes are dealt by range, so that a task holds what lies side by side, and each task folds what it holds. What hangs at a node of another
    task is followed from there: few rows, if ids or their order follow the history, and no more than all.
    """
    spark = ship(arcs.sparkSession)
    rows = arcs.select("repo_id", "node", "prev", "steps", F.lit(False).alias("source")).where("repo_id is not null and node is not null and prev is not null")
    marks = sources.select("repo_id", "node", F.lit(None).cast(arcs.schema["prev"].dataType), F.lit(0).cast(arcs.schema["steps"].dataType), F.lit(True))
    rows = rows.union(marks.where("repo_id is not null and node is not null"))
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {names.get(c, 'boolean')}" for c in ("repo_id", "node", "prev", "steps", "hung", "open"))
    tasks = max(1, -(-rows.count() // FOLD))
    own = cut(rows.repartitionByRange(tasks, "repo_id", "node").mapInArrow(partial(fold, longest=longest), schema))
    if tasks == 1:
        return own.where("not hung").select("repo_id", "node", "prev", "steps"), own.where("hung").select("repo_id", "node", F.col("prev").alias("to"), "steps")
    away = own.where("open")
    met = own.where("hung").join(large(away.select("repo_id", F.col("prev").alias("node")).distinct()), ["repo_id", "node"], "left_semi")
    ends = _jumped(met.select("repo_id", "node", F.col("prev").alias("to"), "steps")).select("repo_id", F.col("node").alias("prev"), "to", F.col("steps").alias("_steps"))
    away = cut(away.join(large(ends), ["repo_id", "prev"], "left").select("repo_id", "node", F.coalesce("to", "prev").alias("prev"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), "hung"))
    rows = own.where("not open").select(*away.columns).union(away)
    return rows.where("not hung").drop("hung"), rows.where("hung").select("repo_id", "node", F.col("prev").alias("to"), "steps")


def ranked(links: DataFrame) -> DataFrame:
    """(repo_id, node, to, steps): where following each node's one link (node, to, steps) ends, and all steps on the way."""
    arcs = links.select("repo_id", "node", F.col("to").alias("prev"), "steps")
    rest, ends = _folded(arcs, arcs.where("false"), False)
    if rest.limit(1).count():
        raise ValueError("the commit graph has a cycle")
    return ends


def _jumped(links: DataFrame) -> DataFrame:
    """As ``ranked``, by pointer jumping alone: a round quadruples what a link spans, so rounds grow with the logarithm of the longest way."""

    def jump(at: DataFrame) -> DataFrame:
        on = at.select("repo_id", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        to, steps = F.coalesce("_to", "to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")
        return at.join(large(on), ["repo_id", "to"], "left").select("repo_id", "node", to, steps, F.col("_to").isNotNull().alias("moved"))

    at, span = cut(links.select("repo_id", "node", "to", "steps")), 1
    n = at.count()
    while n:
        at, span = cut(jump(jump(at))), 4 * span
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        if span > 4 * n:
            raise ValueError("the commit graph has a cycle")
    return at


def _contracted(arcs: DataFrame, sources: DataFrame, longest: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Arcs (repo_id, node, prev, steps) without nodes that have one ``prev`` only, and where these hang: (repo_id, node, to, steps), by passes.

    What such a node's best way is follows from its ``prev`` alone, so runs of them are ranked at once. Ways that then join the same
    two nodes become one arc, which makes more nodes of one ``prev``: branches that were merged fold up with the run they left. The first pass is
    that of ``_folded``. It stops when a pass takes few of the nodes that are left.
    """
    best = F.max if longest else F.min
    arcs, ends = _folded(arcs, sources, longest)
    hung = [ends]
    arcs = cut(arcs.groupBy("repo_id", "node", "prev").agg(best("steps").alias("steps")))
    while True:
        single = arcs.groupBy("repo_id", "node").agg(F.count(F.lit(1)).alias("k"), F.min("prev").alias("to"), F.min("steps").alias("steps"))
        single = single.join(large(sources.select("repo_id", "node")), ["repo_id", "node"], "left_anti")
        found, n = single.agg(F.count_if(F.col("k") == 1), F.count(F.lit(1))).first()
        if not found or 20 * found < n:
            return arcs, hung
        ends = _jumped(single.where("k = 1").select("repo_id", "node", "to", "steps"))
        hung.append(ends)
        rest = arcs.join(large(ends.select("repo_id", "node")), ["repo_id", "node"], "left_anti")
        on = ends.select("repo_id", F.col("node").alias("prev"), "to", F.col("steps").alias("_steps"))
        rest = rest.join(large(on), ["repo_id", "prev"], "left").select("repo_id", "node", F.coalesce("to", "prev").alias("prev"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        arcs = cut(rest.groupBy("repo_id", "node", "prev").agg(best("steps").alias("steps")))


def _jumps(arcs: DataFrame, longest: bool, most: int) -> DataFrame:
    """(repo_id, node, prev, steps) over several arcs, with the least or the largest sum: doubled while there are at most ``most`` rows, or until closed."""
    best = F.max if longest else F.min
    n = arcs.count()
    while n:
        first = arcs.select("repo_id", "node", F.col("prev").alias("middle"), F.col("steps").alias("steps1"))
        second = arcs.select("repo_id", F.col("node").alias("middle"), "prev", F.col("steps").alias("steps2"))
        far = first.join(large(second), ["repo_id", "middle"]).select("repo_id", "node", "prev", (F.col("steps1") + F.col("steps2")).alias("steps"))
        new = cut(arcs.union(far).groupBy("repo_id", "node", "prev").agg(best("steps").alias("steps")))
        grown = new.count()
        if grown > most:
            return arcs
        arcs = new
        if grown == n:
            return arcs
        n = grown
    return arcs


def _walk(jumps: DataFrame, known: DataFrame, key: list[str], longest: bool, rounds: int) -> DataFrame:
    """``known`` (key, depth) and all it leads to over the jumps, with the least (or largest) depth of each key.

    Semi-naive: only keys whose depth changed in the last round go on, and each round covers several arcs.
    """
    best, better = (F.max, "depth > old") if longest else (F.min, "depth < old")
    on = jumps.select("repo_id", F.col("prev").alias("node"), F.col("node").alias("next"), "steps")
    known = cut(known)
    front = known
    while True:
        step = front.join(large(on), ["repo_id", "node"]).withColumn("node", F.col("next")).withColumn("depth", F.col("depth") + F.col("steps"))
        new = step.groupBy(*key).agg(best("depth").alias("depth"))
        front = cut(new.join(large(known.withColumnRenamed("depth", "old")), key, "left").where(f"old is null or {better}").select(*key, "depth"))
        if not front.limit(1).count():
            return known
        if rounds < 0:
            raise ValueError("the commit graph has a cycle")
        known, rounds = cut(known.union(front).groupBy(*key).agg(best("depth").alias("depth"))), rounds - 1


def _best_ways(arcs: DataFrame, start: DataFrame, key: list[str], longest: bool) -> DataFrame:
    """(key, depth) of all nodes that ways over arcs (repo_id, node, prev) reach from ``start`` (key, depth).

    Runs are contracted, the rest is walked in rounds, and the runs are read off from where they hang.
    """
    arcs, start = arcs.select("repo_id", "node", "prev", F.lit(1).alias("steps")), cut(start)
    core, hung = _contracted(arcs, start.select("repo_id", "node").distinct(), longest)
    n = core.select("repo_id", "node").distinct().count()
    known = _walk(_jumps(core, longest, max(1 << 16, arcs.count())), start.select(*key, "depth"), key, longest, n)
    for ends in reversed(hung):
        add = ends.join(large(known.withColumnRenamed("node", "to")), ["repo_id", "to"]).withColumn("depth", F.col("depth") + F.col("steps"))
        known = cut(known.union(add.select(*key, "depth")))
    return known


def distances(edges: DataFrame, seeds: DataFrame, longest: bool = False) -> DataFrame:
    """(repo_id, seed, node, depth): all ancestors of the seeds, themselves at 0, with their least (or largest) distance."""
    start = seeds.select("repo_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    return _best_ways(edges.select("repo_id", F.col("parent").alias("node"), F.col("child").alias("prev")), start, ["repo_id", "seed", "node"], longest)


def reached(edges: DataFrame, seeds: DataFrame, longest: bool = False) -> DataFrame:
    """(repo_id, node, depth): as ``distances``, from whichever seed is best; one row a node however many seeds there are."""
    start = seeds.select("repo_id", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    return _best_ways(edges.select("repo_id", F.col("parent").alias("node"), F.col("child").alias("prev")), start, ["repo_id", "node"], longest)


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph as chains: (repo_id, node, chain, place) and the edges between them (repo_id, chain, place, to_chain, to_place).

    A chain follows first parents, each of which goes on with one of its children, the one from which the longest line of such children
    leads on (of equal ones that with the smallest id), so a main line is one chain, whatever branches leave it. ``place`` grows from
    the chain's oldest node, at 0. What a node leads back to is, of each chain, all up to one place.
    """
    first = cut(edges.groupBy("repo_id", F.col("child").alias("node")).agg(F.min_by("parent", F.struct("parent_idx", "parent")).alias("to")))
    tips = first.select("repo_id", "node").join(large(first.select("repo_id", F.col("to").alias("node"))), ["repo_id", "node"], "left_anti")
    line = _best_ways(first.select("repo_id", F.col("to").alias("node"), F.col("node").alias("prev")), tips.withColumn("depth", F.lit(0)), ["repo_id", "node"], True)
    ahead = first.join(large(line), ["repo_id", "node"]).groupBy("repo_id", "to").agg(F.min_by("node", F.struct(-F.col("depth"), "node")).alias("node"))
    links = cut(ahead.select("repo_id", "node", "to", F.lit(1).alias("steps")))
    ends = ranked(links)
    nodes = edges.select("repo_id", F.explode(F.array("child", "parent")).alias("node")).distinct()
    nodes = nodes.join(large(ends), ["repo_id", "node"], "left").select("repo_id", "node", F.coalesce("to", "node").alias("chain"), F.coalesce("steps", F.lit(0)).alias("place"))
    nodes = cut(nodes)
    across = edges.select("repo_id", F.col("child").alias("node"), F.col("parent").alias("to")).join(large(links), ["repo_id", "node", "to"], "left_anti").distinct()
    across = across.join(large(nodes), ["repo_id", "node"]).join(large(nodes.select("repo_id", F.col("node").alias("to"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))), ["repo_id", "to"])
    # an edge back to its own chain leads to nothing new
    return nodes, cut(across.where("chain <> to_chain").select("repo_id", "chain", "place", "to_chain", "to_place"))


def covered(across: DataFrame, start: DataFrame, key: list[str]) -> DataFrame:
    """(repo_id, key, chain, upto): of each chain the newest place that leads to one of the ``start`` (repo_id, key, chain, upto).

    One number for each chain that is met, not a row for each node. A round crosses from chains to chains, by the edges
    that have come into reach since the last round only.
    """
    at = ["repo_id", *key, "chain"]
    known = cut(start.groupBy(*at).agg(F.max("upto").alias("upto")))
    front = known.withColumn("old", F.lit(-1))
    while True:
        on = front.join(large(across), ["repo_id", "chain"]).where("place > old and place <= upto")
        new = on.groupBy("repo_id", *key, F.col("to_chain").alias("chain")).agg(F.max("to_place").alias("upto"))
        front = new.join(large(known.withColumnRenamed("upto", "old")), at, "left").withColumn("old", F.coalesce("old", F.lit(-1))).where("upto > old")
        front = cut(front.select(*at, "upto", "old"))
        if not front.limit(1).count():
            return known
        known = cut(known.union(front.select(*at, "upto")).groupBy(*at).agg(F.max("upto").alias("upto")))


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(repo_id, node): everything that leads to the seeds, with them."""
    nodes, across = chains(edges)
    start = seeds.select("repo_id", F.col("seed").alias("node")).distinct()
    upto = covered(across, start.join(large(nodes), ["repo_id", "node"]).select("repo_id", "chain", F.col("place").alias("upto")), [])
    return nodes.join(large(upto), ["repo_id", "chain"]).where("place <= upto").select("repo_id", "node").union(start).distinct()


def _from_roots(commits: DataFrame, edges: DataFrame, longest: bool) -> DataFrame:
    start = roots(commits, edges).select("repo_id", F.col("changeset_id").alias("node"), F.lit(0).alias("depth")).distinct()
    return _best_ways(edges.select("repo_id", F.col("child").alias("node"), F.col("parent").alias("prev")), start, ["repo_id", "node"], longest)


def levels(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node, level): length of the longest way from a root, so parents come before children."""
    return _from_roots(commits, edges, True).withColumnRenamed("depth", "level")


def breadth_first(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, node, depth): least number of edges from a root."""
    return _from_roots(commits, edges, False)


def topological_order(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, changeset_id, cs_ord) of changesets with a date: parents before children, then by date and id, from 0 without gaps.

    Parents that are no changesets (of a shallow dump) do not count. Numbers are those of all earlier levels plus the place
    within the level, so no task sorts a whole history.
    """
    ids = sets.select("repo_id", F.col("changeset_id").alias("parent"))
    edges = cut(edges.select("repo_id", "child", "parent").distinct().join(large(ids), ["repo_id", "parent"], "left_semi"))
    rows = sets.select("repo_id", "changeset_id", "date").join(large(levels(sets, edges).withColumnRenamed("node", "changeset_id")), ["repo_id", "changeset_id"])
    rows = cut(rows)
    sizes = rows.groupBy("repo_id", "level").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("repo_id").orderBy("level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("repo_id", "level", earlier.alias("before"))
    place = F.row_number().over(W.partitionBy("repo_id", "level").orderBy("date", "changeset_id"))
    return rows.withColumn("place", place).join(sizes, ["repo_id", "level"]).select("repo_id", "changeset_id", (F.col("before") + F.col("place") - 1).alias("cs_ord"))


def common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo_id, a, b, ancestor): the nearest shared ancestor: least sum of distances, then the smaller id. Pairs without one are left out.

    Where the ways from a and b first meet is a, b, or a commit with several children, so runs of other commits with one parent are
    contracted. Both sides then go back round by round, and a side stops where it is farther away than the best
    sum found so far: what is held for a pair is its surroundings up to there, not all ancestors.
    """
    one = edges.select("repo_id", "child", "parent").distinct()
    pairs = cut(pairs.select("repo_id", "a", "b").distinct())
    ends = pairs.select("repo_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    forks = one.groupBy("repo_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("repo_id", "node")
    single = one.groupBy("repo_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.min("parent").alias("to")).where("k = 1")
    inner = single.join(large(forks.union(ends)), ["repo_id", "node"], "left_anti").select("repo_id", "node", "to", F.lit(1).alias("steps"))
    runs = ranked(inner)
    over = runs.select("repo_id", F.col("node").alias("parent"), "to", "steps")
    arcs = one.join(large(runs.select("repo_id", F.col("node").alias("child"))), ["repo_id", "child"], "left_anti").join(large(over), ["repo_id", "parent"], "left")
    arcs = cut(arcs.groupBy("repo_id", F.col("child").alias("node"), F.coalesce("to", "parent").alias("next")).agg((F.min(F.coalesce("steps", F.lit(0))) + 1).alias("steps")))

    pair, key = ["repo_id", "a", "b"], ["repo_id", "a", "b", "side", "node"]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node"))))
    known = cut(pairs.select(*pair, sides.alias("s")).select(*pair, "s.side", "s.node", F.lit(0).alias("depth")))
    front = known
    while True:
        met = known.groupBy(*pair, "node").agg(F.count(F.lit(1)).alias("k"), F.sum("depth").alias("sum")).where("k = 2")
        best = cut(met.groupBy(*pair).agg(F.min(F.struct("sum", "node")).alias("best")))
        step = front.join(large(arcs), ["repo_id", "node"]).withColumn("node", F.col("next")).withColumn("depth", F.col("depth") + F.col("steps"))
        new = step.groupBy(*key).agg(F.min("depth").alias("depth")).join(large(best), pair, "left").where("best is null or depth <= best.sum").drop("best")
        front = cut(new.join(large(known.withColumnRenamed("depth", "old")), key, "left").where("old is null or depth < old").select(*key, "depth"))
        if not front.limit(1).count():
            return best.select(*pair, F.col("best.node").alias("ancestor"))
        known = cut(known.union(front).groupBy(*key).agg(F.min("depth").alias("depth")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(repo_id, node, parents, children): counts."""
    up = edges.groupBy("repo_id", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("parents"))
    down = edges.groupBy("repo_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return up.join(down, ["repo_id", "node"], "full").select("repo_id", "node", F.coalesce("parents", F.lit(0)).alias("parents"), F.coalesce("children", F.lit(0)).alias("children"))


def classified(diff: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, commit, path, origin) of paths that differ from parents (repo_id, commit, parent_idx, path).

    ``commit``: differs from every parent, so the commit changed it; ``merged``: differs from the first parent only in part of all.
    """
    n = edges.groupBy("repo_id", F.col("child").alias("commit")).agg(F.countDistinct("parent_idx").alias("n"))
    seen = diff.groupBy("repo_id", "commit", "path").agg(F.countDistinct("parent_idx").alias("k"), F.max(F.col("parent_idx") == 0).alias("first"))
    origin = F.when(F.col("k") == F.col("n"), "commit").when(F.col("first"), "merged")
    return seen.join(n, ["repo_id", "commit"]).withColumn("origin", origin).where(F.col("origin").isNotNull()).select("repo_id", "commit", "path", "origin")


def own_changes(diff: DataFrame, edges: DataFrame) -> DataFrame:
    """Change items (repo_id, changeset_id, item_idx, kind, server_path, from_server_path) of what a commit itself changed.

    ``diff`` holds each commit's tree against that of each parent (repo_id, commit, parent_idx, status, path, from_path); a root has one
    diff, against nothing. What differs from the first parent only came in by a merge and belongs to the commits of the merged branch.
    """
    once = diff.select("repo_id", "commit", "parent_idx", "path").distinct()
    own = classified(once, edges).where("origin = 'commit'").select("repo_id", "commit", "path")
    first = once.join(edges.select("repo_id", F.col("child").alias("commit")), ["repo_id", "commit"], "left_anti").select("repo_id", "commit", "path")
    rows = diff.where("parent_idx = 0").join(own.union(first), ["repo_id", "commit", "path"], "left_semi")
    place = W.partitionBy("repo_id", "commit").orderBy("path", "status")
    return rows.select(
        "repo_id", F.col("commit").alias("changeset_id"), (F.row_number().over(place) - 1).alias("item_idx"),
        kind_of_tree_diff(F.col("status")).alias("kind"), F.col("path").alias("server_path"), F.col("from_path").alias("from_server_path"),
    )
