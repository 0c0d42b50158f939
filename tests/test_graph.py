"""The commit graph against plain versions: small random graphs, deep histories, bad input."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commitlens.operators import graph, identity

EDGES = "repo_id string, child long, parent long, parent_idx int"


def random_graph(seed, n=60, roots=2):
    """child -> parents; merges of two or three, long runs between, one repeated edge."""
    rng = random.Random(seed)
    parents = {}
    for v in range(n):
        k = 0 if v < roots else rng.choice([1, 1, 1, 1, 2, 2, 3])
        near = list(range(max(0, v - rng.choice([1, 3, 12])), v)) or [0]
        parents[v] = list(dict.fromkeys(rng.choice(near) for _ in range(k)))
    return parents


def edges_of(spark, graphs):
    return spark.createDataFrame([(r, c, p, i) for r, g in graphs.items() for c, ps in g.items() for i, p in enumerate(ps)], EDGES)


def plain_distances(parents, seed, longest=False):
    best = {seed: 0}
    todo = [seed]
    while todo:
        v = todo.pop()
        for p in parents.get(v, []):
            d = best[v] + 1
            if p not in best or (d > best[p] if longest else d < best[p]):
                best[p] = d
                todo.append(p)
    return best


@pytest.fixture(scope="module")
def graphs():
    return {"a": random_graph(1), "b": random_graph(2, 40, 1), "c": {v: [v - 1] if v else [] for v in range(30)}}


@pytest.fixture(scope="module")
def edges(spark, graphs):
    return edges_of(spark, graphs).cache()


def commits(spark, graphs):
    return spark.createDataFrame([(r, c) for r, g in graphs.items() for c in g], "repo_id string, changeset_id long")


@pytest.mark.parametrize("longest", [False, True])
def test_distances(spark, graphs, edges, longest):
    seeds = [(r, s) for r, g in graphs.items() for s in list(g)[-1::-9]]
    df = spark.createDataFrame(seeds, "repo_id string, seed long")
    got = {tuple(r) for r in graph.distances(edges, df, longest).select("repo_id", "seed", "node", "depth").collect()}
    each = {(r, s): plain_distances(graphs[r], s, longest) for r, s in seeds}
    assert got == {(r, s, v, d) for (r, s), found in each.items() for v, d in found.items()}
    best = {}
    for (r, _), found in each.items():
        for v, d in found.items():
            best[r, v] = max(best.get((r, v), d), d) if longest else min(best.get((r, v), d), d)
    assert {(r, v): d for r, v, d in map(tuple, graph.reached(edges, df, longest).select("repo_id", "node", "depth").collect())} == best
    assert {tuple(r) for r in graph.ancestors(edges, df).select("repo_id", "node").collect()} == set(best)


def test_levels_and_depths(spark, graphs, edges):
    for longest in (True, False):
        want = {}
        for r, g in graphs.items():
            for v in g:  # parents have smaller numbers
                want[r, v] = 1 + (max if longest else min)(want[r, p] for p in g[v]) if g[v] else 0
        f = graph.levels if longest else graph.breadth_first
        got = {(x["repo_id"], x["node"]): x["level" if longest else "depth"] for x in f(commits(spark, graphs), edges).collect()}
        assert got == want


def test_common_ancestors(spark, graphs, edges):
    rng = random.Random(5)
    pairs = sorted({(r, rng.choice(list(g)), rng.choice(list(g))) for r, g in graphs.items() for _ in range(60)})
    got = {tuple(x)[:3]: x["ancestor"] for x in graph.common_ancestors(edges, spark.createDataFrame(pairs, "repo_id string, a long, b long")).select("repo_id", "a", "b", "ancestor").collect()}
    want = {}
    for r, a, b in pairs:
        x, y = plain_distances(graphs[r], a), plain_distances(graphs[r], b)
        if both := x.keys() & y.keys():
            want[r, a, b] = min(both, key=lambda v: (x[v] + y[v], v))
    assert got == want and len(want) > 100


def test_shared_history(spark, graphs, edges):
    rng = random.Random(6)
    items = sorted({(r, c, rng.choice("xyz")) for r, g in graphs.items() for c in g for _ in range(2)})
    seeds = [x for x in items if rng.random() < 0.05] + [("a", 999, "x")]
    df = spark.createDataFrame(items, "repo_id string, changeset_id long, file_id string")
    out = identity.without_shared_history(df, spark.createDataFrame(seeds, df.schema), edges)
    gone = {(r, v, f) for r, c, f in seeds for v in plain_distances(graphs[r], c)}
    assert {tuple(x) for x in out.select("repo_id", "changeset_id", "file_id").collect()} == set(items) - gone


def test_empty_graph(spark, edges):
    none = edges.where("false")
    alone = spark.createDataFrame([("a", 1), ("a", 2)], "repo_id string, changeset_id long")
    assert {tuple(r) for r in graph.levels(alone, none).select("node", "level").collect()} == {(1, 0), (2, 0)}
    seeds = alone.withColumnRenamed("changeset_id", "seed")
    assert {r["node"] for r in graph.ancestors(none, seeds).collect()} == {1, 2}
    assert graph.common_ancestors(none, spark.createDataFrame([("a", 1, 1), ("a", 1, 2)], "repo_id string, a long, b long")).select("a", "b", "ancestor").collect() == [(1, 1, 1)]


def test_cycles_are_errors(spark):
    ring = spark.createDataFrame([("r", v, (v + 1) % 5, 0) for v in range(5)], EDGES)
    with pytest.raises(ValueError, match="cycle"):
        graph.distances(ring, spark.createDataFrame([("r", 9)], "repo_id string, seed long"))
    knot = spark.createDataFrame([("r", 9, 1, 0), ("r", 1, 2, 0), ("r", 2, 1, 0), ("r", 9, 2, 1)], EDGES)
    with pytest.raises(ValueError, match="cycle"):
        graph.distances(knot, spark.createDataFrame([("r", 9)], "repo_id string, seed long"), longest=True)


def counting(monkeypatch):
    """Written tables, which is what a round costs."""
    n, plain = [0], graph.cut

    def cut(df):
        n[0] += 1
        return plain(df)

    monkeypatch.setattr(graph, "cut", cut)
    return n


def deep(spark, n, every):
    """A line of n commits, each ``every``-th of which merges a branch that left the line some commits before."""
    line = spark.range(1, n).select(F.lit("r").alias("repo_id"), F.col("id").alias("child"), (F.col("id") - 1).alias("parent"), F.lit(0).alias("parent_idx"))
    merge = spark.range(1, n // every).select((F.col("id") * every).alias("m"))
    side = merge.select(F.lit("r").alias("repo_id"), F.explode(F.array(F.struct(F.col("m").alias("c"), (-F.col("m")).alias("p"), F.lit(1).alias("i")), F.struct((-F.col("m")).alias("c"), (F.col("m") - every // 2).alias("p"), F.lit(0).alias("i")))).alias("e"))
    return line.union(side.select("repo_id", "e.c", "e.p", "e.i"))


def test_rounds_of_a_deep_history(spark, monkeypatch):
    n = 100_000
    edges = deep(spark, n, 100).cache()
    ids = edges.select("repo_id", F.explode(F.array("child", "parent")).alias("changeset_id")).distinct()
    rounds = counting(monkeypatch)
    level = {r["node"]: r["level"] for r in graph.levels(ids, edges).where("node >= 0").collect()}
    assert rounds[0] < 40
    assert all(level[v] == v for v in range(n))
    rounds[0] = 0
    reach = graph.ancestors(edges, spark.createDataFrame([("r", n - 1)], "repo_id string, seed long"))
    assert reach.count() == ids.count() and rounds[0] < 120
    rounds[0] = 0
    pairs = spark.range(1, 2000).select(F.lit("r").alias("repo_id"), (F.col("id") * 50).alias("a"), (F.col("id") * 50 - 40).alias("b"))
    met = graph.common_ancestors(edges, pairs)
    # a merge is two steps from where its branch left the line, fifty commits before
    assert met.where("ancestor <> if(a % 100 = 0, a - 50, b)").count() == 0 and met.count() == 1999 and rounds[0] < 60


def test_rounds_of_interleaved_branches(spark, monkeypatch):
    """Merges that do not fold up: two lines that merge each other all the time."""
    n = 2000
    pairs = [(2 * k + s, 2 * (k - 1) + (s if i == 0 else 1 - s), i) for k in range(1, n // 2) for s in (0, 1) for i in (0, 1)]
    edges = spark.createDataFrame([("r", *p) for p in pairs], EDGES)
    ids = spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").alias("changeset_id"))
    rounds = counting(monkeypatch)
    level = defaultdict(int, {r["node"]: r["level"] for r in graph.levels(ids, edges).collect()})
    assert all(level[v] == v // 2 for v in range(n)) and rounds[0] < 150


def test_topological_order(spark):
    """Dates that a rebase has left out of order, a parent outside of the dump, two repositories."""
    sets = [("a", "c1", "2020-01-05"), ("a", "c2", "2020-01-03"), ("a", "c3", "2020-01-04"), ("a", "c4", "2020-01-04"), ("b", "c1", "2020-01-01"), ("b", "c0", None)]
    df = spark.createDataFrame(sets, "repo_id string, changeset_id string, date string").withColumn("date", F.to_timestamp("date"))
    edges = spark.createDataFrame([("a", "c2", "c1", 0), ("a", "c3", "c2", 0), ("a", "c4", "c2", 0), ("a", "c1", "gone", 0), ("b", "c1", "gone", 0)], "repo_id string, child string, parent string, parent_idx int")
    got = {tuple(r) for r in graph.topological_order(df, edges).select("repo_id", "changeset_id", "cs_ord").collect()}
    assert got == {("a", "c1", 0), ("a", "c2", 1), ("a", "c3", 2), ("a", "c4", 3), ("b", "c0", 0), ("b", "c1", 1)}


@pytest.mark.parametrize("ids", [int, str])
def test_folding_over_several_tasks(spark, monkeypatch, ids):
    """Each task holds a few nodes, so runs, merges and chains go over the borders of tasks."""
    monkeypatch.setattr(graph, "FOLD", 12)
    g = {"a": random_graph(3, 50), "b": {v: [v - 1] if v else [] for v in range(40)}}
    name = "long" if ids is int else "string"
    edges = spark.createDataFrame([(r, ids(c), ids(p), i) for r, x in g.items() for c, ps in x.items() for i, p in enumerate(ps)], EDGES.replace("long", name))
    want = {}
    for r, x in g.items():
        for v in x:
            want[r, ids(v)] = 1 + max(want[r, ids(p)] for p in x[v]) if x[v] else 0
    every = spark.createDataFrame([(r, ids(v)) for r, x in g.items() for v in x], f"repo_id string, changeset_id {name}")
    assert {(x["repo_id"], x["node"]): x["level"] for x in graph.levels(every, edges).collect()} == want
    seeds = spark.createDataFrame([("a", ids(49)), ("b", ids(20))], f"repo_id string, seed {name}")
    reach = {(r, ids(v)) for r, s in (("a", 49), ("b", 20)) for v in plain_distances(g[r], s)}
    assert {tuple(x) for x in graph.ancestors(edges, seeds).collect()} == reach


def test_runs_side_by_side_are_not_ranked_in_rounds(spark, monkeypatch):
    """Of a long line dealt to several tasks only what crosses their borders is ranked by jumps."""
    monkeypatch.setattr(graph, "FOLD", 1000)
    seen, plain = [], graph._jumped
    monkeypatch.setattr(graph, "_jumped", lambda links: seen.append(links.count()) or plain(links))
    links = spark.range(1, 5000).select(F.lit("r").alias("repo_id"), F.col("id").alias("node"), (F.col("id") - 1).alias("to"), F.lit(1).alias("steps"))
    assert graph.ranked(links).where("to = 0 and steps = node").count() == 4999
    assert len(seen) == 1 and seen[0] < 20


def test_edges_within_a_chain_are_not_crossed(spark):
    edges = spark.createDataFrame([("r", v, v - 1, 0) for v in range(1, 40)] + [("r", v, v - 3, 1) for v in range(7, 40, 7)], EDGES)
    nodes, across = graph.chains(edges)
    assert nodes.select("chain").distinct().count() == 1 and across.count() == 0


def test_nothing_passes_through_the_driver(spark, graphs, edges, monkeypatch):
    """Written tables are compressed far more than Spark reckons, so a broadcast of one may be as large as the history."""
    plain, plans = graph.cut, []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(graph, "cut", cut)
    seeds = spark.createDataFrame([(r, s) for r, g in graphs.items() for s in list(g)[-1::-9]], "repo_id string, seed long")
    cut(graph.ancestors(edges, seeds))
    items = edges.select("repo_id", F.col("child").alias("changeset_id"), F.lit("x").alias("file_id"))
    cut(identity.without_shared_history(items, items.where("changeset_id % 7 = 0"), edges))
    assert len(plans) > 20 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
