import math
import random

import pytest
from pyspark.sql import functions as F

from commitlens.operators import coupling, graph, identity, knowledge, linemetrics, summary, teams, tree
from commitlens.schemas import ADD, DELETE, EDIT, RENAME


@pytest.mark.parametrize(("work", "value"), [({"A": 100}, 0), ({"A": 100, "B": 100}, 0.5), ({"A": 100, "B": 50}, 0.44), ({"A": 1, "B": 1, "C": 1}, 0.67), ({"A": 100, "B": 50, "C": 50}, 0.625), ({"A": 100, "B": 1, "C": 1, "D": 1}, 0.057), ({"A": 100, "B": 50, "C": 1, "D": 1}, 0.46)])
def test_fractal_value(spark, work, value):
    df = spark.createDataFrame([("r", "f", d, n) for d, n in work.items()], "repo_id string, path_key string, developer string, lines long")
    row = knowledge.ownership(df).collect()[0]
    assert math.isclose(row["fractal_value"], value, abs_tol=0.006)
    assert row["main_dev"] == "A"


def test_alias_roll_up(spark):
    work = spark.createDataFrame([("r", "1", "DA", 10), ("r", "1", "DB", 20), ("r", "2", "DA", 10), ("r", "2", "DC", 20)], "repo_id string, path_key string, developer string, lines long")
    alias = spark.createDataFrame([("DA", "MA"), ("DB", "MA"), ("DC", "MC")], "name string, alias string")
    assert {tuple(r)[1:] for r in knowledge.by_alias(work, alias).collect()} == {("1", "MA", 30), ("2", "MA", 10), ("2", "MC", 20)}


def history(spark, script):
    """script: changesets newest first, each a list of (kind, path, from)."""
    n = len(script)
    sets = spark.createDataFrame([("r", str(n - i), n - i) for i in range(n)], "repo_id string, changeset_id string, cs_ord long")
    items = [("r", str(n - i), k, *change) for i, changes in enumerate(script) for k, change in enumerate(changes)]
    return spark.createDataFrame(items, "repo_id string, changeset_id string, item_idx int, kind int, server_path string, from_server_path string"), sets


def ids(spark, script):
    items, sets = history(spark, script)
    out, warnings = identity.with_identity(items, sets)
    return {(int(r["changeset_id"]), r["server_path"], r["kind"]): r["file_id"] for r in out.collect()}, warnings.count()


def test_location_reused(spark):
    got, _ = ids(spark, [[(ADD, "x", None)], [(DELETE, "x", None)], [(EDIT, "x", None)]])
    assert got[3, "x", ADD] != got[2, "x", DELETE] == got[1, "x", EDIT]


def test_cyclic_rename(spark):
    got, _ = ids(spark, [[(RENAME, "now", "then")], [(RENAME, "then", "now")], [(RENAME, "now", "then")]])
    assert len(set(got.values())) == 1


def test_rename_of_a_source_edited_later_is_an_add(spark):
    got, warned = ids(spark, [[(EDIT, "f", None)], [(RENAME, "g", "f")]])
    assert (1, "g", ADD) in got and got[1, "g", ADD] != got[2, "f", EDIT] and warned == 1


def test_add_and_delete_are_a_move(spark):
    got, _ = ids(spark, [[(ADD, "new", "old"), (DELETE, "old", None)], [(EDIT, "old", None)]])
    assert got[2, "new", RENAME] == got[1, "old", EDIT] and len(got) == 2


def replay(script):
    """The sequential rules, for comparison: group number of each remaining item, newest changeset first."""
    at, number, out = {}, 0, []
    for c, changes in enumerate(script):
        items = [dict(kind=k, path=p, source=f) for k, p, f in changes]
        edits = {i["path"] for i in items if i["kind"] == EDIT}
        for i in items:
            if i["kind"] == RENAME and i["source"] in edits:
                i["kind"] = ADD
        copies = [i for i in items if i["source"] is not None and i["kind"] in (ADD, RENAME)]
        for i in copies:
            if sum(j["source"] == i["source"] for j in copies) > 1:
                i["kind"] = ADD
        adds = [i for i in items if i["kind"] == ADD and i["source"] is not None]
        gone = []
        moves = []
        for i in adds:
            deletes = [d for d in items if d["kind"] == DELETE and d["path"] == i["source"]]
            if sum(j["source"] == i["source"] for j in adds) == 1 and len(deletes) == 1:
                moves.append(i)
                gone.append(deletes[0])
        for i in moves:
            i["kind"] = RENAME
        for i in items:
            if any(i is g for g in gone):
                continue
            if i["kind"] == DELETE:
                at.pop(i["path"], None)
            if i["path"] not in at:
                number += 1
                at[i["path"]] = number
            me = at[i["path"]]
            if i["kind"] in (ADD, RENAME):
                del at[i["path"]]
            if i["kind"] == RENAME:
                if i["source"] in at:
                    i["kind"] = ADD
                else:
                    at[i["source"]] = me
            out.append((len(script) - c, i["path"], i["kind"], me))
    return out


def test_identity_equals_sequential_replay(spark):
    rng = random.Random(4)
    for _ in range(4):
        script = []
        for _ in range(25):
            paths = rng.sample("abcdef", rng.randint(1, 4))
            script.append([(k := rng.choice([ADD, EDIT, DELETE, RENAME]), p, rng.choice("abcdef") if k == RENAME or (k == ADD and rng.random() < 0.5) else None) for p in paths])
        script = [[(k, p, f if f != p else None) if k != RENAME or f != p else (EDIT, p, None) for k, p, f in c] for c in script]
        expected = replay(script)
        items, sets = history(spark, script)
        got = {(int(r["changeset_id"]), r["server_path"], r["kind"]): r["file_id"] for r in identity.with_identity(items, sets)[0].collect()}
        assert set(got) == {e[:3] for e in expected}
        pairs = {(got[e[:3]], e[3]) for e in expected}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_renamed_file_is_one_artifact(spark):
    sets = spark.createDataFrame([("r", "1", "A", "2020-01-01", []), ("r", "2", "B", "2020-01-02", [])], "repo_id string, changeset_id string, committer string, date string, work_items array<string>")
    items = spark.createDataFrame([("r", "2", 0, RENAME, "New.cs", "id"), ("r", "1", 0, EDIT, "Old.cs", "id")], "repo_id string, changeset_id string, item_idx int, kind int, server_path string, file_id string")
    row = summary.artifacts(items, sets.withColumn("date", F.to_timestamp("date"))).collect()
    assert [(r["server_path"], r["commits"], r["committers"]) for r in row] == [("New.cs", 2, 2)]


EDGES = {"n1": ["n0"], "n2": ["n1"], "n3": ["n1"], "n4": ["n2"], "n5": ["n3"], "n6": ["n4", "n5"], "n7": ["n6"], "n8": ["n4"], "n9": ["n7", "n8"]}


def test_graph(spark):
    commits = spark.createDataFrame([("r", f"n{i}", " ".join(EDGES.get(f"n{i}", []))) for i in range(10)], "repo_id string, changeset_id string, parents string")
    edges = graph.edges_of(commits)
    assert {r["changeset_id"] for r in graph.roots(commits, edges).collect()} == {"n0"}
    seeds = spark.createDataFrame([("r", "n8")], "repo_id string, seed string")
    assert {r["node"] for r in graph.ancestors(edges, seeds).collect()} == {"n8", "n4", "n2", "n1", "n0"}
    level = {r["node"]: r["level"] for r in graph.levels(commits, edges).collect()}
    assert all(level[c] > level[p] for c, ps in EDGES.items() for p in ps)
    pairs = spark.createDataFrame([("r", "n9", "n8"), ("r", "n5", "n4"), ("r", "n3", "n1")], "repo_id string, a string, b string")
    assert {(r["a"], r["b"]): r["ancestor"] for r in graph.common_ancestors(edges, pairs).collect()} == {("n9", "n8"): "n8", ("n5", "n4"): "n1", ("n3", "n1"): "n1"}


def test_items_of_a_merge(spark):
    edges = spark.createDataFrame([("r", "2", "1", 0), ("r", "3", "1", 0), ("r", "4", "2", 0), ("r", "4", "3", 1)], "repo_id string, child string, parent string, parent_idx int")
    rows = [("1", 0, "Added", "f"), ("2", 0, "Modified", "f"), ("3", 0, "Added", "g"), ("4", 0, "Added", "g"), ("4", 0, "Modified", "f"), ("4", 1, "Modified", "f")]
    diff = spark.createDataFrame([("r", c, k, s, p, None) for c, k, s, p in rows], "repo_id string, commit string, parent_idx int, status string, path string, from_path string")
    items = graph.own_changes(diff, edges)
    assert sorted((r["changeset_id"], r["kind"], r["server_path"]) for r in items.collect()) == [("1", ADD, "f"), ("2", EDIT, "f"), ("3", ADD, "g"), ("4", EDIT, "f")]
    sets = spark.createDataFrame([("r", str(i), i) for i in range(1, 5)], "repo_id string, changeset_id string, cs_ord long")
    ids = {(r["changeset_id"], r["server_path"]): r["file_id"] for r in identity.with_identity(items, sets)[0].collect()}
    assert ids["1", "f"] == ids["2", "f"] == ids["4", "f"] != ids["3", "g"] and len(ids) == 4


def test_shared_history_is_cut(spark):
    edges = spark.createDataFrame([("r", "2", "1", 0)], "repo_id string, child string, parent string, parent_idx int")
    items = spark.createDataFrame([("r", c, k, "p", f) for c in ("1", "2") for k, f in enumerate(("a", "b"))], "repo_id string, changeset_id string, item_idx int, server_path string, file_id string")
    assert identity.without_shared_history(items, summary.shared_paths(items), edges).count() == 0


def test_tree(spark):
    files = spark.createDataFrame([("r", "a/b/x.c", 3.0, 1.0), ("r", "a/b/y.c", 5.0, 3.0), ("r", "a/b/d/z.c", 0.0, 9.0)], "repo_id string, server_path string, area double, weight double")
    t = tree.build(files, F.col("area"), F.col("weight"))
    rows = {r["path"]: r for r in t.collect()}
    assert set(rows) == {"", "a", "a/b", "a/b/x.c", "a/b/y.c"}  # the empty branch is gone
    assert rows["a"]["area"] == 8 and rows["a/b/y.c"]["sibling_rank"] == 1 and rows["a/b/y.c"]["weight_norm"] == 1
    assert {r["path"] for r in tree.shrunk(t).collect()} == {"a/b", "a/b/x.c", "a/b/y.c"}
    assert {r["path"] for r in tree.filtered(t, F.col("area") < 4).collect()} == {"", "a", "a/b", "a/b/x.c"}


def test_lines(spark):
    code = "// c\nint a; /* open\n still\n*/ int b;\n\n\tx\n"
    df = spark.createDataFrame([("f", code)], "path string, content string")
    row = linemetrics.count_lines(df, ["path"], F.lit("C#")).collect()[0]
    assert (row["blanks"], row["comments"], row["code"]) == (1, 2, 3)
    space = linemetrics.inverted_space(df, ["path"]).collect()[0]
    assert (space["space_min"], space["space_max"], space["space_total"]) == (0, 1, 1)
    empty = linemetrics.inverted_space(spark.createDataFrame([("f", "")], "path string, content string"), ["path"]).collect()[0]
    assert empty["space_mean"] is None


def test_coupling_and_size_limit(spark):
    items = spark.createDataFrame([("r", c, f) for c, fs in {"1": "ab", "2": "ab", "3": "abc", "4": "abcdef"}.items() for f in fs], "repo_id string, changeset_id string, file_id string")
    got = {(r["item1"], r["item2"]): (r["couplings"], r["degree"]) for r in coupling.file_coupling(items, most=3, min_couplings=1, min_degree=1.0).collect()}
    assert got == {("a", "b"): (2, 50.0)}
    assert coupling.file_coupling(items, most=3, min_couplings=3, min_degree=100.0, count_first=True).count() == 1


def test_team_by_date(spark):
    sets = spark.createDataFrame([("r", "1", "A", "2020-01-01"), ("r", "2", "A", "2021-01-01"), ("r", "3", "Z", "2021-01-01")], "repo_id string, changeset_id string, committer string, date string")
    t = spark.createDataFrame([("A", "x", None, "2020-06-01"), ("A", "y", "2020-06-01", None)], "developer string, team string, valid_from string, valid_to string")
    got = {r["changeset_id"]: r["team"] for r in teams.with_team(sets, t).collect()}
    assert got == {"1": "x", "2": "y", "3": teams.NOT_CLASSIFIED}


@pytest.mark.parametrize(("name", "mark"), [("s3_svn_log", "<logentry "), ("s4_history_json", '"Committer":')])
def test_written_histories_hold_a_bounded_number_of_changesets(spark, monkeypatch, name, mark):
    from commitlens import queries

    paths, out = [], queries._out
    monkeypatch.setattr(queries, "_out", lambda t, n: paths.append(out(t, n)) or paths[-1])
    queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    held = [r["value"].count(mark) for r in spark.read.text(paths[0], wholetext=True).collect()]
    written = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_orderkey").distinct().count()
    assert sum(held) == written and max(held) <= 1000


@pytest.mark.parametrize("crowd", [1, 4, 1000])
def test_paths_of_many_events_are_counted_in_blocks(spark, crowd):
    """Few paths in many changesets, so lifetimes go on over the blocks of a path."""
    rng = random.Random(9)
    script = []
    for _ in range(60):
        paths = rng.sample("abcd", rng.randint(1, 3))
        change = lambda p: (RENAME, p, rng.choice([x for x in "abcd" if x != p])) if rng.random() < 0.25 else (rng.choice([ADD, EDIT, EDIT, EDIT, DELETE]), p, None)
        script.append([change(p) for p in paths])
    expected = replay(script)
    items, sets = history(spark, script)
    got = {(int(r["changeset_id"]), r["server_path"], r["kind"]): r["file_id"] for r in identity.with_identity(items, sets, crowd)[0].collect()}
    assert set(got) == {e[:3] for e in expected}
    pairs = {(got[e[:3]], e[3]) for e in expected}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_identity_queries_share_seven_paths_over_the_whole_history(spark):
    from commitlens.queries import ORACLES, QUERIES

    rows = QUERIES["i4_identity"](spark, "/root/testdata/sf0.001").select("server_path").distinct().collect()
    assert {r["server_path"] for r in rows} == {f"d/{k}" for k in range(7)}
    assert all("// 1000" not in ORACLES[q] for q in ("i4_identity", "k9_warnings", "a18_resets"))


def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    rows = [("r", f"c{k // 40}", k % 60) for k in range(4000)]
    items = spark.createDataFrame(rows, "repo_id string, changeset_id string, file_id int")
    one = {tuple(r) for r in coupling.pairs(items, "file_id").collect()}
    monkeypatch.setattr(coupling, "PAIRS_PER_TASK", 2000)
    many = coupling.pairs(items, "file_id")
    assert "REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in many.collect()} == one and len(one) > 100
    assert coupling.pairs(items.where("false"), "file_id").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_ids_of_tracked_and_of_undeleted_files(spark, seed):
    """As taking all ids first and then asking for their latest paths, or for their deletes."""
    rng = random.Random(seed)
    script = []
    for _ in range(50):
        paths = rng.sample("abcdefgh", rng.randint(1, 3))
        change = lambda p: (RENAME, p, rng.choice([x for x in "abcdefgh" if x != p])) if rng.random() < 0.3 else (rng.choice([ADD, EDIT, EDIT, EDIT, DELETE]), p, None)
        script.append([change(p) for p in paths])
    items, sets = history(spark, script)
    every = identity.with_identity(items, sets)[0].cache()
    rows = lambda df: sorted(str([r[c] for c in every.columns]) for r in df.collect())
    tracked = spark.createDataFrame([("r", p) for p in "abcx"], "repo_id string, server_path string")
    alive = summary.existing(summary.latest_paths(every, sets, by="cs_ord"), tracked).select("repo_id", "file_id")
    want = rows(summary.keep_alive(every, alive))
    assert want and rows(identity.with_identity(items, sets, tracked=tracked)[0]) == want
    assert rows(identity.with_identity(items, sets, deleted=False)[0]) == rows(summary.drop_deleted(every))


def test_a_written_table_is_computed_once(spark, tmp_path):
    from commitlens.sources import files

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("r", k) for k in range(9)], "repo_id string, k int").mapInArrow(count, "repo_id string, k int")
    files.write_table(df, str(tmp_path / "t"), "r")
    assert seen.value == 9 and spark.read.parquet(str(tmp_path / "t")).count() == 9


def test_work_items_of_a_changeset_count_once_before_they_are_dealt(spark):
    items = spark.createDataFrame([("r", "c", 0, "f", "p", EDIT)], "repo_id string, changeset_id string, item_idx int, file_id string, server_path string, kind int")
    sets = spark.createDataFrame([("r", "c", "Ann", "2020-01-01", ["T-1"] * 150 + ["T-2"])], "repo_id string, changeset_id string, committer string, date string, work_items array<string>")
    found = summary.artifacts(items, sets)
    assert found.first()["work_items"] == 2
    made = sets.withColumn("work_items", F.expr("transform(work_items, x -> upper(x))"))
    assert "upper" not in summary.artifacts(items, made)._jdf.queryExecution().optimizedPlan().toString()
    assert summary.artifacts(items, sets, max_work_items=151).count() == 0


@pytest.mark.parametrize("name", ["s3_svn_log", "s4_history_json", "s1_git_log_items"])
def test_dumps_are_written_compressed(spark, monkeypatch, name):
    from commitlens import queries

    paths, out = [], queries._out
    monkeypatch.setattr(queries, "_out", lambda t, n: paths.append(out(t, n)) or paths[-1])
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert all(r[0].endswith(".gz") for r in spark.read.option("recursiveFileLookup", True).text(paths[0]).select("_metadata.file_path").distinct().collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == (1 if name == "s4_history_json" else 0)


def test_a_summary_shuffles_names_without_paths(spark, monkeypatch):
    """Committers and work items of a file meet apart from its paths, contributions once by path, and files are written before their ranges."""
    from commitlens.plans import analyses

    sets = spark.createDataFrame([("r", k, None if k == 3 else f"c{k % 2}", None if k == 4 else ["w", "w", None, f"w{k}"]) for k in range(6)], "repo_id string, changeset_id long, committer string, work_items array<string>").selectExpr("*", "timestamp '2000-01-01 00:00:00' as date")
    items = spark.createDataFrame([("r", k, k % 3, f, 4, f"p{f}_{k}") for k in range(6) for f in (1, 2) if f == 1 or k == 3], "repo_id string, changeset_id long, item_idx int, file_id long, kind int, server_path string")
    found = {r["file_id"]: (r["commits"], r["committers"], r["work_items"], r["server_path"]) for r in summary.artifacts(items, sets.where("work_items is not null")).collect()}
    assert found == {1: (5, 2, 6, "p1_5"), 2: (1, 0, 2, "p2_3")}

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    work = spark.createDataFrame([("r", "p", "d", 1)], "repo_id string, path_key string, developer string, lines long")
    assert plan(knowledge.ownership(knowledge.by_alias(work, None))).count("Exchange hashpartitioning") == 1
    assert not [line for line in plan(summary.artifacts(items, sets)).split("\n") if "Aggregate(" in line and "server_path" in line and "committer" in line]
    written, plain = [], summary.cut
    monkeypatch.setattr(analyses, "cut", lambda df: written.append(df) or plain(df))
    loc = spark.createDataFrame([("r", "p1_5", 3)], "repo_id string, path_key string, code int")
    out = analyses.summary(items, sets, loc, F.expr("timestamp '2001-01-01 00:00:00'"), work)
    assert len(written) == 1 and "LocalTableScan" not in plan(out.select("hotspot")) and out.count() == 2
