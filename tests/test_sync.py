"""Log dumps to tables: line ends, several repositories, dates out of order, one log per file, histories in several documents."""

import json

import pytest
from pyspark.sql import functions as F

from commitlens.operators import coupling, teams
from commitlens.plans import sync
from commitlens.schemas import ADD, EDIT, RENAME
from commitlens.sources import files, logs


def commit(id_, date, parents, *lines, subject="work", end="\n"):
    return end.join(["START_HEADER", id_, "Ann", f"{date}T10:00:00+00:00", parents, subject, "END_HEADER", "", *lines, ""])


def dump(path, *commits, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(end.join(commits).encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_ends(spark, tmp_path, end):
    log = dump(tmp_path / "log", commit("c3", "2020-01-03", "c2", "M\ta.cs", "R100\ta.cs\tb.cs", end=end), commit("c2", "2020-01-02", "c1", "D\tx y.cs", subject="a START_HEADER in the subject", end=end), commit("c1", "2020-01-01", "", 'A\t"\\303\\251.cs"', end=end), end=end)
    sets, items, edges = logs.git_log(spark, log, "r")
    assert {(r["changeset_id"], r["committer"], r["comment"], str(r["date"])[:10]) for r in sets.collect()} == {("c3", "Ann", "work", "2020-01-03"), ("c2", "Ann", "a START_HEADER in the subject", "2020-01-02"), ("c1", "Ann", "work", "2020-01-01")}
    assert {tuple(r)[1:] for r in items.collect()} == {("c3", 0, 4, "a.cs", None), ("c3", 1, 16, "b.cs", "a.cs"), ("c2", 0, 32, "x y.cs", None), ("c1", 0, 2, "é.cs", None)}
    assert {tuple(r)[1:] for r in edges.collect()} == {("c3", "c2", 0), ("c2", "c1", 0)}
    plain = logs.git_log(spark, log, "r", mode="no_renames")[1].where("changeset_id = 'c3' and item_idx = 1").first()
    assert (plain["kind"], plain["from_server_path"]) == (ADD, None)


def test_sync_keeps_other_repositories_and_goes_by_the_graph(spark, tmp_path):
    out = str(tmp_path / "out")
    # add A, rename A to B, edit B; the rename is dated before the add
    rebased = dump(tmp_path / "a", commit("c3", "2020-01-03", "c2", "M\tB.cs"), commit("c2", "2019-01-01", "c1", "R100\tA.cs\tB.cs"), commit("c1", "2020-01-02", "", "A\tA.cs"))
    clean = dump(tmp_path / "b", commit("d1", "2020-01-01", "", "A\tz.cs"))
    tables = sync.sync_git(spark, clean, "001", out)
    assert tables["identity_warning"].count() == 0 and tables["commit_edge"].count() == 0
    tables = sync.sync_git(spark, rebased, "a/b c", out)
    assert len({r["file_id"] for r in tables["change_item"].collect()}) == 1
    assert {r["changeset_id"]: r["cs_ord"] for r in tables["change_set"].collect()} == {"c1": 0, "c2": 1, "c3": 2}
    whole = files.read_table(spark, f"{out}/change_item", tables["change_item"].schema)
    assert {(r["repo_id"], r["server_path"]) for r in whole.collect()} == {("001", "z.cs"), ("a/b c", "A.cs"), ("a/b c", "B.cs")}
    # rebuilt from a shorter history: old rows go, those of the other one stay
    sync.sync_git(spark, dump(tmp_path / "c", commit("c9", "2020-01-01", "")), "a/b c", out)
    assert {r["repo_id"] for r in files.read_table(spark, f"{out}/change_item", whole.schema).collect()} == {"001"}
    assert files.read_table(spark, f"{out}/change_set", tables["change_set"].schema, "a/b c").count() == 1


def test_contributions(spark):
    blame = spark.createDataFrame([("A.cs", " 12 Ann  x"), ("A.cs", " 13 Bob  x"), ("a.cs", " 1 Zoe  y"), ("empty.cs", ""), ("new.cs", " 1 Ann  z"), ("doc.txt", " 1 Ann  z")], "server_path string, line string")
    tracked = spark.createDataFrame([("r", p) for p in ("A.cs", "a.cs", "empty.cs", "doc.txt")], "repo_id string, server_path string")
    got = sync.contributions(blame, "r", tracked=tracked, accept=F.col("server_path").endswith(".cs"))
    assert {tuple(r) for r in got.collect()} == {("r", "a.cs", "Ann", 1), ("r", "a.cs", "Bob", 1)}


def test_file_by_file(spark, tmp_path):
    """Logs of each file give the history of the whole dump, without what two files share."""
    full = dump(
        tmp_path / "full",
        commit("c5", "2020-01-05", "c4", "M\tb.cs", "M\td.cs"),
        commit("c4", "2020-01-04", "c3", "C100\tb.cs\td.cs"),
        commit("c3", "2020-01-03", "c2", "R100\ta.cs\tb.cs"),
        commit("c2", "2020-01-02", "c1", "M\ta.cs", "D\tgone.cs"),
        commit("c1", "2020-01-01", "", "A\ta.cs", "A\tgone.cs"),
    )
    follow = tmp_path / "logs"
    dump(follow / "b.cs.log", commit("c5", "2020-01-05", "c3", "M\tb.cs"), commit("c3", "2020-01-03", "c2", "R100\ta.cs\tb.cs"), commit("c2", "2020-01-02", "c1", "M\ta.cs"), commit("c1", "2020-01-01", "", "A\ta.cs"))
    dump(follow / "d.cs.log", commit("c5", "2020-01-05", "c4", "M\td.cs"), commit("c4", "2020-01-04", "c3", "C100\tb.cs\td.cs"), commit("c3", "2020-01-03", "c2", "R100\ta.cs\tb.cs"))
    dump(follow / "src%2Fgone.cs.log", commit("c2", "2020-01-02", "c1", "D\tgone.cs"), commit("c1", "2020-01-01", "", "A\tgone.cs"))
    tables = sync.sync_git_by_file(spark, str(follow), full, "r", str(tmp_path / "out"))
    got = {(r["changeset_id"], r["item_idx"], r["file_id"], r["kind"], r["server_path"]) for r in tables["change_item"].collect()}
    assert got == {("c5", 0, "b.cs", EDIT, "b.cs"), ("c5", 1, "d.cs", EDIT, "d.cs"), ("c4", 0, "d.cs", ADD, "d.cs"), ("c3", 0, "b.cs", RENAME, "b.cs"), ("c2", 0, "b.cs", EDIT, "a.cs"), ("c1", 0, "b.cs", ADD, "a.cs")}
    assert {r["changeset_id"]: r["cs_ord"] for r in tables["change_set"].collect()} == {f"c{k}": k - 1 for k in range(1, 6)}
    # two files with one path in a changeset: both leave it and all before
    dump(follow / "d.cs.log", commit("c5", "2020-01-05", "c3", "M\td.cs"), commit("c3", "2020-01-03", "c2", "R100\ta.cs\tb.cs"), commit("c1", "2020-01-01", "", "A\ta.cs"))
    tables = sync.sync_git_by_file(spark, str(follow), full, "r", str(tmp_path / "out"))
    assert {(r["changeset_id"], r["file_id"]) for r in tables["change_item"].collect()} == {("c5", "b.cs"), ("c5", "d.cs")}
    assert {r["changeset_id"] for r in tables["change_set"].collect()} == {"c5"}


def test_history_in_several_documents(spark, tmp_path):
    doc = lambda *ids: json.dumps({"ChangeSets": [{"Id": i, "Committer": "Ann", "Date": "2020-01-01T00:00:00Z", "Items": [{"Id": "f", "Kind": 4, "ServerPath": "p"}]} for i in ids]}, indent=1)
    for name, ids in (("0.json", ("4", "3")), ("1.json", ()), ("2.json", ("2", "1", "0"))):
        (tmp_path / name).write_text(doc(*ids))
    sets, items = files.history_json(spark, str(tmp_path), "r")
    assert {r["changeset_id"]: r["cs_ord"] for r in sets.collect()} == {str(k): k for k in range(5)}
    assert items.count() == 5


def test_one_team_a_commit(spark):
    sets = spark.createDataFrame([("r", str(k), "ann" if k < 6 else None if k == 6 else "bob", f"2020-01-0{k}") for k in range(1, 8)], "repo_id string, changeset_id string, committer string, date string").withColumn("date", F.to_timestamp("date"))
    spells = [("ann", "red", None, "2020-01-04"), ("ann", "blue", "2020-01-02", "2020-01-03"), ("ann", "green", "2020-01-02", "2020-01-03"), ("ann", "late", "2020-01-05", None), ("ann", "late", "2020-01-05", None), (None, "x", None, None)]
    t = spark.createDataFrame(spells, "developer string, team string, valid_from string, valid_to string").withColumns({c: F.to_timestamp(c) for c in ("valid_from", "valid_to")})
    got = sorted((r["changeset_id"], r["team"]) for r in teams.with_team(sets, t).collect())
    assert [x for _, x in got] == ["red", "blue", "red", teams.NOT_CLASSIFIED, "late", teams.NOT_CLASSIFIED, teams.NOT_CLASSIFIED]


@pytest.mark.parametrize("gram", [1, 3, 8])
def test_components(spark, gram):
    keys = [("src/", "all"), ("src/app/", "app"), ("APP/Core", "core"), ("x", "letter"), ("util/é", "accent"), ("tests", "tests"), ("nowhere/at/all", "none"), ("tests", "again"), (None, "null")]
    paths = ["Src/App/Core/a.cs", "src/b.cs", "lib/x.cs", "lib/util/É.cs", "lib/c.cs", "a/tests/t.cs", "", "src/app/core"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(99, None)], "i int, server_path string")
    mapping = spark.createDataFrame(keys, "key string, value string")
    found = coupling.components_of(df, mapping, gram)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["i"]: r["component"] for r in found.collect()}
    for i, p in enumerate(paths):
        hits = [(len(k), k, v) for k, v in keys if k is not None and k.lower() in p.lower()]
        best = max(hits)[:2] if hits else None
        assert got[i] in ({v for n, k, v in hits if (n, k) == best} or {None}), (p, got[i])
    assert got[99] is None
    assert coupling.components_of(df, mapping.where("false")).where("component is not null").count() == 0


def test_named_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "name string, value double")
    assert files.export(df, str(tmp_path), "comments").endswith("/comments.csv")
    path = files.export(df, str(tmp_path), "summary", "2020-02-03")
    assert path.endswith("summary-2020-02-03.csv") and spark.read.option("header", True).csv(path).first()["value"] == "1.500"
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path), "summary")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 60, 1 << 20])
def test_log_as_a_format(spark, tmp_path, monkeypatch, end, size):
    from commitlens.sources import plugin

    log = dump(tmp_path / "dumps" / "one.log", commit("c3", "2020-01-03", "c2 c1", "M\ta.cs", "R100\ta.cs\tb.cs", end=end), commit("c2", "2020-01-02", "c1", "D\tx y.cs", subject="a START_HEADER in the subject", end=end), end=end)
    dump(tmp_path / "dumps" / "sub" / "two.log", commit("c1", "2020-01-01", "", 'A\t"\\303\\251.cs"', 'A\t"bad\\377.cs"', "X\tq", end=end), end=end)
    spark.dataSource.register(plugin.CommitLogSource)
    folder = log.rsplit("/", 1)[0]
    wanted = dict(zip(("change_set", "change_item", "commit_edge"), logs.git_log(spark, folder, "r"), strict=True))
    for table, want in wanted.items():
        got = spark.read.format("commitlog").options(table=table, repo_id="r", range_bytes=size).load(folder)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), table


def test_records_over_small_reads(monkeypatch):
    import io

    from commitlens.sources import plugin

    text = "".join(f"START_HEADER\nid{k}\n{'x' * (k % 7)}\n" for k in range(50)).encode()
    for read in (1, 3, 20, 1000):
        monkeypatch.setattr(plugin, "READ_BYTES", read)
        for size in (1, 13, 100, 5000):
            got = [r.split("\n")[0] for at in range(0, len(text), size) for r in plugin.records(io.BytesIO(text), at, min(len(text), at + size))]
            assert got == [f"id{k}" for k in range(50)], (read, size)


def test_providers_by_name(spark):
    from commitlens.sources import plugin

    assert plugin.provider("commitlens.plans.sync:sync_git") is sync.sync_git
    with pytest.raises(ValueError):
        plugin.provider("commitlens.plans.sync:nothing")


def test_a_small_range_reads_little_of_its_file():
    import io

    from commitlens.sources import plugin

    text = "".join(f"START_HEADER\nid{k}\n{'x' * 50}\n" for k in range(20_000)).encode()
    file = io.BytesIO(text)
    assert len(list(plugin.records(file, 100_000, 200_000))) > 1000
    assert file.tell() < 100_000 + 2 * 100_000


def test_tasks_of_a_dump_grow_with_its_bytes(tmp_path):
    from commitlens.sources import plugin

    big = tmp_path / "big.log"
    with big.open("wb") as f:
        f.truncate(16 << 30)  # takes no room
    reader = plugin.CommitLogReader({"path": str(big), "range_bytes": "100000"}, None)
    tasks = reader.partitions()
    ranges = [r for t in tasks for r in t.ranges]
    assert len(tasks) <= 1100 and ranges[0][1] == 0 and ranges[-1][2] == 16 << 30
    assert all(a[2] == b[1] for a, b in zip(ranges, ranges[1:], strict=False)) and all(e - s <= 100_000 for _, s, e in ranges)
    assert all(len(t.ranges) == 1 for t in plugin.dealt([("a", k * 10, k * 10 + 10) for k in range(200)]))


def test_ranges_of_a_task(spark, tmp_path):
    from commitlens.sources import plugin

    for k in range(3):
        text = "\n".join(f"START_HEADER\nc{k}_{i}\na\n2020-01-01T00:00:00+00:00\n\nx\nEND_HEADER\n\nM\tf{i}" for i in range(400))
        (tmp_path / f"{k}.log").write_text(text)
    reader = plugin.CommitLogReader({"path": str(tmp_path), "range_bytes": "30", "repo_id": "r"}, None)
    assert max(len(t.ranges) for t in reader.partitions()) > 5
    spark.dataSource.register(plugin.CommitLogSource)
    got = spark.read.format("commitlog").options(repo_id="r", range_bytes=30).load(str(tmp_path)).select("changeset_id", "server_path").collect()
    assert sorted(map(tuple, got)) == sorted((f"c{k}_{i}", f"f{i}") for k in range(3) for i in range(400))


def test_a_sync_reads_its_dump_twice(spark, tmp_path, monkeypatch):
    """Changesets and graph in one reading, items in the other."""
    (tmp_path / "log").write_text(commit("b", "2020-01-02", "a", "M\tf") + commit("a", "2020-01-01", "", "A\tf"))
    plain, scans = sync.cut, []
    monkeypatch.setattr(sync, "cut", lambda df: scans.append("FileScan text" in df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    tables = sync.sync_git(spark, str(tmp_path / "log"), "r", str(tmp_path / "out"))
    assert scans.count(True) == 1
    assert [tuple(r) for r in tables["commit_edge"].select("child", "parent").collect()] == [("b", "a")]
