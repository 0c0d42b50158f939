"""Trees, revisions and file logs with more files than directories should hold."""

import pytest
from pyspark.sql import functions as F
from test_sync import commit

from commitlens.queries import QUERIES
from commitlens.sources import files, logs


def test_loose_and_packed_files_are_one_tree(spark, tmp_path):
    (tmp_path / "loose" / "a").mkdir(parents=True)
    (tmp_path / "loose" / "a" / "x.cs").write_text("one\n")
    files.write_packed(spark.createDataFrame([("b/y.cs", "two\n\u0000\r\n"), ("b/z.bin", "no"), ("b/empty.cs", "")], "path string, content string"), str(tmp_path / "packed"))
    got = files.source_tree(spark, str(tmp_path / "loose"), name=F.regexp_extract("path", "loose/(.*)$", 1), packed=str(tmp_path / "packed"))
    assert {tuple(r) for r in got.collect()} == {("a/x.cs", "one\n"), ("b/y.cs", "two\n\u0000\r\n"), ("b/empty.cs", "")}


def test_packed_revisions(spark, tmp_path):
    (tmp_path / "revisions" / "1" / "src").mkdir(parents=True)
    (tmp_path / "revisions" / "1" / "src" / "a.cs").write_text("one")
    files.write_packed(spark.createDataFrame([("2/src/a.cs", "two"), ("3/src/a.cs", "gone")], "path string, content string"), str(tmp_path / "packed"))
    items = spark.createDataFrame([("r", str(k), 32 if k == 3 else 4, "src/a.cs") for k in (1, 2, 3)], "repo_id string, changeset_id string, kind int, server_path string")
    sets = items.select("repo_id", "changeset_id", F.current_timestamp().alias("date"))
    got = files.file_revisions(spark, str(tmp_path / "revisions"), items, sets, packed=str(tmp_path / "packed"))
    assert {(r["path"], r["revision"], r["content"]) for r in got.collect()} == {("src/a.cs", "1", "one"), ("src/a.cs", "2", "two")}


def test_packed_file_logs(spark, tmp_path):
    log = {k: "\r\n".join([commit(f"{k}2", "2020-01-02", f"{k}1", f"M\t{k}.cs", subject="a START_HEADER in the subject", end="\r\n"), commit(f"{k}1", "2020-01-01", "", f"A\t{k}.cs", end="\r\n")]) for k in "ab"}
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "a.cs.log").write_bytes(log["a"].encode())
    files.write_packed(spark.createDataFrame([("x/b.cs.log", log["b"])], "path string, content string"), str(tmp_path / "packed"))
    sets, items = logs.git_file_logs(spark, str(tmp_path / "loose"), "r", packed=str(tmp_path / "packed"))
    assert {(r["changeset_id"], r["file_id"], r["kind"]) for r in items.collect()} == {(f"{k}{n}", f"{k}.cs", 2 if n == 1 else 4) for k in "ab" for n in (1, 2)}
    assert sets.count() == 4


def test_queries_do_not_write_a_file_a_row(spark, monkeypatch, tmp_path):
    from commitlens import queries

    made = []
    monkeypatch.setattr(queries, "new_path", lambda spark, name: made.append(f"{tmp_path}/{name}{len(made)}") or made[-1])
    for name in ("s12_source_tree", "s11_file_revisions", "s2_file_logs"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(made) == 6
    assert sum(1 for p in tmp_path.rglob("part-*")) < 100


def test_packed_by_a_column(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", True), ("b", "2", False), ("c", "3", False)], "path string, content string, loose boolean")
    for name, df in (("all", rows), ("none", rows.where("false")), ("one", rows.where("loose"))):
        files.write_packed(df, str(tmp_path / name), "loose")
        for side in (True, False):
            got = files.packed_files(spark, f"{tmp_path}/{name}/loose={str(side).lower()}")
            assert {tuple(r) for r in got.collect()} == {(r["path"], r["content"]) for r in df.collect() if r["loose"] == side}


def test_file_logs_are_dealt_and_written_once(spark, monkeypatch):
    """The logs of files are packed where they are computed, and items are shuffled by changeset once before."""
    from commitlens import queries

    plans, plain = [], files.write_packed
    monkeypatch.setattr(queries, "cut", lambda df: pytest.fail("written once more"))
    monkeypatch.setattr(files, "write_packed", lambda df, *args: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df, *args))
    QUERIES["s2_file_logs"](spark, "/root/testdata/sf0.001").count()
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning(changeset_id") == 1
