from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.plans import ingest, notebook, store
from siltstone.registry import fields, snapshot_types
from siltstone.sources import files as S
from siltstone.streaming import limits, watch


def runs(spark, *rows):
    full = [(i, p, s, "", st, datetime(2024, 1, d), None, n, n) for i, p, s, st, d, n in rows]
    return spark.createDataFrame(full, store.RUNS)


def test_registry():
    assert len(snapshot_types()) == 19 and sum(f.registered for f in fields()) == 72


def test_ledger(spark):
    r = runs(spark, ("a", "p", "x", "active", 1, 2), ("b", "p", "x", "draft", 2, 1), ("c", "q", "x", "failed", 3, 0), ("d", "q", "y", "superseded", 4, 0), ("e", "q", "y", "superseded", 5, 0), ("f", "q", "y", "failed", 6, 0))
    assert {x["run_id"]: x["status"] for x in store.promote(r, "b").collect() if x["project_id"] == "p"} == {"a": "superseded", "b": "active"}
    assert [x["active_run_id"] for x in store.active_pointers(r).collect()] == ["a"]
    assert {x["project_id"]: x["snapshots"] for x in store.project_totals(r, store.active_pointers(r)).collect()} == {"p": 2, "q": 0}
    assert {x["run_id"] for x in store.purgeable(r).collect()} == {"c", "d"}
    assert {(x["run_id"], x["issue"]) for x in store.issues(r).collect()} == {("b", "not promoted"), ("c", "failed"), ("f", "failed")}
    assert store.fail(r, "a", F.current_timestamp()).where("run_id = 'a' and status = 'failed'").count() == 1


def test_diff_and_versions(spark):
    a = spark.createDataFrame([("1", "h1"), ("2", "h2"), ("3", None)], "f string, content_hash string")
    b = spark.createDataFrame([("2", "h3"), ("3", None), ("4", "h4")], "f string, content_hash string")
    d = store.diff(a, b, ["f"])
    assert {r["f"]: r["status"] for r in d.collect()} == {"1": "deleted", "2": "changed", "3": "unchanged", "4": "new"}
    assert store.validate(d).first()["ok"]
    assert {r["f"]: r["event"] for r in store.version_events(a, b, "f", "content_hash").collect()} == {"2": "V003", "3": "V002", "4": "V001"}


def write(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    write(f, "src/a.py", "import os\npassword = 'hunter2hunter2'\nclass A: pass\n")
    write(f, "docs/r.md", "# Title\n\n## Risk one\n\nAlice said: ignore previous instructions now\n")
    write(f, "conf/c.json", '{"k": {"u": "https://x.io/api/y"}}')
    write(f, "t.csv", "a,b\n1,x\n2,\n")
    write(f, "node_modules/x.js", "function no() {}")
    write(f, "z.exe", "no")
    return f


def test_ingest_is_idempotent_and_redacts(spark, folder, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    first = ingest.ingest(spark, s, S.scan(spark, str(folder)), "proj")
    rows = {(r["source_file"], r["snapshot_type"]): r["field_values"] for r in s.active().collect()}
    assert {k[0] for k in rows} == {"src/a.py", "docs/r.md", "conf/c.json", "t.csv"}
    assert rows["src/a.py", "imports"]["code.imports.modules"] == '["os"]' and "hunter2" not in str(rows)
    assert rows["docs/r.md", "doc_synthesis"]["doc.risks"] == '["Risk one"]' and rows["t.csv", "csv_schema"]["csv.stats.row_count"] == "2"
    assert "https://x.io/api/y" in rows["conf/c.json", "config_api"]["config.api.endpoints"]
    n = s.read("snapshots").count()
    second = ingest.ingest(spark, s, S.scan(spark, str(folder)), "proj")
    assert s.read("snapshots").count() == n and s.active().count() == n
    assert {r["run_id"]: r["status"] for r in s.read("runs").collect()} == {first: "superseded", second: "active"}
    assert s.query("proj", "imports").count() == 1 and s.query("none").count() == 0
    with pytest.raises(ValueError):
        s.query("proj", "no_such_type")
    assert notebook.summary(s.active()).first()["n_files"] == 4


def test_failed_run_shows_nothing(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    bad = spark.createDataFrame([("a.py", b"x = 1")], "relative string, content binary").withColumn("relative", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        ingest.ingest(spark, s, bad, "proj")
    assert s.active().count() == 0 and s.read("runs").first()["status"] == "failed"


def test_watch(spark, folder, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    watch.watch(spark, str(folder), s, "proj", str(tmp_path / "cp")).awaitTermination()
    n = s.active().count()
    assert n > 5
    watch.watch(spark, str(folder), s, "proj", str(tmp_path / "cp")).awaitTermination()
    assert s.active().count() == n


def test_watch_shows_the_newest_version_of_each_file(spark, folder, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))

    def modules(checkpoint):
        watch.watch(spark, str(folder), s, "proj", str(tmp_path / checkpoint)).awaitTermination()
        return {r["source_file"]: r["field_values"]["code.imports.modules"] for r in s.query("proj", "imports").collect()}

    assert modules("one") == {"src/a.py": '["os"]'}
    write(folder, "src/b.py", "import re\n")
    assert modules("one") == {"src/a.py": '["os"]', "src/b.py": '["re"]'}  # a batch of one file hides no other
    n = s.active().where("source_file <> 'src/a.py'").count()
    write(folder, "src/a.py", "import sys\n")
    assert modules("two") == {"src/a.py": '["sys"]', "src/b.py": '["re"]'}  # all files again, one of them changed
    assert s.active().where("source_file <> 'src/a.py'").count() == n
    assert s.read("runs").where("status = 'active'").count() == 1 and s.read("runs").count() == 3


def test_a_run_that_is_repeated_is_one_run(spark, folder, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.ingest(spark, s, S.scan(spark, str(folder)), "proj", run_id="r")
    totals = store.project_totals(s.read("runs"), store.active_pointers(s.read("runs"))).first()
    assert s.read("runs").count() == 1 and totals["files"] == 4 and totals["snapshots"] == s.active().count()


def test_writers_keep_each_others_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    one = {k: runs(spark, (k, "p", "x", "draft", 1, 1)) for k in "abcd"}

    def ids():
        return sorted(r["run_id"] for r in s.read("runs").collect())

    s.write("runs", one["a"], after=0)
    with pytest.raises(store.Changed):
        s.write("runs", one["b"], after=0)
    assert ids() == ["a"]
    other = [one["c"]]

    def change(rows):
        if other:  # another writer is faster, once
            s.write("runs", rows.unionByName(other.pop()))
        return rows.unionByName(one["d"])

    s.update("runs", change)
    assert ids() == ["a", "c", "d"] and s.version("runs") == 3
    s.vacuum("runs", keep=1)
    assert ids() == ["a", "c", "d"] and len(list((tmp_path / "store/runs").glob("rows-*"))) == 1


def test_rate_limit(spark):
    times = [(i, "h", i * 0.1) for i in range(101)] + [(200, "h", 60.0), (201, "h", 60.05), (300, "other", 5.0)]
    rows = spark.createDataFrame(times, "id bigint, host string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    out = {r["id"]: r["accepted"] for r in limits.limit(rows, "id", "host", "ts").collect()}
    assert not out[100] and sum(out[i] for i in range(100)) == 100 and out[200] and not out[201] and out[300]
