"""Runs, rollback, restore, failures between publish steps, ledgers and the command line."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strata.plans.__main__ import main
from strata.plans.pipeline import Pipeline, RunError, blocked_reason
from strata.plans.rollback import RollbackError, affected, cutoff
from strata.sources.ledger import Fenced, Ledger, LedgerError, ReusedBatch
from strata.sources.seeds import load_seed
from strata.sources.store import BatchStore
from strata.spec import ColumnTest, DimensionSpec, ExposureSpec, Registry, SnapshotSpec, SpecError
from strata.streaming.ingest import ingest_available

DIM = DimensionSpec("dim", "stg", ("k",), "d", presentation_exclude=("attribute_hash",))
FACT = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("attribute_hash",))
T0 = datetime(2024, 6, 1, 6)


def extract(spark, *parts):
    return spark.createDataFrame([(k, f"2024-01-{d:02d}", h) for k, d, h in parts], "k string, d string, attribute_hash string").withColumn("d", F.col("d").cast("date"))


def content(df):
    return sorted(tuple(map(str, r)) for r in df.drop("_loaded_at").collect())


NIGHT1 = [("x", 1, "A"), ("y", 1, "A")]
NIGHT2 = [*NIGHT1, ("x", 2, "B"), ("x", 2, "C"), ("y", 2, "A")]  # two hashes on the latest date: the gate fails
NIGHT3 = [*NIGHT1, ("x", 3, "B"), ("y", 3, "A")]


def test_good_bad_good_night_then_rollback_and_restore(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM, FACT], [ExposureSpec("board", ("dim",))]))
    run = lambda n, rows, at: {r["name"]: r["status"] for r in p.run({"stg": extract(spark, *rows)}, f"n{n}", at)}
    assert run(1, NIGHT1, T0)["dim"] == "success"
    first = content(p.read("dim"))
    assert "attribute_hash" not in p.read("dim").columns
    assert run(2, NIGHT2, T0 + timedelta(1)) | {} == {"dim__history": "success", "dim__gates": "fail", "dim": "skipped", "fact__history": "success", "fact__gates": "pass", "fact": "success"}
    assert content(p.read("dim")) == first
    assert spark.read.parquet(f"{tmp_path}/audit/dim__gates/batch=n2").count() == 1
    assert run(3, NIGHT3, T0 + timedelta(2))["dim"] == "success"
    assert p.state("dim").store.batches() == ["n1", "n3"]  # the unapproved batch went
    third = content(p.read("dim"))
    assert len(third) == 3

    report = p.rollback("dim", T0 + timedelta(3), to_batch_id="n1")
    assert report["dry_run"] and report["rows"] == {"n3": 1} and content(p.read("dim")) == third
    done = p.rollback("dim", T0 + timedelta(3), to_batch_id="n1", dry_run=False)
    assert done["refresh"]["ok"] and content(p.read("dim")) == first
    again = p.restore("dim")
    assert again["orphans"] == [] and content(p.read("dim")) == third
    entries = p.state("dim").ledger.entries("dim__history")
    assert [e["approved_at"] for e in entries] == [T0, T0 + timedelta(2)]  # original times
    p.rollback("dim", T0 + timedelta(4), to_datetime="2024-06-01", dry_run=False, purge=True)
    assert p.restore("dim")["orphans"] == ["n3"] and content(p.read("dim")) == first
    assert p.rollback("dim", T0, to_datetime="2030-01-01")["batches"] == []
    assert spark.read.parquet(f"{tmp_path}/operations/run_results").count() == 18
    assert spark.read.parquet(f"{tmp_path}/operations/edges").where("child_type = 'exposure'").count() == 3


def test_reingest_after_a_rollback_without_restore(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM]))
    p.run({"stg": extract(spark, *NIGHT1)}, "n1", T0, record=False)
    p.run({"stg": extract(spark, *NIGHT3)}, "n2", T0 + timedelta(1), record=False)
    whole = [r[1:3] for r in content(p.read("dim"))]
    p.rollback("dim", T0 + timedelta(2), to_batch_id="n1", dry_run=False)
    p.run({"stg": extract(spark, *NIGHT3)}, "n3", T0 + timedelta(3), record=False)  # purged, so the mark has gone back
    assert [r[1:3] for r in content(p.read("dim"))] == whole
    p.run({"stg": extract(spark, *NIGHT3)}, "n4", T0 + timedelta(4), record=False)
    assert "n4" in p.state("dim").ledger.approved("dim__history")  # an empty batch is approved


@pytest.mark.parametrize("step", ["write", "count", "switch", "verify"])
def test_a_failure_between_steps_leaves_the_old_table(spark, tmp_path, step):
    p = Pipeline(spark, str(tmp_path), Registry([DIM]))
    p.run({"stg": extract(spark, *NIGHT1)}, "n1", T0, record=False)
    before = content(p.read("dim"))
    p.build("dim", extract(spark, *NIGHT3), "n2", T0)

    with pytest.raises(RunError):
        p.approve("dim", "n2", T0 + timedelta(1), "pass", fault=failing(step))
    assert p.state("dim").approved() == {"n1"} and content(p.read("dim")) == before
    assert p.approve("dim", "n2", T0 + timedelta(1), "pass")["approved"] and len(content(p.read("dim"))) == 3


def failing(step):
    def fault(at):
        if at == step:
            raise OSError("gone")

    return fault


def test_a_failure_to_tidy_leaves_the_new_table(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM]))
    p.run({"stg": extract(spark, *NIGHT1)}, "n1", T0, record=False)
    p.build("dim", extract(spark, *NIGHT3), "n2", T0)
    done = p.approve("dim", "n2", T0, "pass", fault=failing("tidy"))
    assert done["approved"] and "gone" in done["warning"] and len(content(p.read("dim"))) == 3


def test_an_approved_batch_is_never_written_again(spark, tmp_path):
    sources = {"stg": extract(spark, *NIGHT1)}
    p = Pipeline(spark, str(tmp_path), Registry([DIM, FACT]))
    p.run(sources, "n1", T0, record=False)
    s = p.state("dim")
    whole = lambda: (content(s.store.read()), s.ledger.entries(), content(p.read("dim")), content(p.read("fact")))
    before = whole()
    again = p.run(sources, "n1", T0 + timedelta(1), record=False)
    assert [r["status"] for r in again] == ["success"] * 4 and whole() == before
    with pytest.raises(ReusedBatch):  # the same id with other rows
        p.run({"stg": extract(spark, *NIGHT3)}, "n1", T0 + timedelta(1), record=False)
    assert whole() == before
    with pytest.raises(ValueError):
        s.store.append(s.store.read(), "n1", s.approved())
    # a pending batch gives way to its retry
    p.build("dim", extract(spark, *NIGHT2), "n2", T0)
    p.build("dim", extract(spark, *NIGHT3), "n2", T0)
    assert s.store.batches() == ["n1", "n2"] and s.store.read().where("_batch_id = 'n2'").count() == 1


def test_a_run_that_died_after_its_approval_is_published_by_its_retry(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM]))
    p.build("dim", extract(spark, *NIGHT1), "n1", T0)
    p.state("dim").ledger.approve("dim__history", "n1", T0)  # and no publication
    assert p.read("dim") is None
    p.run({"stg": extract(spark, *NIGHT1)}, "n1", T0 + timedelta(1), record=False)
    assert len(content(p.read("dim"))) == 2 and [e["approved_at"] for e in p.state("dim").ledger.entries()] == [T0]


def test_column_tests_and_severities_block(spark, tmp_path):
    unique, codes = ColumnTest("unique", "note"), ColumnTest("accepted_values", "note", ("a", "b"), "warn")
    spec = DimensionSpec("dim", "stg", ("k",), "d", tests=(unique, codes), column_docs={"note": "a remark"})
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    rows = lambda *notes: extract(spark, *[(str(i), 1, n) for i, n in enumerate(notes)]).withColumn("note", F.col("attribute_hash"))
    got = {r["name"]: r["status"] for r in p.run({"stg": rows("a", "a", "b")}, "n1", T0)}
    assert got == {"dim__history": "success", "dim__gates": "pass", "dim__unique_note": "fail", "dim__accepted_values_note": "pass", "dim": "skipped"}
    assert spark.read.parquet(f"{tmp_path}/audit/dim__unique_note/batch=n1").collect() == [("a", 2)]
    got = {r["name"]: r["status"] for r in p.run({"stg": rows("a", "x")}, "n2", T0)}
    assert got["dim__accepted_values_note"] == "warn" and got["dim"] == "success"
    assert p.read("dim").schema["note"].metadata == {"comment": "a remark"}
    mild = Pipeline(spark, f"{tmp_path}/mild", Registry([DimensionSpec("dim", "stg", ("k",), "d", gate_severity="warn")]))
    got = {r["name"]: r["status"] for r in mild.run({"stg": extract(spark, *NIGHT2)}, "n1", T0, record=False)}
    assert got["dim__gates"] == "warn" and got["dim"] == "skipped"
    for bad in (lambda: ColumnTest("odd", "x"), lambda: ColumnTest("unique", "x", severity="no"), lambda: DimensionSpec("d", "s", ("k",), gate_severity="no")):
        with pytest.raises(SpecError):
            bad()


def test_torn_events_never_happened_and_logs_are_summed_up(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/l")
    ledger.log.every = 4
    for i in range(5):
        ledger.approve("m", f"b{i}", T0 + timedelta(i))
    (tmp_path / "l" / f"{5:010d}.json").write_text("")  # its writer died
    (tmp_path / "l" / f"{6:010d}.json").write_text('{"op": "appr')
    assert ledger.approved("m") == {f"b{i}" for i in range(5)}
    ledger.unapprove("m", "b1")
    assert [n for n in ledger.log.folder.names() if n.endswith(".sum")] and ledger.approved("m") == Ledger(spark, f"{tmp_path}/l").approved("m") == {"b0", "b2", "b3", "b4"}
    with pytest.raises(Exception):
        ledger.log.folder.write(f"{0:010d}.json", "{}")  # two writers can't both succeed


@pytest.mark.parametrize("step", ["mark", "remove"])
def test_compaction_that_dies_loses_no_batch(spark, tmp_path, step):
    store = BatchStore(spark, f"{tmp_path}/h")
    for b in ("a", "b"):
        store.append(spark.range(10).repartition(3).withColumn("_batch_id", F.lit(b)), b)
    with pytest.raises(OSError):
        store.compact("a", fault=failing(step))
    assert sorted(store.read().groupBy("_batch_id").count().collect()) == [("a", 10), ("b", 10)]
    store.compact("a")
    assert store.read().count() == 20 and store.batches() == ["a", "b"]
    assert store.purge({"b"}) == ["a"] and store.read().count() == 10


def test_published_rows_of_a_distribution_value_lie_together(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DimensionSpec("dim", "stg", ("k", "j"), "d", dist_column="j")]))
    rows = extract(spark, *[(str(i), 1, "A") for i in range(40)]).withColumn("j", F.col("k") % 3)
    p.run({"stg": rows}, "n1", T0, record=False)
    files = p.read("dim").select("j", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("j").count().where("count > 1").count() == 0 and p.read("dim").count() == 40


@pytest.mark.parametrize("gate,tests,blocked", [
    ("pass", [], False), ("success", [], False), ("fail", [], True), ("error", [], True), ("warn", [], True), ("skipped", [], True), (None, [], True),
    ("pass", [{"status": "fail"}], True), ("pass", [{"status": "fail", "severity": "warn"}], False), ("pass", [{"status": "pass"}], False),
])
def test_approval_matrix(gate, tests, blocked):
    assert bool(blocked_reason(gate, tests)) == blocked


def test_anchors():
    e = [{"batch_id": b, "approved_at": datetime(2024, 6, d, 12)} for b, d in (("a", 1), ("b", 2), ("c", 2))]
    assert [x["batch_id"] for x in affected(e, cutoff(e, to_batch_id="a"))] == ["b", "c"]
    assert affected(e, cutoff(e, to_batch_id="b")) == []  # equal times stay
    assert [x["batch_id"] for x in affected(e, cutoff(e, to_datetime="2024-06-01"))] == ["b", "c"]
    assert len(affected(e, cutoff(e, to_datetime="2024-06-01T11:00:00"))) == 3
    for bad in ({}, {"to_batch_id": "a", "to_datetime": "2024-06-01"}, {"to_batch_id": "zz"}):
        with pytest.raises(RollbackError):
            cutoff(e, **bad)


@pytest.mark.parametrize("make", [
    lambda: DimensionSpec("", "s", ("k",)), lambda: DimensionSpec("d", "", ("k",)), lambda: DimensionSpec("d", "s", ()), lambda: DimensionSpec("1d", "s", ("k",)),
    lambda: DimensionSpec("d", "s", ("k",), presentation_exclude=("K",)), lambda: DimensionSpec("d", "s", ("k",), presentation_exclude=("valid_from",)),
    lambda: DimensionSpec("d", "s", ("k",), dist_column="z", presentation_exclude=("z",)), lambda: SnapshotSpec("f", "s", ("k",), presentation_exclude=("snapshot_date",)),
    lambda: Registry([])["none"],
])
def test_spec_errors(make):
    with pytest.raises(SpecError):
        make()


def test_registry():
    r = Registry([DIM, FACT, DimensionSpec("dim", "other", ("z",))])
    assert r["dim"].source == "stg" and r.of_model("dim__history") is r["dim"] and r.of_model("none") is None
    assert [n["name"] for n in r.describe("dim")] == ["dim__history", "dim__candidate", "dim__published", "dim__gates", "dim"]


def test_stored_schema_widens_and_old_batches_read_null(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM]))
    p.run({"stg": extract(spark, *NIGHT1)}, "001", T0, record=False)
    p.run({"stg": extract(spark, *NIGHT3).withColumn("colour", F.lit("red"))}, "002", T0 + timedelta(1), record=False)
    rows = p.state("dim").store.read()
    assert rows.columns[-1] == "colour" and rows.where("colour is null").count() == 2
    assert {r._batch_id for r in rows.collect()} == {"001", "002"}
    p.state("dim").store.compact("001")
    assert p.state("dim").store.read().count() == 3


def test_seed_keeps_na_and_refuses_malformed_rows(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    head = "source_system,match_key,source_value,canonical_country_code,note\n"
    good.write_text(head + 'SID,name,Namibia,NA,"a, note"\n')
    bad.write_text(head + "SID,name,South Korea,KR,a, note\n")
    assert load_seed(spark, str(good)).first().canonical_country_code == "NA"
    with pytest.raises(Exception):
        load_seed(spark, str(bad)).collect()


def test_a_stream_that_dies_between_approval_and_its_own_commit_loses_nothing(spark, tmp_path):
    extract(spark, *NIGHT1).coalesce(1).write.parquet(f"{tmp_path}/in")
    p = Pipeline(spark, f"{tmp_path}/out", Registry([DIM]))
    take = lambda: ingest_available(spark, p, "dim", f"{tmp_path}/in", extract(spark, *NIGHT1).schema, f"{tmp_path}/ck", T0)
    take()
    before = (content(p.state("dim").store.read()), p.state("dim").ledger.entries(), content(p.read("dim")))
    for f in (tmp_path / "ck" / "commits").iterdir():
        f.unlink()
    assert [r["name"] for r in take()] == ["dim__history", "dim"]  # the batch comes again
    assert (content(p.state("dim").store.read()), p.state("dim").ledger.entries(), content(p.read("dim"))) == before


def test_stream_of_extracts(spark, tmp_path):
    extract(spark, *NIGHT1).coalesce(1).write.parquet(f"{tmp_path}/in")
    p = Pipeline(spark, f"{tmp_path}/out", Registry([DIM]))
    take = lambda: ingest_available(spark, p, "dim", f"{tmp_path}/in", extract(spark, *NIGHT1).schema, f"{tmp_path}/ck", T0)
    assert [r["status"] for r in take()] == ["success", "pass", "success"]
    extract(spark, *NIGHT3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    take()
    batch = Pipeline(spark, f"{tmp_path}/batch", Registry([DIM]))
    batch.run({"stg": extract(spark, *NIGHT1)}, "n1", T0, record=False)
    batch.run({"stg": extract(spark, *NIGHT3)}, "n2", T0, record=False)
    same = lambda x: content(x.read("dim").drop("_batch_id"))
    assert same(p) == same(batch)


def test_command_line(spark, tmp_path):
    extract(spark, *NIGHT1).write.parquet(f"{tmp_path}/stg")
    config = {"root": f"{tmp_path}/out", "sources": {"stg": f"{tmp_path}/stg"}, "dimensions": [{"name": "dim", "source": "stg", "natural_key": ["k"], "change_column": "d"}]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    at = str(tmp_path / "c.json")
    assert [r["status"] for r in main([at, "build", "--batch", "b1", "--at", "2024-06-01T06:00:00", "--select", "dim"], spark)] == ["success", "pass"]
    assert main([at, "gate", "dim", "--batch", "b1"], spark)[0]["status"] == "pass"
    assert main([at, "publish", "dim", "--batch", "b1", "--at", "2024-06-01T06:00:00"], spark)["row_count"] == 2
    assert main([at, "rollback", "dim", "--to-datetime", "2024-05-01", "--execute"], spark)["refresh"]["row_count"] == 0
    assert main([at, "run", "--batch", "b1", "--at", "2024-06-01T06:00:00", "--tag", "scd2"], spark)[-1]["status"] == "success"
    assert main([at, "rollback", "dim", "--to-datetime", "2024-05-01"], spark)["batches"] == ["b1"]
    assert main([at, "rollback", "dim", "--to-datetime", "2024-05-01", "--execute"], spark)["refresh"]["row_count"] == 0
    assert main([at, "restore", "dim"], spark)["refresh"]["row_count"] == 2
    assert len(main([at, "show", "dim"], spark)) == 5
    extract(spark, ("z", 9, "Z")).write.parquet(f"{tmp_path}/in/e1")
    assert main([at, "intake", "dim", "--path", f"{tmp_path}/in", "--checkpoint", f"{tmp_path}/ck", "--at", "2024-06-09T06:00:00", "--hold"], spark)[-1]["row_count"] == 3
    assert main([at, "resume", "dim", "--path", f"{tmp_path}/in", "--at", "2024-06-09T06:00:00"], spark) == []


def test_of_two_publications_from_one_version_the_slower_plans_anew(spark, tmp_path):
    p, q = (Pipeline(spark, str(tmp_path), Registry([DIM])) for _ in range(2))
    p.run({"stg": extract(spark, *NIGHT1)}, "n1", T0, record=False)
    p.run({"stg": extract(spark, *NIGHT3)}, "n2", T0 + timedelta(1), record=False)
    p.state("dim").ledger.unapprove("dim__history", "n2")

    def overtaken(step):
        if step == "switch" and len(q.read("dim").collect()) == 3:
            q.state("dim").refresh()  # the same change, by another process

    s = p.state("dim", overtaken)
    assert s.refresh()["ok"] and len(content(p.read("dim"))) == 2 == len(content(s.view())) and s.table.versions()[-1] == 3
    assert {f.split("/")[0] for folders in s.table.manifest()["ranges"].values() for f in folders} <= set(s.table.folder.names())
