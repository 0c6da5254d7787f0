"""Extracts as a stream: none is lost, whatever their files, checkpoints and gates."""

from datetime import timedelta

import pytest

from strata.plans.pipeline import Pipeline
from strata.sources.files import Folder
from strata.sources.ledger import ReusedBatch
from strata.spec import DimensionSpec, Registry, SnapshotSpec
from strata.streaming.ingest import Intake, IntakeError, complete_extracts, ingest_available
from tests.test_pipeline import DIM, T0, content, extract


def rows_of(spark, day, n=10, first=0, text="A"):
    return extract(spark, *[(f"k{i}", day, f"{text}{day}") for i in range(first, first + n)]).repartition(4)


def intake(spark, tmp_path, spec=DIM):
    p = Pipeline(spark, f"{tmp_path}/out", Registry([spec]))
    return p, Intake(spark, p, spec.name, f"{tmp_path}/in", extract(spark).schema)


@pytest.mark.parametrize("flat", [True, False])
def test_extracts_of_four_files_lose_no_row(spark, tmp_path, flat):
    p, it = intake(spark, tmp_path)
    for day in (1, 2):
        rows_of(spark, day, first=10 * day).write.mode("append").parquet(f"{tmp_path}/in" if flat else f"{tmp_path}/in/extract={day}")
    found = complete_extracts(Folder(spark, f"{tmp_path}/in"))
    assert len(found) == 2 and all(len(files) == 4 for files in found.values())
    results = it.take_available(f"{tmp_path}/ck", T0)
    assert [r["status"] for r in results] == ["success", "pass", "success"] * 2 and {r["rows_late"] for r in results} == {0}
    assert p.state("dim").store.read().count() == 20 == p.read("dim").count()
    assert it.take_available(f"{tmp_path}/ck", T0) == []
    rows_of(spark, 3, first=50).write.mode("append").parquet(f"{tmp_path}/in" if flat else f"{tmp_path}/in/extract=3")
    it.take_available(f"{tmp_path}/ck", T0)
    assert p.read("dim").count() == 30


def test_folders_that_an_intake_publishes_do_not_follow_its_rows(spark, tmp_path):
    """Two extracts of 1,000 keys at a row a range, the second rolled back and restored."""
    p, it = intake(spark, tmp_path)
    p.state("dim").table.range_rows = 1
    for day in (1, 2):
        rows_of(spark, day, n=1000).write.parquet(f"{tmp_path}/in/{day}")
        it.take_available(f"{tmp_path}/ck", T0 + timedelta(day))
        manifest = p.state("dim").table.manifest()
        assert sum(map(len, manifest["ranges"].values())) <= 256 and sum(manifest["rows"].values()) == 1000 * day
    both = content(p.read("dim"))
    p.rollback("dim", T0 + timedelta(3), to_batch_id="1", dry_run=False)
    assert p.read("dim").count() == 1000
    p.restore("dim")
    assert content(p.read("dim")) == both == content(p.state("dim").view())


def test_a_new_checkpoint_takes_nothing_twice_and_loses_nothing(spark, tmp_path):
    p, it = intake(spark, tmp_path)
    rows_of(spark, 1).write.parquet(f"{tmp_path}/in/a")
    it.take_available(f"{tmp_path}/ck1", T0)
    before = content(p.read("dim")), p.state("dim").ledger.entries()
    rows_of(spark, 2).write.parquet(f"{tmp_path}/in/b")
    results = it.take_available(f"{tmp_path}/ck2", T0)
    assert [r["message"] for r in results if r["resource_type"] == "model"] == ["approved before", ""]
    assert p.state("dim").store.batches() == ["a", "b"] and p.read("dim").count() == 20
    assert set(before[0]) <= set(content(p.read("dim").where("is_current = 0"))) | set(before[0]) and p.state("dim").ledger.entries()[0] == before[1][0]


def test_a_blocked_extract_stops_the_stream_and_comes_again(spark, tmp_path):
    p, it = intake(spark, tmp_path)
    rows_of(spark, 1).write.parquet(f"{tmp_path}/in/a")
    twice = rows_of(spark, 2).unionByName(rows_of(spark, 2, n=1, text="B"))  # two hashes of a key on the latest date
    twice.write.parquet(f"{tmp_path}/in/b")
    for _ in range(2):
        with pytest.raises(IntakeError, match="extract b: the gate test's status is fail"):
            it.take_available(f"{tmp_path}/ck", T0)
        assert p.state("dim").approved() == {"a"} and p.read("dim").count() == 10
    rows_of(spark, 2).write.mode("overwrite").parquet(f"{tmp_path}/in/b")  # mended under its name: other files than announced
    with pytest.raises(IntakeError, match="other files"):
        it.take_available(f"{tmp_path}/ck", T0)


def test_held_extracts_keep_their_order_and_rows(spark, tmp_path):
    p, it = intake(spark, tmp_path)
    rows_of(spark, 1).write.parquet(f"{tmp_path}/in/a")
    it.take_available(f"{tmp_path}/ck", T0, "hold")
    rows_of(spark, 2, n=2).write.parquet(f"{tmp_path}/in/b")  # too few: the volume guard
    it.take_available(f"{tmp_path}/ck", T0, "hold")
    assert list(it.held()) == [] and p.read("dim").count() == 12  # one date an extract: no mean to fall below
    rows_of(spark, 3).unionByName(rows_of(spark, 3, n=1, text="B")).write.parquet(f"{tmp_path}/in/c")
    rows_of(spark, 4).write.parquet(f"{tmp_path}/in/d")
    results = it.take_available(f"{tmp_path}/ck", T0, "hold")
    assert list(it.held().values()) == ["the gate test's status is fail", "waits for c"] and [r["name"] for r in results if r["status"] == "held"] == ["c", "d"]
    assert it.take_available(f"{tmp_path}/ck", T0, "hold") == []  # the stream is past them
    assert it.resume(T0) and list(it.held()) == ["c", "d"]  # still blocked
    assert spark.read.parquet(f"{it.kept}/c").count() == 11 and spark.read.parquet(f"{it.kept}/d").count() == 10
    it.give_up("c", T0, "sent anew by its source")
    results = it.resume(T0 + timedelta(1))
    assert it.held() == {} and [r["status"] for r in results] == ["success", "pass", "success"]
    assert p.read("dim").count() == 22
    with pytest.raises(IntakeError):
        it.give_up("c", T0, "again")


def test_late_extracts_are_told(spark, tmp_path):
    p, it = intake(spark, tmp_path)
    rows_of(spark, 5).write.parquet(f"{tmp_path}/in/a")
    it.take_available(f"{tmp_path}/ck", T0)
    rows_of(spark, 5).write.parquet(f"{tmp_path}/in/b")  # the same rows once more are no loss
    assert {r["status"] for r in it.take_available(f"{tmp_path}/ck", T0)} == {"success", "pass"}
    rows_of(spark, 4, first=5).write.parquet(f"{tmp_path}/in/c")
    with pytest.raises(IntakeError, match="history doesn't reflect 10 of them"):
        it.take_available(f"{tmp_path}/ck", T0)
    fact = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("attribute_hash",))
    q, jt = intake(spark, tmp_path / "fact", fact)
    rows_of(spark, 5).write.parquet(f"{tmp_path}/fact/in/a")
    rows_of(spark, 4, n=3).unionByName(rows_of(spark, 6)).write.parquet(f"{tmp_path}/fact/in/b")
    results = jt.take_available(f"{tmp_path}/fact/ck", T0)
    assert [r["rows_late"] for r in results if r["resource_type"] == "model"] == [0, 3] and q.read("fact").count() == 20  # partly late: told, as history has it
    rows_of(spark, 4, n=3).write.parquet(f"{tmp_path}/fact/in/c")
    with pytest.raises(IntakeError, match="history doesn't reflect 3 of them"):
        jt.take_available(f"{tmp_path}/fact/ck", T0)


def test_a_name_with_other_rows_is_an_error(spark, tmp_path):
    p, it = intake(spark, tmp_path)
    rows_of(spark, 1).write.parquet(f"{tmp_path}/in/a")
    it.take_available(f"{tmp_path}/ck", T0)
    other = Pipeline(spark, f"{tmp_path}/out", Registry([DIM]))
    with pytest.raises(ReusedBatch):
        other.run({"stg": rows_of(spark, 2)}, "a", T0)
    assert other.read("dim").count() == 10


def test_what_is_not_whole_waits(spark, tmp_path):
    rows_of(spark, 1).write.parquet(f"{tmp_path}/in/a")
    (tmp_path / "in" / "a" / "_SUCCESS").unlink()
    (tmp_path / "in" / "a" / "._SUCCESS.crc").unlink()
    folder = Folder(spark, f"{tmp_path}/in")
    assert complete_extracts(folder) == {} and ingest_available(spark, Pipeline(spark, f"{tmp_path}/out", Registry([DimensionSpec("dim", "stg", ("k",), "d")])), "dim", f"{tmp_path}/in", extract(spark).schema, f"{tmp_path}/ck", T0) == []
    rows_of(spark, 1).coalesce(1).write.parquet(f"{tmp_path}/x")
    part = next((tmp_path / "x").glob("part-*"))
    part.rename(tmp_path / "in" / "one.parquet")
    part.with_name(f".{part.name}.crc").unlink()
    assert list(complete_extracts(folder)) == ["one.parquet"]
