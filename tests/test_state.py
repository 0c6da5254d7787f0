"""Stored state against what it stands for: latest versions, ranges of published tables, ledgers of several writers, run records, as-of joins."""

import random
import threading
from datetime import date, timedelta
from functools import partial

import pytest
from pyspark.sql import functions as F

from strata.operators import gates, views
from strata.operators.history import changed_versions
from strata.plans.pipeline import Pipeline
from strata.sources.ledger import EventLog, Fenced, Ledger
from strata.spec import DimensionSpec, Registry, SnapshotSpec
from tests.test_pipeline import DIM, FACT, T0, content, extract


def night(rng, day, keys=30):
    return [(f"k{rng.randrange(keys)}", day, rng.choice("ABC")) for _ in range(rng.randrange(1, 12))]


def unique(rows):
    return list({(k, d): (k, d, h) for k, d, h in rows}.values())


def versions_in_plain(nights):
    """(key, day, hash) of what history keeps, from approved nights in turn."""
    kept, last, mark = [], {}, 0
    for rows in nights:
        for k, d, h in sorted(unique(rows), key=lambda r: r[1]):
            if d > mark and last.get(k) != h:
                kept.append((k, d, h))
                last[k] = h
        mark = max([mark, *(d for _, d, _ in kept)])
    return kept


@pytest.mark.parametrize("seed", [2])
def test_nights_rollbacks_and_restores_equal_a_full_rebuild(spark, tmp_path, seed):
    rng, spec = random.Random(seed), DimensionSpec("dim", "stg", ("k",), "d")
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    s = p.state("dim")
    s.latest.fold, s.table.range_rows, s.table.parts = 2, 5, 2
    nights, undone, written = {}, None, []
    for i in range(1, 11):
        nights[f"n{i}"] = unique(night(rng, i))
        p.run({"stg": extract(spark, *nights[f"n{i}"])}, f"n{i}", T0 + timedelta(i), record=False)
        undone = None
        if rng.random() < 0.4 and i > 2:
            p.rollback("dim", T0 + timedelta(i), to_batch_id=f"n{i - 2}" if f"n{i - 2}" in nights else sorted(s.approved())[0], dry_run=False, purge=rng.random() < 0.5)
            undone = set(nights) - s.approved()
            if set(s.store.batches()) >= undone and rng.random() < 0.5:
                p.restore("dim")
                undone = set(nights) - s.approved()
            for b in undone:
                nights.pop(b)
        want = versions_in_plain([nights[b] for b in sorted(nights, key=lambda b: int(b[1:]))])
        got = p.read("dim")
        assert sorted((r.k, r.valid_from.day, r.attribute_hash) for r in got.collect()) == sorted(want), (i, undone)
        assert content(got) == content(s.view()) and got.dtypes == s.view().dtypes  # the ranges equal the view over history
        written.append(s.table.manifest())
    latest, mark = s.latest.read(s.store, s.ledger.identities(spec.model))
    full = s.history(approved=True)
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, s.latest._latest(full).collect())) and mark == full.agg(F.max("valid_from")).first()[0]
    assert s.latest._manifests()
    source = extract(spark, *[(k, 28, h) for k in ("k1", "k2", "k99") for h in "A"])
    by_state = changed_versions(source, spec, "x", T0, full, mark, latest)
    assert content(by_state) == content(changed_versions(source, spec, "x", T0, full))


def test_a_night_reads_the_state_and_not_history(spark, tmp_path):
    spec = DimensionSpec("dim", "stg", ("k",), "d")
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    s = p.state("dim")
    s.latest.fold = 2
    for i in range(1, 5):
        p.run({"stg": extract(spark, *[(f"k{j}", i, f"{i}{j % i}") for j in range(20)])}, f"n{i}", T0 + timedelta(i), record=False)
    latest, mark = s.latest.read(s.store, s.ledger.identities(spec.model))
    rows = changed_versions(extract(spark, ("k1", 9, "Z")), spec, "n9", T0, s.store.read(), mark, latest)
    files = rows._jdf.queryExecution().optimizedPlan().toString(), [f for f in latest.inputFiles()]
    assert len(rows.collect()) == 1 and all("/latest/base=" in f for f in files[1])


def test_written_rows_follow_the_batch(spark, tmp_path):
    spec = DimensionSpec("dim", "stg", ("k",), "d")
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    p.state("dim").table.range_rows = 20
    p.run({"stg": extract(spark, *[(f"k{i}", 1, "A") for i in range(1000)])}, "n1", T0, record=False)
    first = p.state("dim").table.manifest()
    assert first["n"] == 50 and len(first["ranges"]) == 50
    results = p.run({"stg": extract(spark, ("k5", 2, "B"), ("k6", 2, "B"))}, "n2", T0 + timedelta(1), record=False)
    second = p.state("dim").table.manifest()
    moved = {k for k in second["ranges"] if second["ranges"][k] != first["ranges"].get(k)}
    assert results[-1]["row_count"] == 1002 and 1 <= len(moved) <= 2 and content(p.read("dim")) == content(p.state("dim").view())
    done = p.rollback("dim", T0 + timedelta(2), to_batch_id="n1", dry_run=False)["refresh"]
    assert done["row_count"] == 1000 and done["written"] < 100 and content(p.read("dim")) == content(p.state("dim").view())
    back = p.restore("dim")["refresh"]
    assert back["row_count"] == 1002 and back["written"] < 100
    assert p.state("dim").refresh() == {"ok": True, "row_count": 1002, "written": 0}  # nothing to do


def test_ranges_do_not_follow_the_rows(spark, tmp_path):
    """Folders of a version are bounded, however many rows there are to a range; touched ranges alone are written."""
    spec = DimensionSpec("dim", "stg", ("k",), "d")
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    p.state("dim").table.range_rows = 1
    p.run({"stg": spark.range(3000).selectExpr("concat('k', id) as k", "date'2024-01-01' as d", "'A' as attribute_hash")}, "n1", T0, record=False)
    first = p.state("dim").table.manifest()
    assert first["n"] == 256 and set(first["ranges"]) == set(map(str, range(256))) and sum(first["rows"].values()) == 3000
    results = p.run({"stg": extract(spark, ("k5", 2, "B"), ("k6", 2, "B"))}, "n2", T0 + timedelta(1), record=False)
    second = p.state("dim").table.manifest()
    assert results[-1]["row_count"] == 3002 and 1 <= sum(second["ranges"][k] != first["ranges"][k] for k in first["ranges"]) <= 2
    assert content(p.read("dim")) == content(p.state("dim").view())


def test_approval_shuffles_no_batch(spark, tmp_path):
    """What is published is told by its batch where it is read; a shuffle by batch would put all rows of one into one task."""
    spec = DimensionSpec("dim", "stg", ("k",), "d")
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    for day, n in ((1, 20), (2, 30)):
        p.run({"stg": extract(spark, *[(f"k{i}", day, f"A{day}") for i in range(n)])}, f"n{day}", T0 + timedelta(day), record=False)
    p.rollback("dim", T0 + timedelta(3), to_batch_id="n1", dry_run=False)
    for found in (p.state("dim").view(), p.state("dim").history(approved=True)):
        assert {(r["_batch_id"], r["count"]) for r in found.groupBy("_batch_id").count().collect()} == {("n1", 20)}
        assert "hashpartitioning(_batch_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_snapshots_append_to_their_ranges(spark, tmp_path):
    spec = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("attribute_hash",))
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    p.state("fact").table.range_rows, p.state("fact").table.parts = 10, 3
    for day in range(1, 7):
        written = p.run({"stg": extract(spark, *[(f"k{i}", day, "A") for i in range(60)]).withColumn(f"c{day}", F.lit(day))}, f"n{day}", T0 + timedelta(day), record=False)
        assert written[-1]["row_count"] == 60 * day and content(p.read("fact")) == content(p.state("fact").view())
    assert max(len(v) for v in p.state("fact").table.manifest()["ranges"].values()) <= 3
    p.rollback("fact", T0 + timedelta(9), to_batch_id="n3", dry_run=False)
    assert p.read("fact").count() == 180 and content(p.read("fact")) == content(p.state("fact").view())


def test_presentation_without_batches_is_written_whole(spark, tmp_path):
    spec = DimensionSpec("dim", "stg", ("k",), "d", presentation_exclude=("_batch_id", "valid_to"))
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    for i in (1, 2):
        p.run({"stg": extract(spark, ("a", i, str(i)), ("b", i, "x"))}, f"n{i}", T0 + timedelta(i), record=False)
        assert content(p.read("dim")) == content(p.state("dim").view())


# ------------------------------------------------------------------ ledgers
def test_two_writers_lose_no_event(spark, tmp_path):
    errors = []

    def work(name):
        try:
            log = Ledger(spark, f"{tmp_path}/l")
            log.log.every = 5
            for i in range(12):
                log.approve("m", f"{name}{i}", T0 + timedelta(i))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=partial(work, n)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    reader = Ledger(spark, f"{tmp_path}/l")
    assert not errors and reader.approved("m") == {f"{n}{i}" for n in "ab" for i in range(12)}
    names = [x.name for x in (tmp_path / "l").iterdir()]
    assert sum(n.endswith(".json") for n in names) == 24 and any(n.endswith(".sum") for n in names)


def test_readers_write_nothing_and_sums_end_before_what_is_not_whole(spark, tmp_path):
    log = EventLog(spark, f"{tmp_path}/l", lambda s, e: [*s, e["x"]], list, fold=3)
    for x in range(2):
        log.add(x=x)
    (tmp_path / "l" / f"{2:010d}.json").write_text('{"x": 2')  # by a tool that writes in place, and slowly
    for x in range(3, 9):
        log.add(x=x)
    assert not [n for n in log.folder.names() if n.endswith(".sum")]
    assert EventLog(spark, f"{tmp_path}/l", log.step, list, fold=1).replay()[0] == [0, 1, 3, 4, 5, 6, 7, 8]
    (tmp_path / "l" / f"{2:010d}.json").write_text('{"x": 2}\n')
    fresh = EventLog(spark, f"{tmp_path}/l", log.step, list, fold=3)
    assert fresh.replay()[0] == list(range(9)) and not [n for n in log.folder.names() if n.endswith(".sum")]
    fresh.add(x=9)
    assert [n for n in log.folder.names() if n.endswith(".sum")] and fresh.replay()[0] == list(range(10))


def test_a_run_that_was_overtaken_is_fenced(spark, tmp_path):
    slow, fast = (Pipeline(spark, str(tmp_path), Registry([DIM])) for _ in range(2))
    slow.build("dim", extract(spark, ("x", 1, "A")), "n1", T0)
    fast.run({"stg": extract(spark, ("x", 2, "B"))}, "n2", T0, record=False)  # clears n1's pending rows
    with pytest.raises(Fenced):
        slow.approve("dim", "n1", T0, "pass")
    assert fast.state("dim").approved() == {"n2"} and fast.read("dim").count() == 1


def test_records_are_kept_by_key(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path), Registry([DIM, FACT]))
    source = {"stg": extract(spark, ("x", 1, "A"))}
    for _ in range(2):
        p.run(source, "20240601", T0)
    p.run(source, "20240602", T0, ["dim"])
    p.run(source, "20240602", T0, ["fact"])  # another part of the same invocation
    for table, keys in (("run_results", ["invocation_id", "node_id"]), ("nodes", ["invocation_id", "node_id"]), ("edges", ["invocation_id", "parent_id", "child_id"])):
        rows = spark.read.parquet(f"{tmp_path}/operations/{table}")
        assert rows.count() == rows.select(*keys).distinct().count() > 0
    rows = spark.read.parquet(f"{tmp_path}/operations/run_results")
    assert rows.groupBy("invocation_id").count().where("count <> 6").count() == 0
    p.run(source, "20240602", T0, ["dim"], invocation_id="again")
    assert spark.read.parquet(f"{tmp_path}/operations/run_results").where("invocation_id = 'again' and run_id = '20240602'").count() == 2


# ------------------------------------------------------------------ as-of joins, gates
def test_as_of_join_equals_the_interval_join(spark):
    rng = random.Random(3)
    start = date(2024, 1, 1)
    versions = [(rng.choice(["a", "b", None]), 1, start + timedelta(d), f"v{d}") for d in range(0, 60, 7)] + [("c", 2, None, "no date"), ("c", 2, start, "c0")]
    v = spark.createDataFrame(versions, "k string, j int, valid_from date, name string").dropDuplicates(["k", "j", "valid_from"])
    v = views.candidate(v, DimensionSpec("dim", "s", ("k", "j"), "valid_from"))
    v = v.withColumn("valid_to", F.when(F.col("name") == "v14", F.col("valid_from") + F.expr("interval 2 day")).otherwise(F.col("valid_to")).cast("date"))  # a gap
    facts = [(rng.choice(["a", "b", "c", "z", None]), rng.choice([1, 2]), None if i % 17 == 0 else start + timedelta(rng.randrange(-5, 70)), i) for i in range(300)]
    f = spark.createDataFrame(facts, "k string, j int, day date, n int")
    plain = f.alias("f").join(v.alias("v"), F.expr("f.k = v.k and f.j = v.j and f.day >= v.valid_from and f.day < v.valid_to"), "left").select("f.*", "v.name")
    for how in ("left", "inner"):
        got = views.join_as_of(f, v, ["k", "j"], "day", ["name"], how)
        assert content(got) == content(plain if how == "left" else plain.where("name is not null"))
    noon = f.withColumn("day", F.col("day").cast("timestamp") + F.expr("interval 12 hour"))
    assert sorted(r.name or "" for r in views.join_as_of(noon, v, ["k", "j"], "day", ["name"]).collect()) == sorted(r.name or "" for r in plain.collect())
    with pytest.raises(ValueError):
        views.join_as_of(f, v, ["k"], "day", ["name"], "full")


def test_a_hot_key_costs_its_facts_plus_its_versions(spark):
    versions = spark.range(10_000).select(F.lit("hot").alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int")).alias("valid_from"), F.col("id").alias("name"))
    v = views.candidate(versions, DimensionSpec("dim", "s", ("k",), "valid_from"))
    facts = spark.range(100_000).select(F.lit("hot").alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 9_000).cast("int")).alias("day"), "id")
    got = views.join_as_of(facts, v, ["k"], "day", ["name"])
    assert got.where("name <> id % 9000 or name is null").count() == 0 and got.count() == 100_000
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") >= 1 and ">=" not in "".join(x for x in plan.splitlines() if "Join" in x)  # equi-joins alone


def test_null_keys_are_told_without_a_group(spark):
    spec = DimensionSpec("dim", "stg", ("k",), "d", dist_column="k")
    rows = spark.range(50_000).select(F.lit(None).cast("string").alias("k"), F.lit("s").alias("dim_sk"), F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit(1).alias("is_current"), F.lit("h").alias("attribute_hash"))
    found = gates._of_groups(rows, spec)
    assert {r.failure_reason: r["count"] for r in found.groupBy("failure_reason").count().collect()} == {gates.NULL_KEY: 50_000, gates.DUPLICATE_KEY: 1, gates.SEVERAL_CURRENT: 1}
    assert "array_repeat" not in found._jdf.queryExecution().optimizedPlan().toString()


# ------------------------------------------------------------------ buckets, volumes, descriptions
def test_two_tables_of_equal_buckets_join_without_an_exchange(spark, tmp_path):
    dim = DimensionSpec("dim", "stg", ("k",), "d", dist_buckets=3, description="all about k")
    fact = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("attribute_hash",), dist_buckets=3)
    p = Pipeline(spark, f"{tmp_path}/it's", Registry([dim, fact]))
    for day in (1, 2, 3):
        p.run({"stg": extract(spark, *[(f"k{i}", day, f"{i % day}") for i in range(50)])}, f"n{day}", T0 + timedelta(day), record=False)
        for name in ("dim", "fact"):
            assert content(p.distributed(name)) == content(p.read(name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = p.distributed("fact").join(p.distributed("dim").where("is_current = 1").select("k", "valid_from"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 150
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert p.description("dim") == "all about k" and len([x for x in (tmp_path / "it's" / "dim" / "published").iterdir() if x.name.startswith("b=")]) == 2
    plain = Pipeline(spark, f"{tmp_path}/plain", Registry([DIM]))
    assert plain.distributed("dim") is None and plain.description("dim") == ""


def test_kept_volumes_equal_the_scan_and_go_with_their_batch(spark, tmp_path):
    spec = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("attribute_hash",), volume_window=3)
    p = Pipeline(spark, str(tmp_path), Registry([spec]))
    s = p.state("fact")
    for day in range(1, 6):
        got = p.run({"stg": extract(spark, *[(f"k{i}", day, "A") for i in range(10 if day < 5 else 2)])}, f"n{day}", T0 + timedelta(day), record=False)
        assert s.store.volumes(3) == gates.recent_volumes(s.store.read(), "snapshot_date", 3)
    assert got[-1]["status"] == "skipped"  # the fifth is below half of the mean
    s.store.purge(s.approved())
    assert s.store.volumes(1) == [(date(2024, 1, 4), 10)]
    s.store.folder.delete("volumes/n2")
    assert s.store.volumes(3) is None  # a batch without them: the guard scans
