"""Truth tables and properties of history, views and gates."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strata.functions.types import DriftError
from strata.operators import gates, views
from strata.operators.history import changed_versions, snapshot_rows
from strata.spec import DimensionSpec, SnapshotSpec

SPEC = DimensionSpec("dim", "stg", ("k",), "d")
AT = "2024-06-01 10:00:00.75"
SCHEMA = "k string, d string, attribute_hash string, v string"


def source(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumn("d", F.col("d").cast("date"))


def versions(df):
    return sorted((r.k or "", str(r.valid_from), r.attribute_hash or "") for r in df.collect())


def rows(*parts):
    return [(k, f"2024-01-{d:02d}", h, h) for k, d, h in parts]


def test_changes_and_intervals(spark):
    h = changed_versions(source(spark, rows(("x", 1, "A"), ("x", 2, "A"), ("x", 3, "B"), ("x", 4, "A"))), SPEC, "b1", AT)
    assert versions(h) == [("x", "2024-01-01", "A"), ("x", "2024-01-03", "B"), ("x", "2024-01-04", "A")]
    assert h.columns == ["dim_sk", "k", "valid_from", "attribute_hash", "v", "_batch_id", "_loaded_at"]
    assert str(h.first()._loaded_at) == "2024-06-01 10:00:00"
    c = sorted((str(r.valid_from), str(r.valid_to), r.is_current) for r in views.candidate(h, SPEC).collect())
    assert c == [("2024-01-01", "2024-01-03", 0), ("2024-01-03", "2024-01-04", 0), ("2024-01-04", "9999-12-31", 1)]


def test_second_batch_stitches_and_ignores_late_rows(spark):
    h = changed_versions(source(spark, rows(("x", 5, "A"), ("y", 5, "A"))), SPEC, "b1", AT)
    late = rows(("x", 6, "A"), ("x", 7, "B"), ("y", 6, "B"), ("new", 5, "A"), ("new2", 4, "A"), ("y", 5, "Z"))
    assert versions(changed_versions(source(spark, late), SPEC, "b2", AT, h)) == [("x", "2024-01-07", "B"), ("y", "2024-01-06", "B")]


def test_nulls_and_repeats(spark):
    h = changed_versions(source(spark, rows(("x", 1, "B"), ("x", 1, "A"), ("x", 1, "A"))), SPEC, "b1", AT)
    assert versions(h) == [("x", "2024-01-01", "A")]
    more = [("x", "2024-01-02", None, None), ("n", "2024-01-02", None, None), ("m", None, "A", "A")]
    assert versions(changed_versions(source(spark, more), SPEC, "b2", AT, h)) == [("n", "2024-01-02", "")]
    assert ("m", "None", "A") in versions(changed_versions(source(spark, more), SPEC, "b1", AT))


def test_dedupe_order_may_fall(spark):
    spec = DimensionSpec("dim", "stg", ("k",), "d", dedupe=("v desc",))
    h = changed_versions(source(spark, [("x", "2024-01-01", "A", "1"), ("x", "2024-01-01", "B", "2")]), spec, "b1", AT)
    assert versions(h) == [("x", "2024-01-01", "B")]


def test_batches_in_order_equal_one_run(spark):
    rng = random.Random(5)
    data = [(f"k{rng.randrange(6)}", f"2024-01-{rng.randrange(1, 20):02d}", rng.choice("ABC"), "v") for _ in range(120)]
    whole = changed_versions(source(spark, data), SPEC, "b", AT)
    found = None
    for lo, hi in ((1, 5), (6, 12), (13, 20)):
        part = source(spark, [r for r in data if lo <= int(r[1][-2:]) <= hi])
        new = changed_versions(part, SPEC, "b", AT, found)
        found = new if found is None else found.unionByName(new)
        found = spark.createDataFrame(found.collect(), found.schema)
    assert versions(found) == versions(whole)
    assert changed_versions(source(spark, data), SPEC, "again", AT, found).count() == 0
    c = views.candidate(found, SPEC).collect()
    for k in {r.k for r in c}:
        mine = sorted((r for r in c if r.k == k), key=lambda r: r.valid_from)
        assert [a.valid_to for a in mine[:-1]] == [b.valid_from for b in mine[1:]]
        assert [r.is_current for r in mine] == [0] * (len(mine) - 1) + [1]
        assert all(a.attribute_hash != b.attribute_hash for a, b in zip(mine, mine[1:]))


def test_approval_comes_before_validity(spark):
    h = changed_versions(source(spark, rows(("x", 1, "A"), ("x", 2, "B"), ("x", 3, "C"))), SPEC, "b", AT).withColumn("_batch_id", F.concat(F.lit("b"), F.dayofmonth("valid_from").cast("string")))
    ledger = spark.createDataFrame([("dim__history", "b1"), ("dim__history", "b3"), ("other", "b2")], "model_name string, batch_id string")
    found = sorted((str(r.valid_from), str(r.valid_to)) for r in views.published(h, ledger, SPEC).collect())
    assert found == [("2024-01-01", "2024-01-03"), ("2024-01-03", "9999-12-31")]
    assert views.as_of(views.published(h, ledger, SPEC), "2024-01-02").count() == 1


def test_snapshots_repeat_unchanged_rows(spark):
    spec = SnapshotSpec("fact", "stg", ("k",), "d", dedupe=("v",))
    data = source(spark, [("x", "2024-01-01", "h", "2"), ("x", "2024-01-01", "h", "1"), ("x", "2024-01-02", "h", "1")])
    h = snapshot_rows(data, spec, "b1", AT)
    assert sorted((str(r.snapshot_date), r.v) for r in h.collect()) == [("2024-01-01", "1"), ("2024-01-02", "1")]
    assert snapshot_rows(data, spec, "b2", AT, h).count() == 0


def test_drift(spark):
    h = changed_versions(source(spark, rows(("x", 1, "A"))), SPEC, "b1", AT)
    wider = source(spark, [("x", "2024-01-02", "B", "new")], "k string, d string, attribute_hash string, w string")
    new = changed_versions(wider, SPEC, "b2", AT, h)
    assert new.columns[4:6] == ["w", "v"] and new.first().v is None and dict(new.dtypes)["v"] == "string"
    with pytest.raises(DriftError):
        changed_versions(source(spark, [("x", "2024-01-02", "B", 1)], "k string, d string, attribute_hash string, v int"), SPEC, "b2", AT, h)
    with pytest.raises(DriftError):
        changed_versions(source(spark, [("x", "2024-01-02", "B", [1])], "k string, d string, attribute_hash string, v array<int>"), SPEC, "b2", AT, h)


def test_each_defect_trips_its_gate(spark):
    src = source(spark, rows(("x", 1, "A"), ("y", 1, "A"), ("x", 2, "B"), ("y", 2, "A")))
    good = views.candidate(changed_versions(src, SPEC, "b1", AT), SPEC)
    reasons = lambda s, c: sorted({r.failure_reason for r in gates.dimension_gates(s, c, SPEC).collect()})
    assert reasons(src, good) == []
    assert reasons(src, good.unionByName(good.where("k = 'x' and is_current = 0"))) == [gates.DUPLICATE_KEY]
    assert reasons(src, good.unionByName(good.where("k = 'x' and is_current = 1").withColumn("dim_sk", F.lit("other")))) == [gates.SEVERAL_CURRENT]
    assert reasons(src, good.unionByName(good.where("k = 'y'").withColumns({"k": F.lit(None).cast("string"), "dim_sk": F.lit("n")}))) == [gates.NULL_KEY]
    assert reasons(src, good.where("k = 'y'")) == [gates.NOT_RECONCILED]
    assert reasons(src.unionByName(source(spark, rows(("x", 2, "Z")))), good) == [gates.NOT_RECONCILED]
    vanished = source(spark, rows(("x", 1, "A"), ("y", 1, "A"), ("x", 2, "B")))
    assert reasons(vanished, views.candidate(changed_versions(vanished, SPEC, "b1", AT), SPEC)) == []  # a hard delete stays current
    empty = src.where("false")
    assert reasons(empty, good) == []


def test_volume_guard_is_strict(spark):
    day = lambda d, n: [(f"k{i}", str(date(2024, 1, 1) + timedelta(d)), "h", "v") for i in range(n)]
    # mean over both dates, the latest included: (9 + 3) / 2 = 6, half of it 3
    assert gates.volume_guard(source(spark, day(0, 9) + day(1, 3)), "d", 0.5, 7).count() == 0
    assert gates.volume_guard(source(spark, day(0, 10) + day(1, 3)), "d", 0.5, 7).count() == 1
    assert gates.volume_guard(source(spark, day(0, 1)).where("false"), "d", 0.5, 7).count() == 0
