"""Registered queries of the history engine over the driver's tables, each with its SQL where SQL can express it.

Dates leave as ISO text, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.hashing import deterministic_hash
from strata.functions.keys import key_display, surrogate_key
from strata.functions.types import conform_schema
from strata.operators import checks, conform, events, gates, views
from strata.operators.history import changed_versions, snapshot_rows
from strata.plans.artifacts import edge_frame
from strata.plans.pipeline import Pipeline
from strata.plans.rollback import affected_batches, restore_orphans
from strata.sources.latest import LatestState
from strata.sources.scratch import scratch_path, written
from strata.sources.store import BatchStore
from strata.spec import DimensionSpec, ExposureSpec, Registry, SnapshotSpec
from strata.streaming.ingest import ingest_available

LOADED = "2024-06-01 00:00:00"
CUT = "2024-01-15"
AS_OF = "2024-01-25"

USERS = DimensionSpec("dim_user", "stg_users", ("user_id",), "extract_date", presentation_exclude=("attribute_hash",))
CUSTOMERS = DimensionSpec("dim_customer", "stg_orders", ("o_custkey",), "extract_date")
LINES = DimensionSpec("dim_line", "stg_lines", ("l_orderkey", "l_linenumber"), "extract_date")
ACTIVITY = SnapshotSpec("fact_activity", "stg_activity", ("user_id",), "extract_date", dedupe=("event_id",), presentation_exclude=("event_type",))
REGISTRY = Registry([USERS, CUSTOMERS, LINES, ACTIVITY], [ExposureSpec("user_board", ("dim_user", "fact_activity"), "analytics")])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _plain(df: DataFrame) -> DataFrame:
    dates = {f.name: F.date_format(f"`{f.name}`", "yyyy-MM-dd") for f in df.schema.fields if isinstance(f.dataType, T.DateType)}
    return df.withColumns(dates).drop("_loaded_at") if dates else df.drop("_loaded_at")


def _hash(*columns: str):
    return F.upper(F.md5(F.encode(F.concat_ws("|", *columns), "UTF-8"))).alias("attribute_hash")


# ------------------------------------------------------------------ sources
def user_source(spark, sf):
    return _table(spark, sf, "events").select("user_id", F.to_date("ts").alias("extract_date"), "event_type", _hash("event_type"))


def order_source(spark, sf):
    return _table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("extract_date"), "o_orderstatus", "o_orderpriority", _hash("o_orderstatus", "o_orderpriority"))


def line_source(spark, sf):
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("extract_date"), "l_returnflag", "l_linestatus", _hash("l_returnflag", "l_linestatus"))


def activity_source(spark, sf):
    return _table(spark, sf, "events").select("user_id", F.to_date("ts").alias("extract_date"), "event_id", "event_type")


E_SQL = "(select user_id, cast(ts as date) extract_date, event_type, upper(md5(event_type)) attribute_hash from events)"
O_SQL = "(select o_custkey, cast(o_orderdate as date) extract_date, o_orderstatus, o_orderpriority, upper(md5(o_orderstatus || '|' || o_orderpriority)) attribute_hash from orders)"
L_SQL = "(select l_orderkey, l_linenumber, cast(l_shipdate as date) extract_date, l_returnflag, l_linestatus, upper(md5(l_returnflag || '|' || l_linestatus)) attribute_hash from lineitem)"
A_SQL = "(select user_id, cast(ts as date) extract_date, event_id, event_type from events)"


def _sk_sql(keys: list[str], date: str) -> str:
    return "upper(md5(concat(" + ", ".join(f"cast({k} as varchar), '||'" for k in keys) + f", strftime({date}, '%Y-%m-%d'))))"


def _versions_sql(source: str, keys: list[str], attributes: list[str], name: str, batch: str = "'b1'", where: str = "true", stored: str = "cast(null as varchar)", join: str = "") -> str:
    """Changed versions as a select; ``valid_from`` stays a date."""
    k, a = ", ".join(keys), "".join(f", {x}" for x in attributes)
    return f"""(with d as (select *, row_number() over (partition by {k}, extract_date order by attribute_hash nulls first{a}) rn from {source} where {where}),
      l as (select d.*, coalesce(lag(attribute_hash) over (partition by {k} order by extract_date), {stored}) p from d {join} where rn = 1)
      select {_sk_sql(keys, "extract_date")} {name}_sk, {k}, extract_date valid_from, attribute_hash{a}, {batch} _batch_id from l where p is null or p <> attribute_hash)"""


USER_VERSIONS = _versions_sql(E_SQL, ["user_id"], ["event_type"], "dim_user")
_WEEK_SQL = "strftime(valid_from, '%Y') || 'w' || cast(cast(extract(day from valid_from) - 1 as bigint) // 7 as varchar)"
USER_WEEKS = f"(select * replace ({_WEEK_SQL} as _batch_id) from {USER_VERSIONS})"
APPROVED_WEEKS = ("2024w0", "2024w1", "2024w3")
_APPROVED_SQL = "(" + ", ".join(f"'{w}'" for w in APPROVED_WEEKS) + ")"


def _validity_sql(source: str, keys: str = "user_id") -> str:
    return f"""(select *, coalesce(lead(valid_from) over w, date '9999-12-31') valid_to, case when lead(valid_from) over w is null then 1 else 0 end is_current
      from {source} window w as (partition by {keys} order by valid_from))"""


USER_VALID = _validity_sql(USER_VERSIONS)
_OUT = "dim_user_sk, user_id, strftime(valid_from, '%Y-%m-%d') valid_from, attribute_hash, event_type, _batch_id"
_OUT_VALID = f"{_OUT}, strftime(valid_to, '%Y-%m-%d') valid_to, is_current"


def user_versions(spark, sf):
    return changed_versions(user_source(spark, sf), USERS, "b1", LOADED)


def user_weeks(spark, sf):
    """Versions in batches by week of the month."""
    week = F.concat(F.date_format("valid_from", "yyyy"), F.lit("w"), F.floor((F.dayofmonth("valid_from") - 1) / 7).cast("string"))
    return user_versions(spark, sf).withColumn("_batch_id", week)


def ledger_frame(spark):
    return spark.createDataFrame([(USERS.model, w) for w in APPROVED_WEEKS], "model_name string, batch_id string").withColumn("approved_at", F.lit(LOADED).cast("timestamp"))


# ------------------------------------------------------------------ damaged frames, for gates
def damaged_users(spark, sf):
    """Candidate with repeated rows (keys that end in 7), a null key (those of 11) and lost rows (those that end in 3)."""
    c = views.candidate(user_versions(spark, sf), USERS)
    twice = c.where("user_id % 10 = 7 and is_current = 1")
    nulls = c.where("user_id = 11").withColumn("user_id", F.lit(None).cast("bigint")).withColumn("dim_user_sk", F.concat(F.lit("N"), "dim_user_sk"))
    return c.where("not (user_id % 10 = 3 and is_current = 1)").unionByName(twice).unionByName(nulls)


DAMAGED = f"""(select * from {USER_VALID} where not (user_id % 10 = 3 and is_current = 1)
  union all select * from {USER_VALID} where user_id % 10 = 7 and is_current = 1
  union all select * replace (cast(null as bigint) as user_id, 'N' || dim_user_sk as dim_user_sk) from {USER_VALID} where user_id = 11)"""


def damaged_activity(spark, sf):
    """Snapshots that lack the latest date's even users."""
    h = snapshot_rows(activity_source(spark, sf), ACTIVITY, "b1", LOADED)
    return h.where("not (user_id % 2 = 0 and snapshot_date = date'2024-01-30')")


_SNAP = """(select upper(md5(concat(cast(user_id as varchar), '||', strftime(extract_date, '%Y-%m-%d')))) fact_activity_sk, user_id, extract_date snapshot_date, event_id, event_type, 'b1' _batch_id
  from (select *, row_number() over (partition by user_id, extract_date order by event_id) rn from """ + A_SQL + ") where rn = 1)"
_SNAP_DAMAGED = f"(select * from {_SNAP} where not (user_id % 2 = 0 and snapshot_date = date '2024-01-30'))"


def truncated_users(spark, sf):
    """The source with its latest date cut to a tenth of its users: a truncated extract."""
    return user_source(spark, sf).where("extract_date < date'2024-01-30' or user_id % 10 = 0")


_TRUNCATED = f"(select * from {E_SQL} where extract_date < date '2024-01-30' or user_id % 10 = 0)"


def _reconciliation_sql(source: str, versions: str) -> str:
    return f"""select '{gates.NOT_RECONCILED}' failure_reason, cast(l.user_id as varchar) offending_key from {source} l
      where l.extract_date = (select max(extract_date) from {source}) and not exists (select 1 from {versions} c where c.is_current = 1 and c.user_id = l.user_id and c.attribute_hash = l.attribute_hash)"""


def _volume_sql(source: str, date: str, reason: str) -> str:
    return f"""select '{reason}' failure_reason, cast(null as varchar) offending_key
      where (select count(*) from {source} where {date} = (select max({date}) from {source})) < 0.5 * coalesce((select avg(cast(n as double)) from (select count(*) n from {source} group by {date} order by {date} desc limit 7)), 0)"""


_DUP_SQL = f"select '{gates.DUPLICATE_KEY}' failure_reason, dim_user_sk offending_key from {DAMAGED} group by dim_user_sk having count(*) > 1"
_NULL_SQL = f"select '{gates.NULL_KEY}' failure_reason, cast(user_id as varchar) offending_key from {DAMAGED} where dim_user_sk is null or valid_from is null or user_id is null"
_MULTI_SQL = f"select '{gates.SEVERAL_CURRENT}' failure_reason, cast(user_id as varchar) offending_key from {DAMAGED} where is_current = 1 group by user_id having count(*) > 1"
_COMPLETE_SQL = f"""select '{gates.INCOMPLETE}' failure_reason, cast(l.user_id as varchar) offending_key from {A_SQL} l
  where l.extract_date = (select max(extract_date) from {A_SQL}) and not exists (select 1 from {_SNAP_DAMAGED} c where c.snapshot_date = (select max(snapshot_date) from {_SNAP_DAMAGED}) and c.user_id = l.user_id)"""


# ------------------------------------------------------------------ conformance inputs
def nations(spark, sf):
    return _table(spark, sf, "nation").select(F.col("n_name").alias("code"), F.concat(F.lit("Nação "), F.col("n_nationkey").cast("string")).alias("name"))


def overrides(spark):
    rows = [("CRM", "code", "nation_24x", "NATION_3", ""), ("crm", "code", " NATION_1 ", "NATION_2", ""), ("CRM", "code", "NATION_4", "NATION_99", ""), ("CRM", "code", "NATION_6", None, ""), ("CRM", "name", "nacao 5", "NATION_7", "")]
    return spark.createDataFrame(rows, "source_system string, match_key string, source_value string, canonical_country_code string, note string")


_OVERRIDES_SQL = """(values ('CRM','code','nation_24x','NATION_3'), ('crm','code',' NATION_1 ','NATION_2'), ('CRM','code','NATION_4','NATION_99'), ('CRM','code','NATION_6',null), ('CRM','name','nacao 5','NATION_7')) o(source_system, match_key, source_value, canonical_country_code)"""


def customer_codes(spark, sf):
    nation = F.col("c_nationkey").cast("string")
    return _table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  nation_"), nation, F.when(F.col("c_nationkey") >= 23, "X ").otherwise(" ")).alias("value"))


def customer_names(spark, sf):
    nation = F.col("c_nationkey").cast("string")
    return _table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_nationkey") % 2 == 0, " NACAO ").otherwise("nação "), nation, F.when(F.col("c_nationkey") >= 22, "?").otherwise("")).alias("value"))


_CODES_SQL = "(select c_custkey, '  nation_' || c_nationkey || case when c_nationkey >= 23 then 'X ' else ' ' end as value from customer)"
_NAMES_SQL = "(select c_custkey, case when c_nationkey % 2 = 0 then ' NACAO ' else 'nação ' end || c_nationkey || case when c_nationkey >= 22 then '?' else '' end as value from customer)"
_NATIONS_SQL = "(select n_name code, 'Nação ' || n_nationkey as name from nation)"


def _conform(spark, sf, source, match_key):
    return conform.country_conform(source, nations(spark, sf), overrides(spark), system="CRM", match_key=match_key, source_column="value", code_column="code", name_column="name")


def _conform_sql(source: str, match_key: str) -> str:
    key = (lambda x: f"upper(trim({x}))") if match_key == "code" else (lambda x: f"strip_accents(lower(trim({x})))")
    return f"""select s.c_custkey, s.value, coalesce(o.canonical_country_code, m.code) canonical_country_code, n.name canonical_country_name,
      case when o.canonical_country_code is not null then 'override' when m.code is not null then 'exact_{match_key}' else 'unmatched' end country_match_status
      from {source} s left join (select * from {_OVERRIDES_SQL} where upper(trim(source_system)) = 'CRM' and match_key = '{match_key}') o on {key("s.value")} = {key("o.source_value")}
      left join {_NATIONS_SQL} m on {key("s.value")} = {key(f"m.{match_key}")} left join {_NATIONS_SQL} n on upper(trim(n.code)) = upper(trim(coalesce(o.canonical_country_code, m.code)))"""


# ------------------------------------------------------------------ hashes
def _hash_sql(columns: list[str], f: str, chunk: int = 125) -> str:
    layer = [f"upper({f}(coalesce(cast({c} as varchar), '<<NULL>>')))" for c in sorted(columns)]
    while len(layer) > 1:
        layer = [f"upper({f}({' || '.join(layer[i : i + chunk])}))" for i in range(0, len(layer), chunk)]
    return layer[0]


def _fold_sql(texts: list[str]) -> str:
    """SHA-256 tokens of canonical texts, which stand in the order of their columns' names, folded once."""
    return "upper(sha256(" + " || ".join(f"upper(sha256(coalesce({t}, '<<NULL>>')))" for t in texts) + "))"


def _hashed(key: str, table: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf):
        df = _table(spark, sf, table)
        return df.select(key, deterministic_hash(df, **options).alias("row_hash"))

    return query


def _json_events(spark, sf):
    """Events with their k in both parameter forms: object for even ids, array for odd ones."""
    k = F.get_json_object("props", "$.k")
    obj = F.concat(F.lit('{"session_number":{"int_value":'), k, F.lit('},"page_title":{"string_value":"p'), k, F.lit('"}}'))
    arr = F.concat(F.lit('[{"key":"session_number","value":{"int_value":"'), k, F.lit('"}},{"key":"page_title","value":{"string_value":"p'), k, F.lit('"}}]'))
    return _table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, obj).otherwise(arr).alias("event_params"))


# ------------------------------------------------------------------ queries
def scd2_incremental_second_batch(spark, sf):
    source = user_source(spark, sf)
    history = changed_versions(source.where(f"extract_date <= date'{CUT}'"), USERS, "b1", LOADED)
    return _plain(changed_versions(source, USERS, "b2", LOADED, history))


def scd2_point_in_time(spark, sf):
    """Events of each type by the type that the user's version of that day had."""
    facts = _table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("fact_type"))
    versions = views.candidate(user_versions(spark, sf), USERS)
    joined = views.join_as_of(facts, versions, ["user_id"], "day", ["event_type"])
    return joined.groupBy("fact_type", "event_type").agg(F.count("*").alias("n"))


HOT_USER = "case when event_id % 3 = 0 then 1 else user_id end"


def point_in_time_hot_key(spark, sf):
    """As :func:`scd2_point_in_time`, with a third of all events on one user."""
    facts = _table(spark, sf, "events").select(F.expr(HOT_USER).alias("user_id"), F.col("ts").alias("at"), F.col("event_type").alias("fact_type"))
    joined = views.join_as_of(facts, views.candidate(user_versions(spark, sf), USERS), ["user_id"], "at", ["event_type", "valid_from"], "inner")
    return _plain(joined.groupBy("fact_type", "event_type", "valid_from").agg(F.count("*").alias("n")))


def _one_a_day(source: DataFrame) -> DataFrame:
    """A row of each user and date, the one that history keeps: of several hashes on the latest date the gates would block the batch."""
    return source.groupBy("user_id", "extract_date").agg(F.min(F.struct("attribute_hash", *(c for c in source.columns if c not in ("user_id", "extract_date", "attribute_hash")))).alias("r")).select("user_id", "extract_date", "r.*").select(source.columns)


WEEK = "date_format(extract_date, 'yyyy') || 'w' || cast(floor((dayofmonth(extract_date) - 1) / 7) as string)"


def _weekly(spark, spec, source) -> Pipeline:
    """A pipeline that has taken the source in by weeks of the month: an extract of several files each, by a stream."""
    p = Pipeline(spark, scratch_path(spark, "warehouse"), Registry([spec]))
    p.state(spec.name).table.range_rows = 500
    rows = source.withColumn("_week", F.expr(WEEK)).persist()
    extracts, loaded = scratch_path(spark, "extracts"), datetime(2024, 6, 1)
    for i, (week,) in enumerate(sorted(rows.select("_week").distinct().collect())):  # one a week of the month
        rows.where(F.col("_week") == week).drop("_week").repartition(4).write.parquet(f"{extracts}/{week}")
        ingest_available(spark, p, spec.name, extracts, source.schema, f"{extracts}-checkpoint", loaded + timedelta(days=i))
    rows.unpersist()
    return p


def intake_extracts(spark, sf):
    """The published dimension after a stream of weekly extracts, the last of them rolled back and restored."""
    p = _weekly(spark, USERS, _one_a_day(user_source(spark, sf)))
    p.rollback(USERS.name, datetime(2024, 7, 1), to_batch_id=sorted(p.state(USERS.name).approved())[1], dry_run=False)
    p.restore(USERS.name)
    return _plain(p.read(USERS.name))


def publish_after_rollback(spark, sf):
    """What is published after all weeks but the first two were rolled back: touched ranges only are written."""
    p = _weekly(spark, USERS, _one_a_day(user_source(spark, sf)))
    p.rollback(USERS.name, datetime(2024, 7, 1), to_batch_id=sorted(p.state(USERS.name).approved())[1], dry_run=False)
    return _plain(p.read(USERS.name))


def latest_state(spark, sf):
    """The stored latest version of every user after weekly batches, some of them folded into a base."""
    weeks, store = user_weeks(spark, sf).persist(), BatchStore(spark, scratch_path(spark, "history"))
    state = LatestState(spark, scratch_path(spark, "latest"), USERS, fold=2)
    batches = {}
    for (week,) in sorted(weeks.select("_batch_id").distinct().collect()):  # one a week of the month
        store.append(weeks.where(F.col("_batch_id") == week), week)
        batches[week] = week
        found, _ = state.read(store, batches)
    weeks.unpersist()
    return _plain(found)


def volumes_kept(spark, sf):
    """Rows of the last seven dates of a fact, as they were kept with its weekly batches."""
    store = BatchStore(spark, scratch_path(spark, "history"))
    rows = snapshot_rows(activity_source(spark, sf), ACTIVITY, "b", LOADED).withColumn("_week", F.weekofyear("snapshot_date")).persist()
    for (week,) in rows.select("_week").distinct().collect():  # one a week
        store.append(rows.where(F.col("_week") == week).drop("_week"), f"w{week}", date_column="snapshot_date")
    rows.unpersist()
    return spark.createDataFrame([(d.isoformat(), n) for d, n in store.volumes(7)], "snapshot_date string, n long")


def distributed_join(spark, sf):
    """Two published tables in buckets of the user, joined without an exchange."""
    dim = replace(USERS, dist_buckets=4, presentation_exclude=())
    fact = replace(ACTIVITY, dist_buckets=4, presentation_exclude=())
    p = Pipeline(spark, scratch_path(spark, "warehouse"), Registry([dim, fact]))
    p.run({dim.source: _one_a_day(user_source(spark, sf)), fact.source: activity_source(spark, sf)}, "b1", datetime(2024, 6, 1), record=False)
    left, right = p.distributed(dim.name).where("is_current = 1"), p.distributed(fact.name)
    return right.join(left.select("user_id", F.col("event_type").alias("now_type")), "user_id").groupBy("event_type", "now_type").agg(F.count("*").alias("n"))


def affected_batches_query(spark, sf):
    ledger = spark.createDataFrame([(USERS.model, "2024w0", "2024-06-01 00:00:00"), (USERS.model, "2024w1", "2024-06-02 00:00:00"), (USERS.model, "2024w3", "2024-06-03 00:00:00"), (USERS.model, "2024w9", "2024-06-03 00:00:01")], "model_name string, batch_id string, approved_at string")
    ledger = ledger.withColumn("approved_at", F.col("approved_at").cast("timestamp"))
    return affected_batches(ledger, user_weeks(spark, sf), USERS.model, "2024-06-02 00:00:00").select("batch_id", "row_count")


def restore_orphans_query(spark, sf):
    restored = spark.createDataFrame([("2024w0",), ("2024w8",), ("2024w9",)], "batch_id string")
    return restore_orphans(restored, user_weeks(spark, sf))


def purge_unapproved(spark, sf):
    """What a store holds after batches were appended, one was compacted and those that no ledger approves were purged."""
    store = BatchStore(spark, scratch_path(spark, "history"))
    weeks = user_weeks(spark, sf).persist()
    for (week,) in sorted(weeks.select("_batch_id").distinct().collect()):  # one a week of the month
        store.append(weeks.where(F.col("_batch_id") == week), week)
    weeks.unpersist()
    store.compact(APPROVED_WEEKS[0])
    store.purge(set(APPROVED_WEEKS))
    return _plain(store.read())


def hash_of_kinds(spark, sf):
    """Hash of instants, plain times, dates, doubles and bytes; doubles are quarters, which both engines print alike."""
    o = _table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    instant = F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000 + F.col("o_orderkey") * 1_000_003)
    df = o.select(
        "o_orderkey", instant.alias("instant"), F.when(F.col("o_orderkey") % 7 > 0, day).alias("day"), (F.floor(F.col("o_totalprice") * 4) / 4).alias("price"),
        F.encode("o_orderpriority", "UTF-8").alias("raw"), F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" 02:30:00.25"))).alias("plain"),
    )
    return df.select("o_orderkey", deterministic_hash(df).alias("row_hash"))


_KINDS_SQL = """(select o_orderkey, cast(o_orderdate as timestamp) + to_microseconds(cast(o_orderkey as bigint) * 1000003) instant, case when o_orderkey % 7 > 0 then cast(o_orderdate as date) end d,
  floor(o_totalprice * 4) / 4 price, encode(o_orderpriority) raw, cast(o_orderdate as date) + interval 2 hour + interval 30 minute + interval 250 millisecond plain from orders)"""


def all_parameters(spark, sf):
    """Every parameter and user property, in the object form for even ids and the array form for odd ones."""
    k = F.get_json_object("props", "$.k")

    def document(names):
        by_key: dict[str, list] = {}
        for _, key, field, kind in names:
            by_key.setdefault(key, []).append((kind, field))
        one = lambda key: F.concat(F.lit("{"), *_fields(by_key[key], key, k), F.lit("}"))
        obj = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{key}":'), one(key)) for key in by_key)), F.lit("}"))
        arr = F.concat(F.lit("["), F.concat_ws(",", *(F.concat(F.lit(f'{{"key":"{key}","value":'), one(key), F.lit("}")) for key in by_key)), F.lit("]"))
        return F.when(F.col("event_id") % 2 == 0, obj).otherwise(arr)

    staged = _table(spark, sf, "events").select("event_id", document(events.PARAMETERS).alias("event_params"), document(events.USER_PROPERTIES).alias("user_properties"))
    return events.flatten(staged).drop("event_params", "user_properties")


def _fields(fields: list[tuple[str, str]], key: str, k) -> list:
    """"field":value pairs of a parameter: numbers bare, texts with the parameter's name before them."""
    out = []
    for i, (kind, field) in enumerate(fields):
        text = k if kind != "string" else F.concat(F.lit(f'"{key}-'), k, F.lit('"'))
        out += [F.lit(("," if i else "") + f'"{field}":'), text]
    return out


def _all_parameters_sql() -> str:
    k = "json_extract_string(props, '$.k')"
    typed = {"string": lambda key: f"'{key}-' || {k}", "int": lambda _: f"cast({k} as integer)", "bigint": lambda _: f"cast({k} as bigint)", "double": lambda _: f"cast({k} as double)"}
    return "select event_id, " + ", ".join(f"{typed[kind](key)} {name}" for name, key, _, kind in [*events.PARAMETERS, *events.USER_PROPERTIES]) + " from events"


def _edges_sql() -> str:
    """The registry's edges, written out."""
    rows = []
    for s, dimension in (("dim_user", True), ("dim_customer", True), ("dim_line", True), ("fact_activity", False)):
        source = {"dim_user": "stg_users", "dim_customer": "stg_orders", "dim_line": "stg_lines", "fact_activity": "stg_activity"}[s]
        checked = f"{s}__candidate" if dimension else f"{s}__history"
        rows += [("source", source, "model", f"{s}__history"), ("model", f"{s}__history", "model", f"{s}__published"), ("model", checked, "test", f"{s}__gates"), ("source", source, "test", f"{s}__gates"), ("model", f"{s}__published", "table", s)]
        rows += [("model", f"{s}__history", "model", f"{s}__candidate")] if dimension else []
    rows += [("table", t, "exposure", "user_board") for t in ("dim_user", "fact_activity")]
    values = ", ".join(f"('run1', '{pt}.{p}', '{p}', '{pt}', '{ct}.{c}', '{c}', '{ct}')" for pt, p, ct, c in rows)
    return f"select * from (values {values}) e(invocation_id, parent_id, parent_name, parent_type, child_id, child_name, child_type)"


def part_with(spark, sf, drop: list[str], add: dict):
    return _table(spark, sf, "part").drop(*drop).withColumns(add)


def _catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    first = f"(select * from {_versions_sql(E_SQL, ['user_id'], ['event_type'], 'dim_user', where=f'''extract_date <= date '{CUT}' ''')})"
    second = _versions_sql(
        E_SQL, ["user_id"], ["event_type"], "dim_user", "'b2'", f"extract_date > (select max(valid_from) from {first})", "e.h",
        f"left join (select user_id u, arg_max(attribute_hash, valid_from) h from {first} group by user_id) e on e.u = d.user_id",
    )
    published = _validity_sql(f"(select * from {USER_WEEKS} where _batch_id in {_APPROVED_SQL})")
    snap_out = "fact_activity_sk, user_id, strftime(snapshot_date, '%Y-%m-%d') snapshot_date, event_id, event_type, _batch_id"
    two_weeks = f"(select * from {USER_WEEKS} where _batch_id in (select _batch_id from {USER_WEEKS} group by 1 order by 1 limit 2))"
    shown = _OUT_VALID.replace(" attribute_hash,", "")
    damaged = lambda f: lambda s, d: f(damaged_users(s, d), USERS)
    part_columns = "p_partkey, p_name, p_brand, p_type, p_size"
    return {
        "scd2_history_events": (lambda s, d: _plain(user_versions(s, d)), f"select {_OUT} from {USER_VERSIONS}"),
        "scd2_history_orders": (
            lambda s, d: _plain(changed_versions(order_source(s, d), CUSTOMERS, "b1", LOADED)),
            f"select * replace (strftime(valid_from, '%Y-%m-%d') as valid_from) from {_versions_sql(O_SQL, ['o_custkey'], ['o_orderstatus', 'o_orderpriority'], 'dim_customer')}",
        ),
        "scd2_history_lineitem_composite": (
            lambda s, d: _plain(changed_versions(line_source(s, d), LINES, "b1", LOADED)),
            f"select * replace (strftime(valid_from, '%Y-%m-%d') as valid_from) from {_versions_sql(L_SQL, ['l_orderkey', 'l_linenumber'], ['l_returnflag', 'l_linestatus'], 'dim_line')}",
        ),
        "scd2_incremental_second_batch": (scd2_incremental_second_batch, f"select {_OUT} from {second}"),
        "scd2_candidate": (lambda s, d: _plain(views.candidate(user_versions(s, d), USERS)), f"select {_OUT_VALID} from {USER_VALID}"),
        "scd2_published_partial_approval": (
            lambda s, d: _plain(views.candidate(views.approved_only(user_weeks(s, d), ledger_frame(s), USERS.model), USERS)),
            f"select {_OUT_VALID} from {published}",
        ),
        "scd2_presentation_exclude": (
            lambda s, d: _plain(views.published(user_weeks(s, d), ledger_frame(s), USERS)),
            f"select {_OUT_VALID.replace(' attribute_hash,', '')} from {published}",
        ),
        "scd2_as_of": (lambda s, d: _plain(views.as_of(views.candidate(user_versions(s, d), USERS), CUT)), f"select {_OUT_VALID} from {USER_VALID} where valid_from <= date '{CUT}' and date '{CUT}' < valid_to"),
        "scd2_point_in_time": (
            scd2_point_in_time,
            f"select f.event_type fact_type, v.event_type, count(*) n from events f left join {USER_VALID} v on v.user_id = f.user_id and cast(f.ts as date) >= v.valid_from and cast(f.ts as date) < v.valid_to group by all",
        ),
        "scd2_point_in_time_hot_key": (
            point_in_time_hot_key,
            f"""select f.event_type fact_type, v.event_type, strftime(v.valid_from, '%Y-%m-%d') valid_from, count(*) n from (select *, {HOT_USER} u from events) f
              join {USER_VALID} v on v.user_id = f.u and cast(f.ts as date) >= v.valid_from and cast(f.ts as date) < v.valid_to group by all""",
        ),
        "intake_extracts": (intake_extracts, f"select {shown} from {_validity_sql(USER_WEEKS)}"),
        "publish_after_rollback": (publish_after_rollback, f"select {shown} from {_validity_sql(two_weeks)}"),
        "latest_state": (latest_state, f"select user_id, strftime(max(valid_from), '%Y-%m-%d') valid_from, arg_max(attribute_hash, valid_from) attribute_hash from {USER_VERSIONS} group by user_id"),
        "volumes_kept": (volumes_kept, f"select strftime(snapshot_date, '%Y-%m-%d') snapshot_date, count(*) n from {_SNAP} group by snapshot_date order by 1 desc limit 7"),
        "distributed_join": (
            distributed_join,
            f"select f.event_type, v.event_type now_type, count(*) n from {_SNAP} f join {USER_VALID} v on v.user_id = f.user_id and v.is_current = 1 group by all",
        ),
        "snapshot_history": (lambda s, d: _plain(snapshot_rows(activity_source(s, d), ACTIVITY, "b1", LOADED)), f"select {snap_out} from {_SNAP}"),
        "snapshot_incremental": (
            lambda s, d: _plain(snapshot_rows(activity_source(s, d), ACTIVITY, "b2", LOADED, snapshot_rows(activity_source(s, d).where(f"extract_date <= date'{CUT}'"), ACTIVITY, "b1", LOADED))),
            f"select {snap_out.replace('_batch_id', chr(39) + 'b2' + chr(39) + ' _batch_id')} from {_SNAP} where snapshot_date > date '{CUT}'",
        ),
        "snapshot_published": (
            lambda s, d: _plain(views.snapshot_published(snapshot_rows(activity_source(s, d), ACTIVITY, "b1", LOADED), s.createDataFrame([(ACTIVITY.model, "b1"), ("other", "b2")], "model_name string, batch_id string"), ACTIVITY)),
            f"select {snap_out.replace(' event_type,', '')} from {_SNAP}",
        ),
        "gate_duplicate_sk": (damaged(gates.duplicate_keys), _DUP_SQL),
        "gate_nulls": (damaged(gates.null_keys), _NULL_SQL),
        "gate_multi_current": (damaged(gates.several_current), _MULTI_SQL),
        "gate_reconciliation": (lambda s, d: gates.reconciliation(user_source(s, d), damaged_users(s, d), USERS), _reconciliation_sql(E_SQL, DAMAGED)),
        "gate_completeness": (lambda s, d: gates.completeness(activity_source(s, d), damaged_activity(s, d), ACTIVITY), _COMPLETE_SQL),
        "gate_volume_guard": (lambda s, d: gates.volume_guard(truncated_users(s, d), "extract_date", 0.5, 7), _volume_sql(_TRUNCATED, "extract_date", gates.VOLUME)),
        "gate_all": (
            lambda s, d: gates.dimension_gates(truncated_users(s, d), written(damaged_users(s, d).select(gates.gate_columns(USERS)), "candidate"), USERS),
            " union all ".join([_DUP_SQL, _NULL_SQL, _MULTI_SQL, _reconciliation_sql(_TRUNCATED, DAMAGED), _volume_sql(_TRUNCATED, "extract_date", gates.VOLUME)]),
        ),
        "gate_all_snapshot": (
            lambda s, d: gates.snapshot_gates(activity_source(s, d), written(damaged_activity(s, d).select(gates.gate_columns(ACTIVITY)), "candidate"), ACTIVITY),
            " union all ".join([
                f"select '{gates.DUPLICATE_SNAPSHOT}' failure_reason, fact_activity_sk offending_key from {_SNAP_DAMAGED} group by fact_activity_sk having count(*) > 1",
                f"select '{gates.NULL_SNAPSHOT}' failure_reason, cast(user_id as varchar) offending_key from {_SNAP_DAMAGED} where fact_activity_sk is null or snapshot_date is null or user_id is null",
                _COMPLETE_SQL, _volume_sql(_SNAP_DAMAGED, "snapshot_date", gates.VOLUME_SNAPSHOT),
            ]),
        ),
        "approved_only": (lambda s, d: _plain(views.approved_only(user_weeks(s, d), ledger_frame(s), USERS.model)), f"select {_OUT} from {USER_WEEKS} where _batch_id in {_APPROVED_SQL}"),
        "purge_unapproved": (purge_unapproved, f"select {_OUT} from {USER_WEEKS} where _batch_id in {_APPROVED_SQL}"),
        "affected_batches": (
            affected_batches_query,
            f"select l.batch_id, coalesce(h.n, 0) row_count from (values ('2024w3'), ('2024w9')) l(batch_id) left join (select _batch_id, count(*) n from {USER_WEEKS} group by 1) h on h._batch_id = l.batch_id",
        ),
        "restore_orphans": (restore_orphans_query, f"select batch_id from (values ('2024w0'), ('2024w8'), ('2024w9')) r(batch_id) where batch_id not in (select _batch_id from {USER_WEEKS})"),
        "surrogate_key_single": (
            lambda s, d: order_source(s, d).select("o_custkey", surrogate_key(("o_custkey",), "extract_date").alias("sk")),
            f"select o_custkey, {_sk_sql(['o_custkey'], 'extract_date')} sk from {O_SQL}",
        ),
        "surrogate_key_composite": (
            lambda s, d: line_source(s, d).select("l_orderkey", "l_linenumber", surrogate_key(("l_orderkey", "l_linenumber"), "extract_date").alias("sk")),
            f"select l_orderkey, l_linenumber, {_sk_sql(['l_orderkey', 'l_linenumber'], 'extract_date')} sk from {L_SQL}",
        ),
        "key_display": (lambda s, d: _table(s, d, "lineitem").select(key_display(("l_orderkey", "l_linenumber")).alias("key")), "select concat(l_orderkey, '|', l_linenumber) as key from lineitem"),
        "det_hash_md5": (_hashed("c_custkey", "customer", exclude=["c_acctbal"], algorithm="MD5"), f"select c_custkey, {_hash_sql(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment'], 'md5')} row_hash from customer"),
        "det_hash_sha256": (_hashed("p_partkey", "part", exclude=["P_RETAILPRICE"]), f"select p_partkey, {_hash_sql(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size'], 'sha256')} row_hash from part"),
        "det_hash_include": (_hashed("o_orderkey", "orders", include=["o_orderstatus", "o_orderpriority"]), f"select o_orderkey, {_hash_sql(['o_orderstatus', 'o_orderpriority'], 'sha256')} row_hash from orders"),
        "det_hash_exclude": (_hashed("o_orderkey", "orders", exclude=["o_totalprice", "o_orderdate"], algorithm="SHA1"), f"select o_orderkey, {_hash_sql(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority'], 'sha1')} row_hash from orders"),
        "det_hash_folded": (_hashed("p_partkey", "part", exclude=["p_retailprice"], chunk_size=2), f"select p_partkey, {_hash_sql(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size'], 'sha256', 2)} row_hash from part"),
        "det_hash_kinds": (
            hash_of_kinds,
            "select o_orderkey, " + _fold_sql(["strftime(d, '%Y-%m-%d')", "strftime(instant, '%Y-%m-%dT%H:%M:%S.%f')", "cast(o_orderkey as varchar)", "strftime(plain, '%Y-%m-%dT%H:%M:%S.%f')", "printf('%.16e', price)", "hex(raw)"]) + f" row_hash from {_KINDS_SQL}",
        ),
        "drift_new_column": (
            lambda s, d: conform_schema(part_with(s, d, ["p_retailprice"], {"p_grade": F.upper("p_type")}), T.StructType([f for f in _table(s, d, "part").schema.fields if f.name != "p_retailprice"]), ["p_partkey"]),
            f"select {part_columns}, upper(p_type) p_grade from part",
        ),
        "drift_departed_column": (
            lambda s, d: conform_schema(part_with(s, d, ["p_brand", "p_retailprice"], {}), _table(s, d, "part").drop("p_retailprice").schema, ["p_partkey"]),
            "select p_partkey, p_name, cast(null as varchar) p_brand, p_type, p_size from part",
        ),
        "conform_code": (lambda s, d: _conform(s, d, customer_codes(s, d), "code"), _conform_sql(_CODES_SQL, "code")),
        "conform_name": (lambda s, d: _conform(s, d, customer_names(s, d), "name"), _conform_sql(_NAMES_SQL, "name")),
        "conform_override": (lambda s, d: _conform(s, d, customer_codes(s, d), "code").where("country_match_status = 'override'"), f"select * from ({_conform_sql(_CODES_SQL, 'code')}) where country_match_status = 'override'"),
        "conform_unmatched_report": (
            lambda s, d: conform.country_unmatched_report([(_conform(s, d, customer_codes(s, d), "code"), "CODES", "value"), (_conform(s, d, customer_names(s, d), "name"), "NAMES", "value")]),
            f"select 'CODES' source_system, value source_value, count(*) n from ({_conform_sql(_CODES_SQL, 'code')}) where country_match_status = 'unmatched' group by value union all select 'NAMES', value, count(*) from ({_conform_sql(_NAMES_SQL, 'name')}) where country_match_status = 'unmatched' group by value",
        ),
        "events_json_flatten": (
            lambda s, d: _json_events(s, d).select("event_id", events.json_value("event_params", "session_number", "int_value", "int").alias("session_number"), events.json_value("event_params", "page_title", "string_value").alias("page_title"), events.json_value("event_params", "coupon", "string_value").alias("coupon")),
            "select event_id, cast(json_extract_string(props, '$.k') as integer) session_number, 'p' || json_extract_string(props, '$.k') page_title, cast(null as varchar) coupon from events",
        ),
        "events_all_parameters": (all_parameters, _all_parameters_sql()),
        "events_sequence": (
            lambda s, d: _table(s, d, "events").select("event_id", events.sequence_in_session("user_id", "event_type", "ts", ("event_id",)).cast("bigint").alias("seq")),
            "select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) seq from events",
        ),
        "events_hash": (
            lambda s, d: _table(s, d, "events").select("event_id", events.event_hash("user_id", "event_type", "event_id").alias("event_hash")),
            "select event_id, md5(concat(user_id, '||', event_type, '||', event_id)) event_hash from events",
        ),
        "events_rolling_window": (
            lambda s, d: events.rolling(_table(s, d, "events"), AS_OF, 10, "ts").groupBy("event_type").agg(F.count("*").alias("n")),
            f"select event_type, count(*) n from events where cast(ts as date) >= date '{AS_OF}' - interval 10 day and user_id is not null group by event_type",
        ),
        "events_stage": (
            lambda s, d: _plain(events.stage_events(_staged_input(s, d), AS_OF, 10).select("event_id", "event_date", "param_session_number", "event_sequence_in_session", "event_hash", "extract_date").withColumn("event_sequence_in_session", F.col("event_sequence_in_session").cast("bigint"))),
            f"""select event_id, strftime(ts, '%Y-%m-%d') event_date, cast(json_extract_string(props, '$.k') as integer) param_session_number,
              row_number() over (partition by user_id, event_type order by epoch_us(ts), lpad(cast(event_id as varchar), 12, '0')) event_sequence_in_session,
              md5(concat(user_id, '||', event_type, '||', epoch_us(ts))) event_hash, '{AS_OF}' extract_date from events where cast(ts as date) >= date '{AS_OF}' - interval 10 day""",
        ),
        "unique_combination": (lambda s, d: checks.unique_combination(_table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1"),
        "unique": (lambda s, d: checks.unique(_table(s, d, "orders"), "o_custkey"), "select o_custkey, count(*) n from orders where o_custkey is not null group by o_custkey having count(*) > 1"),
        "accepted_values": (lambda s, d: checks.accepted_values(_table(s, d, "events"), "event_type", ["view", "click", "purchase"]), "select event_type, count(*) n from events where event_type not in ('view', 'click', 'purchase') group by event_type"),
        "not_null": (
            lambda s, d: checks.not_null(damaged_users(s, d), "user_id").select("dim_user_sk", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from")),
            f"select dim_user_sk, strftime(valid_from, '%Y-%m-%d') valid_from from {DAMAGED} where user_id is null",
        ),
        "freshness": (
            lambda s, d: checks.freshness(_table(s, d, "events").select(F.to_date("ts").alias("d")), "d", "2024-01-31 12:00:00").select(F.date_format("latest", "yyyy-MM-dd").alias("latest"), F.col("age_hours").cast("bigint").alias("age_hours"), "status"),
            "select strftime(l, '%Y-%m-%d') latest, cast(date_diff('hour', l, timestamp '2024-01-31 12:00:00') as bigint) age_hours, case when date_diff('hour', l, timestamp '2024-01-31 12:00:00') > 48 then 'error' when date_diff('hour', l, timestamp '2024-01-31 12:00:00') > 24 then 'warn' else 'pass' end status from (select cast(max(cast(ts as date)) as timestamp) l from events)",
        ),
        "lineage_edges": (lambda s, d: edge_frame(s, REGISTRY, "run1"), _edges_sql()),
    }


def _staged_input(spark, sf):
    """Events in the shape that staging expects."""
    return _json_events(spark, sf).join(_table(spark, sf, "events").select("event_id", "event_type"), "event_id").select(
        "event_id", F.to_date("ts").alias("event_date"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("event_timestamp"), F.col("event_type").alias("event_name"), "user_id", F.col("event_type").alias("session_id"),
        "event_params", F.lit("{}").alias("user_properties"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("stream_id"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}
