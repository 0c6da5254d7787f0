"""Event staging: rolling window, times, typed parameters from JSON text, order within sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parameter columns with their keys, value fields and types.
PARAMETERS = [
    ("param_page_location", "page_location", "string_value", "string"),
    ("param_page_title", "page_title", "string_value", "string"),
    ("param_page_referrer", "page_referrer", "string_value", "string"),
    ("param_page_path", "page_path", "string_value", "string"),
    ("param_value", "value", "string_value", "string"),
    ("param_value_numeric", "value", "double_value", "double"),
    ("param_currency", "currency", "string_value", "string"),
    ("param_items", "items", "string_value", "string"),
    ("param_search_term", "search_term", "string_value", "string"),
    ("param_auth_method", "method", "string_value", "string"),
    ("param_session_number", "session_number", "int_value", "int"),
    ("param_engagement_time_msec", "engagement_time_msec", "int_value", "int"),
    ("param_video_title", "video_title", "string_value", "string"),
    ("param_video_duration", "video_duration", "int_value", "int"),
    ("param_video_current_time", "video_current_time", "int_value", "int"),
    ("param_checkout_step", "checkout_step", "int_value", "int"),
    ("param_coupon", "coupon", "string_value", "string"),
]
#: The same of user properties.
USER_PROPERTIES = [
    ("user_first_open_timestamp", "first_open_timestamp", "int_value", "bigint"),
    ("user_ltv_currency", "user_ltv", "currency_value", "string"),
    ("user_ltv_value", "user_ltv", "string_value", "string"),
]
_ENTRIES = "array<struct<key:string,value:map<string,string>>>"


def json_value(json: str, key: str, field: str, kind: str = "string", strict: bool = False) -> Column:
    """A field of a parameter, from the object form ``{key: {field: …}}`` or the array form ``[{key, value}]``."""
    direct = F.get_json_object(json, f"$.{key}.{field}")
    entries = F.filter(F.from_json(json, _ENTRIES), lambda e: e["key"] == key)
    listed = F.get(entries, F.lit(0))["value"][field]
    found = F.when(F.startswith(F.ltrim(json), F.lit("[")), listed).otherwise(direct)
    return _typed(found, kind, strict)


def _typed(found: Column, kind: str, strict: bool) -> Column:
    return found if kind == "string" else found.cast(kind) if strict else found.try_cast(kind)


def parsed(json: str, keys: list[str]) -> Column:
    """A document as a struct of ``keys``, each a map of its fields' texts: one parse, of the form that the document has.

    A document in the array form is parsed as such and its first entry of each key taken; one in the object
    form gives its keys' objects. A field is as text, as :func:`json_value` gives it.
    """
    listed = F.from_json(F.when(F.startswith(F.ltrim(json), F.lit("[")), F.col(json)), _ENTRIES)
    direct = F.from_json(F.when(~F.startswith(F.ltrim(json), F.lit("[")), F.col(json)), "struct<" + ",".join(f"`{k}`:map<string,string>" for k in keys) + ">")
    return F.struct(listed.alias("listed"), direct.alias("direct"))


def flatten(events: DataFrame, params: str = "event_params", user: str = "user_properties", strict: bool = False) -> DataFrame:
    """Events with a column for each parameter and user property; either document is parsed once."""
    made = {}
    for json, wanted in ((params, PARAMETERS), (user, USER_PROPERTIES)):
        made[json] = parsed(json, sorted({key for _, key, _, _ in wanted}))
    slots = {json: f"_parsed_{i}" for i, json in enumerate(made)}
    while set(slots.values()) & set(events.columns):
        slots = {json: f"_{slot}" for json, slot in slots.items()}
    # Spark doesn't repeat an expression as dear as a parse in the columns that read it
    rows = events.withColumns({slots[json]: column for json, column in made.items()})

    def value(slot: str, key: str, field: str) -> Column:
        entry = F.get(F.filter(F.col(f"{slot}.listed"), lambda e: e["key"] == key), F.lit(0))["value"][field]
        return F.coalesce(F.col(f"{slot}.direct.{key}")[field], entry)

    columns = {name: _typed(value(slots[params], key, field), kind, strict) for name, key, field, kind in PARAMETERS}
    columns |= {name: _typed(value(slots[user], key, field), kind, strict) for name, key, field, kind in USER_PROPERTIES}
    return rows.withColumns(columns).drop(*slots.values())


def rolling(events: DataFrame, as_of: str, days: int = 90, date: str = "event_date", user: str = "user_id") -> DataFrame:
    """Events with a user of the last ``days`` days before ``as_of``."""
    return events.where((F.col(date).cast("date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & F.col(user).isNotNull())


def sequence_in_session(user: str = "user_id", session: str = "session_id", at: str = "event_timestamp", ties: tuple[str, ...] = ()) -> Column:
    return F.row_number().over(Window.partitionBy(user, session).orderBy(at, *ties))


def event_hash(user: str = "user_id", session: str = "session_id", at: str = "event_timestamp") -> Column:
    """Lower-case hex MD5 of user, session and time, parted by "||"; nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.encode(F.concat(text(user), F.lit("||"), text(session), F.lit("||"), text(at)), "UTF-8"))


def stage_events(events: DataFrame, as_of: str, days: int = 90, strict: bool = False) -> DataFrame:
    """Events of the window, flattened, with their time, place in the session, hash and extract date."""
    rows = rolling(events, as_of, days).withColumn("event_date", F.col("event_date").cast("date"))
    rows = flatten(rows, strict=strict).withColumn("event_datetime", F.timestamp_micros("event_timestamp"))
    ties = tuple(c for c in ("stream_id", "event_name") if c in events.columns)
    return rows.withColumns({"event_sequence_in_session": sequence_in_session(ties=ties), "event_hash": event_hash(), "extract_date": F.lit(as_of).cast("date")})
