"""Deterministic hash of wide rows: a token for each column, folded in chunks until one is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of each algorithm's digest.
HEX_DIGITS = {"MD5": 32, "SHA1": 40, "SHA2_256": 64, "SHA2_512": 128}
#: Bytes that a fold may hash at once at two bytes a digit, and arguments it may join.
FOLD_BYTES, FOLD_ARGUMENTS = 8000, 254


def _digest(algorithm: str) -> Callable[[Column], Column]:
    if algorithm not in HEX_DIGITS:
        raise ValueError(f"unknown algorithm {algorithm!r}; there are {', '.join(HEX_DIGITS)}")
    return {"MD5": F.md5, "SHA1": F.sha1, "SHA2_256": lambda c: F.sha2(c, 256), "SHA2_512": lambda c: F.sha2(c, 512)}[algorithm]


def chunk_limit(algorithm: str) -> int:
    return min(FOLD_BYTES // (2 * HEX_DIGITS[algorithm]), FOLD_ARGUMENTS)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value's text, the same whenever the value is, whatever the session's time zone: ISO dates, UTC instants, 17 significant digits, upper hex."""
    if isinstance(kind, T.DateType):
        return column.cast("string")
    if isinstance(kind, T.TimestampType):
        return _instant(F.unix_micros(column))
    if isinstance(kind, T.TimestampNTZType):
        text = column.cast("string")
        fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)$", 1), 6, "0")
        return F.concat(F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T")), F.lit("."), fraction)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        double = column.cast("double")
        return F.format_string("%.16e", F.when(double == 0, F.lit(0.0)).otherwise(double))
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    return column.cast("string")


def _instant(micros: Column) -> Column:
    """ISO text in UTC of microseconds since 1970, by whole numbers alone."""
    day_micros = 86_400_000_000
    within = F.pmod(micros, F.lit(day_micros))
    day = F.date_from_unix_date(((micros - within) / F.lit(day_micros)).cast("int")).cast("string")
    part = lambda unit, size: _two(F.pmod(F.floor(within / F.lit(unit)), F.lit(size)))
    return F.concat(day, F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))


def hash_columns(schema: T.StructType, exclude: list[str] | tuple = (), include: list[str] | None = None, exclude_underscore: bool = True) -> list[T.StructField]:
    """The columns that count, by name: allowed, not denied, and not "_"-prefixed unless allowed by name."""
    denied, allowed = {c.lower() for c in exclude}, None if include is None else {c.lower() for c in include}
    chosen = []
    for f in schema.fields:
        name = f.name.lower()
        hidden = exclude_underscore and name.startswith("_") and not (allowed and name in allowed)
        if (allowed is None or name in allowed) and name not in denied and not hidden:
            chosen.append(f)
    return sorted(chosen, key=lambda f: (f.name.lower(), f.name))


def deterministic_hash(
    df: DataFrame, exclude: list[str] | tuple = (), include: list[str] | None = None, exclude_underscore: bool = True,
    algorithm: str = "SHA2_256", null_token: str = "<<NULL>>", chunk_size: int | None = None, encoding: str = "UTF-8",
) -> Column:
    """Upper-case hex hash of a row's columns, independent of their order.

    Each column's canonical text (``null_token`` for null) becomes a token. Tokens are
    joined in chunks and hashed again until one is left; a chunk of one is hashed
    again too, and a single column's token isn't folded.
    """
    digest = _digest(algorithm)
    limit = chunk_limit(algorithm)
    chunk = limit if chunk_size is None else chunk_size
    if not 2 <= chunk <= limit:
        raise ValueError(f"chunk_size has to be from 2 to {limit} for {algorithm}")
    chosen = hash_columns(df.schema, exclude, include, exclude_underscore)
    if not chosen:
        raise ValueError("no columns are left to hash")
    layer = [F.upper(digest(F.encode(F.coalesce(canonical(F.col(f"`{f.name}`"), f.dataType), F.lit(null_token)), encoding))) for f in chosen]
    while len(layer) > 1:
        layer = [F.upper(digest(F.encode(F.concat(*layer[i : i + chunk]), "UTF-8"))) for i in range(0, len(layer), chunk)]
    return layer[0]


def with_hash(df: DataFrame, name: str = "attribute_hash", **options) -> DataFrame:
    return df.withColumn(name, deterministic_hash(df, **options))
