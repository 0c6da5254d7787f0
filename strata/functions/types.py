"""Schema drift: which types history may hold, which are alike, and how a source meets a stored schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DriftError(ValueError):
    """A source that can't be appended to its history."""


_PLAIN = (T.StringType, T.VarcharType, T.CharType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType, T.DoubleType, T.FloatType)
#: Metadata key of a text's declared length.
LENGTH = "char_length"


def check_supported(field: T.StructField) -> T.StructField:
    """The field itself, if history may hold its type."""
    if not isinstance(field.dataType, _PLAIN):
        raise DriftError(f"column {field.name}: type {field.dataType.simpleString()} can't be kept in history; cast it in the source")
    return field


def equivalent(a: T.DataType, b: T.DataType) -> bool:
    """Alike for history: equal, or timestamps of either kind. Decimals only at equal precision and scale."""
    stamps = (T.TimestampType, T.TimestampNTZType)
    return a == b or isinstance(a, stamps) and isinstance(b, stamps)


def _length(f: T.StructField) -> int | None:
    kind = f.dataType
    return kind.length if isinstance(kind, (T.VarcharType, T.CharType)) else (f.metadata or {}).get(LENGTH)


@dataclass(frozen=True)
class Resolution:
    """How a source's attributes are written: a projection, and the attribute fields of the new stored schema."""

    projection: list[Column]
    fields: list[T.StructField]
    added: list[str]
    departed: list[str]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]


def resolve_attributes(source: T.StructType, history: T.StructType | None, exclude: set[str] | list[str]) -> Resolution:
    """Attributes of the source in its order, then those that history has and the source lost, as typed nulls.

    Names compare without case. A shared attribute has to keep its type and declared
    length; one that comes back resumes if its type still matches. Nothing is dropped.
    """
    left_out = {c.lower() for c in exclude}
    stored = {f.name.lower(): f for f in (history.fields if history else []) if f.name.lower() not in left_out}
    projection, fields, added, seen = [], [], [], set()
    for f in source.fields:
        name = f.name.lower()
        if name in left_out:
            continue
        if name in seen:
            raise DriftError(f"column {f.name} stands twice in the source")
        seen.add(name)
        check_supported(f)
        old = stored.get(name)
        if old is None:
            added += [f.name] if history else []
            fields.append(f)
            projection.append(F.col(f"`{f.name}`"))
            continue
        if not equivalent(old.dataType, f.dataType) or _length(old) != _length(f):
            raise DriftError(f"column {f.name}: the source has {f.dataType.simpleString()} ({_length(f)}), history {old.dataType.simpleString()} ({_length(old)})")
        fields.append(old)
        projection.append(F.col(f"`{f.name}`").cast(old.dataType).alias(old.name))
    departed = [f for n, f in stored.items() if n not in seen]
    fields += departed
    projection += [F.lit(None).cast(f.dataType).alias(f.name) for f in departed]
    return Resolution(projection, fields, added, [f.name for f in departed])


def conform_schema(df: DataFrame, history: T.StructType | None, exclude: set[str] | list[str]) -> DataFrame:
    """The excluded columns as they are, then the resolved attributes."""
    found = resolve_attributes(df.schema, history, exclude)
    left_out = {c.lower() for c in exclude}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() in left_out], *found.projection)
