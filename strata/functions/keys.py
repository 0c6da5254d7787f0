"""Surrogate keys and key display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(name: str, width: int | None) -> Column:
    text = F.col(name).cast("string")
    return F.coalesce(F.substring(text, 1, width) if width else text, F.lit(""))


def surrogate_key(keys: tuple[str, ...] | list[str], date: str, width: int | None = None, encoding: str = "UTF-8") -> Column:
    """Upper-case MD5 of the keys and the date, parted by "||"; nulls count as empty text."""
    parts = [p for k in keys for p in (_text(k, width), F.lit("||"))]
    return F.upper(F.md5(F.encode(F.concat(*parts, F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))), encoding)))


def key_display(keys: tuple[str, ...] | list[str], alias: str | None = None) -> Column:
    """The key as text, parts joined by "|"; one part alone stays null if it is."""
    names = [f"{alias}.{k}" if alias else k for k in keys]
    if len(names) == 1:
        return F.col(names[0]).cast("string")
    return F.concat(*[p for i, n in enumerate(names) for p in ([F.lit("|")] if i else []) + [_text(n, None)]])
