"""The latest version of every key, kept beside history: what a night's change detection compares with.

A base holds key, date and hash of each key's latest version over a set of batches.
Batches that came after it are read from history, in these columns; every ``fold``
batches they are folded into a new base. A base counts only while all its batches
are approved with the same rows: after a rollback it is made anew from what is
left. So the state is never wrong, at worst it is history.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.files import Folder
from strata.sources.store import BatchStore
from strata.spec import DimensionSpec


class LatestState:
    """Bases ``base=<n>``, each with a manifest ``<n>.json`` that makes it count."""

    def __init__(self, spark: SparkSession, root: str, spec: DimensionSpec, fold: int = 8):
        self.spark, self.folder, self.spec, self.fold = spark, Folder(spark, root), spec, fold

    def _manifests(self) -> list[tuple[int, dict]]:
        return [(int(n.removesuffix(".json")), json.loads(x)) for n in self.folder.names() if n.endswith(".json") and (x := self.folder.read_whole(n)) is not None]

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, reduced on the map side: the greatest date's hash."""
        hash_of = F.max_by(self.spec.hash_column, self.spec.date_column).alias(self.spec.hash_column)
        return rows.groupBy(*self.spec.natural_key).agg(F.max(self.spec.date_column).alias(self.spec.date_column), hash_of)

    def read(self, store: BatchStore, batches: dict[str, str]) -> tuple[DataFrame, date | None]:
        """(keys, date, hash) of each key's latest version among approved ``batches`` (ids and identities), and the latest date of all."""
        there = {b: i for b, i in batches.items() if b in set(store.batches())}
        columns = [*self.spec.natural_key, self.spec.date_column, self.spec.hash_column]
        fits = [(n, m) for n, m in self._manifests() if m["batches"].items() <= there.items()]
        n, base = max(fits, key=lambda x: len(x[1]["batches"]), default=(None, None))
        missing = set(there) - set(base["batches"] if base else ())
        parts = [store.read(missing).select(*columns)] if missing or base is None else []
        mark = parts[0].agg(F.max(self.spec.date_column)).first()[0] if parts else None
        if base:
            if base["mark"]:
                mark = max(filter(None, (mark, date.fromisoformat(base["mark"]))))
            parts.append(self.spark.read.schema(store.read(set()).select(*columns).schema).parquet(self.folder.at(f"base={n}")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        latest = rows if not missing and base else self._latest(rows)
        if len(missing) >= self.fold:
            latest = self._rebase(latest, there, mark)
        return latest, mark

    def _rebase(self, latest: DataFrame, batches: dict[str, str], mark: date | None) -> DataFrame:
        names = self.folder.names()
        n = 1 + max([0, *(int(x[5:]) for x in names if x.startswith("base=")), *(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))])
        latest.write.mode("error").parquet(self.folder.at(f"base={n}"))
        self.folder.write(f"{n:08d}.json", json.dumps({"batches": batches, "mark": mark.isoformat() if mark else None}))
        for old, _ in self._manifests()[:-2]:
            self.folder.delete(f"{old:08d}.json")
            self.folder.delete(f"base={old}")
        return self.spark.read.schema(latest.schema).parquet(self.folder.at(f"base={n}"))
