"""History as batch folders with a schema manifest, and published tables as versions of ranges."""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.buckets import read_bucketed, write_bucketed
from strata.sources.files import Folder

_BATCH = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$")


class BatchStore:
    """Insert-only history: Parquet partitioned by ``_batch_id``; ``schema-<n>.json`` is the authority on columns.

    A batch is a folder ``data/v=0/_batch_id=<id>``; compaction writes it anew beneath the next ``v`` and a
    marker makes that the one that counts. Purging a batch removes its folders. A batch that was written
    by half is a folder that no ledger approves, so it is purged too.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    @property
    def data(self) -> str:
        return self.folder.at("data")

    def schema(self) -> T.StructType | None:
        found = [n for n in self.folder.names() if n.startswith("schema-") and n.endswith(".json")]
        whole = [x for n in found if (x := self.folder.read_whole(n)) is not None]
        return T.StructType.fromJson(json.loads(whole[-1])) if whole else None

    def _remember(self, schema: T.StructType) -> None:
        """Widen the manifest: columns are added, never dropped."""
        stored = self.schema()
        known = {f.name.lower() for f in stored.fields} if stored else set()
        fields = [*(stored.fields if stored else []), *(T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields if f.name.lower() not in known)]
        if stored is None or len(fields) > len(stored.fields):
            n = len([x for x in self.folder.names() if x.startswith("schema-")])
            self.folder.write(f"schema-{n:06d}.json", T.StructType(fields).json())

    def _written(self, version: str) -> list[str]:
        return [n.removeprefix("_batch_id=") for n in self.folder.names(f"data/{version}") if n.startswith("_batch_id=")]

    def places(self) -> dict[str, str]:
        """Each batch's version folder: the one that its last marker names, else that of its first writing."""
        marked = {b: f"v={n}" for b in self.folder.names("compacted") for n in sorted(map(int, self.folder.names(f"compacted/{b}")))}
        first = {b: "v=0" for b in self._written("v=0")}
        return dict(sorted((first | marked).items()))

    def batches(self) -> list[str]:
        return list(self.places())

    def append(self, rows: DataFrame, batch_id: str, approved: set[str] | frozenset[str] = frozenset(), date_column: str | None = None) -> None:
        """Write one batch. One that is ``approved`` is never written again; one that isn't gives way to the new rows.

        With ``date_column`` its rows a date are kept beside it (:meth:`volumes`).
        """
        if not _BATCH.match(batch_id):
            raise ValueError(f"{batch_id!r} can't name a batch")
        if batch_id in approved:
            raise ValueError(f"batch {batch_id} is approved and can't be written again")
        self._remember(rows.schema)
        self._remove(batch_id)
        path = f"{self.data}/v=0/_batch_id={batch_id}"
        rows.drop("_batch_id").write.mode("error").parquet(path)
        if date_column:
            counts = self.spark.read.schema(rows.drop("_batch_id").schema).parquet(path).groupBy(F.col(date_column).cast("date").cast("string").alias("d")).count()
            self.folder.write(f"volumes/{batch_id}", json.dumps([[r["d"], r["count"]] for r in counts.collect()]))  # a number a date

    def volumes(self, window: int) -> list[tuple[date | None, int]] | None:
        """(date, rows) of the last ``window`` dates over all batches, latest first, from what was kept with them; None if a batch has none."""
        kept, total = set(self.folder.names("volumes")), Counter()
        for b in self.batches():
            if b not in kept or (text := self.folder.read_whole(f"volumes/{b}")) is None:
                return None
            total.update({d: n for d, n in json.loads(text)})
        latest = sorted((d for d in total if d is not None), reverse=True) + [None] * (None in total)
        return [(date.fromisoformat(d) if d else None, total[d]) for d in latest[:window]]

    def read(self, batches: set[str] | None = None) -> DataFrame | None:
        """All batches, or those named, under the manifest's schema (columns that an old batch lacks are null); None before the first."""
        schema = self.schema()
        if schema is None:
            return None
        places = {b: v for b, v in self.places().items() if batches is None or b in batches}
        if not places:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.data}/{v}/_batch_id={b}" for b, v in places.items()]
        return self.spark.read.schema(schema).option("basePath", self.data).parquet(*paths).select([f.name for f in schema.fields])

    def _remove(self, batch_id: str) -> None:
        for v in self.folder.names("data"):
            self.folder.delete(f"data/{v}/_batch_id={batch_id}")
        self.folder.delete(f"compacted/{batch_id}")
        self.folder.delete(f"volumes/{batch_id}")

    def purge(self, approved: set[str]) -> list[str]:
        """Remove batches that aren't approved; their ids."""
        gone = [b for b in self.batches() if b not in approved]
        for b in gone:
            self._remove(b)
        return gone

    def compact(self, batch_id: str, files: int = 1, fault: Callable[[str], None] | None = None) -> None:
        """Rewrite a batch into ``files`` files; its id stays, and readers see the old folder or the new one."""
        step = fault or (lambda _: None)
        old = self.places()[batch_id]
        n = 1 + max(int(v[2:]) for v in self.folder.names("data"))
        rows = self.spark.read.parquet(f"{self.data}/{old}/_batch_id={batch_id}")
        rows.repartition(files).write.mode("overwrite").parquet(f"{self.data}/v={n}/_batch_id={batch_id}")
        step("mark")
        self.folder.write(f"compacted/{batch_id}/{n}", "")
        step("remove")
        for v in self.folder.names("data"):
            if v != f"v={n}":
                self.folder.delete(f"data/{v}/_batch_id={batch_id}")


class VersionedTable:
    """A published table whose rows lie in ranges of a key's hash; a version names the folders of each range.

    ``v=<n>-<token>/_range=<k>`` holds what version ``n`` wrote of range ``k``; ranges that it didn't touch stay
    where an older version put them. The file ``_current/<n>`` is the version's manifest and makes it the one that
    readers take: folders, row counts, batches and schema. It is made at once and only where there is none, so of
    two publications from one version one succeeds. A range is about ``range_rows`` rows; more of one
    key are one range, which Spark writes as several files. Each range is a folder that a publication makes,
    lists, counts and names, so there are at most ``most_ranges``: of a table beyond that, ranges grow instead.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2, range_rows: int = 1_000_000, parts: int = 32, most_ranges: int = 256):
        self.spark, self.folder, self.keep, self.range_rows, self.parts, self.most_ranges = spark, Folder(spark, root), keep, range_rows, parts, most_ranges

    def ranges_for(self, rows: int) -> int:
        """Number of ranges that a table of so many rows lies in."""
        return max(1, min(self.most_ranges, -(-rows // self.range_rows)))

    def versions(self) -> list[int]:
        return [int(n) for n in self.folder.names("_current") if n.isdigit()]

    def manifest(self, version: int | None = None) -> dict | None:
        """That of a version, the current one unless named."""
        found = self.versions() if version is None else [version]
        return json.loads(self.folder.read(f"_current/{found[-1]:08d}")) if found else None

    def rows_of(self, manifest: dict, ranges: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its ranges."""
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [self.folder.at(f) for k, folders in sorted(manifest["ranges"].items(), key=lambda x: int(x[0])) if ranges is None or int(k) in ranges for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        manifest = self.manifest()
        return self.rows_of(manifest) if manifest else None

    @staticmethod
    def range_of(columns: list[str], n: int) -> Column:
        """The range of a row, by the hash of its key."""
        return F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in columns)), F.lit(n)).cast("int")

    def write_version(self, df: DataFrame, columns: list[str], n: int) -> tuple[str, int]:
        """Write rows, dealt into ``n`` ranges, that nobody reads yet; their folder, and their number, counted on the way.

        Rows of one range lie together; Spark divides ranges that are too large for one task.
        """
        folder = f"v={max([0, *self.versions()]) + 1:08d}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        rows = df.withColumn("_range", self.range_of(columns, n)).hint("rebalance", F.col("_range"))
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("error").partitionBy("_range").parquet(self.folder.at(folder))
        return folder, seen.get["n"]

    def written(self, folder: str) -> dict[int, int]:
        """Rows in a version's folder, by range, as they lie there."""
        if not any(n.startswith("_range=") for n in self.folder.names(folder)):
            return {}
        counts = self.spark.read.parquet(self.folder.at(folder)).groupBy("_range").count()
        return {r["_range"]: r["count"] for r in counts.collect()}  # a number a range

    def distribute(self, manifest: dict, folder: str, column: str, n: int) -> dict:
        """Write a version's rows in buckets besides; what the manifest says of them."""
        to = f"b={folder.removeprefix('v=')}"
        write_bucketed(self.rows_of(manifest), self.folder.at(to), column, n)
        return {"folder": to, "column": column, "n": n}

    def distributed(self) -> DataFrame | None:
        """The current version's rows from its buckets; None where it has none."""
        manifest = self.manifest()
        if not manifest or not (b := manifest.get("buckets")):
            return None
        return read_bucketed(self.spark, self.folder.at(b["folder"]), T.StructType.fromJson(json.loads(manifest["schema"])), b["column"], b["n"])

    def switch(self, version: int, manifest: dict) -> None:
        """Readers see the version from now on: one small file is made. ``FileExistsError`` if another publication was faster."""
        self.folder.write(f"_current/{version:08d}", json.dumps(manifest))

    def withdraw(self, version: int) -> None:
        """Readers see the version before again."""
        self.folder.delete(f"_current/{version:08d}")

    def discard(self, folder: str) -> None:
        """Remove what was written for a version that isn't one."""
        self.folder.delete(folder)
        self.folder.delete(f"b={folder.removeprefix('v=')}")

    def tidy(self) -> None:
        """Keep the last versions and the folders that they name; what older ones wrote goes, unless a later one names it."""
        found = self.versions()
        for n in found[: -self.keep]:
            self.withdraw(n)
        kept = [self.manifest(n) for n in found[-self.keep :]]
        named = {f for m in kept for folders in m["ranges"].values() for f in folders} | {m["buckets"]["folder"] for m in kept if m.get("buckets")}
        for v in [x for x in self.folder.names() if x[:2] in ("v=", "b=") and found and int(x[2:10]) < found[-1]]:
            inside = [f"{v}/{x}" for x in self.folder.names(v) if x.startswith("_range=")]
            if v not in named and not named & set(inside):
                self.folder.delete(v)
                continue
            for f in inside:
                if f not in named:
                    self.folder.delete(f)
