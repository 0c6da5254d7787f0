"""Extracts that arrive as files, taken in by a stream that stops when it has caught up.

The unit is an extract, not a file: a folder beneath ``path`` with its ``_SUCCESS``,
the files that one Spark job wrote into ``path`` itself, once its ``_SUCCESS`` is
younger than they are, or a file of any other name. Complete extracts are announced
in a log of manifests (name and files), which is what the stream reads: its offsets
say which manifests are done. An extract is one history batch, named after the
extract and known by its rows' digest. So a micro-batch that comes again, and a
stream with a new checkpoint that reads all manifests again, meet approved batches
and leave them as they are; an extract of the same name with other rows is an error.

No extract is skipped. One that is blocked (its gates fail, or it is late: no row
past the high-water mark, and rows among it that history doesn't reflect) stops the
stream before its offset is committed, so the next run takes it again. With
``on_blocked="hold"`` it is set aside with its rows instead, and later extracts
queue behind it, since history takes dates in order; :meth:`Intake.resume` takes them
in turn, :meth:`Intake.give_up` decides that one is not wanted.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.operators import views
from strata.operators.history import high_water
from strata.plans.pipeline import Pipeline, source_digest
from strata.sources.files import Folder
from strata.sources.ledger import EventLog
from strata.spec import DimensionSpec

_JOB = re.compile(r"^part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
MANIFEST = "extract string, files array<string>, seq long"


class IntakeError(RuntimeError):
    """An extract that can't be taken in; its offset is not committed."""


def complete_extracts(folder: Folder) -> dict[str, list[str]]:
    """Names and files (paths beneath the folder) of the extracts that are whole, the oldest first."""
    found: dict[str, tuple[int, list[str]]] = {}
    jobs: dict[str, list] = {}
    done = 0
    for e in folder.entries():
        if e.is_folder:
            inside = folder.entries(e.name)
            files = [x for x in inside if not x.is_folder and x.name != "_SUCCESS"]
            if any(x.name == "_SUCCESS" for x in inside):
                found[e.name] = (max([x.modified for x in inside]), [f"{e.name}/{x.name}" for x in files])
        elif e.name == "_SUCCESS":
            done = e.modified
        else:
            jobs.setdefault(m[1] if (m := _JOB.match(e.name)) else e.name, []).append(e)
    for job, files in jobs.items():
        last = max(x.modified for x in files)
        if last <= done or job == files[0].name:  # a file by itself is whole when it is there
            found[job] = (last, [x.name for x in files])
    return {name: files for name, (_, files) in sorted(found.items(), key=lambda x: (x[1][0], x[0]))}


class Intake:
    """Takes extracts of one spec's source into its history."""

    def __init__(self, spark: SparkSession, pipeline: Pipeline, name: str, path: str, schema: StructType):
        self.spark, self.pipeline, self.name, self.schema = spark, pipeline, name, schema
        self.spec, self.path, root = pipeline.registry[name], path.rstrip("/"), f"{pipeline.root}/{name}/intake"
        self.announced = EventLog(spark, f"{root}/extracts", lambda state, e: state | {e["extract"]: e["files"]}, dict)
        self.log = EventLog(spark, f"{root}/log", self._step, dict)
        self.kept = f"{root}/held"

    @staticmethod
    def _step(state: dict, e: dict) -> dict:
        rest = {k: v for k, v in state.items() if k != e["extract"]}
        return state | {e["extract"]: e} if e["op"] == "hold" else rest

    @staticmethod
    def batch_of(extract: str) -> str:
        """The history batch of an extract."""
        name = re.sub(r"[^A-Za-z0-9_.\-]", "-", extract)
        return name if name[:1].isalnum() else f"x{name}"

    def held(self) -> dict[str, str]:
        """Extracts that are set aside, in the order in which they came, with the reason."""
        return {k: e["reason"] for k, e in sorted(self.log.replay()[0].items(), key=lambda x: x[1]["order"])}

    def announce(self) -> list[str]:
        """Write a manifest of every extract that is whole and has none yet; their names."""
        new = []
        for extract, files in complete_extracts(Folder(self.spark, self.path)).items():

            def decide(state: dict, extract=extract, files=files) -> dict | None:
                if extract not in state:
                    return {"extract": extract, "files": files}
                if sorted(state[extract]) != sorted(files):
                    raise IntakeError(f"extract {extract} has other files than when it was announced")
                return None

            if self.announced.commit(decide) is not None:
                new.append(extract)
        return new

    def _late(self, rows: DataFrame) -> tuple[int, str | None]:
        """Rows at or before the high-water mark; and, if that is all of them, why they can't be taken in."""
        s = self.pipeline.state(self.name)
        history = s.history(approved=True)
        mark = high_water(history, self.spec.date_column) if history is not None else None
        if mark is None:
            return 0, None
        day = F.col(f"`{self.spec.source_date}`").cast("date")
        late, total = rows.agg(F.count(F.when(~(day > F.lit(mark)) | day.isNull(), 1)), F.count("*")).first()
        if late < total or not total:
            return late, None
        keys = list(self.spec.natural_key)
        if isinstance(self.spec, DimensionSpec):
            known = views.candidate(history, self.spec).withColumnRenamed(self.spec.hash_column, "_known_hash")
            met = views.join_as_of(rows.select(*keys, self.spec.source_date, self.spec.hash_column), known, keys, self.spec.source_date, ["_known_hash"])
            lost = met.where(~F.col("_known_hash").eqNullSafe(F.col(self.spec.hash_column))).count()
        else:
            lost = rows.select(*keys, day.alias(self.spec.date_column)).join(history, [*keys, self.spec.date_column], "left_anti").count()
        return late, f"all rows are of {mark} or before, and history doesn't reflect {lost} of them" if lost else None

    def _take(self, extract: str, rows: DataFrame, loaded_at: datetime) -> tuple[list[dict], str | None]:
        """The results of an extract's run, and why it was blocked, if it was."""
        batch, digest = self.batch_of(extract), source_digest(rows, self.spec)
        before = batch in self.pipeline.state(self.name).approved()
        late, reason = (0, None) if before else self._late(rows)
        if reason:
            return [], reason
        results = self.pipeline.run({self.spec.source: rows}, batch, loaded_at, [self.name], digests={self.spec.source: digest})
        results = [r | {"extract": extract, "rows_late": late} for r in results]
        return results, next((r["message"] for r in results if r["resource_type"] == "table" and r["status"] == "skipped"), None)

    def _rows(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], self.schema)

    def _hold(self, extract: str, rows: DataFrame, order: int, reason: str, at: datetime) -> dict:
        rows.write.mode("overwrite").parquet(f"{self.kept}/{self.batch_of(extract)}")
        self.log.add(op="hold", extract=extract, order=order, reason=reason, at=at.isoformat())
        return {"resource_type": "extract", "name": extract, "extract": extract, "status": "held", "message": reason, "completed_at": at}

    def take_available(self, checkpoint: str, loaded_at: datetime, on_blocked: str = "stop") -> list[dict]:
        """Announce what is whole and take in all that isn't done; the results of each extract's run."""
        if on_blocked not in ("stop", "hold"):
            raise ValueError("on_blocked is stop or hold")
        self.announce()
        if not self.announced.folder.exists():
            return []  # there has never been an extract
        results: list[dict] = []
        stopped: list[str] = []

        def take(manifests: DataFrame, _: int) -> None:
            for m in sorted(manifests.collect(), key=lambda r: r["seq"]):  # a row an extract
                rows, first = self._rows(m["files"]), next(iter(self.held()), None)
                if m["extract"] in self.held():
                    continue  # set aside by a micro-batch that comes again
                if first is not None and self.batch_of(m["extract"]) not in self.pipeline.state(self.name).approved():
                    results.append(self._hold(m["extract"], rows, m["seq"], f"waits for {first}", loaded_at))
                    continue
                found, reason = self._take(m["extract"], rows, loaded_at)
                results.extend(found)
                if reason and on_blocked == "stop":
                    stopped.append(f"extract {m['extract']}: {reason}")
                    raise IntakeError(stopped[-1])
                if reason:
                    results.append(self._hold(m["extract"], rows, m["seq"], reason, loaded_at))

        stream = self.spark.readStream.schema(MANIFEST).option("pathGlobFilter", "*.json").json(self.announced.folder.root)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException as e:
            if stopped:
                raise IntakeError(stopped[-1]) from e
            raise
        return results

    def resume(self, loaded_at: datetime) -> list[dict]:
        """Take in what is set aside, in its order, up to the first extract that is still blocked."""
        results: list[dict] = []
        for extract in list(self.held()):
            rows = self.spark.read.schema(self.schema).parquet(f"{self.kept}/{self.batch_of(extract)}")
            found, reason = self._take(extract, rows, loaded_at)
            results += found
            if reason:
                break
            self.log.add(op="release", extract=extract, at=loaded_at.isoformat())
        return results

    def give_up(self, extract: str, at: datetime, why: str) -> None:
        """Leave a held extract out for good; its rows and this decision stay on record."""
        if extract not in self.held():
            raise IntakeError(f"{extract} isn't held")
        self.log.add(op="give_up", extract=extract, at=at.isoformat(), why=why)


def ingest_available(spark: SparkSession, pipeline: Pipeline, name: str, path: str, schema: StructType, checkpoint: str, loaded_at: datetime, on_blocked: str = "stop") -> list[dict]:
    """Take in all extracts that are whole; the results of each one's run. See :class:`Intake`."""
    return Intake(spark, pipeline, name, path, schema).take_available(checkpoint, loaded_at, on_blocked)
