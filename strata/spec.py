"""Declarative specs: what to keep history of, and how."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

_NAME = re.compile(r"^[A-Za-z][A-Za-z0-9_]*$")
OPEN_END = "9999-12-31"
FIRST_DATE = "1900-01-01"


class SpecError(ValueError):
    """A spec that can't be used."""


def _check(name: str, source: str, keys: tuple[str, ...]) -> None:
    if not name:
        raise SpecError("a spec needs a name")
    if not _NAME.match(name):
        raise SpecError(f"{name!r}: a name starts with a letter and has letters, digits and underscores")
    if not source:
        raise SpecError(f"{name}: no source")
    if not keys or any(not k for k in keys):
        raise SpecError(f"{name}: no natural key")


SEVERITIES = ("error", "warn")


@dataclass(frozen=True)
class ColumnTest:
    """A test of a spec's candidate rows: ``kind`` is not_null, unique, unique_combination or accepted_values."""

    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    severity: str = "error"

    def __post_init__(self):
        columns = (self.columns,) if isinstance(self.columns, str) else tuple(self.columns)
        object.__setattr__(self, "columns", columns)
        object.__setattr__(self, "values", tuple(self.values))
        if self.kind not in ("not_null", "unique", "unique_combination", "accepted_values") or not columns or self.severity not in SEVERITIES:
            raise SpecError(f"no such test: {self.kind} of {columns} with severity {self.severity}")

    @property
    def name(self) -> str:
        return "_".join((self.kind, *self.columns))


@dataclass(frozen=True)
class DimensionSpec:
    """A dimension with Type 2 history. ``dedupe`` orders the rows of one key and date; the first counts.

    ``tests`` are column tests that run with the gates; one of severity "error" that fails blocks the
    batch. ``gate_severity`` "warn" reports failed gates as warn, which blocks too but fails no run.
    ``column_docs`` and ``description`` are stored with the published table. With ``dist_buckets`` every
    version is written in so many buckets of ``dist_column`` besides, which joins use (``Pipeline.distributed``).
    """

    name: str
    source: str
    natural_key: tuple[str, ...]
    change_column: str = "_landing_extract_date"
    hash_column: str = "attribute_hash"
    surrogate_key: str = ""
    dist_column: str = ""
    dedupe: tuple[str, ...] = ()
    presentation_exclude: tuple[str, ...] = ()
    volume_factor: float = 0.5
    volume_window: int = 7
    key_width: int | None = None
    description: str = ""
    tags: tuple[str, ...] = ("scd2",)
    tests: tuple[ColumnTest, ...] = ()
    gate_severity: str = "error"
    column_docs: dict = field(default_factory=dict, hash=False)
    dist_buckets: int = 0

    date_column = "valid_from"

    def __post_init__(self):
        _settle(self, self.dedupe or (self.hash_column,))
        for c in self.presentation_exclude:
            if c.lower() in {*(k.lower() for k in self.natural_key), self.date_column}:
                raise SpecError(f"{self.name}: {c} can't be left out of the presentation: it is part of the key or the validity")
            if c.lower() == self.dist_column.lower():
                raise SpecError(f"{self.name}: {c} can't be left out of the presentation: rows are distributed by it")

    @property
    def model(self) -> str:
        return f"{self.name}__history"

    @property
    def source_date(self) -> str:
        return self.change_column


@dataclass(frozen=True)
class SnapshotSpec:
    """A fact of which every period's rows are kept. Tests, severity and docs are as for a dimension."""

    name: str
    source: str
    natural_key: tuple[str, ...]
    snapshot_column: str = "snapshot_date"
    surrogate_key: str = ""
    dist_column: str = ""
    dedupe: tuple[str, ...] = ()
    presentation_exclude: tuple[str, ...] = ()
    volume_factor: float = 0.5
    volume_window: int = 7
    key_width: int | None = None
    description: str = ""
    tags: tuple[str, ...] = ("snapshot",)
    tests: tuple[ColumnTest, ...] = ()
    gate_severity: str = "error"
    column_docs: dict = field(default_factory=dict, hash=False)
    dist_buckets: int = 0

    date_column = "snapshot_date"

    def __post_init__(self):
        _settle(self, self.dedupe)
        for c in self.presentation_exclude:
            if c.lower() in {*(k.lower() for k in self.natural_key), self.date_column, self.dist_column.lower()}:
                raise SpecError(f"{self.name}: {c} can't be left out of the presentation")

    @property
    def model(self) -> str:
        return f"{self.name}__history"

    @property
    def source_date(self) -> str:
        return self.snapshot_column


def _settle(spec, dedupe: tuple[str, ...]) -> None:
    if isinstance(spec.natural_key, str):
        object.__setattr__(spec, "natural_key", (spec.natural_key,))
    object.__setattr__(spec, "natural_key", tuple(spec.natural_key))
    _check(spec.name, spec.source, spec.natural_key)
    object.__setattr__(spec, "surrogate_key", spec.surrogate_key or f"{spec.name}_sk")
    object.__setattr__(spec, "dist_column", spec.dist_column or spec.natural_key[0])
    object.__setattr__(spec, "dedupe", tuple(dedupe))
    object.__setattr__(spec, "tests", tuple(t if isinstance(t, ColumnTest) else ColumnTest(**t) for t in spec.tests))
    if spec.dist_buckets < 0:
        raise SpecError(f"{spec.name}: buckets are a number, or 0 for none")
    if spec.gate_severity not in SEVERITIES:
        raise SpecError(f"{spec.name}: a severity is one of {', '.join(SEVERITIES)}")


@dataclass(frozen=True)
class ExposureSpec:
    """A named consumer downstream of published tables."""

    name: str
    depends_on: tuple[str, ...]
    owner: str = ""
    description: str = ""
    meta: dict = field(default_factory=dict)


class Registry:
    """Specs by name, and the nodes they stand for."""

    def __init__(self, specs: Iterable[DimensionSpec | SnapshotSpec] = (), exposures: Iterable[ExposureSpec] = ()):
        self.specs: dict[str, DimensionSpec | SnapshotSpec] = {}
        for s in specs:
            self.specs.setdefault(s.name, s)  # the first of a name counts
        self.exposures = list(exposures)

    def __getitem__(self, name: str) -> DimensionSpec | SnapshotSpec:
        try:
            return self.specs[name]
        except KeyError:
            raise SpecError(f"no spec is named {name!r}; there are {', '.join(self.specs) or 'none'}") from None

    def of_model(self, model: str) -> DimensionSpec | SnapshotSpec | None:
        return next((s for s in self.specs.values() if model in (s.model, s.name, f"{s.name}__published")), None)

    def tagged(self, tag: str) -> list[DimensionSpec | SnapshotSpec]:
        return [s for s in self.specs.values() if tag in s.tags]

    def describe(self, name: str) -> list[dict]:
        """The nodes that a spec stands for, in the order in which they are built."""
        s = self[name]
        nodes = [("model", s.model, [s.source])]
        if isinstance(s, DimensionSpec):
            nodes.append(("model", f"{name}__candidate", [s.model]))
        nodes += [("test", f"{name}__{t.name}", [nodes[-1][1]]) for t in s.tests]
        nodes += [("model", f"{name}__published", [s.model]), ("test", f"{name}__gates", [f"{name}__candidate" if isinstance(s, DimensionSpec) else s.model, s.source]), ("table", name, [f"{name}__published"])]
        return [{"resource_type": t, "name": n, "depends_on": d, "tags": list(s.tags), "description": s.description} for t, n, d in nodes]
