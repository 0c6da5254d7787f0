"""License scan: sparse TF-IDF cosine to templates, then inheritance along directories (operator 4).

Each line of a file, and each window of a form's term count over the whole text
(across lines and within them), is compared with the forms of every license, by the
cosine of TF-IDF vectors: its template, usual headers and the opening of its full
text. SPDX tags state a license by their identifier, with cosine 1. Document frequencies are counted over all files for every term of a
template; terms outside the templates weigh as if no file had them and enter a
line's length only. Forms that a file's or a line's terms can't reach are left out before that, and
no match is lost: by Cauchy-Schwarz a cosine is at most the length of the form's vector over
the terms that are present. Anchors, the heaviest terms of each form, so many that
the rest alone cannot reach the threshold, tell most files apart at once. A file's license
is that of its best line or window. Files that state one at their head or foot, the first or
last line that has text, are licence files of their directory with that license,
whatever a better line says of the file itself; files that state none take over that
of the nearest ancestor directory (their own included) by a join of directory paths,
in which each directory stands once.

Defined results: null and empty texts state nothing; a null path has no
directory, so nothing is inherited; equal cosines go to the earlier line, then
to the template's name; two licence files of one directory: a head before a
foot, the higher cosine, then the smaller id; repeated rows are judged each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bytebpe import text_of
from strata.llm.common import written

#: Usual statements of well-known licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Further forms, of which each is a template of its license.
FORMS = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "GPL-3.0": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-3.0": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",),
    "MPL-2.0": ("Mozilla Public License Version 2.0",),
}
_SPDX = re.compile(r"spdx-license-identifier:[ \t]*\(?([a-z0-9.\-]+)")
TERM = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
_TERM = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def forms(templates: dict) -> list[tuple[str, str]]:
    """(license, form): a license has one form or several."""
    return [(name, form) for name, x in sorted(templates.items()) for form in ([x] if isinstance(x, str) else x)]


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Matcher:
    """Templates as unit TF-IDF vectors, and their anchors."""

    def __init__(self, templates: dict, frequency: dict[str, int], n: int, threshold: float):
        every = forms(templates)
        self.idf = {t: math.log((n + 1) / (frequency.get(t, 0) + 1)) + 1 for _, x in every for t in terms(x)}
        self.unknown = math.log(n + 1) + 1
        self.threshold = threshold
        self.spdx = {f"{name.lower()}{end}": name for name in templates for end in ("", "-only", "-or-later")}
        #: of each form: license, unit vector, number of terms, anchors
        self.vectors = []
        for name, text in every:
            v = {t: k * self.idf[t] for t, k in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            v = {t: x / norm for t, x in v.items()}
            anchors, rest = set(), 1.0
            for t, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                    break
                anchors.add(t)
                rest -= x * x
            self.vectors.append((name, v, len(terms(text)), anchors))
        self.anchors = tuple(sorted({a for *_, anchors in self.vectors for a in anchors}))

    def possible(self, present: set[str], among: list | None = None) -> list:
        """Forms that a text of these terms may reach."""
        least = self.threshold**2 - 1e-9
        some = [f for f in (self.vectors if among is None else among) if not f[3].isdisjoint(present)]
        return [f for f in some if sum(x * x for t, x in f[1].items() if t in present) >= least]

    def best(self, line: str) -> tuple[str, float] | None:
        """The nearest template of at least the threshold."""
        found = terms(line)
        return self._best(found, self.possible(set(found)))

    def _best(self, found: list[str], near: list) -> tuple[str, float] | None:
        if not near:
            return None
        counts = Counter(found)
        scores = [(self._cosine(counts, v), name) for name, v, *_ in near]
        score, name = max(scores, key=lambda s: (s[0], [-ord(c) for c in s[1]]))
        return (name, score) if score >= self.threshold else None

    def _cosine(self, counts: Counter, v: dict[str, float]) -> float:
        norm = math.sqrt(sum((k * self.idf.get(t, self.unknown)) ** 2 for t, k in counts.items())) or 1.0
        return sum(counts[t] * self.idf[t] * x for t, x in v.items() if t in counts) / norm

    def windows(self, found: list[str], near: list) -> Iterator[tuple[str, float, int, int]]:
        """License, cosine, first and last term of the form in every window of a form's term count that reaches the threshold."""
        idf = [self.idf.get(t, self.unknown) for t in found]
        squares = np.cumsum([0.0, *(x * x for x in idf)])
        for name, v, n, _ in near:
            n = min(n, len(found))
            dot = np.cumsum([0.0, *(x * v.get(t, 0.0) for t, x in zip(found, idf, strict=True))])
            # a repeated term makes a window longer than the sum of its squares, so this cosine is no less than the true one
            bound = (dot[n:] - dot[:-n]) / np.sqrt(np.maximum(squares[n:] - squares[:-n], 1e-12))
            for i in np.flatnonzero(bound >= self.threshold - 1e-6).tolist():
                if (c := self._cosine(Counter(found[i : i + n]), v)) >= self.threshold:
                    own = [j for j in range(i, i + n) if found[j] in v]
                    yield name, c, own[0], own[-1]

    def scan(self, text: str) -> tuple[str, float, int, int | None, str | None, float | None] | None:
        """License, cosine and line number of a file's best line or window; whether head (0) or foot (1) states one, which, and its cosine."""
        lower = text.lower()
        tagged = "spdx-license-identifier" in lower
        if not tagged and not any(a in lower for a in self.anchors):
            return None
        lines = lower.split("\n")
        of_line = [terms(line) for line in lines]
        found = [t for x in of_line for t in x]
        near = self.possible(set(found))
        if not tagged and not near:
            return None
        full = [i for i, line in enumerate(lines) if line.strip()]
        line_of = [i for i, x in enumerate(of_line) for _ in x]
        stated = []  # license, cosine, first and last line
        for i, line in enumerate(lines):
            if b := self._best(of_line[i], self.possible(set(of_line[i]), near)):
                stated.append((*b, i, i))
            if tagged:
                stated += [(self.spdx[t], 1.0, i, i) for t in _SPDX.findall(line) if t in self.spdx]
        stated += [(name, c, line_of[i], line_of[j]) for name, c, i, j in (self.windows(found, near) if near else ())]
        if not stated:
            return None
        order = lambda x: (-x[1], x[2], x[0])
        best = min(stated, key=order)
        edge, of_edge = None, [x for x in stated if x[2] == full[0]]
        if of_edge:
            edge = 0
        elif of_edge := [x for x in stated if x[3] == full[-1]]:
            edge = 1
        return (*best[:3], edge, *(min(of_edge, key=order)[:2] if of_edge else (None, None)))


def document_frequencies(files: DataFrame, templates: dict, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Files that hold each term of the templates, and files: as many numbers as the templates have terms."""
    known = sorted({t for _, x in forms(templates) for t in terms(x)})
    held = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(TERM), F.lit(0)), F.array(*map(F.lit, known)))
    every = F.concat(held, F.array(F.lit("")))  # each file counts once, by an empty term
    found = {r["t"]: r["count"] for r in files.select(F.explode(every).alias("t")).groupBy("t").count().collect()}
    return found, found.pop("", 0)


def scan(files: DataFrame, templates: dict | None = None, threshold: float = 0.6, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, licence, how, licence_dir, cosine) of every file; how: header, inherited or none."""
    templates = templates or {name: (x, *FORMS[name]) for name, x in TEMPLATES.items()}
    files = files.select(F.col(id_col), F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    frequency, n = document_frequencies(files, templates)

    def run(batches):
        m = Matcher(templates, frequency, n, threshold)
        for b in batches:
            found = [m.scan(text_of(t)) or (None,) * 6 for t in b.column("text")]
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.record_batch([b.column(0), b.column("path"), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else ((),) * 6, kinds, strict=True))], names=[id_col, "path", "stated", "cosine", "line", "edge", "edge_stated", "edge_cosine"])

    schema = f"`{id_col}` {files.schema[0].dataType.simpleString()}, path string, stated string, cosine double, line int, edge int, edge_stated string, edge_cosine double"
    own = written(files.mapInArrow(run, schema).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "stated")

    licensed = own.where("edge is not null and path is not null").groupBy("dir").agg(F.min(F.struct("edge", (-F.col("edge_cosine")).alias("c"), id_col, "edge_stated")).alias("best"))
    licensed = licensed.select(F.col("dir").alias("licence_dir"), F.col("best.edge_stated").alias("licence"))
    # each directory once, with its ancestors and itself: the first k parts of its path
    parts = F.split("dir", "/")
    ancestors = own.where("path is not null").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"))
    ancestors = ancestors.select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("licence_dir"))
    nearest = ancestors.join(licensed, "licence_dir").groupBy("dir").agg(F.max(F.struct("depth", "licence_dir", "licence")).alias("near"))
    # one row a directory; "stated" files need none, so only the others are joined
    kept = F.col("stated").isNotNull()
    plain = own.where(kept).select(id_col, "path", F.col("stated").alias("licence"), F.lit("header").alias("how"), F.lit(None).cast("string").alias("licence_dir"), "cosine")
    others = own.where(~kept).join(nearest, (own.dir == nearest.dir) & own.path.isNotNull(), "left")
    others = others.select(id_col, "path", F.col("near.licence").alias("licence"), F.when(F.col("near").isNull(), "none").otherwise("inherited").alias("how"), F.col("near.licence_dir").alias("licence_dir"), "cosine")
    return plain.unionByName(others)
