"""Sequence packing by Karmarkar-Karp multiway differencing (operator 1).

Documents become token ids plus a closing id, cut into pieces. Whole windows of
a long document stand alone; what is left over is cut at ``largest`` (half a
window: shorter documents stay whole, and padding stays under 1 %; with a whole
window nothing is cut that fits, and padding is some 3 %) and collected, within a
task, in groups of ``group`` pieces. A group is
split into as many windows as its tokens need, by multiway differencing: the
two partial partitions with the largest spreads are merged so that the fullest
windows of one meet the emptiest of the other, until one near-equal partition
is left. If its fullest window exceeds the capacity, the window count rises.

Nothing is shuffled: a group is made from rows of one task, so its size bounds
memory, and a lost task is redone alone. A sequence's id holds the task's
partition number, so it is unique; a task leaves at most one group that is
smaller than the others.

Defined results: null text counts as empty, so such a document is the closing
id alone; repeated rows are packed as often as they stand there; an empty table
gives no pieces; a text of any length is packed whole; extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bytebpe import codec, text_of

#: A partition's sequences are numbered from its number times this.
SEQUENCES_A_TASK = 1 << 40


def difference(lengths: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Split ``lengths`` into ``windows`` near-equal sums: (sum, indices) of each window that has any.

    A partial partition is its windows in falling order of sum, empty ones left out.
    """
    if not lengths:
        return []
    tie = count()
    heap = [(-n, next(tie), [(n, [i])]) for i, n in enumerate(lengths)] if windows > 1 else [(0, 0, [(sum(lengths), list(range(len(lengths))))])]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = _merge(a, b, windows)
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, next(tie), merged))
    return heap[0][2]


def _merge(a: list, b: list, windows: int) -> list:
    overlap = max(0, len(a) + len(b) - windows)
    if overlap:  # the emptiest of a, the last of them, meet the fullest of b, and the other way round
        kept_a, met_a = a[: len(a) - overlap], a[len(a) - overlap :]
        kept_b, met_b = b[: len(b) - overlap], b[len(b) - overlap :]
        out = kept_a + kept_b + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(met_a, reversed(met_b), strict=True)]
    else:
        out = a + b
    out.sort(key=lambda w: -w[0])
    return out


def windows_of(lengths: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Near-equal windows of at most ``capacity``: the count rises whenever the capacity is exceeded."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        out = difference(lengths, windows)
        if not out or out[0][0] <= capacity:
            return out
        windows += 1


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, closing_id: int = 0, group: int = 512, largest: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the document's ids before the piece.
    """
    largest = largest or max(1, capacity // 2)
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches):
        c = codec(vocabulary)
        serial = count((TaskContext.get() and TaskContext.get().partitionId() or 0) * SEQUENCES_A_TASK)
        kind, rest, out = None, [], []

        def close(pieces):
            for _, members in windows_of([p[2] for p in pieces], capacity):
                sequence, offset = next(serial), 0
                for i in members:
                    out.append((*pieces[i], sequence, offset))
                    offset += pieces[i][2]

        def flush():
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            kind = b.schema[0].type
            keys = b.column(0).to_pylist()
            for key, ids in zip(keys, c.encode(map(text_of, b.column(1))), strict=True):
                ids += closing
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    out.append((key, start, capacity, ids[4 * start : 4 * (start + capacity)], n, next(serial), 0))
                rest += [(key, x, min(largest, n - x), ids[4 * x : 4 * min(x + largest, n)], n) for x in range(whole, n, largest)]
                while len(rest) >= group:
                    close(rest[:group])
                    del rest[:group]
                if len(out) >= 4096:
                    yield flush()
        if rest:
            close(rest)
        if out:
            yield flush()

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind_name = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind_name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
