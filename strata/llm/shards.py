"""Training-order materialisation of token ids into fixed-stride binary shards (operator 7).

Each task's documents form one stream of ids, every document closed by an end
id, cut into sequences of a fixed length. These are written once, with their
ids, and then every one has a number in a dense range; a keyed Feistel
permutation with cycle-walking maps that range onto itself and gives each
sequence its slot in training order. The ids are dealt out by range of slots,
and each range is sorted and written as shards of sequences at a fixed stride: slot ``s`` lies in shard ``s // per_shard`` at byte ``(s % per_shard) *
stride``, so readers go through a shard in order and resume at any slot.

Shards are written by Spark's text sink, a sequence's bytes a line: the stride is
those bytes and the line end. So they lie in any store that Spark writes, under
its commit protocol: a lost task or a second attempt leaves nothing that readers
see. Texts are tokenised once: sequences are kept until their number is known.

Defined results: null text counts as empty, so such a document is its end id;
repeated rows are written as often as they stand there; an empty table gives no
shards; long documents run over several sequences; the last sequence of a task's
stream is filled up with the end id; extra columns are not read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.bytebpe import codec, text_of
from strata.llm.common import scratch_path
from strata.sources.files import Folder

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(numbers: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """The permutation of range(total): a balanced Feistel network on the next even number of bits, walked until inside."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & _MASK) for r in range(rounds)]
    out = np.array(numbers, np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= total]
    return out.astype(np.int64)


#: Ranges of slots, each written by one task, at most.
MOST_RANGES = 50_000


#: How the sequences are kept until they have their slots.
KEPT = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.enable.dictionary": "false"}


def _dictionary(sequences: DataFrame, rows: int = 1000, size: int = 1 << 16) -> bytes | None:
    """A compression dictionary of at most ``size`` bytes from at most ``rows`` sequences; none where these are too few or too alike."""
    some = sequences.select("tokens").limit(rows).toArrow()["tokens"].to_pylist()
    try:
        return zstandard.train_dictionary(size, some).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def _streams(batches, vocabulary: str, end_id: int, length: int, kind: np.dtype):
    """Sequences of a task's stream: (ids, count of real ids, ids of its documents)."""
    c = codec(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    ids, keys, ends = np.zeros(0, kind), [], np.zeros(0, np.int64)  # what is left over, its documents and where they end

    def cut(n: int):
        first = np.searchsorted(ends, np.arange(n) * length, side="right").tolist()
        last = np.searchsorted(ends, np.minimum(np.arange(1, n + 1) * length, len(ids))).tolist()
        for i in range(n):
            part = ids[i * length : (i + 1) * length]
            yield part, len(part), keys[first[i] : last[i] + 1]

    for b in batches:
        raw = [x + end for x in c.encode(map(text_of, b.column(1)))]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
        ids = np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4").astype(kind)])
        keys += b.column(0).to_pylist()
        n = len(ids) // length
        yield from cut(n)
        done = int(np.searchsorted(ends, n * length, side="right"))
        ids, keys, ends = ids[n * length :], keys[done:], ends[done:] - n * length
    if len(ids):
        for part, n, within in cut(1):
            yield np.concatenate([part, np.full(length - n, end_id, kind)]), n, within


def materialise(docs: DataFrame, vocabulary: str, path: str, key: int = 2024, length: int = 1024, per_shard: int = 8192, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards under ``path``; return their index, one row a sequence.

    (slot, shard, byte_offset, n_tokens, tokens_crc32, doc_ids), read back from ``path/index``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    id_kind = source.schema[0].dataType.simpleString()
    kind = np.dtype("<u2") if max(end_id, codec(vocabulary).largest_id) < 1 << 16 else np.dtype("<u4")
    stride = length * kind.itemsize + 1

    def cut(batches):
        p, seen, numbers = TaskContext.get().partitionId(), [], count()
        found = _streams(_watched(batches, seen), vocabulary, end_id, length, kind)
        while rows := list(islice(found, 1024)):
            raw = [ids.tobytes() for ids, _, _ in rows]
            columns = ([p] * len(rows), list(islice(numbers, len(rows))), raw, [n for _, n, _ in rows], list(map(zlib.crc32, raw)), [within for _, _, within in rows])
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(seen[0]))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p", "i", "tokens", "n_tokens", "tokens_crc32", "doc_ids"])

    sequences = source.mapInArrow(cut, f"p int, i long, tokens binary, n_tokens int, tokens_crc32 long, doc_ids array<{id_kind}>")
    sequences.write.options(**KEPT).parquet(f"{path}/sequences")
    sequences = spark.read.parquet(f"{path}/sequences")
    counts = dict(sequences.groupBy("p").count().collect())  # one number a task of the scan
    total, tasks = sum(counts.values()), max(counts, default=-1) + 1
    starts = spark.sparkContext.broadcast(np.array([*accumulate([0, *(counts.get(p, 0) for p in range(tasks))])], np.int64))
    n_shards = -(-total // per_shard)
    words = _dictionary(sequences)

    def number(batches):
        squeeze = zstandard.ZstdCompressor(level=6, dict_data=words and zstandard.ZstdCompressionDict(words)).compress
        for b in batches:
            slots = slots_of(starts.value[b.column(0).to_numpy()] + b.column(1).to_numpy(), total, key)
            yield pa.record_batch([pa.array(slots), pa.array([squeeze(x.as_buffer()) for x in b.column(2)], pa.binary())], names=["slot", "tokens"])

    def unpack(batches):
        expand = zstandard.ZstdDecompressor(dict_data=words and zstandard.ZstdCompressionDict(words)).decompress
        for b in batches:
            yield pa.record_batch([pa.array([expand(x.as_buffer()) for x in b.column(0)], pa.binary())], names=["tokens"])

    def place(batches):
        for b in batches:
            numbers = starts.value[b.column(0).to_numpy()] + b.column(1).to_numpy()
            slots = slots_of(numbers, total, key)
            yield pa.record_batch([pa.array(slots), pa.array(slots // per_shard), pa.array(slots % per_shard * stride), *b.columns[2:]], names=["slot", "shard", "byte_offset", *b.schema.names[2:]])

    if total:
        ranges = min(n_shards, MOST_RANGES)  # a task writes one shard, or several that follow each other
        numbered = sequences.select("p", "i", "tokens").mapInArrow(number, "slot long, tokens binary")
        owner = F.floor(F.floor(F.col("slot") / per_shard) * ranges / n_shards).cast("int")
        in_order = numbered.repartitionById(ranges, owner).sortWithinPartitions("slot").select("tokens")
        lines = in_order.mapInArrow(unpack, "tokens binary").select(F.col("tokens").cast("string").alias("value"))
        lines.write.option("maxRecordsPerFile", per_shard).option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")
    schema = f"slot long, shard long, byte_offset long, n_tokens int, tokens_crc32 long, doc_ids array<{id_kind}>"
    sequences.drop("tokens").mapInArrow(place, schema).write.parquet(f"{path}/index")
    Folder(spark, path).delete("sequences")
    layout = [(total, length, kind.str, stride, per_shard, n_shards, key, end_id)]
    spark.createDataFrame(layout, "sequences long, length int, dtype string, stride int, per_shard int, shards int, key long, end_id int").coalesce(1).write.json(f"{path}/layout")
    return spark.read.schema(schema).parquet(f"{path}/index")


def _watched(batches, seen: list):
    for b in batches:
        seen[:] = [b.schema[0].type]
        yield b


class Shards:
    """A reader of what :func:`materialise` wrote, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)
        self.layout = spark.read.json(f"{path}/layout").first()
        self.names = [f"shards/{n}" for n in self.folder.names("shards") if n.startswith("part-")]  # by task and file: in the order of slots
        if len(self.names) != self.layout["shards"]:
            raise ValueError(f"{path} has {len(self.names)} shards, not {self.layout['shards']}")

    def read(self, slot: int, n: int) -> np.ndarray:
        """``n`` sequences in training order from ``slot`` on, by seeking in the shards."""
        at, out = self.layout, []
        while n > 0:
            take = min(n, at["per_shard"] - slot % at["per_shard"])
            raw = self.folder.read_bytes(self.names[slot // at["per_shard"]], slot % at["per_shard"] * at["stride"], take * at["stride"])
            out.append(np.frombuffer(raw, np.uint8).reshape(-1, at["stride"])[:, :-1].copy().view(at["dtype"]))
            slot, n = slot + take, n - take
        return np.concatenate(out) if out else np.zeros((0, at["length"]), at["dtype"])


def materialise_table(spark: SparkSession, docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """:func:`materialise` into a new folder beneath the shared one."""
    return materialise(docs, vocabulary, scratch_path(spark, "shards"), **options)
