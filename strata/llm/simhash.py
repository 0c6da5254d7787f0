"""SimHash near-duplicates by a byte-position index with count filtering (operator 2).

A fingerprint has eight bytes at fixed positions. Two fingerprints that differ
in at most ``bits`` bits differ in at most ``bits`` bytes, so at least
``8 - bits`` positional bytes match: the guaranteed minimum. Lists of single
bytes would each hold 1/256 of all fingerprints, and their pairs would grow
with the square of the input. The index therefore posts byte *triples*: a
smallest family of position triples such that any four matching positions hold
one of them (20 of the 56), so no link is lost. Pairs that meet in a list have
their shared positional bytes tallied, those that reach the minimum stay, and
the Hamming distance verifies them.

Equal fingerprints are one class from the start, so copies are never compared.
A list of more than ``block`` fingerprints is not compared pair by pair: each of
its fingerprints is posted to the centres that lie within two bits of it outside
the triple. Any two within four bits have a centre in common, any two of a centre
are within four bits, and a centre has at most 821 of them, so such lists cost
in proportion to their length and lose nothing. From each group only a spanning
forest of its links leaves, not all pairs: the components are the same.
Components are joined by stars on Spark.

:func:`near_duplicates` links fingerprints. :func:`similar_documents` takes what the
same index links as candidates, then what meets in tensored tables of minhashes, and
compares shingle sets exactly.

Defined results: null text counts as empty; texts without words have
fingerprint zero and link like any other; fewer than ``words`` words make one
shingle; text that isn't UTF-8 has its wrong bytes replaced; repeated rows are
repeated in the result; null ids get the component of their fingerprint (of
:func:`similar_documents` they are no rows); an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import minhash
from strata.llm.bytebpe import text_of
from strata.llm.common import spread_join, written
from strata.llm.components import connected_components
from strata.llm.shingles import class_of, row_digest, shingle_set, shingles, words_of

__all__ = ["class_of", "fingerprint", "fingerprints", "links", "near_duplicates", "row_digest", "shingle_set", "shingles", "similar_documents", "words_of"]


def fingerprint(text: str | None, words: int = 4, seed: int = 42, chunk: int = 65536) -> int:
    """64-bit SimHash of one text over shingles of ``words`` words, repeats counted."""
    from xxhash import xxh64_intdigest

    found = words_of(text)
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        hashes = [xxh64_intdigest(b" ".join(found[i : i + words]), seed) for i in range(at, min(n, at + chunk))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: the fingerprint's bits as a signed long). No shuffle."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(text_of(t), words) for t in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, fp long")


def position_triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions of which any four positions hold one.

    The positions stand in three rings of 3, 3 and 2; taken are the triples
    within a ring and those with two in one ring and one in the next.
    """
    ring = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        r = sorted(ring[p] for p in t)
        if len(set(r)) == 1 or len(set(r)) == 2 and (max(set(r), key=r.count) + 1) % 3 == min(set(r), key=r.count):
            out.append(t)
    return out


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[j] = i
        return i != j


def _forest(octets: np.ndarray, minimum: int, bits: int, step: int = 512) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints, a row of bytes each."""
    sets, out = _Sets(len(octets)), []
    for at in range(0, len(octets), step):
        part = slice(at, at + step)
        shared = np.zeros((len(octets[part]), len(octets) - at), np.uint8)
        for p in range(octets.shape[1]):
            shared += octets[part, p, None] == octets[None, at:, p]
        i, j = np.nonzero(shared >= minimum)
        i, j = i + at, j + at
        keep = i < j
        i, j = i[keep], j[keep]
        near = np.bitwise_count(octets[i] ^ octets[j]).sum(1) <= bits
        out += [(x, y) for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True) if sets.join(x, y)]
    return out


def _octets(nodes: np.ndarray) -> np.ndarray:
    """A row of bytes for each fingerprint."""
    return nodes.view(np.uint8).reshape(-1, 8)


def postings(classes: DataFrame, node: str, triples: list[tuple[int, int, int]], slice_rows: int = 2048) -> DataFrame:
    """(node, key): a row for each byte triple of a fingerprint; keys hold the triple's number and bytes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                nodes = b.column(0).slice(at, slice_rows).to_numpy()
                octets = _octets(nodes).astype(np.int64)
                keys = [(k << 24) + octets[:, x] + (octets[:, y] << 8) + (octets[:, z] << 16) for k, (x, y, z) in enumerate(triples)]
                # a node's rows stand together, so that they compress
                yield pa.record_batch([pa.array(np.repeat(nodes, len(keys))), pa.array(np.stack(keys, axis=1).ravel())], names=["node", "key"])

    return classes.select(F.col(node).cast("long")).mapInArrow(run, "node long, key long")


def _around(triple: tuple[int, int, int]) -> np.ndarray:
    """Masks of at most two bits outside a triple's bytes."""
    free = [np.int64(1) << np.int64(8 * p + b) for p in range(8) if p not in triple for b in range(8)]
    return np.array([0, *free, *(x | y for x, y in combinations(free, 2))], np.int64)


def links(classes: DataFrame, node: str, triples: list[tuple[int, int, int]], minimum: int, bits: int, block: int = 4096) -> DataFrame:
    """(a, b) pairs of linked fingerprints, enough of them to connect all that are linked: with at most ``bits`` = 4 bits of difference."""
    if bits != 4:
        raise ValueError("the index is made for 4 bits")
    posted = postings(classes, node, triples)
    lists = written(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    groups = posted.join(lists.where(F.col("n") <= block), "key").groupBy("key").agg(F.collect_list("node").alias("nodes")).select("nodes")

    def forest(batches):
        for b in batches:
            left, right = [], []
            values, ends = b.column(0).flatten().to_numpy(), np.cumsum(b.column(0).value_lengths().to_numpy())
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) if b.num_rows else ():
                nodes = values[lo:hi]
                for i, j in _forest(_octets(nodes), minimum, bits):
                    left.append(nodes[i])
                    right.append(nodes[j])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    found = groups.mapInArrow(forest, "a long, b long")
    long = lists.where(F.col("n") > block)
    if long.limit(1).count():
        masks = [_around(t) for t in triples]

        def centres(batches):
            for b in batches:
                nodes, which = b.column("node").to_numpy(), b.column("key").to_numpy() >> 24
                for x, k in zip(nodes, which.tolist(), strict=True):
                    yield pa.record_batch([pa.array(np.full(len(masks[k]), x)), pa.array((x ^ masks[k]))], names=["node", "centre"])

        met = spread_join(written(posted, "posted"), long, "key", "node").select("node", "key").mapInArrow(centres, "node long, centre long")
        stars = met.groupBy("centre").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 1")
        near = stars.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b")
        found = found.union(near)
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the component's smallest id, by links of fingerprints, itself included."""
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    found = connected_components(links(classes, "fp", position_triples(), 8 - bits, bits))
    roots = written(classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    component = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = spread_join(roots, component, "root", "fp").select("fp", "component_id")
    return spread_join(prints, of_class, "fp", id_col).select(id_col, "fp", "component_id")


# ---------------------------------------------------------------- similar texts
def majority(hashes: np.ndarray, chunk: int = 65536) -> int:
    """64-bit SimHash of hashes, repeats counted; zero of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        ones += np.unpackbits(hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, block: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """(id, component_id) of every row with an id: components of texts whose shingles' Jaccard similarity is at least ``percent`` hundredths.

    Texts with the same words in the same order are one class from the start. Each class is a candidate with
    the least one among those that the byte-position index links to it by their SimHash; what a few edited words
    keep out of four of 64 bits comes from :func:`strata.llm.minhash.joined`. Whole sets decide on all candidates.

    ``with_row`` adds ``row`` (:func:`row_digest`), and ``chosen``: whether the row stands for its component.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def describe(batches):
        for b in batches:
            digests, prints, sizes, bands, bits = [], [], [], [], []
            for text in b.column("text"):  # a text's words at a time
                found = words_of(text_of(text))
                hashes = shingles(found, words)
                own = np.unique(hashes)
                digests.append(class_of(found))
                prints.append(majority(hashes))
                sizes.append(len(own))
                bands.append(minhash.bands_of(own))
                bits.append(minhash.parity(own).tobytes())
            yield pa.record_batch([b.column("id"), b.column("row"), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())], names=["id", "row", "class", "print", "n", "bands", "parity"])

    described = source.withColumn("row", row_digest()).mapInArrow(describe, f"id {kind}, row binary, class binary, print long, n long, bands binary, parity binary")
    described = written(described, "described")
    classes = described.groupBy("class").agg(F.min(F.struct("id", "row")).alias("least"), *(F.any_value(c).alias(c) for c in ("print", "n", "bands", "parity")))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    near = connected_components(links(classes.select("print").distinct(), "print", position_triples(), 4, 4))
    by_print = written(classes.join(near, classes["print"] == near.node, "left").select("cid", F.coalesce("root", "print").alias("root")), "by_print")
    first = by_print.groupBy("root").agg(F.min("cid").alias("b"))
    by_index = spread_join(by_print, first, "root", "cid").where("cid <> b").select(F.col("cid").alias("a"), "b")

    roots = minhash.joined(classes, source, words, percent, block, by_index)
    component = written(minhash.rooted(classes.select("cid", "class", "least"), roots), "rooted")
    least = component.groupBy("root").agg(F.min("least").alias("first"))
    component = spread_join(component, least, "root", "cid").select("class", "first")
    out = spread_join(described.select("id", "row", "class"), component, "class", "id")
    more = ["row", (F.struct("id", "row") == F.col("first")).alias("chosen")] if with_row else []
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"), *more)
