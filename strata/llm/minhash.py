"""MinHash near-duplicates by tensored banding (operator 12).

A text's set are its distinct shingles of words. Table keys are not bands of
their own minhashes: a small collection of half bands, ``halves`` of ``rows``
minhashes each, is computed once, and every pair of half bands forms a key. 16
half bands of two give 120 keys of four minhashes from 32 minhashes instead of
480. Two sets meet if two half bands agree; of pairs with similarity ``s``
``(1-p)^16 + 16 p (1-p)^15`` never do, with ``p = s^2``: 2e-6 at 0.8, under 1e-8 from
0.87 on.

Equal sets are one class from the start. Each class is first compared with a few
centres of its lists: the least class of a list under several orders. What is not
joined then is compared with all of its lists, in blocks, whatever their length:
no cap. Two classes meet in each list that they share and are a candidate in the
first of these alone. A candidate goes three ways out: by sizes; by parities, 1,024 bits that
each say whether an even number of elements fell on it (every element that is not
shared flips one bit, so two texts differ in at least as many elements as bits);
and by the whole sets, which decide.

Defined results: null text counts as empty; a text without words has an empty set
and links with nothing, not even its like; fewer words than a shingle has are one
shingle; text that isn't UTF-8 has its wrong bytes replaced; repeated rows and ids
are repeated in the result, unlike texts of one id each with its own component;
rows without an id are returned without a component and link nothing; an empty
table gives none; further columns are not read.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.bytebpe import text_of
from strata.llm.common import discard, few, spread_join, written
from strata.llm.components import connected_components
from strata.llm.shingles import row_digest, shingle_set, words_of

PARITIES = 1024
HALVES, ROWS = 16, 2


@functools.cache
def constants(n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of ``n`` hash functions on 64-bit shingles."""
    made = np.random.default_rng(seed).integers(0, 1 << 64, (2, n), np.uint64)
    return made[0], made[1] | np.uint64(1)


def signature(elements: np.ndarray, masks: np.ndarray, factors: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """The least hash of a set under each function."""
    least = np.full(len(masks), np.iinfo(np.uint64).max)
    for at in range(0, len(elements), chunk):
        mixed = (elements[None, at : at + chunk] ^ masks[:, None]) * factors[:, None]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(1), out=least)
    return least


def half_bands(minhashes: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each ``rows`` minhashes."""
    parts = minhashes.reshape(-1, rows)
    out = np.zeros(len(parts), np.uint64)
    for k in range(rows):
        out = (out ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def bands_of(elements: np.ndarray) -> bytes:
    """A set's half bands."""
    return half_bands(signature(elements, *constants(HALVES * ROWS)), ROWS).tobytes()


def parity(elements: np.ndarray) -> np.ndarray:
    """Bits that say on which of the places an odd number of elements falls, as bytes."""
    odd = np.bincount((elements >> np.uint64(54)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8))


def table_keys(halves: np.ndarray) -> np.ndarray:
    """Of rows of half bands, a key for each pair of them: (rows, pairs)."""
    i, j = (np.array(x) for x in zip(*combinations(range(halves.shape[1]), 2), strict=True))
    salt = np.arange(1, len(i) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed = ((halves[:, i] ^ salt) * np.uint64(0xBF58476D1CE4E5B9) ^ halves[:, j]) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed & ~np.uint64(0x7F)) | np.arange(len(i), dtype=np.uint64)).view(np.int64)  # the table's number ends the key


def first_table(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first table in which two rows of half bands meet (they do in one at least)."""
    n = x.shape[1]
    numbers = np.zeros((n, n), np.int64)
    for k, (i, j) in enumerate(combinations(range(n), 2)):
        numbers[i, j] = k
    same = x == y
    a = same.argmax(1)
    same[np.arange(len(same)), a] = False
    return numbers[a, same.argmax(1)]


def most_apart(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """In how many elements two sets of n and m may differ at the threshold."""
    return (n + m) * (100 - percent) // (100 + percent)


def _may_link(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with parities x and y (rows of 64-bit words) can reach the threshold."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.bitwise_count(x ^ y).sum(-1) <= most_apart(n, m, percent))


def _bits(column: pa.Array) -> np.ndarray:
    """Rows of parities as 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITIES // 64)


#: Orders of classes: their numbers, with some bits turned.
ORDERS = [0, *(int(x) for x in np.random.default_rng(8).integers(0, 1 << 62, 7))]


def _stars(met: DataFrame) -> DataFrame:
    """(a, b): each class with the least class of its lists under each order, and with the one that is least in most of them."""
    orders = [F.col("cid").bitwiseXOR(F.lit(m)) for m in ORDERS]
    lists = met.groupBy("key").agg(*(F.min(o).alias(f"c{k}") for k, o in enumerate(orders)), F.count("*").alias("n"))
    lists = written(lists, "centres")
    hot = [r["key"] for r in lists.where("n > 1024").orderBy(F.desc("n")).limit(1000).collect()]
    near = written(spread_join(met, lists.drop("n"), "key", "cid", hot=hot), "near")
    least = near.groupBy("cid").agg(*(F.min(f"c{k}").alias(f"c{k}") for k in range(len(ORDERS))))
    each = least.select(F.col("cid").alias("a"), F.explode(F.array(*(F.col(f"c{k}").bitwiseXOR(F.lit(m)) for k, m in enumerate(ORDERS)))).alias("b"))
    shared = near.groupBy("cid", "c0").agg(F.count("*").alias("n")).where("cid <> c0")
    most = shared.groupBy("cid").agg(F.min(F.struct(-F.col("n"), "c0")).alias("f")).select(F.col("cid").alias("a"), F.col("f.c0").alias("b"))
    return each.where("a <> b").unionByName(most).distinct()


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _rest(met: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): all pairs of a list that are not joined yet and may link, in the first list that they share.

    Of a list's largest component no two are paired: the others, in blocks, meet all, in blocks.
    """
    rows = written(rooted(met.select("key", "cid"), roots), "rooted")
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    lists = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    lists = lists.select("key", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / block).alias("few"), F.ceil(F.col("all") / block).alias("many"))
    wide = rows.join(lists, "key").join(classes.select("cid", "n", "parity", "bands"), "cid")
    open_rows = written(wide, "open")
    minor = open_rows.where("root <> top").withColumns({"x": F.expr("pmod(xxhash64(cid), few)"), "y": F.explode(F.expr("sequence(0L, many - 1)")), "minor": F.lit(True)})
    whole = open_rows.withColumns({"x": F.explode(F.expr("sequence(0L, few - 1)")), "y": F.expr("pmod(xxhash64(cid, 1), many)"), "minor": F.lit(False)})
    dealt = minor.unionByName(whole).groupBy("key", "x", "y").agg(F.collect_list(F.struct("cid", "root", "n", "parity", "bands", "minor")).alias("rows")).select("rows", "key")

    def meet(batches):
        for b in batches:
            for at, key in enumerate(b.column("key").to_pylist()):  # a block of two times `block` rows or so at a time
                cid, root, n, bits, bands, is_minor = b.column("rows")[at].values.flatten()
                cid, root, n, is_minor, bits = cid.to_numpy(), root.to_numpy(), n.to_numpy(), is_minor.to_numpy(zero_copy_only=False), _bits(bits)
                bands = np.frombuffer(b"".join(bands.to_pylist()), np.uint64).reshape(len(cid), -1)
                left, right = np.flatnonzero(is_minor), np.flatnonzero(~is_minor)
                for lo in range(0, len(left), 128):
                    i = left[lo : lo + 128, None]
                    p, q = np.nonzero((root[i] != root[right]) & _may_link(n[i], bits[i], n[right], bits[right], percent))
                    p, q = i[p, 0], right[q]
                    here = first_table(bands[p], bands[q]) == key & 0x7F
                    if here.any():
                        x, y = cid[p[here]], cid[q[here]]
                        yield pa.record_batch([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and parities allow a link. ``b`` may be in many pairs."""
    of = lambda c, k: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    both = spread_join(pairs, of("b", 1), "b", "a").join(of("a", 0), "a").select("a", "b", "n0", "p0", "n1", "p1")

    def run(batches):
        for b in batches:
            ok = _may_link(b.column("n0").to_numpy(), _bits(b.column("p0")), b.column("n1").to_numpy(), _bits(b.column("p1")), percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.where(100 * F.least("n0", "n1") >= percent * F.greatest("n0", "n1")).mapInArrow(run, "a long, b long")


def linked_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) pairs, a written table, those whose sets (cid, set) reach the threshold. ``b`` may be in many pairs."""
    of = lambda c, x: sets.select(F.col("cid").alias(c), F.col("set").alias(x))
    both = spread_join(pairs, of("b", "y"), "b", "a").join(of("a", "x"), "a").select("a", "b", "x", "y")

    def compare(batches):
        for b in batches:
            near = []
            for at in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[at].as_buffer() or b"", np.uint64) for c in "xy")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def _sets(pairs: DataFrame, classes: DataFrame, source: DataFrame, words: int) -> DataFrame:
    """(cid, set) of every class that is in a pair, from a text of it. A written table."""
    wanted = few(written(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "wanted"))
    rows = few(written(classes.select("cid", F.col("least.id").alias("id"), F.col("least.row").alias("row")).join(wanted, "cid", "left_semi"), "rows"))

    def run(batches):
        for b in batches:
            for cid, t in zip(b.column("cid").to_pylist(), b.column("text"), strict=True):
                yield pa.record_batch([pa.array([cid], pa.int64()), pa.array([shingle_set(words_of(text_of(t)), words).tobytes()], pa.binary())], names=["cid", "set"])

    texts = source.withColumn("row", row_digest()).join(rows, ["id", "row"]).select("cid", "text")
    return written(texts.mapInArrow(run, "cid long, set binary").dropDuplicates(["cid"]), "sets")


def joined(classes: DataFrame, source: DataFrame, words: int, percent: int, block: int, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of each class that links with another: ``classes`` (cid, n, bands, parity, least) is a written table, ``source`` has the texts (id, text).

    ``more`` are further candidates (a, b), which join the first turn.
    """

    def post(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                keys = table_keys(np.frombuffer(b"".join(part.column("bands").to_pylist()), np.uint64).reshape(part.num_rows, HALVES))
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(part.column("cid").to_numpy(), keys.shape[1]))], names=["key", "cid"])

    posted = classes.where("n > 0").select("cid", "bands").mapInArrow(post, "key long, cid long")
    lists = written(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    hot = [r["key"] for r in lists.where("n > 1024").orderBy(F.desc("n")).limit(1000).collect()]
    met = written(spread_join(posted, lists.select("key"), "key", "cid", hot=hot), "met")
    discard(lists)

    linked = roots = None
    for candidates in (lambda: _stars(met) if more is None else _stars(met).union(more).distinct(), lambda: _rest(met, classes, roots, percent, block)):
        asked = written(candidates(), "asked")
        pairs = written(_possible(asked, classes, percent), "pairs")
        sets = _sets(pairs, classes, source, words)
        found = written(linked_sets(pairs, sets, percent), "linked")
        discard(asked, sets, pairs)
        linked = found if linked is None else linked.union(found)
        roots = connected_components(linked)
    discard(met)
    return roots


def similar_sets(docs: DataFrame, words: int = 2, percent: int = 80, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: components of texts whose sets' Jaccard similarity is at least ``percent`` hundredths."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def describe(batches):
        from xxhash import xxh3_128_digest

        for b in batches:
            digests, sizes, bands, bits = [], [], [], []
            for t in b.column("text"):
                own = shingle_set(words_of(text_of(t)), words)
                digests.append(xxh3_128_digest(own.tobytes()) if len(own) else None)
                sizes.append(len(own))
                bands.append(bands_of(own))
                bits.append(parity(own).tobytes())
            yield pa.record_batch([b.column("id"), b.column("row"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()), pa.array(bits, pa.binary())], names=["id", "row", "class", "n", "bands", "parity"])

    described = source.withColumn("row", row_digest()).mapInArrow(describe, f"id {kind}, row binary, class binary, n long, bands binary, parity binary")
    described = written(described, "described")
    told = F.col("class").isNotNull() & F.col("id").isNotNull()
    classes = described.where(told).groupBy("class").agg(F.min(F.struct("id", "row")).alias("least"), *(F.any_value(c).alias(c) for c in ("n", "bands", "parity")))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = joined(classes, source, words, percent, block)

    component = written(rooted(classes.select("cid", "class", F.col("least.id").alias("least")), roots), "rooted")
    first = component.groupBy("root").agg(F.min("least").alias("first"))
    component = spread_join(component, first, "root", "cid").select("class", "first")
    out = spread_join(described.where(told).select("id", "n", "class"), component, "class", "id").select("id", "n", "first")
    out = out.unionByName(described.where(~told).select("id", "n", F.col("id").alias("first")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
