"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding (operator 10).

Pre-tokenisation works without a regular expression. Every codepoint gets a
class from a table; a few classes look one to three codepoints ahead (the last
blank of a run, an apostrophe that opens a contraction). Each class is a
transition function on nine states. Composition of such functions is
associative, so a prefix scan over blocks gives the state in front of every
codepoint, and state and class together say whether a piece begins there. The
resulting slices feed a bounded cache of merged pieces. Each token's end among
the text's bytes is kept with its id: decoding goes to the place of any token
or byte without decoding what stands before it.

A long text is encoded in parts, each of which ends where a piece begins that
no later character can move, so memory is bounded by the part and by the ids.

Defined results: null text counts as empty and has no ids; an empty text
decodes to no bytes; a text of any length is encoded whole; repeated rows give
repeated results; an empty table gives none; extra columns are not read. Text
that isn't valid UTF-8, as of a cast binary, has its wrong bytes replaced by U+FFFD.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- classes
OTHER, LETTER, NUMBER, SPACE, BLANK, END = range(6)
#: Unicode White_Space codepoints, which \s of the pattern stands for.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# symbols of the automaton: what stands at a position, with what must be known of the following
(S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_BLANK, S_SPACE_LAST, S_BLANK_LAST, S_RESET) = range(9)
# states: what stands in front of a position
(START, IN_L, IN_N, IN_O, AFTER_SPACE, IN_BLANK, C1, C2, C_END) = range(9)
N_STATES = 9


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a piece begins at the symbol."""
    if symbol == S_LETTER:
        if state in (C1, C2):
            return (C_END if state == C1 else C1), False
        return IN_L, state not in (IN_L, AFTER_SPACE)
    if symbol == S_NUMBER:
        return IN_N, state not in (IN_N, AFTER_SPACE)
    if symbol in (S_OTHER, S_APOS1, S_APOS2):
        if state in (IN_O, AFTER_SPACE):
            return IN_O, False
        return {S_OTHER: IN_O, S_APOS1: C1, S_APOS2: C2}[symbol], True
    if symbol == S_BLANK:
        return IN_BLANK, state != IN_BLANK
    if symbol == S_SPACE_LAST:
        return AFTER_SPACE, True
    return START, True  # S_BLANK_LAST, S_RESET


@functools.cache
def _class_table() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closure of the symbols' transition functions: element of each symbol, products, values, piece starts."""
    generators = [tuple(_step(s, x)[0] for s in range(N_STATES)) for x in range(9)]
    elements = [tuple(range(N_STATES))]  # element 0: the identity
    index = {elements[0]: 0}
    for f in elements:  # grows while it is walked
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in index:
                index[h] = len(elements)
                elements.append(h)
    k = len(elements)
    product = np.array([[index[tuple(g[s] for s in f)] for g in elements] for f in elements], np.uint8)
    values = np.array(elements, np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(N_STATES)], bool)
    assert k < 256
    return np.array([index[g] for g in generators], np.uint8), product, values, starts


def _scan(elements: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix products, in blocks: along each block, over the blocks' totals, and both together."""
    _, product, _, _ = _monoid()
    flat, k = product.ravel(), np.int32(len(product))
    n = len(elements)
    rows = -(-n // block)
    if rows <= 1:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], out[i]]
        return out
    grid = np.zeros(rows * block, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = flat.take(grid[j - 1] * k + grid[j])
    before = np.zeros(rows, np.uint8)
    before[1:] = _scan(grid[-1], block)[:-1]
    return np.ascontiguousarray(flat.take(before * k + grid).T).ravel()[:n]


def piece_starts(codepoints: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin. ``ends`` are positions of separators, each of which closes a text."""
    cls = _class_table()[codepoints]
    cls[ends] = END
    after = np.empty_like(cls)
    after[:-1] = cls[1:]
    after[-1] = END
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BLANK, S_BLANK, S_RESET], np.uint8)[cls]
    last = (cls == SPACE) | (cls == BLANK)
    last &= after <= NUMBER
    symbols[last & (cls == SPACE)] = S_SPACE_LAST
    symbols[last & (cls == BLANK)] = S_BLANK_LAST
    at = np.flatnonzero(codepoints == ord("'"))
    if len(at):
        padded = np.append(codepoints, [0, 0])
        a, b = padded[at + 1], padded[at + 2]
        symbols[at[np.isin(a, [ord(c) for c in "stmd"])]] = S_APOS1
        symbols[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = S_APOS2
    of_symbol, _, values, starts = _monoid()
    state = np.empty(len(symbols), np.uint8)
    state[0] = START
    state[1:] = values[:, START].take(_scan(of_symbol[symbols])[:-1])
    return np.flatnonzero(starts.ravel().take(state * np.int16(9) + symbols))


# ---------------------------------------------------------------- vocabularies
def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in JSON vocabularies: itself where printable, else 256 upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a ``.tiktoken`` file or from a byte-level BPE's JSON, whose ids are its merge order."""
    with open(path, "rb") as f:
        if path.endswith(".json"):
            model, names = json.load(f), byte_names()
            return {bytes(names[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added_tokens(path)}
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def added_tokens(path: str) -> dict[str, int]:
    """Tokens of a JSON vocabulary that are found in a text before it is split, as its library does; a ``.tiktoken`` file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, "rb") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def _merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """The merges of one piece: the tokenizer library's, whose own splitting is not used, or the plain rule where it doesn't offer them."""
    import tiktoken

    try:
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    except AttributeError:
        return functools.partial(merge_piece, ranks)


def merge_piece(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The adjacent pair of lowest rank is merged, the first of such, until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(pairwise(parts)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class _Merged(dict):
    """Piece to its ids as little-endian unsigned 32-bit bytes.

    At ``limit`` pieces a new generation begins, which takes over what is asked for again of the one
    before; earlier ones go. So memory is bounded and frequent pieces stay.
    """

    def __init__(self, merge: Callable[[bytes], list[int]], limit: int):
        super().__init__()
        self.merge, self.limit, self.before = merge, limit, {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        out = self.before.get(piece)
        if out is None:
            out = array("I", self.merge(piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """Encodes texts and decodes ids under one vocabulary. One instance a worker and vocabulary: see :func:`codec`."""

    def __init__(self, path: str, cache_pieces: int = 300_000, chunk_chars: int = 1_000_000):
        ranks, self.added = load_ranks(path), added_tokens(path)
        self._found = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._merged = _Merged(_merger(ranks), cache_pieces)
        self.chunk_chars = chunk_chars
        self.token_bytes = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.token_bytes[i] = token
        self._lengths = np.fromiter(map(len, self.token_bytes), np.int64, len(self.token_bytes))

    @property
    def largest_id(self) -> int:
        return len(self.token_bytes) - 1

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All pieces of the texts as UTF-8, at which codepoint each begins, and where the texts end, each followed by one separator."""
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = piece_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends)
        utf8 = joined.encode()
        at = starts
        if len(utf8) > len(joined):  # from codepoints to bytes
            at = np.flatnonzero((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)[starts]
        at = at.tolist()
        at.append(len(utf8))
        return [utf8[a:b] for a, b in pairwise(at)], starts, ends

    def _plain(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of texts in which no added token is looked for."""
        for chunk in _chunks(texts, self.chunk_chars):
            if len(chunk[0]) > self.chunk_chars:
                yield self._long(chunk[0])
                continue
            found, starts, ends = self.pieces(chunk)
            ids = list(map(self._merged.__getitem__, found))
            hi = np.searchsorted(starts, ends).tolist()
            lo = np.searchsorted(starts, np.append(0, ends[:-1] + 1)).tolist()
            for a, b in zip(lo, hi, strict=True):
                yield b"".join(ids[a:b])

    def _long(self, text: str) -> bytes:
        """A long text in parts: one ends at the last piece that begins four characters or more before what isn't known yet."""
        out, at, size = [], 0, self.chunk_chars
        while at < len(text):
            part = text[at : at + size]
            found, starts, (end,) = self.pieces([part])
            n, step = int(np.searchsorted(starts, end)), len(part)
            if at + size < len(text):
                n = int(np.searchsorted(starts, len(part) - 4, side="right")) - 1
                if n < 1:  # one piece fills the part
                    size *= 2
                    continue
                step = int(starts[n])
            out += map(self._merged.__getitem__, found[:n])
            at, size = at + step, self.chunk_chars
        return b"".join(out)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit bytes."""
        if not self._found:
            yield from self._plain(texts)
            return
        between: deque[list[bytes]] = deque()  # of each text on its way, the added tokens between its segments

        def segments() -> Iterator[str]:
            for t in texts:
                between.append([np.array([self.added[x]], "<u4").tobytes() for x in self._found.findall(t)] if any(x in t for x in self.added) else [])
                yield from self._found.split(t) if between[-1] else (t,)

        done: list[bytes] = []
        for ids in self._plain(segments()):
            done.append(ids)
            if len(done) > len(between[0]):
                yield done[0] if len(done) == 1 else b"".join([done[0], *(x for pair in zip(between[0], done[1:], strict=True) for x in pair)])
                between.popleft()
                done = []

    def ends(self, ids: bytes) -> np.ndarray:
        """Where each token ends among the text's bytes."""
        return np.cumsum(self._lengths[np.frombuffer(ids, "<u4")])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray, start: int, stop: int) -> bytes:
        """Bytes ``start`` to ``stop`` of a text, from the tokens that hold them alone."""
        first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop))
        held = self.decode(ids[first : last + 1].tolist())
        base = int(ends[first - 1]) if first else 0
        return held[max(0, start - base) : max(0, stop - base)]


def _chunks(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    chunk, n = [], 0
    for t in texts:
        if chunk and n + len(t) > chars:
            yield chunk
            chunk, n = [], 0
        chunk.append(t)
        n += len(t) + 1
    if chunk:
        yield chunk


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


# ---------------------------------------------------------------- operator
def text_of(value: pa.Scalar) -> str:
    """A text, empty for null; bytes that aren't UTF-8 are replaced."""
    try:
        return value.as_py() or ""
    except UnicodeDecodeError:
        return value.as_buffer().to_pybytes().decode("utf-8", "replace")


def _source(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    source = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return source, source.schema[0].dataType.simpleString()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (id, ids, ends, n_tokens). No shuffle.

    ``ids`` are little-endian unsigned 32-bit, ``ends`` the same for each token's end among the text's
    bytes (64-bit).
    """

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            ids = list(c.encode(map(text_of, b.column(1))))
            ends = [c.ends(x).astype("<i8").tobytes() for x in ids]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(ends, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[id_col, "ids", "ends", "n_tokens"])

    source, kind = _source(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary, ends binary, n_tokens long")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", start: int = 0, stop: int | None = None) -> DataFrame:
    """(id, bytes) of every row of :func:`encode_documents`: the text's bytes from ``start`` to ``stop``, found by the tokens' ends."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, ends = np.frombuffer(x or b"", "<u4"), np.frombuffer(y or b"", "<i8")
                size = int(ends[-1]) if len(ends) else 0
                out.append(c.decode_bytes(ids, ends, start, size if stop is None else min(stop, size)))
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"])

    source = encoded.select(id_col, "ids", "ends")
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of :func:`encode_documents` and of what its ids decode to, in one pass: nothing but digests leaves a task."""

    def run(batches):
        c = codec(vocabulary)
        decimal = list(map(str, range(c.largest_id + 1)))
        for b in batches:
            counts, encoded, decoded = [], [], []
            for raw in c.encode(map(text_of, b.column(1))):
                ids = np.frombuffer(raw, "<u4")
                ends = c.ends(raw)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode_bytes(ids, ends, 0, int(ends[-1]) if len(ends) else 0)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source, kind = _source(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
