"""Byte-level BPE with vectorised pre-tokenisation.

Texts are arrays of code points.  A table maps each to a class, and a look at
the next three points refines it (a space before a word, an apostrophe before
``ll``, white space before white space).  A small automaton over these classes
says where a token begins.  Its transition functions compose associatively, so
it is run as a scan: blocks of characters are composed side by side, the block
functions are chained, and each block is then replayed from its true state, all
with numpy and without a regular expression.

The slices between boundaries are merged by rank and remembered.  Their byte
offsets are kept, so a token id's place in the text is known and decoding gives
back the same bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_buffers

#: slices that one Python process remembers
CACHE = 400_000
# classes of code points, and what looking ahead makes of some
OTHER, LETTER, NUMBER, SPACE, WHITE, APOS, BEFORE_WHITE, SHORT, LONG = range(9)
# states: what the last character belongs to
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, JOINS, LEFT1, LEFT2, DONE = range(9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and begins[state, class]: the state after a character, and whether it begins a token."""
    after, begins = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    for state in range(9):
        for cls in range(9):
            if state in (LEFT1, LEFT2):  # within 's or 'll
                after[state, cls], begins[state, cls] = (DONE, False) if state == LEFT1 else (LEFT1, False)
                continue
            for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS)):
                if cls == kind:
                    after[state, cls], begins[state, cls] = inside, state not in (inside, JOINS)
            if cls in (OTHER, APOS) or (cls in (SHORT, LONG) and state in (IN_OTHER, JOINS)):
                after[state, cls], begins[state, cls] = IN_OTHER, state not in (IN_OTHER, JOINS)
            elif cls in (SHORT, LONG):
                after[state, cls] = LEFT1 if cls == SHORT else LEFT2
            elif cls == SPACE:  # the last white space before something else, and able to join it
                after[state, cls] = JOINS
            elif cls == WHITE:  # the last white space before something else, a token by itself
                after[state, cls] = DONE
            elif cls == BEFORE_WHITE:
                after[state, cls], begins[state, cls] = IN_WHITE, state != IN_WHITE
    return after, begins


NEXT, BEGINS = _automaton()


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, as the tokenizer library itself sees it.

    Its letters and numbers follow a newer Unicode than Python's, so it is
    asked once which characters it takes for which.
    """
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], "<u4")
    text = points.tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    table[0x20], table[0x27] = SPACE, APOS
    return table


def classes(points: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes with their look-ahead; ``last`` holds the place of each text's last character."""
    c = table[points]
    n = len(c)
    white = (c == SPACE) | (c == WHITE)
    ends = np.zeros(n, bool)
    ends[last] = True
    follows = np.ones(n, bool)
    follows[:-1] = white[1:]
    c[white & (follows | ends)] = BEFORE_WHITE
    apos = np.flatnonzero((c == APOS) & ~ends)
    one = points[apos + 1]
    c[apos[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
    more = apos[~ends[apos + 1]]
    a, b = points[more + 1], points[more + 2]
    pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    c[more[pair]] = LONG
    return c


#: The same over flat codes, 18 x state + class: a class plus 9 begins a text, whatever came before.
_CODES = [(state, cls) for state in range(9) for cls in range(18)]
_NEXT = np.array([18 * int(NEXT[state if cls < 9 else START, cls % 9]) for state, cls in _CODES])
_BEGINS = np.array([bool(BEGINS[state, cls]) if cls < 9 else True for state, cls in _CODES])


def _last_states(step: np.ndarray) -> np.ndarray:
    """The flat state after each column of ``step``, for each state before it: composed functions, (columns, 9).

    The last characters alone mostly decide; only columns that are still open
    are composed over a longer end.
    """
    width, columns = step.shape
    out = np.empty((columns, 9), np.int64)
    open_columns, tail = np.arange(columns), min(16, width)
    while len(open_columns):
        function = np.tile(18 * np.arange(9), (len(open_columns), 1))
        for i in range(width - tail, width):
            function = _NEXT[function + step[i, open_columns][:, None]]
        out[open_columns] = function
        if tail == width:
            break
        open_columns, tail = open_columns[(function != function[:, :1]).any(axis=1)], min(tail * 8, width)
    return out


def scan(c: np.ndarray, first: np.ndarray, width: int = 256) -> np.ndarray:
    """Where tokens begin, by composing transition functions; ``first`` holds each text's first character."""
    n = len(c)
    if not n:
        return np.zeros(0, bool)
    columns = -(-n // width)
    step = np.zeros(columns * width, np.int64)
    step[:n] = c
    step[first] += 9
    step = np.ascontiguousarray(step.reshape(columns, width).T)
    # 1. each column's function  2. the state that each column begins in
    functions, state = _last_states(step), 18 * START
    enter = np.empty(columns, np.int64)
    for r, function in enumerate(functions.tolist()):
        enter[r] = state
        state = function[state // 18]
    # 3. replay, all columns side by side
    out, state = np.empty((width, columns), bool), enter
    for i in range(width):
        code = state + step[i]
        np.take(_BEGINS, code, out=out[i])
        state = _NEXT[code]
    return out.T.ravel()[:n]


def slices(data: bytes, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all tokens' slices, their number in each text) of texts that lie one after another."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), "<u4")
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte of each code point
    full = offsets[:-1][np.diff(offsets) > 0]
    first = np.searchsorted(lead, full)
    last = np.append(first[1:], len(points)) - 1 if len(first) else first
    begins = scan(classes(points, last, table), first)
    starts = lead[begins]
    return starts, np.diff(np.searchsorted(starts, offsets))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: the pair of the lowest rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i
    back = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        j = end[i]
        alive[j], end[i] = False, to
        if to < n:
            back[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (b := back[i]) >= 0 and (r := ranks.get(piece[b:to])) is not None:
            heapq.heappush(heap, (r, b, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """A vocabulary of ranks with the slices met so far."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.table = class_table()
        self.known: dict[bytes, tuple[int, ...]] = {}

    def encode_block(self, data: bytes, offsets: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """(ids of each slice, byte starts of the slices, number of slices in each text)."""
        starts, counts = slices(data, offsets, self.table)
        at = starts.tolist()
        pieces = [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
        new = set(pieces) - self.known.keys()
        for p in new:
            self.known[p] = tuple(merge(p, self.ranks))
        out = list(map(self.known.__getitem__, pieces))
        if len(self.known) > CACHE:
            # what came first is the commonest
            for p in new:
                del self.known[p]
        return out, starts, counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def _texts(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, bytes, np.ndarray]]:
    raw, offs = text_buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1))
        yield at, raw[offs[at] : offs[to]].tobytes(), offs[at : to + 1] - offs[at]
        at = to


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids, starts): each row of docs in a struct, its token ids, and the byte where each token begins.

    A null or empty text has no ids.  Rows do not meet, so nothing is shuffled.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for first, data, offsets in _texts(batch.column(1)):
                parts, starts, counts = c.encode_block(data, offsets)
                at = np.concatenate([[0], np.cumsum(counts)])
                ids = [[i for p in parts[a:b] for i in p] for a, b in zip(at[:-1], at[1:], strict=True)]
                places = []
                for row, a, b in zip(ids, at[:-1], at[1:], strict=True):
                    sizes = np.array([len(c.bytes_of[i]) for i in row], np.int64)
                    places.append((np.cumsum(sizes) - sizes).tolist() if b > a else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))], ["row", "ids", "starts"])

    schema = packed.select("row").schema.add("ids", T.ArrayType(T.IntegerType())).add("starts", T.ArrayType(T.LongType()))
    return packed.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(row, decoded): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "decoded"])

    return encoded.select("row", "ids").mapInArrow(run, encoded.select("row").schema.add("decoded", "binary"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns; encoding and decoding happen in one pass so that no id leaves its task.

    Null and empty texts have no tokens; repeated rows give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for first, data, offsets in _texts(batch.column("text")):
                parts, _, counts = c.encode_block(data, offsets)
                n, digest, back, at = [], [], [], 0
                for k in counts.tolist():
                    ids = [i for p in parts[at : at + k] for i in p]
                    at += k
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join(map(_decimal, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(n)), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_decimal = [str(i) for i in range(1 << 17)].__getitem__
