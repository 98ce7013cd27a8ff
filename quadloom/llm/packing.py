"""Packing documents into sequences by the configuration linear program.

Only the histogram of piece lengths, at most ``capacity`` numbers, reaches the
driver.  There a sequence's content is a *configuration*: how many pieces of
each length.  The linear program that covers the histogram with as few
configurations as possible is solved by multiplicative weights: lengths that
are covered more than others get cheaper, and a knapsack dynamic program over
the prices finds the next configurations.  Its fractional solution is rounded,
and the program solved again for what rounding leaves.  Pieces find their places
in the plan by their rank within their length; the plan has some thousand
configurations whatever the input's size.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_buffers

CAPACITY, END = 4096, 1
#: how strongly a length's coverage lowers its price; how much worse than the best a configuration may be; configurations of one pricing
RATE, NEAR, COLUMNS = 1.0, 0.01, 64
#: what part of its scarcest length's need a configuration takes in the first solution; tokens that rounding may leave, as a part of all;
#: and how full a configuration must be while any such one is found, first and then
STEP, RESIDUE, FULL = 0.25, 0.001, (1.0, 0.999)
#: solutions that are tried where lengths do not fill sequences, and how strongly wasted space changes weights
PASSES, LEARN = 12, 1.0
#: pieces of one length that are ranked together, and parts of all pieces beyond which it is more, as the driver has a row for each
RANKED, PARTS = 1000, 50_000
#: words that one Python process remembers
CACHE = 500_000


#: Letters whose lower case, composed form and class are the same in every Unicode version.
_L = "a-z\u00df-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(f"[\\x21-\\x7eA-Z\u00c0-\u00d6\u00d8-\u012f\u0131-\u017f{_L}]+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^{_L}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Token ids of texts, by words.

    Splitting at ASCII white space never changes ids: the tokenizer drops
    white space, and neither its normaliser nor its splits cross it.  A word
    of common Latin letters is normalised and split here and its pieces go to
    the tokenizer's merge model; any other word takes the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        w = raw.decode("utf-8", "replace")
        if "<|" in w or not _PLAIN.fullmatch(w):
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        out = b""
        for piece in _PIECE.findall(w.lower()):
            got = self.pieces.get(piece)
            if got is None:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(self.pieces) < CACHE:
                    self.pieces[piece] = got
            out += got
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]
        new = set().union(*split) - self.known.keys()
        for w in new:
            self.known[w] = self.word(w)
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(self.known) > CACHE:
            # what came first is the commonest; the rest is worked out again when it is met again
            for w in new:
                del self.known[w]
        return out


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids_crc32[, ids]): a text's ids, then ``end``, in pieces of ``capacity``."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(vocabulary)
        for batch in batches:
            raw, offs = text_buffers(batch.column("text"))
            at, n = 0, len(offs) - 1
            while at < n:
                to = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 20), side="right")) - 1))
                block = raw[offs[at] : offs[to]].tobytes()
                cut = (offs[at : to + 1] - offs[at]).tolist()
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, ids in enumerate(tok.ids([block[a:b] for a, b in zip(cut, cut[1:], strict=False)])):
                    ids += tail
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        row.append(at + i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        held.append(part)
                cols = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Knapsack:
    """What each space up to ``capacity`` is worth at most under some prices, by dynamic programming; price[i] is that of length i + 1."""

    def __init__(self, price: np.ndarray, capacity: int):
        self.price, best, take = price, np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        n = int(np.flatnonzero(price > 0).max(initial=-1)) + 1
        # turned round, so that each step reads forwards
        turned = price[:n][::-1].copy()
        for c in range(1, capacity + 1):
            m = min(c, n)
            value = best[c - m : c] + turned[n - m :]
            k = int(value.argmax()) if m else 0
            if m and value[k] > best[c - 1]:
                best[c], take[c] = value[k], m - k
            else:
                best[c] = best[c - 1]
        self.best, self.take = best, take

    def fill(self, space: int, left: np.ndarray, held: dict[int, int]) -> dict[int, int]:
        """``held`` with the dearest content of the space besides, of which no length is taken more often than ``left`` has."""
        while space > 0:
            k = int(self.take[space])
            if not k:
                space -= 1
                continue
            if held.get(k, 0) >= left[k - 1]:
                # the best that is left, with the worth of the space after it
                m = min(space, len(left))
                value = np.where(left[:m] > 0, self.price[:m] + self.best[space - m : space][::-1], -1.0)
                for length, times in held.items():
                    if length <= m and times >= left[length - 1]:
                        value[length - 1] = -1.0
                # of equals the longest, as short pieces are of use to the end
                k = m - int(value[::-1].argmax())
                if value[k - 1] <= 0:
                    return held
            held[k] = held.get(k, 0) + 1
            space -= k
        return held


def relax(counts: np.ndarray, capacity: int, share: float, full: float, weight: np.ndarray | float = 1.0) -> tuple[list[tuple[dict[int, int], float]], float]:
    """A fractional solution of the configuration program, as (configuration, how often), and the dual's bound.

    Multiplicative weights: a length is worth its tokens, times ``weight``, times
    exp(-RATE * coverage), and nothing once it is covered.  The knapsack finds
    the dearest configuration; through its table also the dearest one that holds
    a given length, and those that are within NEAR of the best are used too, for
    the lengths that are covered least.  A configuration is used for ``share`` of
    what its scarcest length still needs.  It ends when all is covered, or when
    no configuration is worth its place, holding ``full`` tokens.  Prices divided
    by the dearest configuration are feasible in the dual, whose best value
    bounds the optimum.
    """
    lengths, need = np.arange(1, len(counts) + 1), np.maximum(counts, 1)
    rest, chosen, bound = counts.astype(float), [], 0.0
    while True:
        open_ = np.flatnonzero(rest > 1e-9)
        if not len(open_):
            return chosen, bound
        covered = 1 - rest / need
        price = np.where(rest > 1e-9, lengths * weight * np.exp(-RATE * covered), 0.0)
        sack = Knapsack(price, capacity)
        bound = max(bound, float((counts * price).sum() / sack.best[capacity]))
        value = price[open_] + sack.best[capacity - lengths[open_]]
        first = open_[np.lexsort((-lengths[open_], covered[open_], value < (1 - NEAR) * sack.best[capacity]))][:COLUMNS]
        met = np.zeros(len(counts), bool)
        # what is still to be covered now limits the configurations of this round
        now = np.ceil(rest - 1e-9)
        used = False
        for i in first.tolist():
            if met[i] or rest[i] <= 1e-9:
                continue
            held = sack.fill(capacity - i - 1, now, {i + 1: 1})
            if sum(n * k for n, k in held.items()) < full:
                continue
            used = True
            at = np.array(list(held), np.int64) - 1
            times = np.array(list(held.values()), float)
            most = float((rest[at] / times).min())
            step = most if len(held) == 1 or most <= 1 else max(1.0, share * most)
            rest[at] -= times * step
            rest[np.abs(rest) < 1e-9] = 0
            now[at] = np.ceil(rest[at] - 1e-9)
            met[at] = True
            chosen.append((held, step))
        if not used:
            return chosen, bound


def cover(counts: np.ndarray, capacity: int, share: float) -> tuple[list[tuple[dict[int, int], float]], float]:
    """As ``relax``, for lengths of which no full configurations can be made: all are covered, by as few as PASSES find.

    Lengths in configurations that waste space weigh more in the next pass, so
    that those take company while there is some; it ends where the dual proves
    that no fewer sequences would do.
    """
    weight, best, bound = np.ones(len(counts)), None, 0.0
    for _ in range(PASSES):
        chosen, dual = relax(counts, capacity, share, 0.0, weight)
        bound, used = max(bound, dual), sum(x for _, x in chosen)
        if best is None or used < best[1] - 1e-9:
            best = (chosen, used)
        if np.ceil(used - 1e-6) <= np.ceil(bound - 1e-6):
            break
        loss = np.zeros(len(counts))
        for held, step in chosen:
            waste = 1 - sum(n * k for n, k in held.items()) / capacity
            for n, k in held.items():
                loss[n - 1] += waste * step * k
        weight = weight * np.exp(LEARN * loss / np.maximum(counts, 1))
    return best[0], bound


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], dict[str, float]]:
    """Configurations and how often each is used, that hold counts[i] pieces of length i + 1, exactly; and how it went.

    The program is solved, its solution rounded down; a configuration whose
    fraction is left is used once more while its pieces last, the largest
    fraction first.  The program is solved again for what remains, with larger
    steps, until that is less than RESIDUE of all tokens or one sequence; this
    rest alone goes best-fit decreasing, into the spaces left or new sequences.
    Configurations that are not nearly full wait until no others are found.
    """
    left = counts.astype(np.int64).copy()
    lengths = np.arange(1, len(counts) + 1)
    volume = int((lengths * left).sum())
    plan: list[tuple[dict[int, int], int]] = []
    share, bound, fulls = STEP, None, [f * capacity for f in FULL]
    while (lengths * left).sum() > max(RESIDUE * volume, capacity):
        chosen, dual = relax(left, capacity, share, fulls[0]) if fulls else cover(left, capacity, share)
        bound = dual if bound is None else bound
        chosen.sort(key=lambda x: -x[1])
        again = []
        for held, step in chosen:
            at, each = np.array(list(held), np.int64) - 1, np.array(list(held.values()), np.int64)
            times = int(min(np.floor(step + 1e-9), (left[at] // each).min()))
            if times > 0:
                plan.append((held, times))
                left[at] -= each * times
            if step - times > 1e-9:
                again.append((step - times, at, each, held))
        for _, at, each, held in sorted(again, key=lambda x: -x[0]):
            if (left[at] >= each).all():
                plan.append((held, 1))
                left[at] -= each
        if not chosen:
            fulls = fulls[1:]
        share = min(1.0, share * 2)
    residue = int((lengths * left).sum())
    plan = fill_up(plan, left, capacity)
    used = sum(t for _, t in plan)
    return plan, {"sequences": used, "dual_bound": bound or 0.0, "volume_bound": -(-volume // capacity), "residue": residue / max(volume, 1)}


def fill_up(plan: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The plan with the pieces that are left, longest first, in the smallest space that holds them or in sequences of their own."""
    room: dict[int, list[list]] = {}
    out = [[dict(held), times] for held, times in plan]
    for entry in out:
        room.setdefault(capacity - sum(n * k for n, k in entry[0].items()), []).append(entry)
    for i in np.flatnonzero(left)[::-1].tolist():
        length = i + 1
        for _ in range(int(left[i])):
            space = min((r for r, entries in room.items() if r >= length and entries), default=None)
            if space is None:
                entry, space = [{}, 1], capacity
                out.append(entry)
            else:
                entry = room[space].pop()
                if entry[1] > 1:
                    entry[1] -= 1
                    room[space].append(entry)
                    entry = [dict(entry[0]), 1]
                    out.append(entry)
            entry[0][length] = entry[0].get(length, 0) + 1
            room.setdefault(space - length, []).append(entry)
    return [(held, times) for held, times in out]


def pack(found: DataFrame, capacity: int = CAPACITY, ranked: int = RANKED) -> DataFrame:
    """found(doc_id, piece, length, ...) with sequence_id and offset, in as few sequences as the plan needs.

    Every row is one piece and gets one place; ties and repeated rows get
    places of their own; an empty table gives no rows.
    """
    spark = found.sparkSession
    # at most ``capacity`` rows
    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity, np.int64)
    for length, n in sizes.items():
        counts[length - 1] = n
    ranked = max(ranked, int(counts.sum()) // PARTS)
    salts = spark.createDataFrame([(int(n), int(-(-k // ranked))) for n, k in sizes.items()], "_of long, _salts long")
    salted = found.join(F.broadcast(salts), F.col("length") == F.col("_of")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.col("_salts"))).drop("_of", "_salts")
    # a row for each length, and one for each ``ranked`` pieces: PARTS more at most
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "_salt"])
    cell_key = cells["length"].to_numpy(np.int64) << 32 | cells["_salt"].to_numpy(np.int64)
    before = cells["n"].to_numpy(np.int64).cumsum() - cells["n"].to_numpy(np.int64)
    length_before = np.concatenate([[0], counts.cumsum()])
    cell_first = before - length_before[cells["length"].to_numpy(int) - 1]

    rows, used, first = [], np.zeros(capacity + 1, np.int64), 0
    for content, times in solve(counts, capacity)[0]:
        at = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, used[length], each, first, at))
            used[length] += times * each
            at += length * each
        first += times
    rows.sort()
    plan = np.array(rows, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << np.int64(48)
        key = plan[:, 0] * span + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            cell = np.searchsorted(cell_key, length << 32 | batch.column("_salt").to_numpy(zero_copy_only=False))
            rank = batch.column("_rank").to_numpy(zero_copy_only=False) + (cell_first[cell] if len(cell) else 0)
            p = plan[np.searchsorted(key, length * span + rank, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            k = rank - p[:, 1]
            out = batch.drop_columns(["_salt", "_rank"])
            for name, v in (("sequence_id", p[:, 3] + k // np.maximum(p[:, 2], 1)), ("offset", p[:, 4] + k % np.maximum(p[:, 2], 1) * length)):
                out = out.append_column(name, pa.array(v, pa.int64()))
            yield out

    rank = (F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1).cast("long")
    ranked = salted.withColumn("_rank", rank)
    return ranked.mapInArrow(place, T.StructType(list(found.schema.fields)).add("sequence_id", "long").add("offset", "long"))


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The contract's columns for docs(doc_id, text).

    Null and empty texts are one piece, the end token alone.  Null ids pack
    like others; other columns are ignored.
    """
    found = stored(pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary, capacity), "pieces")
    return pack(found, capacity)
