"""Language-model scoring by a hierarchical Pitman-Yor process.

Restaurants form a chain: the two words before a token, the word before it, no
context.  Tables of a restaurant are customers of its parent, and the last one
rests on a uniform choice among the known words and one unknown.

Where things are.  *Chunks* are some whole documents as numbers of words, and
*shares* hold all trigrams whose last but one word falls to them, so that a
restaurant and its parent always lie together, and a word's root customers are
summed by the word.  Chunks send their different trigrams with counts and get
probabilities back, so the commonest trigram is one entry of a chunk.  A
previous word with more than ``share / 2`` tokens is spread over shares by the
word before it, and a pair with as many by the word after it; so no share grows
with a hot word, and nothing but a few sums reaches the driver.  Spreading moves
work, not the model: such a word or pair stays one restaurant.  The dishes of
its pieces are summed by their word, where the root's customers are too, and are
seated there; pieces get back each dish's customers and tables, and the sums of
the restaurant.

Seating.  A Gibbs step takes all customers of a word away from a restaurant and
from its children and seats them again one after another by the Chinese
restaurant's rule, each new table sending a customer up.  Between two new tables
the waiting time is beta-geometric, which is sampled as such: seating is exact
and costs as many steps as there are tables.  As the rule is myopic, a seating
is accepted by the ratio of its predictive products; those of the state before
are as they were when it was made.  Half of the words of a share are seated at
once given the other half.  Root probabilities, without the tables of the word that is
seated, and what other pieces hold, are those of the last exchange; in the first sweep each share has a root of its own, and each piece is a restaurant.  Discounts come from the counts of ones
and twos of their level, concentrations are sampled with auxiliary variables.

Predictive probabilities are averaged over ``sweeps`` states after the burn-in;
a random part of the words is seated anew for each.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, bounded_batches, mix

#: averaged states, the part of the dishes that is seated anew for each, and whole sweeps before them: with a root for each share and with that of all
SWEEPS, PART, BURN = 10, 0.12, (1, 1)
#: tokens of a chunk, and trigrams that a share should hold
CHUNK, SHARE = 1_000_000, 650_000
#: pairs met less often than this in a chunk are not asked for: they add less than that to a share
OFTEN = 8
#: rows of a dish beyond which they are seated given each other and not one after another
MANY = 12
#: dishes that are seated one after another rather than together
FEW = 40
#: negative logarithms travel as multiples of this
GRAIN = 2.0**-12
START = mix(np.array([0x57A], np.uint64))[0]
END = mix(np.array([0xE0D], np.uint64))[0]

#: bits of a place that tell the piece of a previous word, 0 where it is whole; the top bit marks pieces of pairs
PIECE = (1 << 20) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the tokens of a block, each text's words and then its end."""
    low = Block(_LOWER[b.data], b.offsets, b.first)
    n = len(low.starts)
    out, row = np.empty(n + b.n, np.uint64), np.empty(n + b.n, np.int64)
    out[np.arange(n) + low.doc] = low.hashes
    row[np.arange(n) + low.doc] = low.doc
    ends = low.word_at[1:] + np.arange(b.n)
    out[ends], row[ends] = END, np.arange(b.n)
    return out, row


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its first bytes first, then its second bytes and so on."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays if len(a))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *what: tuple[type, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, n in what:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbours begin, and the length."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64), len(x))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse, by a table where the numbers are small enough for one."""
    most = int(x.max(initial=0))
    if most > 32 * len(x) + (1 << 16):
        return np.unique(x, return_inverse=True)
    there = np.zeros(most + 1, bool)
    there[x] = True
    return np.flatnonzero(there).astype(x.dtype), (np.cumsum(there) - 1)[x]


def _same(key: int) -> int:
    return key


def _limit(share: int) -> int:
    """Training tokens beyond which a previous word, or a pair, is spread over shares."""
    return max(share // 2, 1)


def _pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(u) + v) | _U(1)


def _of(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The values of some of the sorted keys, 0 for others."""
    if not len(keys):
        return np.zeros(len(x), values.dtype)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, values[i], 0)


def _by_chunk(chunk: int) -> int:
    return chunk * 0x9E3779B97F4A7C15 >> 24 & 0x7FFFFFFF


# ---- seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive values."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    r = 1 / (y * y)
    far = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y
    # beyond this the product is not needed and may overflow
    return np.where(x < 1e30, far - np.log(np.minimum(low, 1e300)), far)


def until_new(rng: np.random.Generator, a: np.ndarray, x: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many of the next ``most`` customers join tables before one opens a new one.

    The i-th of them (from 0) opens one with probability a / (x + i + a); so the
    number is geometric with a chance that is beta distributed.
    """
    k = np.minimum(most, 1.0)
    one = most <= 1
    k[one] *= rng.random(int(one.sum())) * (x[one] + a[one]) >= a[one]
    if not one.all():
        more = np.flatnonzero(~one)
        p = np.maximum(rng.beta(a[more], x[more]), 1e-300)
        with np.errstate(divide="ignore", over="ignore"):
            n = np.floor(np.log(rng.random(len(more))) / np.log1p(-np.minimum(p, 1 - 1e-16)))
        k[more] = np.minimum(np.where(p >= 1, 0, n), most[more])
    return k


def _join(x: np.ndarray, a: np.ndarray, k: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The logarithm of the product of x + i + a for the k customers that joined, and the one that did not."""
    out = np.log(x + a)
    some = np.flatnonzero(k + new > 1)
    if len(some):
        far = x[some] + a[some]
        out[some] = log_gamma(far + k[some] + new[some]) - log_gamma(far)
    return out


def seat(rng: np.random.Generator, n: np.ndarray, theta: np.ndarray | float, d: float, tables: np.ndarray | float, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seats n customers of each dish in turn beside ``tables`` of others; p is its parent probability.  Returns tables and the log of the predictive product."""
    theta, tables, p = (np.broadcast_to(np.asarray(v, float), n.shape) for v in (theta, tables, p))
    c, t, z = np.minimum(n, 1.0), np.minimum(n, 1.0), np.where(n > 0, np.log(np.maximum((theta + d * tables) * p, 1e-300)), 0.0)
    at = np.flatnonzero(n > 1)
    while len(at) > FEW:
        a, x, left = (theta[at] + d * (tables[at] + t[at])) * p[at], c[at] - d * t[at], n[at] - c[at]
        k = until_new(rng, a, x, left)
        new = k < left
        z[at] += _join(x, a, k, new)
        c[at] += k + new
        t[at] += new
        at = at[c[at] < n[at]]
    draw = random.Random(int(rng.integers(1 << 62))) if len(at) else None
    for i in at.tolist():
        t[i], z[i] = _seat_alone(draw, float(n[i]), float(theta[i] + d * tables[i]), d, float(p[i]), float(c[i]), float(t[i]), float(z[i]))
    return t, z


def _seat_alone(draw: random.Random, n: float, w: float, d: float, p: float, c: float, t: float, z: float) -> tuple[float, float]:
    """As ``seat``, for one dish whose first c customers sit at t tables; ``w`` is the weight of a new table without its own."""
    log, lgamma = math.log, math.lgamma
    while c < n:
        a, x = (w + d * t) * p, c - d * t
        if 8 * a > x or n - c < 4:
            # new tables are frequent: one by one
            z += log(x + a)
            c += 1
            t += draw.random() * (x + a) < a
        else:
            chance = max(draw.betavariate(a, x), 1e-300)
            k = min(log(draw.random() or 1e-300) // math.log1p(-chance) if chance < 1 else 0.0, n - c)
            new = k < n - c
            z += lgamma(x + a + k + new) - lgamma(x + a)
            c += k + new
            t += new
    return t, z


@dataclass
class Level:
    """A level's discount and concentration."""

    discount: float
    theta: float


@dataclass
class Root:
    """Sums over all words: customers, tables, and the base probability."""

    level: Level
    customers: float
    tables: float
    base: float

    def of(self, c: np.ndarray | float, t: np.ndarray | float) -> np.ndarray:
        return (c - self.level.discount * t + (self.level.theta + self.level.discount * self.tables) * self.base) / (self.level.theta + self.customers)


class Seating:
    """The restaurants of a share: rows (restaurant, word) of both levels with their customers and tables.

    ``of`` and ``dish`` give each row's restaurant and its word in the parent,
    ``up`` and ``word`` each such dish's restaurant and its word in the root;
    ``customers`` may be 0 for rows that are only to be predicted.
    """

    def __init__(self, of: np.ndarray, dish: np.ndarray, up: np.ndarray, word: np.ndarray, customers: np.ndarray, seed: int):
        self.of, self.dish, self.up, self.word, self.c = of, dish, up, word, customers.astype(float)
        self.n_of, self.n_up, self.seed = int(of.max(initial=-1)) + 1, int(up.max(initial=-1)) + 1, seed
        self.t = np.minimum(self.c, 1.0)
        self.all = np.bincount(self.of, weights=self.c, minlength=self.n_of)
        several = np.flatnonzero(self.c > 1)
        #: rows with more than one customer by dish, and where each dish's begin
        self.several = several[np.argsort(dish[several], kind="stable")]
        self.first = np.searchsorted(dish[self.several], np.arange(len(up) + 1))
        self.single = np.bincount(dish, weights=self.c == 1, minlength=len(up))
        self.single_of = np.bincount(of, weights=self.c == 1, minlength=self.n_of)
        #: dishes and restaurants that have other pieces elsewhere, and what those hold as far as it is known
        self.shared, self.apart = np.zeros(len(up), bool), np.zeros(self.n_of, bool)
        self.c_else, self.all_else, self.tables1_else, self.tables_else = np.zeros(len(up)), np.zeros(self.n_up), np.zeros(self.n_up), np.zeros(self.n_of)
        self.t1 = np.minimum(self.customers_up(), 1.0)
        #: dishes with many such rows, or many customers in one: their rows are seated all at once
        most = np.zeros(len(up))
        np.maximum.at(most, dish[self.several], self.c[self.several])
        self.many = (np.diff(self.first) > MANY) | (most > 4 * MANY)
        self.free = (np.bincount(dish, weights=self.c, minlength=len(up)) > 1) & ~self.many
        self.log_z = np.full(len(up), -np.inf)
        self._gather()
        self.count()

    def _gather(self) -> None:
        """Finds the rows of dishes with many, which have not been seated yet."""
        self.crowd = np.flatnonzero(self.many[self.dish[self.several]])
        self.crowd_dish = self.dish[self.several[self.crowd]]
        self.row_log_z = np.full(len(self.crowd), -np.inf)

    def join(self, c1: np.ndarray, t1: np.ndarray, all1: np.ndarray, tables1: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> None:
        """Makes pieces parts of whole restaurants: customers and tables of shared dishes, and the sums of restaurants, both where not nan."""
        self.c_else[self.shared] = np.maximum(c1 - self.customers_up()[self.shared], 0)
        self.t1[self.shared] = t1
        self.count()
        self.all_else, self.tables1_else = np.nan_to_num(all1 - self.all1), np.nan_to_num(tables1 - self.tables1)
        self.tables_else[self.apart], self.all[self.apart] = tables - self.tables[self.apart], customers
        self.count()
        # tables of shared dishes stay, so their rows are seated given all others
        self.many |= self.shared
        self.free &= ~self.shared
        self._gather()

    def customers_up(self) -> np.ndarray:
        return self.c_else + self.single + np.bincount(self.dish[self.several], weights=self.t[self.several], minlength=len(self.up))

    def tables_of(self) -> np.ndarray:
        return self.tables_else + self.single_of + np.bincount(self.of[self.several], weights=self.t[self.several], minlength=self.n_of)

    def count(self) -> None:
        """Sums that every change of the seating keeps up: tables of each restaurant, customers of each dish above, of each restaurant above, its tables."""
        self.tables, self.c1 = self.tables_of(), self.customers_up()
        self.all1, self.tables1 = (np.bincount(self.up, weights=x, minlength=self.n_up) for x in (self.c1, self.t1))
        self.all1 += self.all_else
        self.tables1 += self.tables1_else

    def _set_rows(self, row: np.ndarray, t: np.ndarray) -> None:
        """Changes the tables of different rows."""
        more = t - self.t[row]
        changed = np.flatnonzero(more)
        row, more = row[changed], more[changed]
        self.t[row] += more
        dish = self.dish[row]
        np.add.at(self.tables, self.of[row], more)
        np.add.at(self.c1, dish, more)
        np.add.at(self.all1, self.up[dish], more)

    def _set_dishes(self, dish: np.ndarray, t1: np.ndarray) -> None:
        """Changes the tables of different dishes above."""
        np.add.at(self.tables1, self.up[dish], t1 - self.t1[dish])
        self.t1[dish] = t1

    def local_root(self, base: float) -> Root:
        """A root that only knows these restaurants."""
        return Root(Level(0.5, 10.0), float(self.t1.sum()), float(self.word.max(initial=-1) + 1), base)

    def sweep(self, k: int, low: Level, high: Level, p0: np.ndarray, part: float = 1.0) -> None:
        """Seats the customers of a random ``part`` of the dishes again; p0 are the dishes' root probabilities without their own tables."""
        rng = np.random.Generator(np.random.PCG64([self.seed, k]))
        side, half = rng.random(len(self.up)), rng.random(len(self.crowd)) < 0.5
        for lo, hi in ((0, part),) if part <= 0.5 else ((0, part / 2), (part / 2, part)):
            now = (side >= lo) & (side < hi)
            self._reseat(rng, np.flatnonzero(now & self.free), low, high, p0)
            crowd = now[self.crowd_dish]
            if crowd.any():
                self._reseat_rows(rng, np.flatnonzero(crowd & half), low, high, p0)
                self._reseat_rows(rng, np.flatnonzero(crowd & ~half), low, high, p0)
                who = np.flatnonzero(now & self.many & ~self.shared)
                self._set_dishes(who, seat(rng, self.c1[who], high.theta, high.discount, self.tables1[self.up[who]] - self.t1[who], p0[who])[0])

    def _reseat_rows(self, rng: np.random.Generator, at: np.ndarray, low: Level, high: Level, p0: np.ndarray) -> None:
        """Some rows of dishes with many, given all others; the parents' tables follow."""
        row = self.several[self.crowd[at]]
        dish, own = self.crowd_dish[at], self.t[row]
        rest, up = self.c1[dish] - own, self.up[dish]
        p1 = (rest - high.discount * np.minimum(self.t1[dish], rest) + (high.theta + high.discount * self.tables1[up]) * p0[dish]) / (high.theta + self.all1[up] - own)
        t, z = seat(rng, self.c[row], low.theta, low.discount, self.tables[self.of[row]] - own, p1)
        take = np.flatnonzero(np.log(rng.random(len(row)) + 1e-300) < z - self.row_log_z[at])
        self._set_rows(row[take], t[take])
        self.row_log_z[at[take]] = z[take]
        over = np.unique(dish[(self.t1[dish] > self.c1[dish]) & ~self.shared[dish]])
        self._set_dishes(over, self.c1[over])

    def _reseat(self, rng: np.random.Generator, who: np.ndarray, low: Level, high: Level, p0: np.ndarray) -> None:
        up = self.up[who]
        others1, beside1, p0 = self.tables1[up] - self.t1[who], self.all1[up] - self.c1[who], p0[who]
        d1, d2 = high.discount, low.discount
        # rows with one customer: each sends one up
        c1 = self.single[who]
        t1, z = seat(rng, c1, high.theta, d1, others1, p0)
        # the others, row by row
        at, end = self.first[who].copy(), self.first[who + 1]
        n, t = np.zeros(len(who)), np.zeros(len(who))
        seated = np.zeros(len(self.several))
        live = np.flatnonzero(at < end)
        while len(live):
            row = self.several[at[live]]
            x1, new1 = c1[live] - d1 * t1[live], (high.theta + d1 * (others1[live] + t1[live])) * p0[live]
            p1 = (x1 + new1) / (high.theta + beside1[live] + c1[live])
            a = (low.theta + d2 * (self.tables[self.of[row]] - self.t[row] + t[live])) * p1
            begun = n[live] > 0
            left = self.c[row] - n[live]
            x = n[live] - d2 * t[live]
            k = np.zeros(len(live))
            if begun.any():
                k[begun] = until_new(rng, a[begun], x[begun], left[begun])
            opens = k < left
            z[live] += np.where(begun, _join(np.where(begun, x, 1.0), a, k, opens), np.log(np.maximum(a, 1e-300)))
            n[live] += k + opens
            t[live] += opens
            c1[live] += opens
            t1[live] += opens & (rng.random(len(live)) * (x1 + new1) < new1)
            done = n[live] >= self.c[row]
            full = live[done]
            seated[at[full]] = t[full]
            at[full] += 1
            n[full], t[full] = 0, 0
            live = live[at[live] < end[live]]
        take = np.flatnonzero(np.log(rng.random(len(who)) + 1e-300) < z - self.log_z[who])
        took = who[take]
        self.log_z[took] = z[take]
        self._set_dishes(took, t1[take])
        size = self.first[took + 1] - self.first[took]
        at = np.repeat(self.first[took] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self._set_rows(self.several[at], seated[at])

    def weights(self, low: Level, high: Level, p0: np.ndarray) -> np.ndarray:
        """The predictive probability of each row times its restaurant's customers and concentration, given the root's probability of each dish."""
        p1 = (self.c1 - high.discount * self.t1 + (high.theta + high.discount * self.tables1)[self.up] * p0) / (high.theta + self.all1)[self.up]
        return self.c - low.discount * self.t + (low.theta + low.discount * self.tables)[self.of] * p1[self.dish]

    def predict(self, low: Level, high: Level, p0: np.ndarray) -> np.ndarray:
        """The predictive probability of each row, given the root's of each dish."""
        return self.weights(low, high, p0) / (low.theta + self.all)[self.of]

    def ones_and_twos(self, whole: bool = False) -> np.ndarray:
        """Rows, and dishes above, with one and two customers; of ``whole`` dishes only, if asked."""
        c1 = self.c1[~self.shared] if whole else self.c1
        return np.array([(self.c == 1).sum(), (self.c == 2).sum(), (c1 == 1).sum(), (c1 == 2).sum()], float)

    def auxiliary(self, k: int, low: Level, high: Level) -> np.ndarray:
        """Sums of the auxiliary variables of both concentrations over whole restaurants: successes, and minus the logarithms."""
        rng = np.random.Generator(np.random.PCG64([self.seed, k, 7]))
        divided = np.zeros(self.n_up, bool)
        divided[self.up[self.shared]] = True
        out = []
        for level, c, t, there in ((low, self.all, self.tables, ~self.apart), (high, self.all1, self.tables1, ~divided)):
            some = (c > 1) & there
            c, t = c[some], t[some].astype(np.int64)
            i = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            i = i[i > 0]
            out += [(rng.random(len(i)) < level.theta / (level.theta + level.discount * i)).sum(), -np.log(rng.beta(level.theta + 1, c - 1) + 1e-300).sum()]
        return np.array(out, float)


def _mean_auxiliary(rng: np.random.Generator, level: Level, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """As ``Seating.auxiliary``, for a few large restaurants: the successes are their mean, without a draw for each table."""
    c, t = c[c > 1], t[c > 1]
    lo, hi = level.theta / level.discount + 1, level.theta / level.discount + np.maximum(t, 1)
    digamma = lambda x: np.log(x) - 1 / (2 * x) - 1 / (12 * x * x)
    return np.array([(level.theta / level.discount * (digamma(hi) - digamma(lo))).sum(), -np.log(rng.beta(level.theta + 1, c - 1) + 1e-300).sum()])


# ---- chunks


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, held_out, text) -> (chunk, docs, tokens, words, pairs, blob)."""
    names = ["chunk", "docs", "tokens", "words", "pairs", "blob"]

    def pack(chunk: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, null, held, token, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        word, at, times = np.unique(token, return_inverse=True, return_counts=True)
        # common words get small numbers, which take less room
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        word, at = word[order], rank[at]
        train = np.repeat(~held, length)
        count = np.bincount(at[train], minlength=len(word))
        before = np.roll(at, 1)
        before[np.cumsum(length) - length] = len(word)
        pair, times = np.unique(before[train] * len(word) + at[train], return_counts=True)
        pair, times = pair[times >= OFTEN], times[times >= OFTEN]
        blob = _pack(ids, null.astype(np.uint8), held.astype(np.uint8), length.astype(np.uint32), word, count.astype(np.uint32), at.astype(np.uint32), pair, times.astype(np.uint32))
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (chunk, len(ids), len(token), len(word), len(pair))), pa.array([blob], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the same in every attempt of a task, and different in all tasks
        chunk, parts, n = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            ids, held = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            null, ids = ~np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for b in blocks(batch.column("text")):
                token, row = tokens(b)
                here = slice(b.first, b.first + b.n)
                parts.append((ids[here], null[here], held[here], token, np.bincount(row, minlength=b.n)))
                n += len(token)
                if n >= size:
                    yield pack(chunk, parts)
                    chunk, parts, n = chunk + 1, [], 0
        if parts:
            yield pack(chunk, parts)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", blob binary")


class Chunk:
    """Some documents; words are numbered from the commonest on, the start of a text comes after them."""

    def __init__(self, chunk: int, docs: int, n: int, words: int, pairs: int, blob: bytes):
        self.chunk, self.n_words, self.n_pairs = chunk, words, pairs
        what = [(np.int64, docs), (np.uint8, docs), (np.uint8, docs), (np.uint32, docs), (np.uint64, words), (np.uint32, words), (np.uint32, n), (np.int64, pairs), (np.uint32, pairs)]
        self.ids, self.null, held, length, self.word, self.count, token, self.pair, self.times = _unpack(blob, *what)
        self.held, self.length, self.token = held.astype(bool), length.astype(np.int64), token.astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """What is counted over all chunks: the words, the start, and the pairs met often; and their counts here in training."""
        word = np.append(self.word, START)
        pair = _pair_key(word[self.pair // self.n_words], word[self.pair % self.n_words])
        # words have even keys, pairs odd ones
        return np.concatenate([word & ~_U(1), pair]), np.concatenate([self.count, [(~self.held).sum()], self.times]).astype(np.uint32)

    def trigrams(self, number: np.ndarray, seen: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], share: int, shares: int) -> tuple[np.ndarray, ...]:
        """(share, place of the parent, word before, word, training count) of each different trigram, by share and place, and which one each token is.

        ``number`` and ``seen`` are what the exchange told of words, ``pairs`` the keys and counts of all hot pairs.
        """
        first = np.cumsum(self.length) - self.length
        before, second = np.roll(self.token, 1), np.roll(self.token, 2)
        before[first] = second[first] = self.n_words
        more = first[self.length > 1] + 1
        second[more] = self.n_words
        bits = int(self.n_words).bit_length()
        if 3 * bits <= 63:
            key, at = np.unique(before << 2 * bits | second << bits | self.token, return_inverse=True)
            v, u, w = key >> 2 * bits, key >> bits & (1 << bits) - 1, key & (1 << bits) - 1
        else:
            pair, at = np.unique(before << 31 | second, return_inverse=True)
            key, at = np.unique(at << 31 | self.token, return_inverse=True)
            v, u, w = pair[key >> 31] >> 31, pair[key >> 31] & (1 << 31) - 1, key & (1 << 31) - 1
        count = np.bincount(at[np.repeat(~self.held, self.length)], minlength=len(key))
        # pieces of hot words and hot pairs; all chunks place a trigram alike
        limit = _limit(share)
        parent = number[v] << _U(20)
        hot = np.flatnonzero(seen[v] > limit)
        if len(hot):
            hot_u, hot_v = u[hot], v[hot]
            mixed = mix(number)
            pieces = np.minimum(-(-seen[hot_v] // limit), PIECE).astype(np.uint64)
            parent[hot] += mixed[hot_u] % pieces + _U(1)
            word = np.append(self.word, START)
            times = _of(pairs[0], pairs[1], _pair_key(word[hot_u], word[hot_v]))
            # all texts begin alike
            times = np.where((hot_v == self.n_words) & (hot_u == self.n_words), seen[self.n_words], times)
            much = np.flatnonzero(times > limit)
            group = mixed[w[hot[much]]] % (-(-times[much] // limit)).astype(np.uint64)
            at_piece = mix(mixed[hot_u[much]] + group) & _U(PIECE) | _U(1)
            parent[hot[much]] = _U(1 << 63) | number[hot_v[much]] << _U(20) | at_piece
        # by share, then in the order of numbers, whose differences take little room
        run = _runs(parent)
        first_of, size = run[:-1], np.diff(run)
        to = (mix(parent[first_of]) >> _U(32)) * _U(shares) >> _U(32)
        runs = np.lexsort((parent[first_of], to))
        size, to = size[runs], to[runs]
        order = np.repeat(first_of[runs] - (np.cumsum(size) - size), size) + np.arange(len(parent))
        to = np.repeat(to, size)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return to, parent[order], number[u[order]], number[w[order]], count[order], back[at]


def _sum(kind: str, keys: np.ndarray | list, *values: np.ndarray | list) -> tuple:
    """Something to be summed by key over all partitions."""
    return -1, ("sum", kind, np.asarray(keys, np.uint64), np.array(values, float).reshape(len(values), -1))


def _numbers(items: Iterator[tuple], parts: int, limit: int) -> Iterator[tuple]:
    """Sums of the keys that chunks ask for; words get numbers, small ones for common words and 0 where training lacks them, sent back in the order of each chunk."""
    asked = sorted((k, *x[1:]) for k, x in items)
    for lo, hi in zip((cut := _runs(np.array([a[0] for a in asked], np.int64)))[:-1], cut[1:], strict=True):
        part = asked[lo][0]
        got = [_unpack(blob, (np.uint64, n), (np.uint32, n)) for _, _, n, _, blob in asked[lo:hi]]
        key, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([g[1] for g in got])).astype(np.uint64)
        word = (key & _U(1)) == 0
        rank = np.empty(len(key), np.uint64)
        rank[np.lexsort((key, -total.astype(np.int64), ~word))] = np.arange(len(key), dtype=np.uint64)
        number = np.where(word & (total > 0), rank * _U(parts) + _U(part + 1), 0).astype(np.uint64)
        real = word & (key != (START & ~_U(1)))
        c = total[real]
        yield _sum("words", [0], [c.sum()], [(c > 0).sum()], [(c == 1).sum()], [(c == 2).sum()])
        hot = ~word & (total > limit)
        yield _sum("pairs", key[hot], total[hot])
        i = 0
        for _, chunk, n, words, _ in asked[lo:hi]:
            # words come before pairs
            j = at[i : i + words]
            yield chunk, ("told", part, words, _pack(number[j], total[j]))
            i += n


def _asks(items: Iterator[tuple], parts: int) -> Iterator[tuple]:
    for _, x in items:
        c = Chunk(*x[1:])
        key, count = c.keys()
        to = key // _U(2) % _U(parts)
        order = np.argsort(to, kind="stable")
        cut = _runs(to[order])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            i = order[lo:hi]
            yield int(to[i[0]]), ("ask", c.chunk, int(hi - lo), int((i <= c.n_words).sum()), _pack(key[i], count[i]))


def _known_chunks(items: Iterator[tuple], parts: int, pairs: tuple, share: int, shares: int) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, tuple, list]]:
    """Each chunk of a partition with its words' numbers and counts, its trigrams, and the answers to these."""
    rows, told, answers = [], {}, {}
    for key, x in items:
        if x[0] == "chunk":
            rows.append(x[1:])
        elif x[0] == "told":
            told.setdefault(key, []).append(x[1:])
        elif x[0] == "answer":
            answers.setdefault(key, []).append(x[1:])
    for row in sorted(rows):
        c = Chunk(*row)
        key = c.keys()[0][: c.n_words + 1]
        order = np.argsort(key // _U(2) % _U(parts), kind="stable")
        got = [_unpack(blob, (np.uint64, n), (np.uint64, n)) for _, n, blob in sorted(told.pop(c.chunk))]
        number, seen = np.empty(len(key), np.uint64), np.empty(len(key), np.int64)
        number[order] = np.concatenate([g[0] for g in got])
        seen[order] = np.concatenate([g[1] for g in got]).astype(np.int64)
        yield c, number, seen, c.trigrams(number, seen, pairs, share, shares), sorted(answers.pop(c.chunk, []))


def _posted(items: Iterator[tuple], parts: int, pairs: tuple, shares: int, share: int) -> Iterator[tuple]:
    for c, _, _, (to, parent, u, w, count, _), _ in _known_chunks(items, parts, pairs, share, shares):
        cut = _runs(to)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            run = _runs(parent[lo:hi])
            n, size = len(run) - 1, int(hi - lo)
            steps = np.diff(parent[lo:hi][run[:-1]], prepend=_U(0))
            yield int(to[lo]), ("post", c.chunk, n, size, _pack(steps, np.diff(run).astype(np.uint32), u[lo:hi], w[lo:hi], count[lo:hi].astype(np.uint32)))


# ---- shares


class Share:
    """The trigrams of one share, from what chunks posted, and their seating."""

    def __init__(self, posts: list[tuple[int, int, int, bytes]]):
        # order and seed depend on what the share holds, not on how it arrived
        posts = sorted(posts)
        got = [_unpack(blob, (np.uint64, n), (np.uint32, n), (np.uint64, size), (np.uint64, size), (np.uint32, size)) for _, n, size, blob in posts]
        self.chunks = [(chunk, size) for chunk, _, size, _ in posts]
        parent, run, u, w, count = (np.concatenate(x) for x in zip(*((np.cumsum(g[0], dtype=np.uint64), *g[1:]) for g in got), strict=True))
        del got
        n = len(u)
        parents, at = np.unique(parent, return_inverse=True)
        at = np.repeat(at, run)
        known, i = _places(np.concatenate([u, w]))
        u, w = i[:n], i[n:]
        bits = len(known).bit_length()
        if len(parents).bit_length() + 2 * bits <= 63:
            key, self.back = np.unique(at << 2 * bits | u << bits | w, return_inverse=True)
            at, u, w = key >> 2 * bits, key >> bits & (1 << bits) - 1, key & (1 << bits) - 1
        else:
            pair, back = np.unique(at << bits | u, return_inverse=True)
            key, self.back = np.unique(back << bits | w, return_inverse=True)
            at, u, w = pair[key >> bits] >> bits, pair[key >> bits] & (1 << bits) - 1, key & (1 << bits) - 1
        self.back = self.back.astype(np.int32)
        customers = np.bincount(self.back, weights=count, minlength=len(key))
        new = np.append(True, (at[1:] != at[:-1]) | (u[1:] != u[:-1]))
        dish, of_dish = np.unique(at << bits | w, return_inverse=True)
        words, word = _places(dish & (1 << bits) - 1)
        self.words = known[words]
        x = self.seating = Seating(np.cumsum(new) - 1, of_dish, dish >> bits, word, customers, int(known.sum() % _U(1 << 31)) + n)
        # previous words, and the restaurants that are pieces
        self.before = (parents & _U((1 << 63) - 1)) >> _U(20)
        self.divided = (parents & _U(PIECE)) > 0
        x.shared = self.divided[x.up]
        first = np.flatnonzero(new)
        x.apart = parents[at[first]] >> _U(63) > 0
        first = first[x.apart]
        self.pairs = mix(mix(self.before[at[first]]) + known[u[first]])

    def ask(self, share: int, parts: int) -> Iterator[tuple]:
        """Each word's tables here, and its customers in pieces, for its place in the root; the word without a number has none."""
        x = self.seating
        t = np.bincount(x.word, weights=np.where(x.shared, 0, x.t1), minlength=len(self.words)).astype(np.uint32)
        for to, i in self._order(self.words, parts):
            yield to, ("ask", share, len(i), _pack(self.words[i] // _U(parts), t[i]))
        dish = np.flatnonzero(x.shared)
        word, before, c1 = self.words[x.word[dish]], self.before[x.up[dish]], x.c1[dish].astype(np.uint32)
        for to, i in self._order(word, parts):
            yield to, ("dish", share, len(i), _pack(before[i], word[i] // _U(parts), c1[i]))
        yield _sum("pairs", self.pairs, x.all[x.apart], x.tables[x.apart])

    @staticmethod
    def _order(words: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """The places of words in the root, and which ones are there; the word without a number is nowhere."""
        to = words % _U(parts)
        order = np.argsort(to, kind="stable")
        order = order[words[order] > 0]
        cut = _runs(to[order])
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield int(to[order[lo]]), order[lo:hi]

    def join(self, rows: list[tuple[int, int, bytes]], parts: int, ups: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> None:
        """Takes in what is known of whole restaurants: of their dishes, and the sums (customers, tables) by previous word and by pair."""
        x = self.seating
        dish = np.flatnonzero(x.shared)
        c, t = self._back(self.words[x.word[dish]], rows, parts)
        all1, tables1 = (np.where(self.divided, _of(ups[0], v, self.before), np.nan) for v in ups[1])
        x.join(c, t, all1, tables1, *(_of(pairs[0], v, self.pairs) for v in pairs[1]))

    def told(self, rows: list[tuple[int, int, bytes]], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables in the root of each word."""
        return self._back(self.words, rows, parts)

    def _back(self, words: np.ndarray, rows: list[tuple[int, int, bytes]], parts: int) -> tuple[np.ndarray, np.ndarray]:
        c, t = np.zeros(len(words)), np.zeros(len(words))
        order = [i for _, i in self._order(words, parts)]
        got = [_unpack(blob, (np.float32, n), (np.float32, n)) for _, n, blob in sorted(rows)]
        for i, (c_here, t_here) in zip(order, got, strict=True):
            c[i], t[i] = c_here, t_here
        return c, t

    def without_own(self, root: Root, c: np.ndarray, t: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Root probabilities for each dish, its own tables taken away."""
        rest = np.maximum(c[self.seating.word] - own, 0)
        return root.of(rest, np.minimum(t[self.seating.word], rest))


def _dishes(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of dishes in one place of the root, summed: (previous words, which of them, word, customers of each dish, and which dish each piece is)."""
    got = [_unpack(blob, (np.uint64, n), (np.uint64, n), (np.uint32, n)) for _, _, n, blob in rows]
    v, w, c = (np.concatenate([g[i] for g in got]) if got else np.empty(0, np.uint64) for i in range(3))
    before, of = np.unique(v, return_inverse=True)
    key, at = np.unique(of.astype(np.uint64) << _U(40) | w, return_inverse=True)
    return before, (key >> _U(40)).astype(np.int64), key & _U((1 << 40) - 1), np.bincount(at, weights=c, minlength=len(key)), at


def _by_place(items: Iterator[tuple], *kinds: str) -> Iterator[tuple[int, list[list[tuple]]]]:
    """Each place of a partition with what came for it, of each kind in the order of shares."""
    by: dict[int, dict[str, list]] = {}
    for key, x in items:
        if x[0] in kinds:
            by.setdefault(key, {}).setdefault(x[0], []).append(x)
    for key in sorted(by):
        yield key, [sorted(by[key].get(kind, []), key=lambda x: x[1]) for kind in kinds]


def _met(items: Iterator[tuple]) -> Iterator[tuple]:
    """Sums of shared dishes: (customers, dishes) by previous word, and how many have one or two customers; other sums pass."""
    rows = []
    for key, x in items:
        if x[0] == "sum":
            yield key, x
        elif x[0] == "dish":
            rows.append((key, x))
    for _, [dishes] in _by_place(iter(rows), "dish"):
        before, of, _, c, _ = _dishes(dishes)
        yield _sum("ups", before, np.bincount(of, weights=c, minlength=len(before)), np.bincount(of, weights=c > 0, minlength=len(before)))
        yield _sum("shared", [0], [(c == 1).sum()], [(c == 2).sum()])


def _root(items: Iterator[tuple], level: Level, tables: float, base: float, samples: int, seed: int, high: Level, ups: tuple[np.ndarray, np.ndarray], whole: float) -> Iterator[tuple]:
    """Seats shared dishes, and what they and shares send of each word in the root, ``samples`` times, and sends back customers and mean tables.

    ``ups`` has customers and dishes of previous words with shared dishes,
    ``whole`` is how many customers of the root come from all others.  Words of
    a place are as good as a random part: sums over all are judged by theirs.
    """
    for part, (asked, dishes) in _by_place(items, "ask", "dish"):
        got = [_unpack(blob, (np.uint64, n), (np.uint32, n)) for _, _, n, blob in asked]
        key, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        sent = np.bincount(at, weights=np.concatenate([g[1] for g in got]))
        before, of, word, c1, at1 = _dishes(dishes)
        word, known = np.searchsorted(key, word), _of(ups[0], ups[1][1], before)
        here = np.maximum(np.bincount(of, weights=c1 > 0, minlength=len(before)), 1)
        rng = np.random.Generator(np.random.PCG64([seed, part]))
        now1, z1, mean1 = np.minimum(c1, 1.0), np.full(len(c1), -np.inf), np.zeros(len(c1))
        c = sent + np.bincount(word, weights=now1, minlength=len(key))
        now, z, t, mean = np.minimum(c, 1.0), np.full(len(c), -np.inf), np.zeros(len(c)), np.zeros(len(c))
        for _ in range(samples):
            if len(c1):
                all_tables = known * np.bincount(of, weights=now1, minlength=len(before)) / here
                rest = np.maximum(c[word] - now1, 0)
                p = Root(level, whole + all_tables.sum() + _rest(ups, before), tables, base).of(rest, np.minimum(now[word], rest))
                next_t, next_z = seat(rng, c1, high.theta, high.discount, np.maximum(all_tables[of] - now1, 0), p)
                take = np.log(rng.random(len(c1)) + 1e-300) < next_z - z1
                now1, z1 = np.where(take, next_t, now1), np.where(take, next_z, z1)
                last, c = c, sent + np.bincount(word, weights=now1, minlength=len(key))
                z[c != last] = -np.inf
            next_t, next_z = seat(rng, c, level.theta, level.discount, np.maximum(tables - now, 0), np.full(len(c), base))
            take = np.log(rng.random(len(c)) + 1e-300) < next_z - z
            now, z = np.where(take, next_t, now), np.where(take, next_z, z)
            t += now / samples
            mean += c / samples
            mean1 += now1 / samples
        yield _sum("root", [0], [mean.sum()], [t.sum()])
        yield _sum("ups", before, np.bincount(of, weights=mean1, minlength=len(before)))
        for rows, place, kind, x, y in ((asked, at, "root", mean, t), (dishes, at1, "dish", c1, mean1)):
            i = 0
            for _, share, n, _ in rows:
                j = place[i : i + n]
                yield share, (kind, part, n, _pack(x[j].astype(np.float32), y[j].astype(np.float32)))
                i += n


def _rest(ups: tuple[np.ndarray, np.ndarray], before: np.ndarray) -> float:
    """Dishes of the previous words that have none in a place."""
    return float(ups[1][1].sum() - _of(ups[0], ups[1][1], before).sum())


def _shares(items: Iterator[tuple]) -> Iterator[tuple[int, Share, dict[str, list]]]:
    """Each share of a partition, with what else came for it."""
    by: dict[int, dict[str, list]] = {}
    for key, x in items:
        if key >= 0:
            by.setdefault(key, {}).setdefault(x[0], []).append(x[1:])
    for key in sorted(by):
        got = by.pop(key)
        yield key, Share(got.pop("post")), got


def _total(rdd: RDD, **widths: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """What partitions send along to be summed, of each kind (sorted keys, rows of sums): a few numbers, and some for each hot word and pair."""

    def add(*parts: dict[str, tuple]) -> dict[str, tuple]:
        out = {}
        for kind in widths:
            key, at = np.unique(np.concatenate([p[kind][0] for p in parts]), return_inverse=True)
            values = np.concatenate([p[kind][1] for p in parts], axis=1)
            out[kind] = key, np.array([np.bincount(at, weights=v, minlength=len(key)) for v in values])
        return out

    none = {kind: (np.empty(0, np.uint64), np.empty((n, 0))) for kind, n in widths.items()}

    def some(items: Iterator[tuple]) -> Iterator[dict[str, tuple]]:
        yield add(none, *({**none, x[1]: x[2:]} for _, x in items if x[0] == "sum"))

    return rdd.mapPartitions(some).treeAggregate(none, add, add)


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


def score(docs: DataFrame, sweeps: int = SWEEPS, share: int = SHARE, chunk: int = CHUNK) -> DataFrame:
    """The contract's columns for docs(doc_id, text): a row for each input row.

    A null or empty text is one token, its end.  A null id counts as the empty
    text and so trains.  Repeated rows train and are scored each time.  With no
    training token at all every probability is that of the uniform base.  An
    empty table gives no rows.  ``docs`` is read once; a task that is repeated
    must read the same rows in the same order, as it does from a table.
    """
    spark = bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    held = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    # chunks are dealt out by the size of the table, not by how its files are split; eight bytes or more are a token and what goes with it
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    homes = max(spark.sparkContext.defaultParallelism, -(-size // (8 * chunk)))
    made = _chunks(docs.select(doc_id.alias("doc_id"), held.alias("held_out"), "text"), chunk).rdd
    chunks = made.map(lambda r: (r[0], ("chunk", *r))).partitionBy(homes, _by_chunk)
    n_all, entries = chunks.map(lambda x: np.array([x[1][3], x[1][4] + x[1][5]], float)).treeAggregate(np.zeros(2), np.add, np.add)
    places, shares = max(1, -(-int(entries) // (2 * share))), max(1, -(-int(n_all) // share))

    asked = chunks.mapPartitions(lambda it: _asks(it, places)).partitionBy(places, _same)
    numbers = asked.mapPartitions(lambda it: _numbers(it, places, _limit(share))).partitionBy(homes, _by_chunk)
    got = _total(numbers, words=4, pairs=1)
    n, v, ones, twos = map(int, got["words"][1].sum(axis=1))
    hot = got["pairs"][0], got["pairs"][1][0].astype(np.int64)
    known = chunks.union(numbers)
    posts = known.mapPartitions(lambda it: _posted(it, places, hot, shares, share)).partitionBy(shares, _same)
    base = 1.0 / (v + 1)
    top = Level(_discount(ones, twos), 10.0)

    def burn(items: Iterator[tuple]) -> Iterator[tuple]:
        for key, s, _ in _shares(items):
            x = s.seating
            counts = x.ones_and_twos()
            low, high = Level(_discount(*counts[:2]), 1.0), Level(_discount(*counts[2:]), 1.0)
            # until shares have met, each has a root of its own
            c = np.bincount(x.word, weights=x.t1, minlength=len(s.words))
            p0 = s.without_own(x.local_root(base), c, np.minimum(c, 1.0), x.t1)
            for k in range(BURN[0]):
                x.sweep(k, low, high, p0)
            yield _sum("whole", [0], *np.append(np.concatenate([x.ones_and_twos(whole=True), x.auxiliary(0, low, high)]), x.t1[~x.shared].sum())[:, None])
            yield from s.ask(key, places)
            yield key, ("state", len(x.several), len(x.t1), _pack(x.t[x.several].astype(np.uint32), x.t1.astype(np.uint32)))

    # sums and tables go to the root; states only pass there, on the way back to their share
    given = posts.mapPartitions(burn).partitionBy(places, _same)
    got = _total(given.mapPartitions(_met), whole=9, shared=2, ups=2, pairs=2)
    ups, pairs = got["ups"], got["pairs"]
    ones2, twos2, ones1, twos1, y2, l2, y1, l1, whole = map(float, got["whole"][1].sum(axis=1))
    more1, more2 = got["shared"][1].sum(axis=1)
    rng = np.random.Generator(np.random.PCG64(1))
    low, high = Level(_discount(ones2, twos2), 1.0), Level(_discount(ones1 + more1, twos1 + more2), 1.0)
    (y2, l2), (y1, l1) = _mean_auxiliary(rng, low, *pairs[1]) + (y2, l2), _mean_auxiliary(rng, high, *ups[1]) + (y1, l1)
    low.theta, high.theta = float(rng.gamma(1 + y2) / (1 + l2)), float(rng.gamma(1 + y1) / (1 + l1))
    roots = given.mapPartitions(lambda it: _root(it, top, v, base, sweeps, 1, high, ups, whole)).partitionBy(shares, _same)
    got = _total(roots, root=2, ups=1)
    root = Root(top, *map(float, got["root"][1].sum(axis=1)), base)
    sums = ups[0], np.array([ups[1][0], _of(got["ups"][0], got["ups"][1][0], ups[0])])
    states = given.filter(lambda x: x[1][0] == "state").partitionBy(shares, _same)

    def last(items: Iterator[tuple]) -> Iterator[tuple]:
        for key, s, got in _shares(items):
            x = s.seating
            [(n1, n2, blob)] = got["state"]
            x.t[x.several], x.t1[:] = _unpack(blob, (np.uint32, n1), (np.uint32, n2))
            s.join(got.get("dish", []), places, sums, pairs)
            c, t = s.told(got.get("root", []), places)
            without, full = s.without_own(root, c, t, x.t1), root.of(c, t)[x.word]
            p = np.zeros(len(x.c))
            for k in range(BURN[0], BURN[0] + BURN[1] + sweeps):
                x.sweep(k, low, high, without, 1.0 if k < BURN[0] + BURN[1] else PART)
                if k >= BURN[0] + BURN[1]:
                    p += x.weights(low, high, full)
            p /= (sweeps * (low.theta + x.all))[x.of]
            far = np.rint(-np.log10(np.maximum(p, 1e-300)) / GRAIN).astype(np.uint32)
            at = 0
            for chunk_id, size in s.chunks:
                yield chunk_id, ("answer", key, size, _pack(far[s.back[at : at + size]]))
                at += size

    answers = posts.union(roots).union(states).mapPartitions(last).partitionBy(homes, _by_chunk)
    smooth = n + 0.5 * (v + 1)

    def scored(items: Iterator[tuple]) -> Iterator[tuple]:
        for c, number, seen, (_, _, _, _, _, at), got in _known_chunks(items, places, hot, share, shares):
            log_p = np.concatenate([_unpack(blob, (np.uint32, size))[0] for _, size, blob in got]) * -GRAIN
            count = np.where(number[: c.n_words] > 0, seen[: c.n_words], 0)[c.token]
            first = np.cumsum(c.length) - c.length
            known_here, low_here, high_here = (np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10((count + 0.5) / smooth), log_p[at]))
            for doc, null, *row in zip(c.ids.tolist(), c.null.tolist(), c.held.tolist(), c.length.tolist(), known_here.tolist(), low_here.tolist(), high_here.tolist(), strict=True):
                yield None if null else doc, row[0], row[1], row[2], n, row[3], row[4]

    rows = known.union(answers).mapPartitions(scored)
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", verifySchema=False)
