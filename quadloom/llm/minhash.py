"""Near-duplicate documents by ProbMinHash.

A document is its set of 5-word shingles with weights.  Each element is a
Poisson process of rate equal to its weight, seeded by the element alone; its
arrivals fall on random registers, and a register keeps its earliest arrival.
Two documents agree on a register with the probability Jaccard similarity of
their weights.  Elements whose next arrival is later than all registers stop,
so most end at their first one.  Weights are occurrences with ``weighted``; with
equal weights, as the contract of ``op9`` has them, the probability Jaccard
similarity is the plain one.

Bands of registers give buckets.  Links are verified on the shingle sets, and
documents joined by links form a group:

* documents with equal sets are one class from the start, however many;
* in a bucket, members are compared with a pivot, not with each other; members
  that end in the pivot's group need no more comparisons;
* a bucket whose members are still in several groups goes on with further
  pivots, eight times as many in each round, until every pair of its members
  is in one group, was compared, or cannot be similar: by its sketch, or as a
  member shares too little with all other groups together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Block, blocks, mix, signed, span_hash, stored
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**24 = 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: One bit of each register: at similarity 0.8, 9.6 of 96 differ on average and more than 26 once in a million pairs.
SKETCH_DIFFERS = 26


def shingle_weights(b: Block, k: int = SHINGLE, counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) of a block, sorted by row and element.

    A text of one to k - 1 words is one shingle.  The weight is 1, or with
    ``counts`` the number of occurrences.
    """
    n = np.diff(b.word_at)
    at = b.windows(k)
    short = np.flatnonzero((n > 0) & (n < k))
    starts = np.concatenate([at, b.word_at[short]])
    ends = np.concatenate([at + k, b.word_at[short + 1]])
    doc = np.concatenate([b.doc[at], short]) if len(b.starts) else short
    h = span_hash(b.hashes, starts, ends)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h))).astype(float) if counts else np.ones(len(first))
    return doc[first], h[first], weight


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS, seed: int = 1) -> np.ndarray:
    """The element that each of m registers of n documents keeps; 0 where a document has none."""
    earliest = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    time = np.zeros(len(element))
    state = mix(element + np.uint64(seed))
    live = np.arange(len(element))
    gold = np.uint64(0x9E3779B97F4A7C15)
    while len(live):
        state = state + gold
        bits = mix(state)
        uniform = ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight[live]
        register = doc[live] * m + ((mix(bits ^ gold) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, register, time)
        won = time == earliest[register]
        kept[register[won]] = element[live[won]]
        latest = earliest.reshape(n, m).max(axis=1)
        go = time < latest[doc[live]]
        live, time, state = live[go], time[go], state[go]
    return kept.reshape(n, m)


def signatures(docs: DataFrame, k: int = SHINGLE, counts: bool = False) -> DataFrame:
    """docs(id, text) -> (id, n, s1, s2, bands, k1, k2): set size, set digest, band keys and sketch; texts without a word give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                doc, h, w = shingle_weights(b, k, counts)
                size = np.bincount(doc, minlength=b.n)
                at = np.concatenate([[0], np.cumsum(size)])
                digest = []
                for salt in (0x1234567, 0x89ABCDEF):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)) * w.astype(np.uint64))])
                    digest.append(total[at[1:]] - total[at[:-1]])
                r = prob_minhash(doc, h, w, b.n)
                # a bit for the element and the register: registers are independent, so are those of one element
                bits = mix(r ^ mix(np.uint64(0xABCDEF0123) + np.arange(REGISTERS, dtype=np.uint64))[None, :]) & np.uint64(1)
                half = np.uint64(1) << np.arange(REGISTERS // 2, dtype=np.uint64)
                k1, k2 = (bits[:, : REGISTERS // 2] * half).sum(axis=1, dtype=np.uint64), (bits[:, REGISTERS // 2 :] * half).sum(axis=1, dtype=np.uint64)
                key = np.zeros((b.n, BANDS), np.uint64)
                for i in range(ROWS):
                    key = mix(key * np.uint64(31) + r[:, i::ROWS] + np.arange(BANDS, dtype=np.uint64)[None, :])
                rows = np.flatnonzero(size)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), signed(key[rows].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows + b.first)), pa.array(size[rows]), signed(digest[0][rows]), signed(digest[1][rows]), bands, signed(k1[rows]), signed(k2[rows])],
                    ["id", "n", "s1", "s2", "bands", "k1", "k2"],
                )

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, k1 long, k2 long")


def probability_jaccard(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """The chance that two sets of elements a, b (sorted) with weights u, v agree on a register.

    For a shared element i it is 1 / sum_j max(u_j / u_i, v_j / v_i); in the
    order of u / v the sum is one of u beyond i and one of v before it.
    """
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)], y[np.searchsorted(every, b)] = u, v
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    x, y = x[order], y[order]
    from_here = np.cumsum(x[::-1])[::-1]
    before = np.cumsum(y) - y
    both = (x > 0) & (y > 0)
    return float((1 / (from_here[both] / x[both] + before[both] / y[both])).sum())


def _sets(docs: DataFrame, k: int, repeated: bool, weighted: bool) -> DataFrame:
    """docs(id, text) -> (id, elements[, weights]): the shingle sets, a row for each different one where ids are ``repeated``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                doc, h, w = shingle_weights(b, k, weighted)
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.n))]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, x) for x in (signed(h), pa.array(w.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(b.first, b.n), *lists[: 1 + weighted]], ["id", "elements", "weights"][: 2 + weighted])

    found = docs.mapInArrow(run, "id long, elements array<long>" + ", weights array<int>" * weighted)
    # the elements are sorted, so equal sets have equal digests
    return found.withColumn("_d", F.xxhash64(*found.columns[1:])).dropDuplicates(["id", "_d"]).drop("_d") if repeated else found


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b) whose sets are similar enough."""
    if "weights" in sets.columns:
        named = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias("e" + x), F.col("weights").alias("w" + x))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = {c: batch.column(c) for c in ("ea", "wa", "eb", "wb")}
                each = lambda c, i: lists[c][i].values.to_numpy(zero_copy_only=False)
                j = [probability_jaccard(each("ea", i), each("wa", i), each("eb", i), each("wb", i)) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], ["a", "b", "jaccard"])

        both = pairs.join(named("b"), "b").join(named("a"), "a").select("a", "b", "ea", "wa", "eb", "wb")
        return both.mapInArrow(run, "a long, b long, jaccard double").where(F.col("jaccard") >= similarity - 1e-12)
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    both = F.size(F.array_intersect("ea", "eb")).cast("double")
    return two.select("a", "b", (both / (F.size("ea") + F.size("eb") - both)).alias("jaccard")).where(F.col("jaccard") >= similarity)


def _plausible(similarity: float, weighted: bool = False) -> str:
    """SQL: sizes n, m and sketches (k1, k2), (q1, q2) do not rule the similarity out; with weights, sizes tell nothing."""
    return ("" if weighted else f"least(n, m) >= {similarity} * greatest(n, m) AND ") + f"bit_count(k1 ^ q1) + bit_count(k2 ^ q2) <= {SKETCH_DIFFERS}"


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose members are in more than one group."""
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return rows.join(keys, "key", "left_semi")


def _able(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members that could still be similar to one of another group.

    Two similar sets share so many elements that each has at least that part
    of its own in common with members of other groups.  A member with too many
    elements of its own, or of its own group alone, is done, without having
    been compared with any other.
    """
    ids = rows.select("rep", "label", "n").distinct()
    elements = ids.join(sets.withColumnRenamed("id", "rep"), "rep").select("rep", "label", "n", F.explode("elements").alias("e"))
    # written, so that the join deals a hot element to several tasks
    spread = stored(elements.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("e"), "spread")
    # an id may stand for several sets: their elements together are compared with the smallest
    held = elements.join(spread, "e", "left_semi").groupBy("rep").agg(F.count("*").alias("held"), F.min("n").alias("n"))
    return held.where(F.col("held") >= similarity * F.col("n")).select("rep")


def groups(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """docs(id, text) -> (id, group): ids linked to others and the smallest id of their group.

    Links: Jaccard similarity of shingle sets of at least ``similarity``, or with
    ``weighted`` the probability Jaccard similarity of their occurrences.  Ids
    without a link, null ids and texts without a word have no row.  A
    repeated id stands for all its texts.
    """
    docs = docs.where("id IS NOT NULL AND text IS NOT NULL")
    signed_docs = stored(signatures(docs, k, weighted), "signatures")
    classes = signed_docs.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.count("*").alias("members"))
    classes = stored(classes, "classes")

    bands = classes.select("rep", "n", "k1", "k2", F.explode("bands").alias("key"))
    member = F.struct("rep", "n", "k1", "k2")
    pivots = bands.groupBy("key").agg(F.min(member).alias("p"), F.count("*").alias("size")).where("size > 1")
    buckets = bands.join(pivots, "key").select("key", "size", "rep", "n", "k1", "k2", F.col("p.rep").alias("pivot"), F.col("p.n").alias("m"), F.col("p.k1").alias("q1"), F.col("p.k2").alias("q2"))
    buckets = stored(buckets, "buckets")
    pairs = buckets.where(f"rep <> pivot AND {_plausible(similarity, weighted)}").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()

    # texts of the documents that some other one may match; each is read and dealt out once
    candidates = buckets.select("rep").distinct()
    repeated = not signed_docs.select("id").groupBy("id").count().where("count > 1").isEmpty()
    sets = stored(_sets(docs.join(candidates.withColumnRenamed("rep", "id"), "id", "left_semi"), k, repeated, weighted), "sets")
    links = stored(_verified(pairs, sets, similarity).select("a", "b").distinct(), "links")
    found = stored(components(links), "groups")

    # further pivots, by their place in the bucket; the first one has met all others
    rank = F.row_number().over(Window.partitionBy("key").orderBy("rep"))
    rest = buckets.where("size > 2").select("key", "rep", "n", "k1", "k2").withColumn("rank", rank)
    low, high = 1, 8
    while True:
        labelled = rest.where(F.col("rank") > low).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        rest = stored(_open(labelled), "open")
        if rest.isEmpty():
            break
        if not weighted:
            rest = stored(_open(rest.join(_able(rest, sets, similarity), "rep", "left_semi")), "open")
        chosen = rest.where(F.col("rank") <= high).select("key", F.col("rep").alias("pivot"), F.col("n").alias("m"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("label").alias("to"), F.col("rank").alias("at"))
        more = rest.join(chosen, "key").where(f"rank > at AND label <> to AND {_plausible(similarity, weighted)}").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
        new = stored(_verified(more, sets, similarity).select("a", "b").distinct(), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = stored(components(links), "groups")
        rest, low, high = rest.drop("label"), high, high * 8

    reps = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("members > 1 OR component IS NOT NULL").select("s1", "s2", "n", F.coalesce("component", "rep").alias("group"))
    ids = signed_docs.select("id", "s1", "s2", "n").join(reps, ["s1", "s2", "n"]).select("id", "group")
    return ids.groupBy("id").agg(F.min("group").alias("group"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id, kept) for each row of docs(doc_id, text): its group's smallest id, and whether it is that one.

    Null and empty texts and null ids are groups of their own.  Of rows that
    repeat an id, all are kept or none.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = groups(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), k, similarity)
    out = ids.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("group", "doc_id").alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col("group_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that are not the smallest id of their group; all columns stay."""
    found = groups(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), k, similarity).where("id <> group").select(F.col("id").alias("_dropped"))
    return docs.join(found, F.col("doc_id") == F.col("_dropped"), "left_anti")
