"""Substring dedup over prefix-partitioned suffix trees.

A window is 50 consecutive words of one document: the first 50 words of a
suffix.  Its words are removed if the same 50 words start in a document with a
smaller id.

* **Prefixes.** The trees are sparse: they hold the suffixes that begin at a
  minimiser, the smallest 8-word gram of a window, with the words before it that
  the window has.  Equal windows have equal minimisers, so no repeat is missed,
  and the gram, as the prefix of the suffix, splits suffixes into groups.
  Neighbouring windows with one minimiser are a *span*.
* **Leaves.** Equal spans are one leaf with the smallest document and whether
  there are others; leaves are made before the words are fetched, so copies of a
  document are one.  Groups of a single document end here, and a group with one
  leaf needs no words: every window of its other documents is repeated.
* **Subtrees.** The spans of a group are sorted with the longest common prefixes
  of neighbours, which are the tree's internal nodes.  Those of 50 words or more
  are the repeats; each carries its smallest document.
* **Variable length.** A group whose branches would not fit the memory of a task
  takes longer prefixes, each window's own suffix, up to the depth of 50 words.
  There a node is all that is left of a tree, and it is summed before the shuffle.

All comparisons are between words by 64-bit hashes and between spans by 128-bit
hashes of their words.  Only hashes and positions are shuffled; texts twice, by
document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, mix, signed, span_hash, stored

#: words of a window; of the prefixes that split suffixes first; branches that fit a task's memory, of up to 92 words with a rank for each doubling
DEPTH, GRAM, GROUP = 50, 8, 16_384


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value among each ``width`` neighbours."""
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        if len(v) <= step:
            return np.empty(0, np.int64)
        less = v[step:] < v[:-step]
        at = np.where(less, at[step:], at[:-step])
        v = np.where(less, v[step:], v[:-step])
        have += step
    return at


def spans(b: Block, depth: int = DEPTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The spans of a block: row, first window within its document, number of windows, gram, two hashes."""
    h = b.hashes
    at = b.windows(depth)
    if not len(at):
        return {k: np.empty(0, np.uint64 if k in ("g", "h1", "h2") else np.int64) for k in ("row", "start", "n", "g", "h1", "h2")}
    grams = np.arange(len(h) - gram + 1)
    g = span_hash(h, grams, grams + gram, 1)
    least = _smallest(g, depth - gram + 1)[at]
    doc = b.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    s, e = at[first], at[first] + n - 1 + depth
    return {"row": doc[first], "start": s - b.word_at[doc[first]], "n": n, "g": g[least[first]], "h1": span_hash(h, s, e), "h2": span_hash(h, s, e, 1)}


class Tree:
    """The suffix tree of some branches: their suffixes in order, and its internal nodes of ``depth`` words or more.

    ``branches`` are the words of all branches and ``lengths`` how many each
    has; only suffixes of ``depth`` words or more are in the tree.  Suffixes are
    sorted by prefix doubling, and the same ranks give the longest common prefix
    of neighbours, which never reaches over a branch's end.  A node's suffixes
    are an interval of the order: ``first`` and ``last`` bound it, ``string_depth``
    is the length of the repeat that the node stands for.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int = DEPTH):
        n = np.maximum(lengths - depth + 1, 0)
        at = np.cumsum(lengths) - lengths
        self.branch = np.repeat(np.arange(len(lengths)), n)
        self.place = np.arange(len(self.branch)) - np.repeat(np.cumsum(n) - n, n)
        starts = at[self.branch] + self.place
        left = lengths[self.branch] - self.place

        ranks, have, most = [np.unique(words, return_inverse=True)[1]], [1], int(lengths.max(initial=1))
        while have[-1] < most:
            step, rank = min(have[-1], most - have[-1]), ranks[-1]
            ahead = np.full(len(rank), -1)
            ahead[: len(rank) - step] = rank[step:]
            ranks.append(np.unique(rank << 32 | ahead + 1, return_inverse=True)[1])
            have.append(have[-1] + step)
        self.order = np.argsort(ranks[-1][starts], kind="stable")
        i, j = starts[self.order[:-1]], starts[self.order[1:]]
        common = np.zeros(len(i), np.int64)
        bound = np.minimum(left[self.order[:-1]], left[self.order[1:]])
        for rank, k in reversed(list(zip(ranks, have, strict=True))):
            a, b = np.minimum(i + common, len(words) - 1), np.minimum(j + common, len(words) - 1)
            # only lengths that double may be met twice; the last one is an odd one out and is met first
            same = (rank[a] == rank[b]) & (common < bound)
            common += np.where(same, k, 0)
        self.common = np.minimum(common, bound)
        #: each suffix's node at ``depth``, in the order, a leaf of its own where no other suffix shares so much
        cut = np.append(True, self.common < depth) if len(self.order) else np.empty(0, bool)
        self.first = np.flatnonzero(cut)
        self.node = np.cumsum(cut) - 1
        self.last = np.append(self.first[1:], len(self.order)) - 1 if len(self.first) else self.first
        deep = np.append(self.common, 0) if len(self.order) else self.common
        inner = np.where(np.append(~cut[1:], False), deep, np.iinfo(np.int64).max) if len(self.order) else deep
        self.string_depth = np.minimum.reduceat(inner, self.first) if len(self.first) else self.first
        leaf = self.string_depth == np.iinfo(np.int64).max
        self.string_depth = np.where(leaf, left[self.order[self.first]] if len(self.first) else 0, self.string_depth)

    def least(self, value_of_branch: np.ndarray) -> np.ndarray:
        """The smallest value among the branches of each suffix's node, by suffix."""
        out = np.empty(len(self.order), value_of_branch.dtype)
        if len(self.order):
            out[self.order] = np.minimum.reduceat(value_of_branch[self.branch[self.order]], self.first)[self.node]
        return out


def _subtrees(batches: Iterator[pa.RecordBatch], depth: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(h1, h2, bits) from rows (g, h1, h2, doc, n, words) in the order of g: windows that a smaller document has too."""
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        words = np.concatenate([np.frombuffer(r[5], np.uint64) for r in rows])
        doc = np.array([r[3] for r in rows], np.int64)
        tree = Tree(words, np.array([len(r[5]) // 8 for r in rows]), depth)
        hit = tree.least(doc) < doc[tree.branch]
        bits = np.zeros(len(rows), np.uint64)
        np.bitwise_or.at(bits, tree.branch[hit], np.uint64(1) << tree.place[hit].astype(np.uint64))
        some = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in some], pa.int64()), pa.array([rows[i][2] for i in some], pa.int64()), signed(bits[some])], ["h1", "h2", "bits"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= most and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) // 8
    if held:
        yield flush(held)


def repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """What is repeated in docs(doc_id, th, text): texts keyed by (doc_id, th), and (doc_id, th, start, bits) of windows to remove.

    ``th`` tells apart texts that share an id; rows that share both are one.
    Bit i stands for the window that starts at word start + i.
    """
    assert depth - gram < 63, "a span's windows must fit one long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                s = spans(b, depth, gram)
                rows = pa.array(s["row"] + b.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(s["start"], pa.int64()), pa.array(s["n"].astype(np.int32)), signed(s["g"]), signed(s["h1"]), signed(s["h2"])],
                    ["doc_id", "th", "start", "n", "g", "h1", "h2"],
                )

    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = stored(known.mapInArrow(scan, "doc_id long, th long, start long, n int, g long, h1 long, h2 long"), "spans")

    branch = stored(
        found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "start", "n", "g")).alias("r"), F.max("doc_id").alias("last"))
        .select("h1", "h2", "r.*", (F.col("last") > F.col("r.doc_id")).alias("copied")),
        "branches",
    )
    groups = branch.groupBy("g").agg(F.count("*").alias("branches"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("branches > 1 AND lo < hi")
    deep = branch.join(groups.select("g", "branches"), "g").select("g", "branches", "h1", "h2", "doc_id", "th", "start", "n")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for b in blocks(batch.column("text")):
                h = b.hashes
                for i in range(b.n):
                    for w in wanted[b.first + i]:
                        at = b.word_at[i] + w["start"]
                        blob = h[at : at + w["n"] + depth - 1].tobytes()
                        for col, v in zip(out, (w["g"], w["branches"], w["h1"], w["h2"], ids[b.first + i], w["n"], blob), strict=True):
                            col.append(v)
                if len(out[0]) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["g", "branches", "h1", "h2", "doc_id", "n", "words"]
    wanted = deep.groupBy("doc_id", "th").agg(F.collect_list(F.struct("g", "branches", "h1", "h2", "start", "n")).alias("wanted"))
    one = known.select("doc_id", "th", "text")
    suffixes = stored(one.join(wanted, ["doc_id", "th"]).select("doc_id", "text", "wanted").mapInArrow(words, "g long, branches long, h1 long, h2 long, doc_id long, n int, words binary"), "suffixes")

    small = suffixes.where(F.col("branches") <= group).select("g", "h1", "h2", "doc_id", "n", "words")
    trees = small.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _subtrees(it, depth), "h1 long, h2 long, bits long")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "n", "words")), strict=True):
                w, at = np.frombuffer(blob, np.uint64), np.arange(n)
                same = lambda v: pa.array(np.full(n, v))
                yield pa.RecordBatch.from_arrays([signed(span_hash(w, at, at + depth)), signed(span_hash(mix(w), at, at + depth, 1)), same(h1), same(h2), same(doc), pa.array(at)], ["w1", "w2", "h1", "h2", "doc_id", "k"])

    # groups that memory would not hold: prefixes as long as the window
    whole = suffixes.where(F.col("branches") > group).mapInArrow(explode, "w1 long, w2 long, h1 long, h2 long, doc_id long, k long")
    # written, so that the join that follows deals a hot window to several tasks
    least = stored(whole.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "nodes")
    full = whole.join(least, ["w1", "w2"]).where("lo < doc_id").groupBy("h1", "h2").agg(F.expr("bit_or(shiftleft(1L, CAST(k AS INT)))").alias("bits"))

    part = trees.unionByName(full).groupBy("h1", "h2").agg(F.bit_or("bits").alias("bits"))
    verdict = branch.where("copied").select("h1", "h2", F.col("doc_id").alias("lo")).join(part, ["h1", "h2"], "full_outer")
    hits = found.select("doc_id", "th", "start", "n", "h1", "h2").join(verdict, ["h1", "h2"])
    # a branch's smallest document keeps what only itself has; every other one loses all of it
    hits = hits.withColumn("bits", F.expr("IF(doc_id > lo, shiftleft(1L, n) - 1, coalesce(bits, 0L))")).where("bits <> 0")
    return one, hits.select("doc_id", "th", "start", "bits")


def cover(n_words: int, starts: np.ndarray, bits: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The flags of a document's words that lie in a window to remove."""
    edge = np.zeros(n_words + 1, np.int64)
    if len(starts):
        flags = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, k = np.nonzero(flags)
        at = starts[row] + k
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + depth, 1)
    return np.cumsum(edge[:-1]) > 0


def _with_hits(docs: DataFrame, depth: int) -> DataFrame:
    """docs(row, doc_id, th, text) with ``hits``, an array of (start, bits)."""
    _, hits = repeats(docs.select("doc_id", "th", F.col("row").getField("text").alias("text") if "row" in docs.columns else F.col("text")), depth)
    lists = hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "bits")).alias("hits"))
    return docs.join(lists, ["doc_id", "th"], "left")


def _removed(texts: pa.Array, hits: pa.Array, depth: int) -> Iterator[tuple[int, Block, int, np.ndarray]]:
    """(row in the batch, block, row in the block, flags of removed words)."""
    lists, flat = hits.offsets.to_numpy(), hits.values
    starts, bits = flat.field("start").to_numpy(zero_copy_only=False), flat.field("bits").to_numpy(zero_copy_only=False)
    for b in blocks(texts):
        for i in range(b.n):
            r, n = b.first + i, int(b.word_at[i + 1] - b.word_at[i])
            lo, hi = (lists[r], lists[r + 1]) if hits[r].is_valid else (0, 0)
            yield r, b, i, cover(n, starts[lo:hi], bits[lo:hi], depth)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def digests(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256; one row for each input row.

    Null and empty texts have no words; rows without an id are compared with
    nothing and keep all words; rows with equal ids never remove each other's
    words; repeated rows each get a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for _, b, i, flags in _removed(batch.column("text"), batch.column("hits"), depth):
                lo, hi = b.word_at[i], b.word_at[i + 1]
                s, e = b.starts[lo:hi][~flags].tolist(), b.ends[lo:hi][~flags].tolist()
                raw = b.data.tobytes() if i == 0 else raw  # noqa: F821
                n.append(len(flags))
                gone.append(int(flags.sum()))
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_hits(keyed(docs.select("doc_id", "text")).drop("row"), depth).select("doc_id", "text", "hits").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the repeated words cut out of ``text``; all other columns stay as they are.

    Between two kept words that were neighbours the text stays as it was; where
    words are cut, the white space around them goes with them but for what
    stood after the cut.  A text without repeats is unchanged, byte for byte.
    """
    columns = docs.columns
    wide = _with_hits(keyed(docs).drop("text"), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field(rows.type.get_field_index("text"))
            new: list[str | None] = []
            first = 0
            for r, b, i, flags in _removed(texts, batch.column("hits"), depth):
                if not flags.any():
                    new.append(texts[r].as_py())
                else:
                    lo, at = b.word_at[i], b.offsets[i]
                    raw, end = b.data[at : b.offsets[i + 1]], b.offsets[i + 1] - at
                    # each word owns the white space before it; what follows the last word stays
                    s, e = b.starts[lo : lo + len(flags)] - at, b.ends[lo : lo + len(flags)] - at
                    before = np.concatenate([[0], e[:-1]])
                    edge = np.zeros(end + 1, np.int64)
                    np.add.at(edge, before[flags], 1)
                    np.subtract.at(edge, e[flags], 1)
                    new.append(raw[np.cumsum(edge[:-1]) == 0].tobytes().decode("utf-8", "replace"))
                if i + 1 == b.n:
                    yield pa.RecordBatch.from_arrays([rows.slice(first, len(new)), pa.array(new, pa.string())], ["row", "new"])
                    first, new = r + 1, []

    schema = wide.select("row").schema.add("new", "string")
    out = wide.select("row", "hits").mapInArrow(run, schema)
    return out.select(*[F.col("new").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns])
