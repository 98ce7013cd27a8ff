"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text.  The ledger keeps one failure bit per
rule and the measurements behind it; a policy is a named, versioned mask over
these bits, so a verdict, a changed policy or an ablation reads the stored ledger
and never a text again.

The words of the toxicity rule are learned: those that are much commoner in
documents labelled toxic than in others, from a bounded sample of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Block, blocks, bounded_batches, signed, span_hash, stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_toxic")

#: rule -> SQL over the measurements that is true where the rule fails; the order gives the bit
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines AND n_dup_lines > 2",
    "toxic": "n_toxic >= 2 AND 100 * n_toxic >= n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}

#: policies by version: the rules of which none may fail
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "word_length", "dup_lines", "toxic"),
}

#: labelled rows that the words are learned from, the smallest ids; toxic documents that a word must be in; how much commoner it must be there
LABELLED, LEAST, RATIO = 20_000, 3, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER_SEP = np.ones(256, bool)
_LETTER_SEP[0x80:] = False
for _a in (ord("a"), ord("A")):
    _LETTER_SEP[_a : _a + 26] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(words: list[str]) -> list[int]:
    """Words, in lower case as far as A to Z go, as the rule knows them."""
    data = [np.frombuffer(w.encode(), np.uint8) for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return Block(np.concatenate([np.empty(0, np.uint8), *data]), offsets, 0, _LETTER_SEP).hashes.view(np.int64).tolist()


def toxic_words(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, least: int = LEAST, ratio: int = RATIO) -> list[int]:
    """Hashes of the words that mark toxic documents; none where no label is toxic.

    Null labels are no labels, of several for an id the largest counts, of
    several texts for an id each counts.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.max("toxic").alias("_toxic")).orderBy("_of").limit(labelled)
    # the broadcast side has ``labelled`` rows at most
    texts = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_of")).select((F.col("_toxic") == 1).alias("toxic"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of both kinds that each word is in; word 0 stands for all texts."""
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            found = [(np.zeros(len(toxic), np.uint64), toxic)]
            for b in blocks(batch.column("text")):
                letters = Block(_LOWER[b.data], b.offsets, b.first, _LETTER_SEP)
                order, new, _ = _distinct(letters.doc, letters.hashes)
                found.append((letters.hashes[order[new]], toxic[b.first + letters.doc[order[new]]]))
            word, flag = (np.concatenate(x) for x in zip(*found, strict=True))
            word, at = np.unique(word, return_inverse=True)
            t = np.bincount(at, weights=flag, minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([signed(word), pa.array(t), pa.array(np.bincount(at, minlength=len(word)) - t)], ["word", "t", "c"])

    counts = texts.mapInArrow(run, "word long, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = stored(counts, "words")
    t, c = (x or 0 for x in counts.where("word = 0").agg(F.sum("t"), F.sum("c")).first())
    return sorted(r["word"] for r in counts.where((F.col("word") != 0) & (F.col("t") >= least) & (F.col("t") * c >= F.col("c") * (ratio * t))).select("word").collect())


def _distinct(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts (doc, key), the flag of each first of a kind there, and each one's kind."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return order, new, np.cumsum(new) - 1


def measure(b: Block, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each row of a block; ``toxic`` are the sorted hashes of the learned words."""
    at = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[b.offsets[1:]] - c[b.offsets[:-1]]
    in_word = np.zeros(len(b.data) + 1, np.int8)
    in_word[b.starts] += 1
    np.subtract.at(in_word, b.ends, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": np.diff(b.word_at), "word_chars": at(in_word & ((b.data & 0xC0) != 0x80)), "n_symbols": at(_SYMBOL[b.data])}

    cut = np.union1d(np.flatnonzero(b.data == 10) + 1, b.offsets)
    cut = cut[cut <= len(b.data)]
    first, last = cut[:-1], cut[1:]
    filled = np.concatenate([[0], np.cumsum(in_word)])
    keep = filled[last] > filled[first]
    first, last = first[keep], last[keep]
    ends = last - (b.data[last - 1] == 10)
    line_doc = np.searchsorted(b.offsets, first, side="right") - 1
    _, new, _ = _distinct(line_doc, span_hash(BYTE_VALUES[b.data], first, ends))
    order_doc = np.sort(line_doc, kind="stable")
    out["n_lines"] = np.bincount(line_doc, minlength=b.n)
    out["n_dup_lines"] = np.bincount(order_doc[~new], minlength=b.n)

    at3 = b.windows(3)
    covered = np.zeros(len(b.starts) + 3, bool)
    if len(at3):
        order, _, kind = _distinct(b.doc[at3], span_hash(b.hashes, at3, at3 + 3))
        again = at3[order[np.bincount(kind)[kind] > 1]]
        for i in range(3):
            covered[again + i] = True
    out["n_repeat_words"] = b.per_doc(covered[: len(b.starts)])

    letters = Block(_LOWER[b.data], b.offsets, b.first, _LETTER_SEP)
    out["n_toxic"] = np.bincount(letters.doc[np.isin(letters.hashes, toxic)], minlength=b.n)
    return out


def ledger(docs: DataFrame, words: list[int], text: str = "text") -> DataFrame:
    """(row, the measurements, failed): each input row in a struct with its ledger entry beside it.

    A null or empty text has no words and so fails ``few_words``.  Repeated rows
    are entered once each; columns of any name survive inside ``row``.  No row
    meets another, so nothing is shuffled and memory is bounded by a block of
    about a megabyte or one text.
    """
    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("_text"))
    toxic = np.sort(np.array(words, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(b, toxic) for b in blocks(batch.column(1))]
            cols = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["row", *MEASURES])

    schema = packed.select("row").schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    measured = packed.mapInArrow(run, schema)
    failed = " | ".join(f"IF({sql}, {BITS[name]}L, 0L)" for name, sql in RULES.items())
    return measured.select("*", F.expr(failed).alias("failed"))


def mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a ledger entry passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) == 0 if isinstance(failed, str) else failed.bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_alone, n_kept_without): what each rule of a policy does.

    The ledger is first summed by bit pattern, of which there are at most
    2**rules whatever the input; the rest is arithmetic on patterns.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = patterns.select("bits", "n", rules).selectExpr("r.rule", "n", "bits & r.bit AS own", "bits & ~r.bit AS rest")
    return each.groupBy("rule").agg(
        F.sum(F.expr("IF(own <> 0, n, 0)")).alias("n_failed"),
        F.sum(F.expr("IF(own <> 0 AND rest = 0, n, 0)")).alias("n_alone"),
        F.sum(F.expr("IF(rest = 0, n, 0)")).alias("n_kept_without"),
    )


def book(docs: DataFrame, words: list[int]) -> DataFrame:
    """The ledger of documents(doc_id, text) as a stored table: an entry for each row, without its text."""
    entries = ledger(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words)
    return stored(entries.select("row.doc_id", *MEASURES, "failed"), "ledger")


def verdicts(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """The contract's columns, and the ledger's bits, from a ledger."""
    return entries.select(
        "doc_id", *MEASURES[:5], (~passes("base")).alias("base_failed"), passes(policy).alias("kept"),
        F.col("failed").alias("failed_bits"), "n_lines", "n_toxic",
    )


def keep(docs: DataFrame, words: list[int], policy: str = "v1") -> DataFrame:
    """The rows of docs whose text passes the policy, unchanged; entry and row are together, so the ledger is not stored."""
    return ledger(docs, words).where(passes(policy)).select("row.*")
