"""Each operator on awkward rows, against plain versions."""

from __future__ import annotations

import base64
import random
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from pyspark.sql import functions as F
from quadloom.llm import bpe, chat, embedding, minhash, packing, pitman_yor, quality, sharding, substring, warc
from quadloom.llm.queries import vocabulary

random.seed(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


PASSAGE = prose(80)
LONG = prose(30_000)
TEXTS = [
    (1, PASSAGE + "\n" + prose(30)), (2, prose(20) + "  " + PASSAGE), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG), (8, "one two"), (9, "one two"), (10, PASSAGE + "\n" + PASSAGE),
    (11, "Ünïcödé ☃ " + prose(60) + " x"), (11, prose(55)), (12, prose(70)), (12, prose(70)), (None, PASSAGE), (13, "a\x00b </s> [INST] it's \U0001f600"),
]
TEXTS.append(TEXTS[0])
NEAR = LONG.split()[:600]
for _i in range(20, 40):
    _w = NEAR[:]
    for _j in random.sample(range(600), 2):
        _w[_j] = "changed" + str(_i)
    TEXTS.append((_i, " ".join(_w)))


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns carry names that the operators use themselves
    return spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in TEXTS], "doc_id long, text string, row string, n int, shard double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("group", [substring.GROUP, 1])
def test_substring(docs, none, group, monkeypatch):
    monkeypatch.setattr(substring.repeats, "__defaults__", (50, 8, group))
    assert got(substring.digests(docs)) == sorted(brute.substring_dedup(TEXTS), key=repr)
    assert substring.digests(none).count() == 0
    kept = substring.dedup(docs)
    assert kept.columns == docs.columns
    for d, text in ((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] in (3, 4, 5, 8, 6)):
        assert text == dict(TEXTS)[d]


def test_substring_tree():
    rng = np.random.default_rng(1)
    for case in range(60):
        depth, letters = int(rng.integers(1, 8)), int(rng.integers(1, 4))
        branches = [rng.integers(0, letters, int(rng.integers(depth, 30))) for _ in range(int(rng.integers(1, 9)))]
        t = substring.Tree(np.concatenate(branches).astype(np.uint64), np.array([len(b) for b in branches]), depth)
        suffixes = [tuple(branches[i][k:].tolist()) for i, k in zip(t.branch, t.place, strict=True)]
        assert all(len(x) >= depth for x in suffixes) and len(suffixes) == sum(len(b) - depth + 1 for b in branches)
        nodes = {}
        for x in suffixes:
            nodes.setdefault(x[:depth], []).append(x)
        assert len(nodes) == len(t.first)
        for lo, hi, deep in zip(t.first.tolist(), t.last.tolist(), t.string_depth.tolist(), strict=True):
            mine = [suffixes[i] for i in t.order[lo : hi + 1]]
            assert sorted(nodes[mine[0][:depth]]) == sorted(mine)
            common = 0
            while all(len(x) > common and x[common] == mine[0][common] for x in mine):
                common += 1
            assert deep == common
        doc = rng.integers(0, 9, len(branches))
        least = t.least(doc)
        for x, v in zip(suffixes, least.tolist(), strict=True):
            assert v == min(doc[i] for i, y in zip(t.branch, suffixes, strict=True) if y[:depth] == x[:depth])


def test_substring_decides_by_trees(spark, docs):
    """Every window to remove is in a leaf with a smaller document or below an internal node; no group is too large for a tree here."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text").distinct()
    _, hits = substring.repeats(rows)
    found = {(r["doc_id"], r["th"], r["start"] + i) for r in hits.collect() for i in range(64) if r["bits"] >> i & 1}
    texts = [(r["doc_id"], r["th"], brute.words(r["text"])) for r in rows.collect()]
    least = {}
    for d, _, w in texts:
        for i in range(len(w) - 49):
            least[tuple(w[i : i + 50])] = min(d, least.get(tuple(w[i : i + 50]), d))
    assert found == {(d, th, i) for d, th, w in texts for i in range(len(w) - 49) if least[tuple(w[i : i + 50])] < d}


def test_quality(docs, none):
    entries = quality.book(docs, quality.word_hashes(["w1"]))
    found = sorted(((x["doc_id"], *(x[m] for m in quality.MEASURES[:5]), x["base_failed"]) for x in quality.verdicts(entries).collect()), key=repr)
    plain = [(d, *(q := brute.quality(t)), q[0] < 50 or 100 * q[4] > 50 * q[0]) for d, t in TEXTS]
    assert found == sorted(plain, key=repr)
    assert quality.verdicts(quality.book(none, [])).count() == 0
    assert quality.keep(docs, []).columns == docs.columns
    table = {x["rule"]: x for x in quality.ablations(entries).collect()}
    bits = [x["failed"] for x in entries.collect()]
    for rule, bit in quality.BITS.items():
        assert table[rule]["n_failed"] == sum(1 for b in bits if b & bit)
        assert table[rule]["n_alone"] == sum(1 for b in bits if b == bit)
        assert table[rule]["n_kept_without"] == sum(1 for b in bits if not b & ~bit)


def test_quality_learns_toxic_words(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        w = [rng.choice(WORDS) for _ in range(80)]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(80)] = rng.choice(["Rotzig!", "\u00e9puant", "vil"])
        rows.append((i, " ".join(w)))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (350, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    words = quality.toxic_words(docs, known)
    assert set(quality.word_hashes(["rotzig", "\u00e9puant", "vil"])) <= set(words) and len(words) < 10
    failed = {r["doc_id"] for r in quality.book(docs, words).where(F.col("failed").bitwiseAND(quality.BITS["toxic"]) != 0).collect()}
    # those without a label too
    assert failed == {i for i in range(400) if i % 8 == 0}
    assert quality.toxic_words(docs, known.where("false")) == []


def test_near_duplicates(spark, docs, none):
    want = brute.near_groups([(d, t) for d, t in TEXTS if d is not None])
    found = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert found == want
    assert minhash.near_duplicates(docs).count() == len(TEXTS)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_near_duplicates_of_repeated_ids(spark):
    """An id stands for all its texts, whichever comes first."""
    a, b, c = ([f"{x}{i}" for i in range(300)] for x in "abc")
    near = lambda w: " ".join([*w[:-2], "x", "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, " ".join(c)), (4, near(c)), (5, near(c)), (1, " ".join(a))]
    for order in (rows, rows[::-1]):
        found = {r["id"]: r["group"] for r in minhash.groups(spark.createDataFrame(order, "id long, text string").coalesce(1)).collect()}
        assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_near_duplicates_of_short_texts(spark):
    """Few shingles: one more word makes similarities of 4/5 to 12/13; recall against brute force."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        w = [f"s{rng.randrange(10**6)}" for _ in range(8 + i % 9)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "more"]))]
    want = brute.near_groups(rows)
    found = {r["id"]: r["group"] for r in minhash.groups(spark.createDataFrame(rows, "id long, text string")).collect()}
    missed = sum(found.get(d, d) != g for d, g in want.items())
    assert missed <= 2


def test_near_duplicates_of_pairs_that_only_a_third_joins(spark):
    """A chain: neighbours are similar, the ends are not; and many members of one bucket."""
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(12):
        w = base[:]
        for j in range(k * 4, k * 4 + 4):
            w[j * 5] = f"c{k}_{j}"
        for j in range((k + 1) * 4, (k + 2) * 4):
            w[j * 5] = f"c{k + 1}_{j}"
        rows.append((k, " ".join(w)))
    want = brute.near_groups(rows)
    found = minhash.groups(spark.createDataFrame(rows, "id long, text string"))
    found = {r["id"]: r["group"] for r in found.collect()}
    assert {d: found.get(d, d) for d in want} == want


def test_near_duplicates_by_occurrences(spark):
    """Weights count: equal sets of shingles, but one text repeats a part of it many times."""
    from collections import Counter

    rng = random.Random(9)
    base = [f"q{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"new{rng.randrange(9)}"
        rows.append((i, " ".join(w + w[5 : 5 + rng.randrange(6, 30)] * rng.randrange(0, 5))))
    weights = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]

    def exact(a, b):
        every = a.keys() | b.keys()
        return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in every) for i in a.keys() & b.keys())

    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for j in range(i):
            if exact(weights[i], weights[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = {r["id"]: r["group"] for r in minhash.groups(spark.createDataFrame(rows, "id long, text string"), weighted=True).collect()}
    assert [found.get(i, i) for i in range(60)] == [root(i) for i in range(60)]
    assert [root(i) for i in range(60)] != [brute.near_groups(rows)[i] for i in range(60)]


def test_prob_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(1, 2**63, 300, dtype=np.uint64)
    w1, w2 = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300).astype(float)
    exact = sum(1 / np.maximum(w1 / w1[i], w2 / w2[i]).sum() for i in range(300))
    m = 4096
    r = minhash.prob_minhash(np.repeat([0, 1], 300), np.concatenate([e, e]), np.concatenate([w1, w2]), 2, m)
    assert abs((r[0] == r[1]).mean() - exact) < 0.04


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "a </s>[INST] \\ \\l <|> b"), (1, 2, "assistant", "x<|>y"), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, 5, None, "z"), (2, 1, "we]ird<r>", ""), (None, None, "user", "q"), (3, 0, "assistant", "\U0001f600")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    formatted = chat.format_chats(df)
    back = formatted.select("conv_id", chat.turns_of(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("loss")).alias("l"))
    for r in back.collect():
        mine = sorted(((t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"]))
        assert [tuple(t) for t in r["t"]] == [(ro, x) for _, ro, x in mine]
        assert r["l"] == "".join(x for _, ro, x in mine if ro == "assistant")
    assert chat.digests(df.where("false")).count() == 0
    many = spark.range(1000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    d = chat.digests(many).first()
    assert d["n_turns"] == 1000 and d["loss_chars"] == sum(len(f"t{i}") for i in range(1000) if i % 3)


def test_sharding(docs, none):
    placed = sharding.shard(docs, 4).select("_placed.*", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).collect()
    assert len(placed) == len(TEXTS)
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    biggest = max(r["size"] for r in placed)
    mean = sum(r["size"] for r in placed) / 4
    assert all(abs(sum(r["size"] for r in by.get(k, [])) - mean) <= 2 * biggest for k in range(4))
    assert sharding.digests(none).count() == 0


def test_sharding_splits_a_text_with_many_copies(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'same text', concat('t', id)) AS text")
    sizes = [r["s"] for r in sharding.digests(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 60


def test_sharding_with_many_ranges_against_plain(spark):
    """More ranges than the least number, a text that fills many of them, and each column of the contract."""
    rows = [(i, "x" * 40 if i % 3 == 0 else None if i % 101 == 0 else f"text \u00e9 {i % 977} " * (1 + i % 5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = sharding.shard(df, 24, target=400).select("_placed.*", "row.*").collect()
    assert len({r["range"] for r in placed}) > 192
    by = {}
    for r in placed:
        by.setdefault(r["shard"], []).append(r)
        assert r["size"] == len((r["text"] or "").encode()) + 8
    assert sorted(((r["doc_id"], r["text"]) for r in placed), key=repr) == sorted(rows, key=repr)
    sizes = [sum(r["size"] for r in by[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in placed)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    crc = {r["doc_id"]: r["text_crc32"] for r in sharding.digests(df).collect()}
    assert crc == {d: zlib.crc32((t or "").encode()) for d, t in rows}


def test_bpe(docs, none):
    import tiktoken
    import public_tokenizers as P

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    alphabet = [*"aab 's  ''tlvremd!!9 \n\t é1½中", "'ll", "'re", "  ", " '", "　", "\x85"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["".join(chr(c) for c in range(0x2000))]
    c = bpe.Codec(path)
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    parts, _, counts = c.encode_block(b"".join(data), offsets)
    at = 0
    for t, k in zip(texts, counts.tolist(), strict=True):
        ids = [i for p in parts[at : at + k] for i in p]
        at += k
        assert ids == enc.encode_ordinary(t)
        assert c.decode(ids) == t.encode()
    encoded = bpe.encode(docs, path)
    for r in bpe.decode(encoded, path).collect():
        assert bytes(r["decoded"]).decode() == (r["row"]["text"] or "")
    for r in encoded.collect():
        assert r["ids"] == enc.encode_ordinary(r["row"]["text"] or "") and len(r["starts"]) == len(r["ids"])
    assert bpe.digests(none, path).count() == 0


def test_bpe_classes_are_the_library_s():
    table = bpe.class_table()
    assert table[ord(" ")] == bpe.SPACE and table[0x3000] == bpe.WHITE and table[0x1C] == bpe.OTHER


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    r = packing.packed(docs, vocabulary("word_bpe_49k.json")).collect()
    want = []
    for d, text in TEXTS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            p = ids[s : s + 4096]
            want.append((d, k, s, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))))
    assert sorted((tuple(x)[:5] for x in r), key=repr) == sorted(want, key=repr)
    by = {}
    for x in r:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.packed(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_word_ids_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t, w = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["it's IT'S 's ''s !'s x1234 Ŀa ŉ ſ ß ẞ é ½ ² × ÷ ª a_b \x7f 're'llx İ ΣΑΣ", "a<|endoftext|>b", *(chr(c) + "a " + chr(c) for c in range(33, 0x250)), ""]
    for text, ids in zip(texts, w.ids([x.encode() for x in texts]), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("lengths", [[100] * 1000, [1400] * 9, list(range(1, 900)) * 2, [4096, 4095, 1, 1], [3000] * 40 + [1000] * 50 + [90] * 30, [], [7]])
def test_packing_plans(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=4097)[1:]
    plan, how = packing.solve(counts)
    held = np.zeros(4096, int)
    for content, times in plan:
        assert sum(n * k for n, k in content.items()) <= 4096
        for n, k in content.items():
            held[n - 1] += k * times
    assert (held == counts).all()
    assert how["dual_bound"] - 1e-6 <= how["sequences"] <= sum(t for _, t in brute.best_fit(counts, 4096))


def test_packing_is_done_by_the_program():
    """On lengths of a skewed distribution, few and many: hardly anything is left to best fit, and the dual proves the plan to be nearly optimal."""
    rng = np.random.default_rng(11)
    for n in (300, 3000, 60_000):
        lengths = np.minimum(np.maximum(rng.lognormal(5.7, 1.3, n).astype(int), 1), 4096)
        counts = np.bincount(lengths, minlength=4097)[1:]
        plan, how = packing.solve(counts)
        assert how["residue"] < 0.03 if n < 1000 else how["residue"] < 0.01
        assert how["sequences"] <= sum(t for _, t in brute.best_fit(counts, 4096))
        assert how["sequences"] <= how["dual_bound"] * 1.005 + 1


def test_packing_ranks_within_salts(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 4096L, 1 + id % 700) AS length")
    rows = packing.pack(df, ranked=50).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == 5000
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096


def test_pitman_yor(spark, docs, none):
    r = pitman_yor.score(docs).collect()
    assert len(r) == len(TEXTS)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda d: zlib.crc32((str(d) if d is not None else "").encode()) % 5 == 1
    from collections import Counter
    from math import log10

    count = Counter()
    toks = [(d, [*brute.words((t or "").translate(low)), None]) for d, t in TEXTS]
    for d, w in toks:
        if not held(d):
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(w), sum(count[x] > 0 for x in w), n, round(sum(log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 3)) for d, w in toks), key=repr)
    assert sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 3)) for x in r), key=repr) == want
    assert all(x["score"] < 0 for x in r)
    assert pitman_yor.score(none).count() == 0


def test_pitman_yor_predicts_held_out_text_better_than_its_base(spark):
    rng = random.Random(2)
    # each word is mostly followed by its successor
    rows = []
    for d in range(400):
        w = [rng.randrange(50)]
        for _ in range(60):
            w.append((w[-1] + 1) % 50 if rng.random() < 0.8 else rng.randrange(50))
        rows.append((d, " ".join(f"w{x}" for x in w)))
    r = [x for x in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["held_out"]]
    assert sum(x["score"] for x in r) > 0.7 * sum(x["base_score"] for x in r)


@pytest.mark.parametrize("share", [pitman_yor.SHARE, 12_000, 60])
def test_pitman_yor_has_a_restaurant_for_each_context(spark, share):
    rng = random.Random(3)
    # each word is followed by one of two, and the word before it tells which
    rows = []
    for d in range(600):
        w = [rng.randrange(300), rng.randrange(300)]
        for _ in range(200 if share > 100 else 20):
            w.append((w[-1] * 7 + w[-2] % 2 + 1) % 300)
        rows.append((d, " ".join(f"w{x}" for x in w)))
    r = [x for x in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), share=share, chunk=3000).collect() if x["held_out"]]
    assert len(r) == sum(zlib.crc32(str(d).encode()) % 5 == 1 for d in range(600))
    assert sum(x["score"] for x in r) > (0.2 if share > 100 else 0.95) * sum(x["base_score"] for x in r)


def test_pitman_yor_scores_do_not_hang_on_where_a_hot_word_lies(spark):
    """A previous word and a pair with more tokens than half a share are still one restaurant each."""
    rng = random.Random(4)
    rows = []
    for d in range(500):
        w = []
        for _ in range(15):
            # rarely the same word twice before the hot one, and a hot pair with words of its own
            w += [f"x{rng.randrange(5000)}", "the", f"y{min(rng.randrange(60), rng.randrange(60))}", "of", "the", f"z{min(rng.randrange(60), rng.randrange(60))}"]
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole, spread = ({x["doc_id"]: x["score"] for x in pitman_yor.score(docs, share=share, chunk=2000).collect()} for share in (pitman_yor.SHARE, 400))
    held = [d for d in whole if zlib.crc32(str(d).encode()) % 5 == 1]
    assert abs(sum(spread[d] for d in held) / sum(whole[d] for d in held) - 1) < 0.01
    assert max(abs(spread[d] / whole[d] - 1) for d in whole) < 0.05


def test_pitman_yor_probabilities_sum_to_one():
    # two pairs of words before, under one previous word; words 0 to 2, and unknown ones
    of, word = np.repeat([0, 1], 4), np.tile([0, 1, 2, 3], 2)
    s = pitman_yor.Seating(of, word, np.zeros(4, int), np.arange(4), np.array([5, 2, 0, 0, 1, 0, 4, 0]), 3)
    low, high, root = pitman_yor.Level(0.6, 1.5), pitman_yor.Level(0.4, 0.7), pitman_yor.Root(pitman_yor.Level(0.5, 2.0), 5.0, 4.0, 1 / 4)
    p0 = root.of(np.array([2.0, 2.0, 1.0, 0.0]), np.array([1.0, 2.0, 1.0, 0.0]))
    assert abs(p0.sum() - 1) < 1e-12
    for k in range(50):
        s.sweep(k, low, high, p0)
        assert (s.t <= s.c).all() and (s.t[s.c > 0] >= 1).all()
        c1 = s.customers_up()
        assert (s.t1 <= c1).all() and (s.t1[c1 > 0] >= 1).all()
        p = s.predict(low, high, p0)
        assert abs(p[:4].sum() - 1) < 1e-12 and abs(p[4:].sum() - 1) < 1e-12


def test_pitman_yor_sweeps_keep_their_sums_without_counting_all_rows(monkeypatch):
    rng = np.random.default_rng(9)
    # 12 restaurants over 3 parents, 30 words; the last parent's dishes and restaurants have pieces elsewhere
    of, word = np.divmod(np.sort(rng.choice(12 * 30, 250, replace=False)), 30)
    dish, at = np.unique(of // 4 * 30 + word, return_inverse=True)
    s = pitman_yor.Seating(of, at, dish // 30, dish % 30, rng.integers(0, 90, 250) // rng.integers(1, 30, 250), 7)
    s.shared, s.apart = s.up == 2, np.arange(12) >= 10
    c1 = s.customers_up()[s.shared] + 3
    s.join(c1, np.minimum(c1, 2.5), np.array([np.nan, np.nan, 500.0]), np.array([np.nan, np.nan, 200.0]), s.all[10:] + 40, s.tables_of()[10:] + 9)
    assert abs(s.all1[2] - 500) < 1e-9 and abs(s.tables1[2] - 200) < 1e-9
    assert s.many.any() and s.free.any()
    low, high, p0 = pitman_yor.Level(0.5, 0.8), pitman_yor.Level(0.3, 1.1), np.full(len(dish), 1 / 31)

    def whole(self):
        raise AssertionError("all rows are counted for a part of the words")

    t1 = s.t1[s.shared].copy()
    with monkeypatch.context() as m:
        for name in ("customers_up", "tables_of"):
            m.setattr(pitman_yor.Seating, name, whole)
        for k in range(60):
            s.sweep(k, low, high, p0, 0.12 if k else 1.0)
    kept = s.tables, s.c1, s.all1, s.tables1
    s.count()
    for a, b in zip(kept, (s.tables, s.c1, s.all1, s.tables1), strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-9)
    assert (s.t1[s.shared] == t1).all() and (s.t1[~s.shared] <= s.c1[~s.shared]).all() and (s.t <= s.c).all()


def test_pitman_yor_waits_as_long_as_customers_one_by_one():
    rng = np.random.default_rng(6)
    a, x, most = 0.8, 2.3, 6
    n = 200_000
    k = pitman_yor.until_new(rng, np.full(n, a), np.full(n, x), np.full(n, float(most)))
    stay = 1.0
    for i in range(most):
        new = a / (x + i + a)
        assert abs((k == i).mean() - stay * new) < 0.005
        stay *= 1 - new
    assert abs((k == most).mean() - stay) < 0.005
    values = np.array([0.01, 0.5, 1, 3.7, 50, 1e4, 1e9])
    from math import lgamma

    assert np.allclose(pitman_yor.log_gamma(values), [lgamma(v) for v in values], rtol=1e-9, atol=1e-9)


def test_pitman_yor_seating_is_the_chinese_restaurants():
    """Mean tables of one dish with six customers, against all seatings one by one, weighted by their probability."""
    theta, d, others, p, n = 0.9, 0.35, 3.0, 0.2, 6

    def plain(c, t, weight):
        if c == n:
            return {t: weight}
        out = {}
        for t2, w in ((t + 1, (theta + d * (others + t)) * p), (t, c - d * t)):
            for key, value in plain(c + 1, t2, weight * w).items():
                out[key] = out.get(key, 0) + value
        return out

    exact = plain(1, 1, 1.0)
    mean = sum(t * w for t, w in exact.items()) / sum(exact.values())
    rng, state, z = np.random.default_rng(8), np.ones(20_000), np.full(20_000, -np.inf)
    seen = []
    for _ in range(30):
        t, new_z = pitman_yor.seat(rng, np.full(20_000, float(n)), theta, d, others, np.full(20_000, p))
        take = np.log(rng.random(20_000)) < new_z - z
        state, z = np.where(take, t, state), np.where(take, new_z, z)
        seen.append(state.mean())
    assert abs(np.mean(seen[5:]) - mean) < 0.01


def test_pitman_yor_blocks_have_the_right_distribution():
    """Two restaurants below one, one free word: mean tables of both levels against all seatings."""
    low, high, p0 = pitman_yor.Level(0.5, 0.8), pitman_yor.Level(0.3, 1.1), 0.3

    def plain(rows, t, c1, t1, weight):
        if not rows:
            return {(t, t1): weight}
        (n, done, mine), *rest = rows
        if n == done:
            return plain(rest, t, c1, t1, weight)
        out = {}
        steps = [(mine, c1, t1, done - low.discount * mine)] if done else []
        up = (low.theta + low.discount * mine) / (high.theta + c1)
        steps.append((mine + 1, c1 + 1, t1 + 1, up * (high.theta + high.discount * t1) * p0))
        if c1:
            steps.append((mine + 1, c1 + 1, t1, up * (c1 - high.discount * t1)))
        for m, c, t1b, w in steps:
            for key, value in plain([(n, done + 1, m), *rest], t + m - mine, c, t1b, weight * w).items():
                out[key] = out.get(key, 0) + value
        return out

    exact = plain([(3, 0, 0), (4, 0, 0)], 0, 0, 0, 1.0)
    total = sum(exact.values())
    want = [sum(k[i] * w for k, w in exact.items()) / total for i in (0, 1)]
    n = 4000
    s = pitman_yor.Seating(np.arange(2 * n), np.repeat(np.arange(n), 2), np.arange(n), np.arange(n), np.tile([3, 4], n), 5)
    got = []
    for k in range(40):
        s.sweep(k, low, high, np.full(n, p0))
        got.append((s.t.sum() / n, s.t1.sum() / n))
    assert np.abs(np.mean(got[8:], axis=0) - want).max() < 0.02


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        rows.append((i, i % 3, v.tolist()))
        if i % 5 == 0:
            rows += [(1000 + 10 * i + j, i % 3, (v + rng.normal(size=16) * 0.1).tolist()) for j in range(4)]
            rows.append((5000 + i, i % 3, v.tolist()))
    rows += [(9001, 0, None), (9002, None, [1.0] * 16), (9003, 0, [0.0] * 16), (9004, 0, [1.0, None] * 8), (9005, 0, [float("nan")] * 16), (9006, 0, []), (9007, 0, [1.0] * 3), (9008, 0, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    ok = [(i, lab, np.array(v)) for i, lab, v in rows if lab is not None and v and not any(x is None or x != x for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, la, va in ok:
        for b, lb, vb in ok:
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.98:
                links[a].add(b)
                links[b].add(a)

    def root(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    want = sorted((i, len(links[i]), root(i), root(i) == i) for i, _, _ in rows)
    named = lambda d: sorted(tuple(r) for r in d.collect())
    assert named(embedding.digests(df)) == want
    one = embedding.links(df.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")), block=7)
    assert named(one) == want
    assert embedding.digests(df.where("false")).count() == 0


def test_embeddings_that_share_an_id_and_extreme_ones(spark):
    rows = [
        (5, 0, [1.0, 0.0]), (5, 0, [0.0, 1.0]), (6, 0, [1.0, 0.001]), (3, 0, [0.001, 1.0]), (5, 0, [0.0, 1.0]),
        (20, 1, [1e200, 1e198]), (21, 1, [1e-200, 1e-202]), (22, 1, [1e300, 0.0]), (23, 1, [-1e-300, 0.0]), (24, 1, [5e-324, 0.0]),
    ]
    found = sorted(tuple(r) for r in embedding.digests(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect())
    assert found == [
        (3, 2, 3, True), (5, 1, 5, True), (5, 2, 3, False), (5, 2, 3, False), (6, 1, 5, False),
        (20, 3, 20, True), (21, 3, 20, False), (22, 3, 20, False), (23, 0, 23, True), (24, 3, 20, False),
    ]


def test_warc(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><p>a &amp; b<p>c<br>d <!-- x --><script>var y='</p>';</script><b>e</b>f</body>"
    rows = [(1, "http://a/", page), (2, None, None), (3, "http://b/\r\nx", ""), (3, "http://b/\r\nx", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    out = warc.derivatives(warc.responses(df)).collect()
    assert len(out) == 4
    fields, block = warc.parse(bytes(out[0]["conversion"]))
    assert block.decode() == "a & b\nc\nd ef"
    meta, about = warc.parse(bytes(out[0]["metadata"]))
    assert meta["warc-refers-to"] == fields["warc-refers-to"] and fields["warc-record-id"] in about.decode()
    assert all(r["digests_agree"] and r["refers_to_agree"] for r in warc.digests(df).collect())
    assert warc.digests(df.where("false")).count() == 0
    import gzip

    member = bytes(warc.gzipped(warc.derivatives(warc.responses(df))).first()["member"])
    assert gzip.decompress(member).count(b"WARC/1.1\r\n") == 2


def test_warc_text_is_linear_and_as_a_parser_reads():
    import time

    for page in ("<script " * 130_000, "<a " * 350_000, "<a href='" * 110_000, "<!--" * 260_000, "<" * 1_000_000, "<svg>" * 200_000, "<head>" * 170_000, "<script></scrip" * 70_000, "</" * 500_000, '<p =="' * 170_000, "<textarea>x</textarea " * 45_000):
        t = time.time()
        warc.plain_text(page)
        assert time.time() - t < 2, page[:20]
    assert warc.plain_text("<head><title>t</title><body>a") == "a"
    assert warc.plain_text("<head><title>t</title><p>a") == "a"
    assert warc.plain_text("a<svg/>b<svg><svg></svg>x</svg>c") == "a b c"
    assert warc.plain_text("a < b &lt; c<script>1<2</script >d <p title='x>y'>e") == "a < b < c d\ne"
    rng = random.Random(4)

    def node(depth):
        kind = rng.choice(["text", "text", "p", "b", "div", "br", "script", "comment", "svg", "a"])
        inner = "".join(node(depth - 1) for _ in range(rng.randrange(4))) if depth else "z"
        return {
            "text": rng.choice(["word ", "&amp;", " x\n", "caf\u00e9", "&lt;p&gt;"]), "br": "<br/>", "script": "<SCRIPT type='a'>if (a<b) '</p>'</Script>", "comment": "<!-- <p> -->",
            "svg": "<svg width=1><text>no</text></svg>", "a": f"<a href=\"x>y\" title='<p>'>{inner}</a>",
        }.get(kind, f"<{kind} class=x>{inner}</{kind}>")

    for _ in range(300):
        page = "".join(node(4) for _ in range(5))
        assert warc.plain_text(page) == brute.page_text(page)


def test_warc_of_awkward_records(spark):
    import gzip

    ok = warc.record([("WARC-Type", "response"), ("X-Long", "y" * 9000), ("WARC-Record-ID", "<a>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + (lambda z: b"%x\r\n" % len(z) + z + b"\r\n0\r\n\r\n")(gzip.compress(b"<p>hi")))
    late = warc.record([("X-Long", "y" * 9000), ("WARC-Type", "Response"), ("WARC-Record-ID", "<b>")], b"HTTP/1.1 200 OK\r\n\r\n<p>late")
    bad = [
        None, b"", b"junk", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nx", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nx",
        warc.record([("WARC-Type", "response")], b"x"), warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<c>")], b"WARC-Type: response\r\n"),
    ]
    rows = [(i, r) for i, r in enumerate([*bad, ok, late, late])]
    out = warc.derivatives(spark.createDataFrame(rows, "page long, record binary")).collect()
    assert [r["page"] for r in out] == [8, 9, 10] and out[1]["metadata"] == out[2]["metadata"]
    texts = [warc.parse(bytes(r["conversion"])) for r in out]
    assert [b.decode() for _, b in texts] == ["hi", "late", "late"] and texts[0][0]["warc-refers-to"] == "<a>"
    assert "http-header-content-encoding: gzip" in warc.parse(bytes(out[0]["metadata"]))[1].decode()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = [(i, prose(200)) for i in range(30)]
    d += [(100 + i, d[i][1]) for i in range(5)] + [(200, "short"), *((201 + i, f"idiot moron {prose(100)}") for i in range(4))] + [(300, prose(60) + " " + " ".join(d[3][1].split()[20:90]) + " " + prose(60))]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in d], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(201 <= i < 204)) for i, _ in d if i != 204], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    r = corpus_pipeline.run(spark, path).collect()
    assert {x["doc_id"] for x in r} == {*range(30), 300}
    kept = [(i, t) for i, t in d if i < 30 or i == 300]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    text = dict(kept)
    words = text[300].split()
    text[300] = " ".join(words[:60] + words[130:])
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in text.items()}
    assert {x["doc_id"]: x["length"] for x in r} == want
