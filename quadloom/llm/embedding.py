"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors are cut into grid cells of side epsilon on the leading principal
directions, where epsilon is the distance that the cosine threshold allows.
Sorted by label and cell they form a sequence; vectors within epsilon lie in
neighbouring cells, so most intervals of the sequence cannot meet.  Intervals
become blocks of rows.  Blocks whose bounding boxes come close enough are
paired, and a pair is joined recursively: halves that are provably distant are
skipped, the rest is one product of matrices in double precision.

A pair of blocks reports counts, and for connectivity one smaller id for each
vector, never its list of links, so a dense cluster costs arithmetic but no
rows.  Equal vectors are one weighted vector from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import components

COSINE, DIRECTIONS, BLOCK, LEAF = 0.98, 4, 512, 64


def _clean(rows: DataFrame) -> DataFrame:
    """rows(id, label, vector) -> (id, label, dim, d1, d2, raw): a digest and the bytes of those that can link, nulls for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            lists = vectors.offsets.to_numpy()
            flat = vectors.values
            bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), bool)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            bad |= ~np.isfinite(values)
            here, there = np.asarray(vectors.is_valid()), np.asarray(labels.is_valid()) & np.asarray(ids.is_valid())
            cols: list[list] = [[None] * batch.num_rows for _ in range(4)]
            for i in np.flatnonzero(here & there).tolist():
                v = values[lists[i] : lists[i + 1]]
                if len(v) and not bad[lists[i] : lists[i + 1]].any() and v.any():
                    blob = v.tobytes()
                    digest = hashlib.blake2b(blob, digest_size=16).digest()
                    for col, x in zip(cols, (len(v), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), blob), strict=True):
                        col[i] = x
            yield pa.RecordBatch.from_arrays([ids, labels, *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["id", "label", "dim", "d1", "d2", "raw"])

    return rows.mapInArrow(run, "id long, label long, dim int, d1 long, d2 long, raw binary")


def _scaled(m: np.ndarray) -> np.ndarray:
    """The rows times a power of two each, which brings the largest component near 1 and rounds nothing: cosines neither overflow nor vanish."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    m = _scaled(np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim))
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal(classes: DataFrame, directions: int) -> dict[int, np.ndarray]:
    """For each vector length, its leading principal directions, from sums of moments."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            raw = batch.column("raw").to_pylist()
            for d in np.unique(dims).tolist():
                u = _units([raw[i] for i in np.flatnonzero(dims == d)], d)
                u = np.hstack([u, np.ones((len(u), 1))])
                found[d] = found.get(d, 0) + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([m.tobytes() for m in found.values()], pa.binary())], ["dim", "moments"])

    def both(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {d: a.get(d, 0) + b.get(d, 0) for d in a.keys() | b.keys()}

    # summed on the executors: the driver gets one matrix for each length
    sent = classes.select("dim", "raw").mapInArrow(moments, "dim int, moments binary").rdd
    total = sent.map(lambda r: {r[0]: np.frombuffer(r[1], np.float64).reshape(r[0] + 1, r[0] + 1)}).treeAggregate({}, both, both)
    out = {}
    for dim, m in total.items():
        n = m[-1, -1]
        mean = m[:-1, -1] / n
        _, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
        out[dim] = axes[:, ::-1][:, :directions]
    return out


def join_blocks(a: dict, b: dict, same: bool, epsilon: float, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights linked to each row of a, to each of b, smallest id joined to each of a, of b) for two blocks."""
    na, nb = len(a["id"]), len(b["id"])
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    to_a, to_b = a["id"].copy(), b["id"].copy()
    hits: list[tuple[slice, slice, np.ndarray]] = []

    def go(i: slice, j: slice) -> None:
        pa_, pb = a["at"][i], b["at"][j]
        gap = np.maximum(pa_.min(axis=0) - pb.max(axis=0), pb.min(axis=0) - pa_.max(axis=0))
        if (gap > epsilon).any():
            return
        ni, nj = i.stop - i.start, j.stop - j.start
        if ni > LEAF or nj > LEAF:
            if ni >= nj:
                mid = i.start + ni // 2
                go(slice(i.start, mid), j)
                go(slice(mid, i.stop), j)
            else:
                mid = j.start + nj // 2
                go(i, slice(j.start, mid))
                go(i, slice(mid, j.stop))
            return
        if same and i.start > j.start:
            return
        hit = (a["m"][i] @ b["m"][j].T) / np.multiply.outer(a["norm"][i], b["norm"][j]) >= cosine
        if same and i.start == j.start:
            hit = np.triu(hit, 1)
        if hit.any():
            hits.append((i, j, hit))

    go(slice(0, na), slice(0, nb))
    for i, j, hit in hits:
        count_a[i] += hit @ b["weight"][j]
        count_b[j] += hit.T @ a["weight"][i]
    far, changed = np.iinfo(np.int64).max, bool(hits)
    while changed:
        changed = False
        for i, j, hit in hits:
            x = np.minimum(to_a[i], np.where(hit, to_b[j][None, :], far).min(axis=1))
            y = np.minimum(to_b[j], np.where(hit, x[:, None], far).min(axis=0))
            changed |= bool((x < to_a[i]).any() or (y < to_b[j]).any())
            to_a[i], to_b[j] = x, y
        if same:
            low = np.minimum(to_a, to_b)
            changed |= bool((low < to_a).any() or (low < to_b).any())
            to_a[:], to_b[:] = low, low
    return count_a, count_b, to_a, to_b


def links(rows: DataFrame, cosine: float = COSINE, directions: int = DIRECTIONS, block: int = BLOCK) -> DataFrame:
    """rows(id, label, vector) -> (id, n_links, component, kept), a row for each input row.

    Only vectors of one label and one length are compared.  A null vector,
    label or id, an empty or zero vector, and one with a null or a non-finite
    component link with nothing: no links, their own id as component.  Repeated
    rows are vectors of their own, and link; rows that share an id but not the
    vector have links and components of their own.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    clean = stored(_clean(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")), "vectors")
    alike = clean.where("dim IS NOT NULL").groupBy("label", "dim", "d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    # a class is known by a hash of its label and its vector's 128 bits
    classes = stored(alike.withColumn("id", F.xxhash64("label", "dim", "d1", "d2")), "classes")
    axes = principal(classes, directions)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, raw = batch.column("dim").to_numpy(), batch.column("raw").to_pylist()
            at = np.zeros((len(dims), directions))
            for d in np.unique(dims).tolist():
                i = np.flatnonzero(dims == d)
                z = _units([raw[k] for k in i], d) @ axes[d]
                at[i, : z.shape[1]] = z
            cells = np.floor(at / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(directions)], pa.array([r.tobytes() for r in at], pa.binary())], [*batch.schema.names, *cell_names, "at"])

    cell_names = [f"c{k}" for k in range(directions)]
    order = ["label", "dim", *cell_names, "id"]
    schema = T.StructType(list(classes.schema.fields))
    for c in cell_names:
        schema = schema.add(c, "integer")
    placed = classes.mapInArrow(project, schema.add("at", "binary")).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of the sequence: at most ``block`` rows of one label and length."""
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            label, dim, ids, weights, raw, at = zip(*held, strict=True)
            place = np.frombuffer(b"".join(at), np.float64).reshape(len(at), -1)
            lo, hi = np.floor(place.min(axis=0) / epsilon), np.floor(place.max(axis=0) / epsilon)
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays(
                [one(ids[0], pa.int64()), one(label[0], pa.int64()), one(dim[0], pa.int32()), one(lo.astype(int).tolist(), pa.list_(pa.int32())), one(hi.astype(int).tolist(), pa.list_(pa.int32())),
                 one(np.array(ids, np.int64).tobytes(), pa.binary()), one(np.array(weights, np.int64).tobytes(), pa.binary()), one(b"".join(raw), pa.binary()), one(place.tobytes(), pa.binary())],
                ["bid", "label", "dim", "lo", "hi", "ids", "weights", "raws", "places"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "id", "weight", "raw", "at")), strict=True):
                if held and (len(held) >= block or held[-1][:2] != row[:2]):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    kinds = "bid long, label long, dim int, lo array<int>, hi array<int>, ids binary, weights binary, raws binary, places binary"
    blocks = stored(placed.mapInArrow(cut, kinds), "blocks")

    # boxes that come within a cell of each other, found by the cells of two directions
    box = blocks.select("bid", "label", "dim", "lo", "hi")
    near = box.select("*", F.explode(F.expr("sequence(lo[0], hi[0] + 1)")).alias("g0"))
    near = near.select("*", F.explode(F.expr("sequence(lo[1], hi[1] + 1)")).alias("g1")) if directions > 1 else near.withColumn("g1", F.lit(0))
    left, right = near, near.select(F.col("bid").alias("bid2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "label", "dim", "g0", "g1")
    meet = " AND ".join(f"lo[{k}] <= hi2[{k}] + 1 AND lo2[{k}] <= hi[{k}] + 1" for k in range(directions))
    pairs = left.join(right, ["label", "dim", "g0", "g1"]).where("bid <= bid2").where(meet).select("bid", "bid2", "dim").distinct()

    body = ["ids", "weights", "raws", "places"]
    work = pairs.join(blocks.select("bid", *[F.col(c).alias(f"a_{c}") for c in body]), "bid").join(blocks.select(F.col("bid").alias("bid2"), *[F.col(c).alias(f"b_{c}") for c in body]), "bid2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sides = []
                for s in "ab":
                    m = _scaled(np.frombuffer(row[f"{s}_raws"], np.float64).reshape(-1, row["dim"]))
                    sides.append({
                        "id": np.frombuffer(row[f"{s}_ids"], np.int64), "weight": np.frombuffer(row[f"{s}_weights"], np.int64),
                        "m": m, "norm": np.sqrt((m * m).sum(axis=1)), "at": np.frombuffer(row[f"{s}_places"], np.float64).reshape(len(m), -1),
                    })
                ca, cb, ta, tb = join_blocks(*sides, row["bid"] == row["bid2"], epsilon, cosine)
                ids, n, to = np.concatenate([sides[0]["id"], sides[1]["id"]]), np.concatenate([ca, cb]), np.concatenate([ta, tb])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(to[some])], ["id", "n", "to"])

    found = stored(work.mapInArrow(compare, "id long, n long, to long"), "links")
    joined = components(found.selectExpr("id AS a", "to AS b"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.select("label", "dim", "d1", "d2", "id", "least", "weight").join(counts, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "id")), "named")
    smallest = named.where("n IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
    per_class = named.join(smallest, "component", "left").select("label", "dim", "d1", "d2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    out = clean.select("id", "label", "dim", "d1", "d2").join(per_class, ["label", "dim", "d1", "d2"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def digests(embeddings: DataFrame) -> DataFrame:
    """The contract's columns for embeddings(vec_id, embedding, label)."""
    found = links(embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector")))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
