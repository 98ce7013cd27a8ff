"""Sharding by sampled splitters, with near equal bytes.

Records are ordered by a key in which equal texts are neighbours.  A sample of
keys, drawn with the records' sizes as weights, gives quantile boundaries that
cut this order into ranges; a range that still turns out overfull, as one that
holds a text with many copies does, is subdivided by a second key into as many
cells as its size asks for.  Exact sums of the ranges then tell at which byte of
the whole order each range begins, and a record's byte its shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: least ranges for each shard; bytes that a range should hold, and ranges beyond which it holds more; sampled keys for each range
RANGES, TARGET, MOST, SAMPLE = 8, 64 << 20, 50_000, 16


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for a null, and eight for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shard(rows: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", target: int = TARGET) -> DataFrame:
    """(_placed, row): each of rows in a struct, beside its (size, shard, slot, range); every row is in one shard.

    Law ``bytes``: a shard's size differs from the mean by less than two
    records.  Slots are gapless from 0 in each shard.  Equal texts are
    neighbours in the order, so they share a shard unless a boundary falls
    among them or they fill a range.  Null keys and texts are ordered like any value, repeated rows
    take a slot each, an empty table gives no rows, and other columns are kept.

    The table is read for its size, for the sample, for the ranges' sums, for
    those of overfull ranges, and for the rows, which are shuffled once.  There
    are as many ranges as the size asks for, MOST at most, which then hold more
    each; the driver holds about SAMPLE keys and one sum for each of them, and
    at most as many cells again of those that are overfull.
    """
    spark = rows.sparkSession
    base = rows.select(F.struct("*").alias("row"), F.xxhash64(text).alias("h1"), F.xxhash64(F.col(key), F.lit(7)).alias("h2"), size_of(text).alias("size"))
    slim = base.select("h1", "h2", "size")
    total = rows.agg(F.sum(size_of(text))).first()[0] or 0
    most = max(shards * RANGES, -(-total // max(target, total // MOST)))

    # those whose exponential clock of rate size rings early: a sample weighted by size, which each task draws by itself
    uniform = (F.shiftrightunsigned(F.xxhash64("h1", "h2", F.lit(11)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    drawn = sorted(r[0] for r in slim.where(-F.log(uniform) / F.col("size") < F.lit(most * SAMPLE / max(total, 1))).select("h1").collect())
    bounds = np.array(sorted({drawn[len(drawn) * i // most] for i in range(1, most)}) if drawn else [], np.int64)

    @F.pandas_udf("int")
    def range_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, h.to_numpy(np.int64), side="right").astype(np.int32))

    sums = slim.select(range_of("h1").alias("range"), "size").groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    # an overfull range is cut into cells by its size; another one is a single cell
    full = {r["range"]: -(-r["bytes"] * most // total) for r in sums if r["bytes"] > 2 * total / most}
    many = np.ones(len(bounds) + 1, np.int64)
    for r, k in full.items():
        many[r] = k

    @F.pandas_udf("int")
    def cell_of(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy(np.int64) % many[r.to_numpy(np.int64)]).astype(np.int32))

    cells = slim.select(range_of("h1").alias("range"), "h2", "size").where(F.col("range").isin(list(full))).groupBy("range", cell_of("range", "h2").alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect() if full else []
    units = [(r["range"], 0, r["bytes"], r["n"]) for r in sums if r["range"] not in full] + [tuple(r) for r in cells]
    begins, at, n = [], 0, 0
    for r, c, b, k in sorted(units):
        begins.append((r, c, at, n))
        at, n = at + b, n + k

    starts = F.broadcast(spark.createDataFrame(begins, "unit_range int, unit_cell int, bytes_before long, rows_before long"))  # a row for each range or cell, 2 x MOST at most
    placed = base.withColumn("range", range_of("h1")).withColumn("cell", cell_of("range", "h2"))
    placed = placed.join(starts, (F.col("range") == F.col("unit_range")) & (F.col("cell") == F.col("unit_cell")))
    order = Window.partitionBy("range", "cell").orderBy("h1", "h2", "size")
    before = F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    index = F.col("rows_before") + F.row_number().over(order) - 1
    placed = placed.select("row", "size", "range", before.alias("before"), index.alias("index"))
    placed = placed.withColumn("shard", F.expr(f"CAST(least(before * {shards} DIV {max(total, 1)}, {shards - 1}) AS INT)"))
    # a shard begins inside some unit; its first row there is found by one minimum for each shard
    kept = stored(placed, "placed")
    firsts = kept.groupBy("shard").agg(F.min("index").alias("first"))
    placed = kept.join(F.broadcast(firsts), "shard")  # one row for each shard
    return placed.select(F.struct("size", "shard", (F.col("index") - F.col("first")).alias("slot"), "range").alias("_placed"), "row")


def write(placed: DataFrame, path: str) -> None:
    """The shards as folders ``shard=N`` of Parquet files whose rows are in slot order."""
    flat = placed.select("row.*", F.col("_placed.shard").alias("shard"), F.col("_placed.slot").alias("slot"), F.col("_placed.range").alias("range"))
    flat.repartition("shard", "range").sortWithinPartitions("shard", "slot").drop("range").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's columns, from the placed rows."""
    placed = shard(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shards)
    return placed.select(
        "row.doc_id", "_placed.size", F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "_placed.shard", "_placed.slot", F.lit(None).cast("int").alias("grown_shard"),
    )
