"""The five-table columnar form: terms, quads, reifiers, annotations and blobs as Parquet.

Ids number the terms densely.  Numbering is by range partitions: sorted codes
get their partition's offset plus their row number there, so no single task
sees all terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import Val, datatype, is_kind, language, lexical, triple_code
from ..storage import materialise
from ..terms import RDF, RS, XSD

REIFIES = "I" + RDF + "reifies"


def _parts(c: Column) -> list[Column]:
    pieces = F.split(F.substr(c, F.lit(2)), RS, 3)
    return [F.when(is_kind(Val("term", c), "T"), F.get(pieces, F.lit(i))) for i in range(3)]


def write_tables(quads: DataFrame, path: str) -> None:
    """Writes the five tables as folders under ``path``; blobs are empty, as quads hold none."""
    quads = materialise(quads.select("s", "p", "o", "g").distinct())
    every = quads.select(F.explode(F.array("s", "p", "o", "g")).alias("code")).where("code IS NOT NULL").distinct()
    # triple terms name others, and literals their datatypes
    d = datatype(Val("term", F.col("code")))
    kinds = F.when(d.startswith("x:"), F.concat(F.lit("I" + XSD), F.substr(d, F.lit(3)))).otherwise(F.concat(F.lit("I"), d))
    known = every
    while True:
        inner = known.select(F.explode(F.array(*_parts(F.col("code")))).alias("code")).where("code IS NOT NULL").distinct()
        fresh = materialise(inner.join(known, "code", "left_anti"))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    known = known.union(known.select(kinds.alias("code")).where("code IS NOT NULL")).distinct()
    placed = materialise(known.repartitionByRange("code").sortWithinPartitions("code").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    terms = materialise(placed.join(F.broadcast(before), "part").select("code", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("code"))).alias("id")))
    lookup = lambda df, c, to: df.join(terms.select(F.col("code").alias(c), F.col("id").alias(to)), c, "left").drop(c)

    c = F.col("code")
    v = Val("term", c)
    lang = language(v)
    out = terms.withColumn("kind", F.when(is_kind(v, "I"), 0).when(is_kind(v, "L"), 1).when(is_kind(v, "B"), 2).otherwise(3).cast("long"))
    out = out.withColumn("lex", F.when(is_kind(v, "L"), lexical(c)).when(~is_kind(v, "T"), F.substr(c, F.lit(2))))
    out = out.withColumn("dt", F.when(d.isNotNull(), kinds)).withColumn("lang", F.nullif(F.regexp_replace(lang, "--.*", ""), F.lit("")))
    out = out.withColumn("direction", F.when(lang.endswith("--ltr"), 0).when(lang.endswith("--rtl"), 1).cast("long")).withColumn("scope", F.when(is_kind(v, "B"), F.lit(0)).cast("long"))
    for name, part in zip(("ts", "tp", "to"), _parts(c), strict=True):
        out = out.withColumn(name, part)
    graphs = quads.select(F.col("g").alias("code")).where("code IS NOT NULL").distinct().withColumn("named_graph", F.lit(1).cast("long"))
    out = out.join(graphs, "code", "left").withColumn("named_graph", F.coalesce("named_graph", F.lit(0).cast("long"))).drop("code")
    for c_, to in (("dt", "datatype"), ("ts", "triple_s"), ("tp", "triple_p"), ("to", "triple_o")):
        out = lookup(out, c_, to)
    out.select("id", "kind", "lex", "datatype", "lang", "direction", "scope", "triple_s", "triple_p", "triple_o", "named_graph").write.parquet(f"{path}/terms")

    reified = quads.where(F.col("p") == REIFIES)
    named = reified.select("s", "g").distinct().withColumnRenamed("s", "r").withColumnRenamed("g", "rg")
    rest = quads.where(F.col("p") != REIFIES)
    on = (F.col("s") == F.col("r")) & F.col("g").eqNullSafe(F.col("rg"))
    notes, plain = rest.join(named, on, "left_semi"), rest.join(named, on, "left_anti")
    ids = plain
    for x in "spog":
        ids = lookup(ids, x, "i" + x)
    ids.selectExpr("is AS s", "ip AS p", "io AS o", "ig AS g").repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o", "g").write.parquet(f"{path}/quads")
    pieces = _parts(F.col("o"))
    r = reified.select(F.col("s").alias("r"), pieces[0].alias("s"), pieces[1].alias("p"), pieces[2].alias("o"), "g")
    for x in "rspog":
        r = lookup(r, x, "i" + x)
    r.selectExpr("ir AS reifier", "is AS s", "ip AS p", "io AS o", "ig AS g").write.parquet(f"{path}/reifiers")
    for x in "spog":
        notes = lookup(notes, x, "i" + x)
    notes.selectExpr("is AS reifier", "ip AS predicate", "io AS value", "ig AS g").write.parquet(f"{path}/annotations")
    quads.sparkSession.createDataFrame([], "digest string, bytes binary").write.parquet(f"{path}/blobs")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """The quads of the five tables, reifiers and annotations as quads too."""
    terms = spark.read.parquet(f"{path}/terms")
    types = terms.select(F.col("id").alias("datatype"), F.col("lex").alias("dt"))
    t = terms.join(types, "datatype", "left")
    kind = F.when(F.col("dt").startswith(XSD), F.concat(F.lit("x:"), F.substr("dt", F.lit(len(XSD) + 1)))).otherwise(F.col("dt"))
    tag = F.concat(F.coalesce("lang", F.lit("")), F.when(F.col("direction") == 0, "--ltr").when(F.col("direction") == 1, "--rtl").otherwise(""))
    code = F.when(F.col("kind") == 0, F.concat(F.lit("I"), "lex")).when(F.col("kind") == 2, F.concat(F.lit("B"), "lex")).when(F.col("kind") == 1, F.concat(F.lit("L"), kind, F.lit("\x1f"), tag, F.lit("\x1f"), "lex"))
    flat = t.where("kind <> 3").select("id", code.alias("code"))
    nested = terms.where("kind = 3").select("id", "triple_s", "triple_p", "triple_o")
    # triple terms from the inside out
    while not nested.isEmpty():
        ready = nested
        for x in ("s", "p", "o"):
            ready = ready.join(flat.select(F.col("id").alias("triple_" + x), F.col("code").alias(x)), "triple_" + x)
        done = materialise(ready.select("id", triple_code(F.col("s"), F.col("p"), F.col("o")).alias("code")))
        if done.isEmpty():
            raise ValueError("triple terms that name each other")
        flat = materialise(flat.union(done))
        nested = materialise(nested.join(done.select("id"), "id", "left_anti"))

    def coded(df: DataFrame, names: list[str]) -> DataFrame:
        for c in names:
            df = df.join(flat.select(F.col("id").alias(c), F.col("code").alias("_" + c)), c, "left").drop(c).withColumnRenamed("_" + c, c)
        return df

    quads = coded(spark.read.parquet(f"{path}/quads"), ["s", "p", "o", "g"]).select("s", "p", "o", "g")
    r = coded(spark.read.parquet(f"{path}/reifiers"), ["reifier", "s", "p", "o", "g"])
    r = r.select(F.col("reifier").alias("s"), F.lit(REIFIES).alias("p"), triple_code(F.col("s"), F.col("p"), F.col("o")).alias("o"), "g")
    a = coded(spark.read.parquet(f"{path}/annotations"), ["reifier", "predicate", "value", "g"])
    a = a.select(F.col("reifier").alias("s"), F.col("predicate").alias("p"), F.col("value").alias("o"), "g")
    return quads.unionByName(r).unionByName(a)
