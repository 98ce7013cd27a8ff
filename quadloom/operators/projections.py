"""Views of a dataset in other models: VoID statistics, labelled property graphs, skolem IRIs, lists, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, datatype, is_kind, lexical, text_of, triple_code
from ..storage import materialise
from ..terms import OWL, RDF, RS
from .rules import list_members

TYPE = "I" + RDF + "type"


def void(quads: DataFrame) -> DataFrame:
    """(statistic, subject, n): counts of a dataset, by property and by class."""
    q = quads.select("s", "p", "o")
    whole = q.agg(F.count("*").alias("triples"), F.count_distinct("s").alias("distinctSubjects"), F.count_distinct("p").alias("properties"), F.count_distinct("o").alias("distinctObjects"))
    names = ", ".join(f"'{c}', {c}" for c in whole.columns)
    out = whole.selectExpr(f"stack({len(whole.columns)}, {names}) AS (statistic, n)").select("statistic", F.lit("").alias("subject"), "n")
    by_p = q.groupBy("p").agg(F.count("*").alias("n")).select(F.lit("propertyPartition").alias("statistic"), F.substr("p", F.lit(2)).alias("subject"), "n")
    by_c = q.where(F.col("p") == TYPE).groupBy("o").agg(F.count_distinct("s").alias("n")).select(F.lit("classPartition").alias("statistic"), F.substr("o", F.lit(2)).alias("subject"), "n")
    return out.unionByName(by_p).unionByName(by_c)


def lpg_nodes(quads: DataFrame) -> DataFrame:
    """(id, labels, properties): resources with their classes and literal values."""
    q = quads.select("s", "p", "o")
    literal = is_kind(Val("term", F.col("o")), "L")
    pair = F.when(literal, F.struct(F.substr("p", F.lit(2)).alias("key"), lexical(F.col("o")).alias("value"), datatype(Val("term", F.col("o"))).alias("datatype")))
    subjects = q.groupBy("s").agg(
        F.array_sort(F.collect_set(F.when(F.col("p") == TYPE, F.substr("o", F.lit(2))))).alias("labels"),
        F.array_sort(F.collect_set(pair)).alias("properties"),
    )
    ends = q.where(~literal & (F.col("p") != TYPE)).select(F.col("o").alias("s")).distinct().join(subjects.select("s"), "s", "left_anti")
    empty = ends.select("s", F.array().cast("array<string>").alias("labels"), F.array().cast(subjects.schema["properties"].dataType).alias("properties"))
    return subjects.unionByName(empty).withColumnRenamed("s", "id")


def lpg_edges(quads: DataFrame) -> DataFrame:
    """(source, label, target): triples between resources."""
    resource = F.substr("o", F.lit(1), F.lit(1)).isin("I", "B")
    return quads.where(resource & (F.col("p") != TYPE)).select(F.col("s").alias("source"), F.substr("p", F.lit(2)).alias("label"), F.col("o").alias("target"))


def lpg_lift(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as quads again."""
    g = F.lit(None).cast("string").alias("g")
    labels = nodes.select(F.col("id").alias("s"), F.lit(TYPE).alias("p"), F.explode("labels").alias("o")).select("s", "p", F.concat(F.lit("I"), "o").alias("o"), g)
    flat = nodes.select(F.col("id").alias("s"), F.explode("properties").alias("x"))
    props = flat.select("s", F.concat(F.lit("I"), "x.key").alias("p"), F.concat(F.lit("L"), "x.datatype", F.lit("\x1f\x1f"), "x.value").alias("o"), g)
    return labels.unionByName(props).unionByName(edges.select(F.col("source").alias("s"), F.concat(F.lit("I"), "label").alias("p"), F.col("target").alias("o"), g))


def _each(quads: DataFrame, f) -> DataFrame:
    return quads.select(*[f(F.col(c)).alias(c) for c in "spog"])


def skolemize(quads: DataFrame, authority: str) -> DataFrame:
    """Blank nodes as IRIs under an authority."""
    base = authority.rstrip("/") + "/.well-known/genid/"
    return _each(quads, lambda c: F.when(F.substr(c, F.lit(1), F.lit(1)) == "B", F.concat(F.lit("I" + base), F.substr(c, F.lit(2)))).otherwise(c))


def deskolemize(quads: DataFrame, authority: str) -> DataFrame:
    base = "I" + authority.rstrip("/") + "/.well-known/genid/"
    return _each(quads, lambda c: F.when(c.startswith(base), F.concat(F.lit("B"), F.substr(c, F.lit(len(base) + 1)))).otherwise(c))


def lists(quads: DataFrame) -> DataFrame:
    """(list, items): every rdf:List as an array of codes."""
    members = list_members(quads.select("s", "p", "o"))
    return members.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))


def list_functions(items: Column) -> dict[str, object]:
    """listLength, listGet and their like over an array of codes; places count from 0."""
    return {
        "listLength": F.size(items).cast("long"),
        "listGet": lambda i: F.get(items, i),
        "listIndexOf": lambda x: F.nullif(F.array_position(items, x) - 1, F.lit(-1).cast("long")),
        "listContains": lambda x: F.array_contains(items, x),
        "listSlice": lambda i, n: F.slice(items, i + 1, n),
        "listConcat": lambda other: F.concat(items, other),
    }


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, s, p, o, g): quads of one dataset only; blank nodes by label."""
    only = lambda x, y, side: x.select(*"spog").exceptAll(y.select(*"spog")).select(F.lit(side).alias("side"), *"spog")
    return only(a, b, "left").unionByName(only(b, a, "right"))


def canonical(quads: DataFrame, rounds: int = 8) -> DataFrame:
    """Quads with blank nodes named by what is said about them: hash refinement as joins.

    Each round hashes every blank node with its quads, other blanks by their
    hash so far.  Nodes that are still alike after all rounds share a name only
    if nothing tells them apart; then they are numbered by label.
    """
    q = materialise(quads.select(*"spog"))
    blanks = q.select(F.explode(F.array("s", "o", "g")).alias("b")).where("b LIKE 'B%'").distinct()
    names = blanks.select("b", F.lit("").alias("h"))
    distinct = -1
    for _ in range(rounds):
        named = q
        for c in "sog":
            named = named.join(names.select(F.col("b").alias(c), F.col("h").alias("h" + c)), c, "left")
        part = lambda c, me: F.when(F.col(c) == F.col("b"), F.lit("_:self")).when(F.col("h" + c).isNotNull(), F.concat(F.lit("_:"), "h" + c)).otherwise(F.coalesce(c, F.lit("")))
        told = named.withColumn("b", F.explode(F.array_distinct(F.filter(F.array("s", "o", "g"), lambda x: x.startswith("B")))))
        line = F.sha2(F.concat_ws("\x1e", part("s", 0), "p", part("o", 0), part("g", 0)), 256)
        new = told.groupBy("b").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(line))), 256).alias("h"))
        names = materialise(new.join(names.withColumnRenamed("h", "old"), "b").select("b", F.sha2(F.concat("old", "h"), 256).alias("h")))
        n = names.select("h").distinct().count()
        if n == distinct:
            break
        distinct = n
    from pyspark.sql import Window

    twin = F.row_number().over(Window.partitionBy("h").orderBy("b"))
    final = names.select("b", F.concat(F.lit("Bc"), F.substr("h", F.lit(1), F.lit(32)), F.when(twin > 1, F.concat(F.lit("x"), twin.cast("string"))).otherwise(F.lit(""))).alias("n"))
    for c in "sog":
        q = q.join(final.select(F.col("b").alias(c), F.col("n").alias("n" + c)), c, "left").withColumn(c, F.coalesce("n" + c, c)).drop("n" + c)
    return q.select(*"spog")


def isomorphic(a: DataFrame, b: DataFrame) -> bool:
    """Whether two datasets are equal up to the names of blank nodes, as far as refinement tells these apart."""
    return difference(canonical(a), canonical(b)).isEmpty()


def top_k(vectors: DataFrame, query: list[float], k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score): the k nearest by cosine, exactly; a top-k, so only k rows leave each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    score = dot(v, q) / (F.sqrt(dot(v, F.transform(v, lambda x: x.cast("double")))) * F.sqrt(dot(q, q)))
    return vectors.select(F.col(id_), score.alias("score")).orderBy(F.desc("score"), id_).limit(k)


def terms_text(quads: DataFrame) -> DataFrame:
    return quads.select(*[text_of(Val("term", F.col(c))).alias(c) for c in "spog"])


def to_axioms(quads: DataFrame) -> DataFrame:
    """Quads whose rdf:reifies statements are OWL axioms instead: a source, a property and a target for each reifier."""
    reifies = F.col("p") == "I" + RDF + "reifies"
    term = reifies & is_kind(Val("term", F.col("o")), "T")
    parts = F.split(F.substr("o", F.lit(2)), RS, 3)
    owl = lambda name: F.lit("I" + OWL + name)
    made = F.array(
        F.struct(F.lit(TYPE).alias("p"), owl("Axiom").alias("o")), F.struct(owl("annotatedSource").alias("p"), F.get(parts, F.lit(0)).alias("o")),
        F.struct(owl("annotatedProperty").alias("p"), F.get(parts, F.lit(1)).alias("o")), F.struct(owl("annotatedTarget").alias("p"), F.get(parts, F.lit(2)).alias("o")),
    )
    return quads.where(~term).unionByName(quads.where(term).select("s", F.explode(made).alias("x"), "g").select("s", "x.p", "x.o", "g")).distinct()


def from_axioms(quads: DataFrame) -> DataFrame:
    """The inverse of ``to_axioms``: a node with one source, one property and one target reifies their triple; others stay as they are."""
    names = {"annotatedSource": "a", "annotatedProperty": "b", "annotatedTarget": "c"}
    mine = F.col("p").isin(["I" + OWL + n for n in names])
    values = [F.collect_set(F.when(F.col("p") == "I" + OWL + n, F.col("o"))).alias(c) for n, c in names.items()]
    found = quads.where(mine).groupBy("s", "g").agg(*values).where("size(a) = 1 AND size(b) = 1 AND size(c) = 1")
    made = found.select("s", F.lit("I" + RDF + "reifies").alias("p"), triple_code(F.get("a", F.lit(0)), F.get("b", F.lit(0)), F.get("c", F.lit(0))).alias("o"), "g")
    whole = found.select(F.col("s").alias("_s"), F.col("g").alias("_g"))
    axiom = mine | ((F.col("p") == TYPE) & (F.col("o") == "I" + OWL + "Axiom"))
    gone = quads.where(axiom).join(whole, (F.col("s") == F.col("_s")) & F.col("g").eqNullSafe(F.col("_g")), "left_anti")
    return quads.where(~axiom).unionByName(gone).unionByName(made)
