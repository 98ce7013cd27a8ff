"""SPARQL updates: each operation makes a new table of quads.

The WHERE part is evaluated once on the state before the operation, its quads
are written to shared storage, and then deleted and inserted.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import algebra as A
from ..sources.quads import SCHEMA, QuadSource
from ..storage import materialise
from ..terms import IRI, Blank, Triple, Var, encode
from .compiler import compile

KEYS = ["s", "p", "o", "g"]


class UpdateProblem(ValueError):
    """An operation that cannot be done and is not SILENT."""


def run(dataset, operations: list[A.Operation]):
    """The dataset after all operations, or none of them if one fails."""
    quads = dataset.quads.select(*KEYS)
    for op in operations:
        quads = materialise(apply(dataset, quads, op))
    return dataset.with_quads(quads)


def _without(quads: DataFrame, gone: DataFrame) -> DataFrame:
    gone = gone.select(*[F.col(k).alias("_" + k) for k in KEYS])
    same = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")) & F.col("g").eqNullSafe(F.col("_g"))
    return quads.join(gone, same, "left_anti")


def _with(quads: DataFrame, more: DataFrame) -> DataFrame:
    """The quads and those that are new: only these are made distinct, and a few of them need no shuffle of all quads."""
    more = more.select(*KEYS).distinct()
    there = more.select(*[F.col(k).alias("_" + k) for k in KEYS])
    same = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")) & F.col("g").eqNullSafe(F.col("_g"))
    return quads.unionByName(_without(more, quads.join(there, same, "left_semi")))


def _data(dataset, template: tuple, salt: str) -> DataFrame:
    rows = []
    for (s, p, o), g in template:
        fresh = lambda t: Blank(f"{salt}_{t.label}") if isinstance(t, Blank) else Triple(*map(fresh, (t.s, t.p, t.o))) if isinstance(t, Triple) else t
        if any(isinstance(t, Var) for t in (s, p, o, g)):
            raise UpdateProblem("data holds a variable")
        rows.append((encode(fresh(s)), encode(p), encode(fresh(o)), encode(g) if g is not None else None))
    return dataset.spark.createDataFrame(rows, SCHEMA)


def _in(ref: object) -> Column:
    """Whether a quad is in DEFAULT, NAMED, ALL or a graph."""
    g = F.col("g")
    return {"DEFAULT": g.isNull(), "NAMED": g.isNotNull(), "ALL": F.lit(True)}[ref] if isinstance(ref, str) else g == encode(ref)


def _label(ref: object) -> Column:
    return F.lit(None).cast("string") if ref in ("DEFAULT", None) else F.lit(encode(ref))


def apply(dataset, quads: DataFrame, op: A.Operation) -> DataFrame:
    import uuid

    match op.kind:
        case "INSERT DATA":
            return _with(quads, _data(dataset, op.insert, "i" + uuid.uuid4().hex[:8]))
        case "DELETE DATA":
            return _without(quads, _data(dataset, op.delete, "d"))
        case "MODIFY":
            return modify(dataset, quads, op)
        case "CLEAR" | "DROP":
            if not op.silent and isinstance(op.target, IRI) and quads.where(_in(op.target)).isEmpty():
                raise UpdateProblem(f"no graph {op.target.value}")
            return quads.where(~F.coalesce(_in(op.target), F.lit(False)))
        case "CREATE":
            # a graph without quads leaves no trace in a table of quads
            if not op.silent and not quads.where(_in(op.target)).isEmpty():
                raise UpdateProblem(f"graph {op.target.value} is there")
            return quads
        case "ADD" | "COPY" | "MOVE":
            if op.source == op.target:
                return quads
            source = quads.where(F.coalesce(_in(op.source), F.lit(False)))
            if not op.silent and op.source != "DEFAULT" and source.isEmpty():
                raise UpdateProblem(f"no graph {op.source}")
            rest = quads if op.kind == "ADD" else quads.where(~F.coalesce(_in(op.target), F.lit(False)))
            if op.kind == "MOVE":
                rest = rest.where(~F.coalesce(_in(op.source), F.lit(False)))
            return _with(rest, source.withColumn("g", _label(op.target)))
        case "LOAD":
            try:
                if dataset.resolver is not None:
                    loaded = dataset.resolver(op.source)
                else:
                    from ..sources.readers import read

                    loaded = read(dataset.spark, op.source)
                loaded = loaded.withColumn("g", _label(op.target)) if op.target is not None else loaded
                return _with(quads, loaded)
            except Exception:
                if op.silent:
                    return quads
                raise
    raise TypeError(op.kind)


def modify(dataset, quads: DataFrame, op: A.Operation) -> DataFrame:
    from ..dataset import instantiate

    ctx = replace(dataset.context(), source=QuadSource(quads))
    if op.has_dataset:
        ctx = replace(ctx, default=op.default, named=op.named)
    elif op.with_graph is not None:
        ctx = replace(ctx, graph=IRI(op.with_graph))
    f = compile(op.pattern, ctx)
    home = IRI(op.with_graph) if op.with_graph is not None else None
    at = lambda template: tuple((t, g if g is not None else home) for t, g in template)
    gone = materialise(instantiate(f, at(op.delete))) if op.delete else None
    more = materialise(instantiate(f, at(op.insert))) if op.insert else None
    if gone is not None:
        quads = _without(quads, gone)
    return _with(quads, more) if more is not None else quads
