"""A dataset held as quads: a table s, p, o, g of codes, where a NULL graph is the default one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, code
from ..operators import frame as R
from ..operators.frame import Frame
from ..operators.paths import G, O, S
from ..terms import IRI, Triple, Var, encode

SCHEMA = "s string, p string, o string, g string"


def ground(t: object) -> bool:
    return not isinstance(t, Var) and (not isinstance(t, Triple) or all(map(ground, (t.s, t.p, t.o))))


class QuadSource:
    """Scans of a quad table.  Partitioned by ``p``, a constant predicate prunes files."""

    def __init__(self, quads: DataFrame, counts: dict[str, int] | None = None):
        self.quads = quads
        self.counts = counts

    def measure(self) -> None:
        """Counts the quads of each predicate once, to order joins by."""
        self.counts = {r["p"]: r["n"] for r in self.quads.groupBy("p").agg(F.count("*").alias("n")).limit(10_000).collect()}

    def active(self, ctx) -> tuple[DataFrame, bool]:
        """The triples of the active graph, and whether they carry a graph column ``g``."""
        q = self.quads
        if isinstance(ctx.graph, Var):
            q = q.where(F.col("g").isNotNull())
            if ctx.default is not None or ctx.named is not None:
                q = q.where(F.col("g").isin(["I" + n for n in ctx.named or ()]))
            return q, True
        if ctx.graph is not None:
            if ctx.named is not None and ctx.graph.value not in ctx.named:
                return q.where(F.lit(False)).drop("g"), False
            return q.where(F.col("g") == encode(ctx.graph)).drop("g"), False
        if ctx.default is not None or ctx.named is not None:
            merged = q.where(F.col("g").isin(["I" + n for n in ctx.default or ()])).drop("g")
            return (merged.distinct() if len(ctx.default or ()) > 1 else merged), False
        return q.where(F.col("g").isNull()).drop("g"), False

    def scans(self, triples: list, ctx) -> list[tuple[float, Frame]]:
        return [(self._cost(t), self._scan(t, ctx)) for t in triples]

    def _cost(self, t) -> float:
        bound = sum((not isinstance(x, Var)) * w for x, w in ((t.s, 4), (t.o, 2), (t.p, 1)))
        size = float((self.counts or {}).get(encode(t.p), 1e6)) if isinstance(t.p, IRI) else 1e7
        return size / 10.0**bound

    def _scan(self, t, ctx) -> Frame:
        q, with_graph = self.active(ctx)
        vals: dict[str, Val] = {}
        for c, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(x, Var):
                if x.name in vals:
                    q = q.where(F.col(c) == vals[x.name].col)
                else:
                    vals[x.name] = Val("term", F.col(c))
            elif ground(x):
                q = q.where(F.col(c) == encode(x))
            else:
                raise NotImplementedError("a triple pattern as a subject")
        if with_graph:
            if ctx.graph.name in vals:
                q = q.where(F.col("g") == vals[ctx.graph.name].col)
            else:
                vals[ctx.graph.name] = Val("term", F.col("g"))
        return R.build(q, vals) if vals else Frame(q.select(F.lit(1).alias(R.fresh("unit"))), {})

    def edges(self, iris: list[str] | None, ctx, without: tuple[str, ...] = (), subject=None) -> Frame:
        q, with_graph = self.active(ctx)
        if iris is not None:
            q = q.where(F.col("p").isin(["I" + i for i in iris]))
        if without:
            q = q.where(~F.col("p").isin(["I" + i for i in without]))
        vals = {S: Val("term", F.col("s")), O: Val("term", F.col("o"))}
        if with_graph:
            vals[G] = Val("term", F.col("g"))
        return R.build(q, vals)

    def nodes(self, ctx) -> Frame:
        """Every subject and object of the active graph, as ``.n`` (and its graph)."""
        q, with_graph = self.active(ctx)
        g = [F.col("g")] if with_graph else []
        df = q.select(F.col("s").alias("n"), *g).union(q.select(F.col("o").alias("n"), *g)).distinct()
        vals = {".n": Val("term", F.col("n"))}
        if with_graph:
            vals[G] = Val("term", F.col("g"))
        return R.build(df, vals)

    def graph_names(self, name: str, ctx) -> Frame:
        q = self.quads.where(F.col("g").isNotNull())
        if ctx.named is not None:
            q = q.where(F.col("g").isin(["I" + n for n in ctx.named]))
        return R.build(q.select("g").distinct(), {name: Val("term", F.col("g"))})

    def all_quads(self) -> DataFrame:
        return self.quads


class Both:
    """Several sources as one dataset: every scan is the union of theirs."""

    def __init__(self, *sources):
        self.sources = sources

    def scans(self, triples: list, ctx) -> list[tuple[float, Frame]]:
        out = []
        for t in triples:
            parts = [s.scans([t], ctx)[0] for s in self.sources]
            out.append((min(c for c, _ in parts), reduce(R.union, [f for _, f in parts])))
        return out

    def edges(self, iris, ctx, without=(), subject=None) -> Frame:
        return reduce(R.union, [R.term_frame(s.edges(iris, ctx, without, subject)) for s in self.sources])

    def nodes(self, ctx) -> Frame:
        return R.distinct(reduce(R.union, [s.nodes(ctx) for s in self.sources]))

    def graph_names(self, name: str, ctx) -> Frame:
        return R.distinct(reduce(R.union, [R.term_frame(s.graph_names(name, ctx)) for s in self.sources]))

    def all_quads(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.all_quads() for s in self.sources]).distinct()


def from_frame(f: Frame, s: str, p: object, o: str) -> DataFrame:
    """Solutions as quads of a constant predicate."""
    return f.df.select(code(f.val(s)).alias("s"), F.lit(encode(p)).alias("p"), code(f.val(o)).alias("o"), F.lit(None).cast("string").alias("g"))
