"""Datasets: load, query, update, materialise, validate, write."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import algebra as A
from .functions.values import Val, code, is_kind
from .operators import frame as R
from .operators.compiler import Context, compile, context
from .operators.frame import Frame
from .parser import parse_query, parse_update
from .sources.quads import SCHEMA, QuadSource
from .terms import RDF, Blank, Triple, Var, encode


@dataclass
class Result:
    """What a query gives; ``df`` is lazy."""

    form: str
    df: DataFrame
    variables: list[str]
    frame: Frame | None = None

    def rows(self):
        """Solutions as dictionaries of terms."""
        from .terms import decode

        f = R.term_frame(self.frame)
        names = [n for n in self.variables if n in f.slots]
        for row in f.df.select(*[F.col(f.slots[n].column).alias(n) for n in names]).toLocalIterator():
            yield {n: decode(row[n]) for n in names if row[n] is not None}

    @property
    def boolean(self) -> bool:
        return bool(self.df.first()[0])


class Dataset:
    """RDF data behind one scan interface: quads, mapped tables, or both.

    A dataset does not change; ``update`` and ``materialise`` return another.
    """

    def __init__(self, spark: SparkSession, source, functions: dict[str, Callable] | None = None, aggregates: dict | None = None, relations: dict | None = None, service: Callable | None = None, resolver: Callable | None = None, extensions: str = "", standpoint: tuple[str, str] | None = None):
        self.spark, self.source = spark, source
        self.functions, self.aggregates, self.relations = functions or {}, aggregates or {}, relations or {}
        self.service, self.resolver = service, resolver
        #: the namespace of list functions and heldIn, and the predicates of standpoints
        self.extensions, self.standpoint = extensions, standpoint

    @classmethod
    def of_quads(cls, quads: DataFrame, **more) -> Dataset:
        return cls(quads.sparkSession, QuadSource(quads), **more)

    @classmethod
    def of_terms(cls, spark: SparkSession, quads, **more) -> Dataset:
        """From Python (s, p, o[, g]) terms."""
        rows = [(*map(encode, q[:3]), encode(q[3]) if len(q) > 3 and q[3] is not None else None) for q in quads]
        return cls.of_quads(spark.createDataFrame(rows, SCHEMA).distinct(), **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str, media: str | None = None, **more) -> Dataset:
        from .sources import readers

        return cls.of_quads(readers.read(spark, path, media), **more)

    def stored(self) -> Dataset:
        """The same dataset, written by predicate and measured, so that constant predicates prune files and joins begin with the smallest."""
        from .storage import by_predicate

        out = self.with_quads(by_predicate(self.quads))
        out.source.measure()
        return out

    def with_quads(self, quads: DataFrame) -> Dataset:
        return Dataset(self.spark, QuadSource(quads), self.functions, self.aggregates, self.relations, self.service, self.resolver, self.extensions, self.standpoint)

    @property
    def quads(self) -> DataFrame:
        return self.source.all_quads()

    def context(self, **more) -> Context:
        return context(self.spark, self.source, functions=self.functions, custom_aggregates=self.aggregates, relations=self.relations, service=self.service, extensions=self.extensions, standpoint=self.standpoint, **more)

    def prepare(self, text: str, base: str = "") -> A.Query:
        return parse_query(text, base, frozenset(self.relations))

    def query(self, text: str | A.Query, base: str = "", bindings: dict[str, object] | None = None, now: dt.datetime | None = None, limit: int | None = None) -> Result:
        """Evaluates a query.  ``bindings`` fix variables before it runs; ``limit`` caps the answers."""
        q = self.prepare(text, base) if isinstance(text, str) else text
        if q.version == "1.2-basic":
            refuse_triple_terms(q)
        ctx = self.context(base=base, now=now)
        if q.has_dataset:
            ctx = replace(ctx, default=q.default, named=q.named)
        pattern = q.pattern
        if bindings:
            pattern = prebind(pattern, bindings)
        f = compile(pattern, ctx)
        if limit is not None:
            f = replace(f, df=f.df.limit(limit))
        if q.form == "SELECT":
            names = [v.name for v in q.variables]
            return Result("SELECT", R.native(f, names), names, f)
        if q.form == "ASK":
            # at most one row is made; the answer is a row either way
            df = f.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
            return Result("ASK", df, ["answer"])
        if q.form == "CONSTRUCT":
            return Result("CONSTRUCT", instantiate(f, q.template).select("s", "p", "o"), ["s", "p", "o"])
        return Result("DESCRIBE", self._describe(f, q.terms, ctx), ["s", "p", "o"])

    def _describe(self, f: Frame, terms: tuple, ctx: Context) -> DataFrame:
        """Symmetric concise bounded description: triples in and out of each resource, onwards through blank nodes."""
        seeds = [self.spark.createDataFrame([(encode(t),)], "n string") for t in terms if not isinstance(t, Var)]
        seeds += [f.df.select(code(f.val(t.name)).alias("n")) for t in terms if isinstance(t, Var) and t.name in f.slots]
        triples, _ = QuadSource(self.quads).active(ctx)
        plain = ctx.graph is None and ctx.default is None and ctx.named is None
        touching = getattr(self.source, "touching", None) if plain else None
        from .storage import materialise

        frontier = materialise(reduce(DataFrame.union, seeds).where("n IS NOT NULL").distinct())
        seen, found = frontier, None
        blank = lambda c: is_kind(Val("term", F.col(c)), "B")
        while not frontier.isEmpty():
            if touching is not None:
                out = touching(frontier)
            else:
                out = triples.join(frontier.withColumnRenamed("n", "s"), "s", "left_semi").union(triples.join(frontier.withColumnRenamed("n", "o"), "o", "left_semi").select("s", "p", "o"))
            # statements about a described resource are part of it
            out = materialise(out.distinct())
            found = out if found is None else found.union(out)
            near = out.where(blank("o")).select(F.col("o").alias("n")).union(out.where(blank("s")).select(F.col("s").alias("n")))
            near = near.union(out.where(F.col("p") == "I" + RDF + "reifies").select(F.col("s").alias("n")))
            frontier = materialise(near.distinct().join(seen, "n", "left_anti"))
            seen = seen.union(frontier)
        return found.distinct() if found is not None else triples.limit(0)

    def match(self, s: object = None, p: object = None, o: object = None, g: object = None) -> DataFrame:
        """The quads that agree with the terms given."""
        q = self.quads
        for c, t in (("s", s), ("p", p), ("o", o), ("g", g)):
            if t is not None:
                q = q.where(F.col(c) == encode(t))
        return q

    def update(self, text: str, base: str = "") -> Dataset:
        from .operators import update

        return update.run(self, parse_update(text, base, frozenset(self.relations)))

    def materialise(self, regime: str = "RDFS", rules=None) -> Dataset:
        from .operators import rules as engine

        stored = getattr(self.source, "counts", None) is not None
        return self.with_quads(engine.materialise(self.quads, regime, rules, stored))

    def consistency(self, regime: str = "OWL-RL") -> DataFrame:
        """The clashes of the closure; empty if it is consistent."""
        from .operators import rules as engine

        return engine.clashes(engine.materialise(self.quads, regime, None))

    def entails(self, pattern: str, regime: str = "RDFS") -> bool:
        """Whether the closure has an instance of a graph given as a SPARQL group, blank nodes as variables."""
        return self.materialise(regime).query("ASK " + pattern).boolean

    def validate(self, shapes) -> DataFrame:
        from .operators import shapes as engine

        return engine.validate(self, shapes)

    def write(self, path: str, media: str = "nquads") -> None:
        from .sources import writers

        writers.write(self.quads, path, media)

    def explain(self, text: str) -> str:
        df = self.query(text).df
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def prebind(p: A.Pattern, bindings: dict[str, object]) -> A.Pattern:
    """A VALUES row joined beneath the solution modifiers."""
    match p:
        case A.Project(inner, vs):
            return A.Project(prebind(inner, bindings), vs)
        case A.Slice(inner, s, n):
            return A.Slice(prebind(inner, bindings), s, n)
        case A.Distinct(inner):
            return A.Distinct(prebind(inner, bindings))
        case A.Reduced(inner):
            return A.Reduced(prebind(inner, bindings))
        case A.OrderBy(inner, keys):
            return A.OrderBy(prebind(inner, bindings), keys)
        case A.Extend(inner, v, e):
            return A.Extend(prebind(inner, bindings), v, e)
        case A.Group(inner, keys, aggs):
            return A.Group(prebind(inner, bindings), keys, aggs)
        case A.Filter(c, inner):
            return A.Filter(c, prebind(inner, bindings))
    row = A.Values(tuple(map(Var, bindings)), (tuple(bindings.values()),))
    return A.Join(p, row) if p != A.BGP(()) else row


def refuse_triple_terms(q: A.Query) -> None:
    """The basic profile has no triple terms."""

    def has(x: object) -> bool:
        if isinstance(x, Triple) or (isinstance(x, A.Call) and x.name in ("TRIPLE", "SUBJECT", "PREDICATE", "OBJECT", "ISTRIPLE")):
            return True
        if isinstance(x, tuple):
            return any(map(has, x))
        return hasattr(x, "__dataclass_fields__") and any(has(getattr(x, k)) for k in x.__dataclass_fields__)

    if has(q.pattern) or has(q.template):
        raise ValueError("triple terms are not part of version 1.2-basic")


def instantiate(f: Frame, template: tuple) -> DataFrame:
    """The quads (s, p, o, g) of a template: one scan of the solutions, ill-formed and partial ones left out, as a set.

    A blank node of the template is fresh in every solution.  Solutions are
    fixed before blanks are made, as a row's number must not change.
    """
    from .storage import materialise

    blanks = any(_has_blank(t) for (t, _) in template)
    df = f.df
    row = R.fresh("row")
    if blanks:
        df = materialise(df.withColumn(row, F.concat(F.hex(F.monotonically_increasing_id()), F.lit("r"))))
    g = replace(f, df=df)

    def term(t: object):
        if isinstance(t, Var):
            return code(g.val(t.name)) if t.name in g.slots else F.lit(None).cast("string")
        if isinstance(t, Blank):
            return F.concat(F.lit(f"Bc{t.label}_"), F.col(row))
        if isinstance(t, Triple):
            from .functions.values import triple_code

            return triple_code(term(t.s), term(t.p), term(t.o))
        return F.lit(encode(t))

    made = [F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), (term(gr) if gr is not None else F.lit(None).cast("string")).alias("g"), F.lit(gr is not None).alias("named")) for (s, p, o), gr in template]
    if not made:
        return f.df.sparkSession.createDataFrame([], SCHEMA)
    out = df.select(F.explode(F.array(*made)).alias("q")).select("q.*")
    kind = lambda c: F.substr(F.col(c), F.lit(1), F.lit(1))
    ok = kind("s").isin("I", "B") & (kind("p") == "I") & F.col("o").isNotNull() & (~F.col("named") | (kind("g") == "I"))
    return out.where(ok).select("s", "p", "o", "g").distinct()


def _has_blank(x: object) -> bool:
    return isinstance(x, Blank) or (isinstance(x, tuple) and any(map(_has_blank, x))) or (isinstance(x, Triple) and any(map(_has_blank, (x.s, x.p, x.o))))


