"""Tables as a virtual RDF dataset: nothing is converted, patterns read the tables.

A class is a table; its instances' IRIs are a prefix and the row's key, a
predicate is a column, a foreign key an object property.  All patterns with one
subject become one projection of its table, so a star needs no join, and a
foreign key joins on the native key column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Val, code, constant
from ..functions.builtins import same_term
from ..operators import frame as R
from ..operators.frame import Frame
from ..operators.paths import G, O, S
from ..terms import IRI, RDF, Var

TYPE = RDF + "type"


@dataclass(frozen=True)
class Property:
    """A column as a predicate: its kind, and for ``ref`` the prefix of the other class's IRIs."""

    expr: str
    kind: str
    prefix: str = ""
    lang: str = ""


@dataclass(frozen=True)
class TableMap:
    table: str
    cls: str
    prefix: str
    key: str  # SQL over the columns; unique to a row
    properties: dict[str, Property] = field(default_factory=dict)
    graph: tuple[str, str] | None = None  # (prefix, SQL) of the graph that a row is in


class RelationalSource:
    """Scans of mapped tables.  ``read`` gives a table by name.

    Rows with a mapped graph are in that named graph and, as no graph is told
    apart there, in the default graph as well.
    """

    def __init__(self, spark: SparkSession, maps: list[TableMap], read: Callable[[str], DataFrame]):
        self.spark, self.maps, self.read = spark, maps, read
        self.by_property = {p: m for m in maps for p in m.properties}
        self.by_class = {m.cls: m for m in maps}

    # one star
    def _value(self, p: Property) -> Val:
        lang = F.expr(p.lang) if p.lang else None
        return Val(p.kind, F.expr(p.expr), p.prefix, F.when(F.expr(p.expr).isNotNull(), F.coalesce(lang, F.lit(""))) if lang is not None else None)

    def _subject(self, m: TableMap) -> Val:
        return Val("ref", F.expr(m.key), m.prefix)

    def _star(self, m: TableMap, subject: object, pairs: list[tuple[object, object]], ctx) -> Frame:
        df = self.read(m.table)
        vals: dict[str, Val] = {}
        conditions: list[Column] = []

        def meet(t: object, v: Val) -> None:
            if isinstance(t, Var):
                if t.name in vals:
                    conditions.append(same_term(vals[t.name], v))
                else:
                    vals[t.name] = v
            elif isinstance(t, IRI) and v.kind == "ref":
                # a key is compared natively; another prefix has no such row
                if not t.value.startswith(v.prefix):
                    conditions.append(F.lit(False))
                else:
                    conditions.append(v.col == F.lit(t.value[len(v.prefix) :]))
            else:
                c = constant(t)
                conditions.append(v.col == c.col if v.kind == c.kind and v.kind != "lang" else same_term(v, c))

        if not isinstance(subject, Var) or subject.name:
            meet(subject, self._subject(m))
        for p, o in pairs:
            if p == TYPE:
                meet(o, Val("iri", F.lit(m.cls)))
                continue
            v = self._value(m.properties[p])
            conditions.append(v.col.isNotNull())
            meet(o, v)
        if isinstance(ctx.graph, Var) or ctx.graph is not None or ctx.default is not None:
            if m.graph is None:
                conditions.append(F.lit(False) if ctx.graph is not None or ctx.default is not None else F.lit(True))
                g = Val("iri", F.lit(""))
            else:
                g = Val("ref", F.expr(m.graph[1]), m.graph[0])
            if isinstance(ctx.graph, Var):
                meet(ctx.graph, g)
                if ctx.named is not None or ctx.default is not None:
                    conditions.append(self._within(g, ctx.named or ()))
            elif ctx.graph is not None:
                if ctx.named is not None and ctx.graph.value not in ctx.named:
                    conditions.append(F.lit(False))
                meet(ctx.graph, g)
            elif ctx.default is not None and m.graph is not None:
                conditions.append(self._within(g, ctx.default))
        if conditions:
            df = df.where(reduce(lambda a, b: a & b, conditions))
        return R.build(df, vals) if vals else Frame(df.select(F.lit(1).alias(R.fresh("unit"))), {})

    def _within(self, g: Val, names: tuple[str, ...]) -> Column:
        keys = [n[len(g.prefix) :] for n in names if n.startswith(g.prefix)]
        return g.col.isin(keys) if keys else F.lit(False)

    def scans(self, triples: list, ctx) -> list[tuple[float, Frame]]:
        """Stars of known predicates are one scan each; a variable or unknown predicate reads all that can match."""
        stars: dict[tuple[str, object], list] = {}
        other = []
        typed: dict[object, list] = {}
        for t in triples:
            if isinstance(t.p, IRI) and t.p.value in self.by_property:
                stars.setdefault((self.by_property[t.p.value].table, t.s), []).append((t.p.value, t.o))
            elif isinstance(t.p, IRI) and t.p.value == TYPE:
                typed.setdefault(t.s, []).append(t.o)
            else:
                other.append(t)
        for s, classes in typed.items():
            for c in classes:
                homes = [k for k in stars if k[1] == s]
                if isinstance(c, IRI) and c.value in self.by_class:
                    stars.setdefault((self.by_class[c.value].table, s), []).append((TYPE, c))
                elif isinstance(c, Var) and len(homes) == 1:
                    stars[homes[0]].append((TYPE, c))
                else:
                    other.append(_Triple(s, IRI(TYPE), c))
        tables = {m.table: m for m in self.maps}
        out = []
        for (table, s), pairs in stars.items():
            constants = sum(not isinstance(o, Var) for p, o in pairs if p != TYPE) + 3 * (not isinstance(s, Var))
            out.append((10.0 ** (6 - constants), self._star(tables[table], s, pairs, ctx)))
        for t in other:
            # a subject whose class is known is looked for in one table
            homes = {table for table, s in stars if s == t.s and isinstance(s, Var)}
            maps = [m for m in self.maps if not homes or m.table in homes]
            if isinstance(t.p, Var):
                parts = [self._any(m, t, ctx) for m in maps]
            else:
                parts = [self._star(m, t.s, [(t.p.value, t.o)], ctx) for m in maps if t.p.value == TYPE]
            if not parts:
                names = [x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)]
                parts = [R.build(self.spark.range(0), {n: Val("term", F.lit("")) for n in names})] if names else [Frame(self.spark.range(0), {})]
            out.append((1e8, reduce(R.union, parts)))
        return out

    def _any(self, m: TableMap, t, ctx, only: list[str] | None = None) -> Frame:
        """All predicates of a table, or only some, in one pass: its columns become rows."""
        df = self.read(m.table)
        if m.graph is None and (ctx.graph is not None or ctx.default is not None):
            df = df.where(F.lit(False))
        elif m.graph is not None and (ctx.graph is not None or ctx.default is not None):
            g = Val("ref", F.expr(m.graph[1]), m.graph[0])
            wanted = ctx.named if isinstance(ctx.graph, Var) else (ctx.graph.value,) if ctx.graph is not None else ctx.default
            df = df if wanted is None else df.where(self._within(g, wanted))
        pairs = [F.struct(F.lit(p).alias("p"), (F.lit("I" + m.cls) if p == TYPE else code(self._value(m.properties[p]))).alias("o")) for p in [TYPE, *m.properties] if only is None or p in only]
        graph = [F.expr(m.graph[1]).alias("g")] if m.graph is not None else []
        df = df.select(self._subject(m).col.alias("s"), F.explode(F.array(*pairs)).alias("x"), *graph).select("s", "x.p", "x.o", *(["g"] if graph else [])).where(F.col("o").isNotNull())
        vals: dict[str, Val] = {}
        places = [(t.s, Val("ref", F.col("s"), m.prefix)), (t.p, Val("iri", F.col("p"))), (t.o, Val("term", F.col("o")))]
        if isinstance(ctx.graph, Var) and graph:
            places.append((ctx.graph, Val("ref", F.col("g"), m.graph[0])))
        elif isinstance(ctx.graph, Var):
            places.append((ctx.graph, Val("iri", F.lit(""))))
        for x, v in places:
            if not isinstance(x, Var):
                df = df.where(same_term(v, constant(x)))
            elif x.name in vals:
                df = df.where(same_term(vals[x.name], v))
            else:
                vals[x.name] = v
        return R.build(df, vals)

    def edges(self, iris: list[str] | None, ctx, without: tuple[str, ...] = (), subject=None) -> Frame:
        """(start, end) of one step; ``subject`` is a slot whose kind tells which tables the starts that are needed may be in."""
        parts = []
        for m in self.maps:
            if subject is not None and subject.kind == "ref" and not m.prefix.startswith(subject.prefix) and not subject.prefix.startswith(m.prefix):
                continue
            steps = [p for p in [TYPE, *m.properties] if (iris is None or p in iris) and p not in without]
            if not steps:
                continue
            f = self._any(m, _Triple(Var(S), Var(".p"), Var(O)), ctx, steps) if len(steps) > 1 else self._star(m, Var(S), [(steps[0], Var(O))], ctx)
            if isinstance(ctx.graph, Var) and ctx.graph.name in f.slots:
                f.slots[G] = f.slots[ctx.graph.name]
            parts.append(R.project(f, [S, O] + [G] * (G in f.slots)))
        if not parts:
            return R.build(self.spark.range(0), {n: Val("term", F.lit("")) for n in (S, O, *([G] if isinstance(ctx.graph, Var) else []))})
        return reduce(R.union, parts)

    def nodes(self, ctx) -> Frame:
        e = R.term_frame(self.edges(None, ctx))
        g = [F.col(e.slots[G].column).alias("g")] if G in e.slots else []
        # one pass, both ends of a step
        df = e.df.select(F.explode(F.array(F.col(e.slots[S].column), F.col(e.slots[O].column))).alias("n"), *g).distinct()
        vals = {".n": Val("term", F.col("n"))}
        if g:
            vals[G] = Val("term", F.col("g"))
        return R.build(df, vals)

    def graph_names(self, name: str, ctx) -> Frame:
        parts = [R.build(self.read(m.table).select(F.expr(m.graph[1]).alias("g")).distinct(), {name: Val("ref", F.col("g"), m.graph[0])}) for m in self.maps if m.graph]
        f = reduce(R.union, parts) if parts else R.build(self.spark.range(0), {name: Val("term", F.lit(""))})
        if ctx.named is not None:
            from ..functions.values import text_of

            f = Frame(f.df.where(text_of(f.val(name)).isin(list(ctx.named)) if ctx.named else F.lit(False)), f.slots)
        return f

    def touching(self, nodes: DataFrame) -> DataFrame:
        """The default graph's triples (s, p, o) in and out of nodes(n): a table is read only if its keys, or what its columns hold, may be among these."""
        kinds = [(m.table, F.col("n").startswith("I" + m.prefix)) for m in self.maps]
        kinds += [("class " + m.cls, F.col("n") == "I" + m.cls) for m in self.maps]
        kinds += [("to " + x, F.col("n").startswith("I" + x)) for x in {p.prefix for m in self.maps for p in m.properties.values() if p.kind == "ref"}]
        other = ("other", ~F.col("n").startswith("I") & ~F.col("n").startswith("B"))
        row = nodes.agg(*[F.max(c.cast("int")).alias(f"k{i}") for i, (_, c) in enumerate([*kinds, other])]).first()
        have = {name for i, (name, _) in enumerate([*kinds, other]) if row[i]}
        parts = []
        for m in (m for m in self.maps if m.graph is None):
            df = self.read(m.table)
            values = {"I" + TYPE: F.lit("I" + m.cls)} | {"I" + p: code(self._value(x)) for p, x in m.properties.items()}
            key = code(self._subject(m)).alias("s")

            def rows(df: DataFrame, some: dict[str, Column], key=key) -> DataFrame:
                pairs = [F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in some.items()]
                return df.select(key, F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o").where(F.col("o").isNotNull())

            if m.table in have:
                parts.append(rows(df.join(nodes, code(self._subject(m)) == F.col("n"), "left_semi"), values))
            # a reference meets nodes of its prefix, and anything else but the class the literals
            near = {p: values["I" + p] for p, x in m.properties.items() if (x.kind == "ref" and "to " + x.prefix in have) or (x.kind not in ("ref", "iri", "term") and "other" in have) or x.kind in ("iri", "term")}
            some = {"I" + p: o for p, o in near.items()} | ({"I" + TYPE: values["I" + TYPE]} if "class " + m.cls in have else {})
            if some:
                parts.append(rows(df, some).join(nodes.withColumnRenamed("n", "o"), "o", "left_semi").select("s", "p", "o"))
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")

    def all_quads(self) -> DataFrame:
        """Everything as quads of codes."""
        parts = []
        for m in self.maps:
            df = self.read(m.table)
            s = code(self._subject(m))
            g = code(Val("ref", F.expr(m.graph[1]), m.graph[0])) if m.graph else F.lit(None).cast("string")
            pairs = [F.struct(F.lit("I" + TYPE).alias("p"), F.lit("I" + m.cls).alias("o"))]
            pairs += [F.struct(F.lit("I" + p).alias("p"), code(self._value(x)).alias("o")) for p, x in m.properties.items()]
            # one pass over the table, however many columns
            parts.append(df.select(s.alias("s"), F.explode(F.array(*pairs)).alias("x"), g.alias("g")).select("s", "x.p", "x.o", "g").where(F.col("o").isNotNull()))
        return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class _Triple:
    s: object
    p: object
    o: object
