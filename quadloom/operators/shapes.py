"""SHACL validation: shapes are read once, every constraint becomes a table of violations.

A violation is (focus, path, value, component, shape, severity, message).  Focus
nodes and value nodes are tables, so a constraint is a filter, an anti-join or
a grouped count over all focus nodes at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import algebra as A
from ..functions import builtins as B
from ..functions.values import Val, constant, datatype, is_kind, language, lexical, text_of, well_formed
from ..sources.quads import QuadSource
from ..storage import materialise
from ..terms import RDF, RDFS, Literal, Var, decode, encode, short
from . import frame as R
from . import paths

SH = "http://www.w3.org/ns/shacl#"
TYPE = "I" + RDF + "type"
COLUMNS = "focus string, path string, value string, component string, shape string, severity string, message string"


@dataclass
class Shape:
    """A shape: its path (None for a node shape), targets, and parameters by the local name of their predicate."""

    name: str
    path: object = None
    path_text: str | None = None
    parameters: dict[str, list[str]] = field(default_factory=dict)
    off: bool = False
    severity: str = "Violation"
    message: str | None = None


class Shapes:
    """A shapes graph in memory: it is small, and read by its terms."""

    def __init__(self, quads: DataFrame):
        self.by: dict[str, dict[str, list[str]]] = {}
        for s, p, o in quads.select("s", "p", "o").distinct().toLocalIterator():
            self.by.setdefault(s, {}).setdefault(p, []).append(o)
        self.shapes: dict[str, Shape] = {}
        constraints = {"I" + SH + x for x in ("path", "property", "node", "and", "or", "xone", "not", "datatype", "class", "nodeKind", "minCount", "maxCount", "in", "hasValue", "pattern", "closed", "sparql", "targetClass", "targetNode", "targetSubjectsOf", "targetObjectsOf", "target", "rule")}
        for s, props in self.by.items():
            kinds = props.get(TYPE, [])
            if "I" + SH + "NodeShape" in kinds or "I" + SH + "PropertyShape" in kinds or constraints & props.keys():
                self.shapes[s] = self.read(s)

    def one(self, s: str, name: str) -> str | None:
        return next(iter(self.by.get(s, {}).get(name if name.startswith("I") else "I" + SH + name, [])), None)

    def list(self, head: str) -> list[str]:
        out, seen = [], set()
        while head and head != "I" + RDF + "nil" and head not in seen:
            seen.add(head)
            out.append(self.one(head, "I" + RDF + "first"))
            head = self.one(head, "I" + RDF + "rest")
        return out

    def path(self, node: str) -> object:
        if node[0] == "I":
            return A.Link(node[1:])
        for name, make in (("inversePath", A.Inverse), ("zeroOrMorePath", lambda p: A.Repeat(p, 0, None)), ("oneOrMorePath", lambda p: A.Repeat(p, 1, None)), ("zeroOrOnePath", lambda p: A.Repeat(p, 0, 1))):
            if (x := self.one(node, name)) is not None:
                return make(self.path(x))
        if (x := self.one(node, "alternativePath")) is not None:
            return reduce(A.Alt, map(self.path, self.list(x)))
        return reduce(A.Seq, map(self.path, self.list(node)))

    def read(self, s: str) -> Shape:
        props = {p[1 + len(SH) :]: v for p, v in self.by[s].items() if p.startswith("I" + SH)}
        path = self.one(s, "path")
        severity = self.one(s, "severity")
        message = self.one(s, "message")
        return Shape(
            s, self.path(path) if path else None, path, props, self.one(s, "deactivated") in (encode(Literal("true", "http://www.w3.org/2001/XMLSchema#boolean")),),
            severity[1 + len(SH) :] if severity else "Violation", decode(message).lex if message else None,
        )


class Validator:
    def __init__(self, dataset, shapes: Shapes):
        self.data = dataset.quads.where(F.col("g").isNull()).select("s", "p", "o")
        self.ctx = dataset.context()
        self.ctx.source = QuadSource(self.data.withColumn("g", F.lit(None).cast("string")))
        self.shapes, self.spark, self.dataset = shapes, dataset.spark, dataset
        self.within: list[str] = []
        sub = self.data.where(F.col("p") == "I" + RDFS + "subClassOf").select(F.col("s").alias("c"), F.col("o").alias("d"))
        self.above = None if sub.isEmpty() else self._closed(sub)

    def _closed(self, sub: DataFrame) -> DataFrame:
        every = delta = materialise(sub.distinct())
        parts = [every]
        while True:
            delta = materialise(delta.join(sub.select(F.col("c").alias("d"), F.col("d").alias("e")), "d").select("c", F.col("e").alias("d")).distinct().join(every, ["c", "d"], "left_anti"))
            if delta.isEmpty():
                return every
            parts.append(delta)
            every = reduce(DataFrame.union, parts)

    # tables
    def instances(self, cls: str) -> DataFrame:
        """Members of a class or of its subclasses."""
        types = self.data.where(F.col("p") == TYPE).select(F.col("s").alias("focus"), F.col("o").alias("c"))
        direct = types.where(F.col("c") == cls).select("focus")
        if self.above is None:
            return direct.distinct()
        return direct.union(types.join(self.above.where(F.col("d") == cls).select("c"), "c").select("focus")).distinct()

    def targets(self, s: Shape) -> DataFrame | None:
        parts = []
        p = s.parameters
        nodes = p.get("targetNode", [])
        if nodes:
            parts.append(self.spark.createDataFrame([(n,) for n in nodes], "focus string"))
        classes = list(p.get("targetClass", []))
        if {"I" + RDFS + "Class", "Ihttp://www.w3.org/2002/07/owl#Class"} & set(self.shapes.by[s.name].get(TYPE, [])):
            classes.append(s.name)  # a shape that is a class targets its instances
        parts += [self.instances(c) for c in classes]
        parts += [self.data.where(F.col("p") == x).select(F.col("s").alias("focus")) for x in p.get("targetSubjectsOf", [])]
        parts += [self.data.where(F.col("p") == x).select(F.col("o").alias("focus")) for x in p.get("targetObjectsOf", [])]
        for t in p.get("target", []):
            if (q := self.shapes.one(t, "select")) is not None:
                f = self._select(t, q)
                parts.append(f.df.select(f.slots["this"].column).toDF("focus"))
        return reduce(DataFrame.union, parts).where("focus IS NOT NULL").distinct() if parts else None

    def values(self, s: Shape, focus: DataFrame) -> DataFrame:
        """(focus, value): the value nodes; for a node shape the focus itself."""
        if s.path is None:
            return focus.select("focus", F.col("focus").alias("value"))
        f = paths.pairs(s.path, self.ctx)
        f = paths._coded(f, [paths.S, paths.O])
        pairs = f.df.select(F.col(f.slots[paths.S].column).alias("focus"), F.col(f.slots[paths.O].column).alias("value")).distinct()
        return pairs.join(focus, "focus", "left_semi")

    def _select(self, node: str, q: str):
        from .compiler import compile as compile_pattern

        query = self.dataset.prepare(self.prefixes(node) + decode(q).lex)
        return compile_pattern(query.pattern, self.ctx)

    def prefixes(self, node: str) -> str:
        out = ""
        for p in self.shapes.by.get(node, {}).get("I" + SH + "prefixes", []):
            for d in self.shapes.by.get(p, {}).get("I" + SH + "declare", []):
                out += f"PREFIX {decode(self.shapes.one(d, 'prefix')).lex}: <{decode(self.shapes.one(d, 'namespace')).lex}> "
        return out

    def construct(self, node: str, q: str, focus: DataFrame) -> DataFrame:
        """The quads of a CONSTRUCT rule, with ?this bound to each focus node."""
        from ..dataset import instantiate
        from .compiler import compile as compile_pattern

        query = self.dataset.prepare(self.prefixes(node) + decode(q).lex)
        this = R.build(focus, {"this": Val("term", F.col("focus"))})
        given = A.Given((Var("this"),), this)
        pattern = A.Join(query.pattern, given) if query.pattern != A.BGP(()) else given
        return instantiate(compile_pattern(_given_within(pattern, given), self.ctx), query.template)

    # violations
    def report(self, s: Shape, found: DataFrame, component: str) -> DataFrame:
        return found.select("focus", F.lit(s.path_text).cast("string").alias("path"), "value", F.lit(component).alias("component"), F.lit(s.name).alias("shape"), F.lit(s.severity).alias("severity"), F.lit(s.message).cast("string").alias("message"))

    def check(self, s: Shape, focus: DataFrame) -> list[DataFrame]:
        """Violations of the focus nodes, by constraint component."""
        if s.off:
            return []
        p, out = s.parameters, []
        values = self.values(s, focus)
        v = Val("term", F.col("value"))
        number = lambda x: int(decode(x).lex)
        none = F.lit(None).cast("string").alias("value")

        def bad(cond: Column, component: str) -> None:
            out.append(self.report(s, values.where(F.coalesce(cond, F.lit(True))), component))

        for x in p.get("minCount", []):
            counts = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left")
            out.append(self.report(s, counts.where(F.coalesce("n", F.lit(0)) < number(x)).select("focus", none), "MinCount"))
        for x in p.get("maxCount", []):
            out.append(self.report(s, values.groupBy("focus").agg(F.count("*").alias("n")).where(F.col("n") > number(x)).select("focus", none), "MaxCount"))
        for x in p.get("datatype", []):
            d = decode(x).value
            bad((datatype(v) != short(d)) | ~well_formed(v, d), "Datatype")
        for x in p.get("class", []):
            out.append(self.report(s, values.join(self.instances(x).withColumnRenamed("focus", "value"), "value", "left_anti").select("focus", "value"), "Class"))
        for x in p.get("nodeKind", []):
            kind = x[1 + len(SH) :]
            letters = [letter for name, letter in (("IRI", "I"), ("BlankNode", "B"), ("Literal", "L")) if name in kind]
            bad(~F.substr("value", F.lit(1), F.lit(1)).isin(letters), "NodeKind")
        for x in p.get("in", []):
            bad(~F.col("value").isin(self.shapes.list(x)), "In")
        for x in p.get("hasValue", []):
            out.append(self.report(s, focus.join(values.where(F.col("value") == x).select("focus"), "focus", "left_anti").select("focus", none), "HasValue"))
        flags = p.get("flags", [None])[0]
        for x in p.get("pattern", []):
            flag = f"(?{decode(flags).lex})" if flags else ""
            bad(is_kind(v, "B") | ~F.rlike(text_of(v), F.lit(flag + decode(x).lex)), "Pattern")
        for x in p.get("minLength", []):
            bad(is_kind(v, "B") | (F.length(text_of(v)) < number(x)), "MinLength")
        for x in p.get("maxLength", []):
            bad(is_kind(v, "B") | (F.length(text_of(v)) > number(x)), "MaxLength")
        for name, op in (("minInclusive", ">="), ("minExclusive", ">"), ("maxInclusive", "<="), ("maxExclusive", "<")):
            for x in p.get(name, []):
                bad(~F.coalesce(B.less(v, constant(decode(x)), op), F.lit(False)), name[0].upper() + name[1:])
        for x in p.get("languageIn", []):
            tags = [decode(t).lex.lower() for t in self.shapes.list(x)]
            lang = F.regexp_replace(language(v), "--.*", "")
            fits = reduce(lambda a, b: a | b, [(lang == t) | lang.startswith(t + "-") for t in tags], F.lit(False))
            bad(~F.coalesce(fits, F.lit(False)), "LanguageIn")
        if any(decode(x).lex in ("true", "1") for x in p.get("uniqueLang", [])):
            twice = values.select("focus", language(v).alias("lang")).where("lang <> ''").groupBy("focus", "lang").agg(F.count("*").alias("n")).where("n > 1")
            out.append(self.report(s, twice.select("focus", none), "UniqueLang"))
        for name in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            for x in p.get(name, []):
                other = self.data.where(F.col("p") == x).select(F.col("s").alias("focus"), F.col("o").alias("other")).join(focus, "focus", "left_semi")
                if name == "equals":
                    o = other.withColumnRenamed("other", "value")
                    out.append(self.report(s, values.join(o, ["focus", "value"], "left_anti").union(o.join(values, ["focus", "value"], "left_anti")), "Equals"))
                elif name == "disjoint":
                    out.append(self.report(s, values.join(other.withColumnRenamed("other", "value"), ["focus", "value"], "left_semi"), "Disjoint"))
                else:
                    both = values.join(other, "focus")
                    fits = B.less(v, Val("term", F.col("other")), "<" if name == "lessThan" else "<=")
                    out.append(self.report(s, both.where(~F.coalesce(fits, F.lit(False))).select("focus", "value"), name[0].upper() + name[1:]))
        for x in p.get("node", []):
            out.append(self.report(s, values.join(self.failing(x, values), "value", "left_semi").select("focus", "value"), "Node"))
        for x in p.get("property", []):
            # results of a property shape are its own
            inner = self.shapes.shapes[x]
            nodes = values.select(F.col("value").alias("focus")).distinct()
            out += self.check(inner, nodes)
        for x in p.get("not", []):
            out.append(self.report(s, values.join(self.failing(x, values), "value", "left_anti").select("focus", "value"), "Not"))
        for name in ("and", "or", "xone"):
            for x in p.get(name, []):
                members = self.shapes.list(x)
                counted = reduce(DataFrame.union, [self.failing(m, values).select("value", F.lit(1).alias("f")) for m in members]).groupBy("value").agg(F.sum("f").alias("f"))
                held = values.join(counted, "value", "left").withColumn("ok", len(members) - F.coalesce("f", F.lit(0)))
                wrong = {"and": F.col("ok") < len(members), "or": F.col("ok") == 0, "xone": F.col("ok") != 1}[name]
                out.append(self.report(s, held.where(wrong).select("focus", "value"), name.capitalize()))
        for x in p.get("qualifiedValueShape", []):
            fails = self.failing(x, values)
            good = values.join(fails, "value", "left_anti")
            if any(decode(d).lex == "true" for d in p.get("qualifiedValueShapesDisjoint", [])):
                for parent in self.shapes.shapes.values():
                    if s.name in parent.parameters.get("property", []):
                        for sibling in parent.parameters["property"]:
                            for y in self.shapes.shapes[sibling].parameters.get("qualifiedValueShape", []):
                                if y != x:
                                    good = good.join(self.failing(y, good), "value", "left_semi")
            counts = focus.join(good.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            for y in p.get("qualifiedMinCount", []):
                out.append(self.report(s, counts.where(F.col("n") < number(y)).select("focus", none), "QualifiedMinCount"))
            for y in p.get("qualifiedMaxCount", []):
                out.append(self.report(s, counts.where(F.col("n") > number(y)).select("focus", none), "QualifiedMaxCount"))
        if any(decode(x).lex == "true" for x in p.get("closed", [])):
            allowed = [self.shapes.shapes[x].path_text for x in p.get("property", [])] + [y for x in p.get("ignoredProperties", []) for y in self.shapes.list(x)]
            extra = self.data.join(values.select("focus", F.col("value").alias("s")), "s").where(~F.col("p").isin([a for a in allowed if a] or [""]))
            found = extra.select("focus", F.col("o").alias("value"), "p")
            out.append(self.report(s, found, "Closed").drop("path").join(found, ["focus", "value"]).select("focus", F.col("p").alias("path"), "value", "component", "shape", "severity", "message"))
        for x in p.get("sparql", []):
            out.append(self.sparql(s, x, focus))
        return out

    def failing(self, name: str, values: DataFrame) -> DataFrame:
        """The value nodes that do not conform to a shape, as ``value``; ValueError for a shape that refers to itself, which the standard leaves open."""
        if name in self.within:
            raise ValueError(f"recursive shape {name}")
        self.within.append(name)
        try:
            return self._failing(name, values)
        finally:
            self.within.pop()

    def _failing(self, name: str, values: DataFrame) -> DataFrame:
        nodes = values.select(F.col("value").alias("focus")).distinct()
        found = self.check(self.shapes.shapes.get(name) or self.shapes.read(name), nodes)
        if not found:
            return self.spark.createDataFrame([], "value string")
        return reduce(DataFrame.unionByName, found).select(F.col("focus").alias("value")).distinct()

    def sparql(self, s: Shape, node: str, focus: DataFrame) -> DataFrame:
        """A SELECT constraint: $this is a column, joined with all focus nodes at once."""
        f = self._select(node, self.shapes.one(node, "select"))
        this = f.slots["this"].column
        value = F.col(f.slots["value"].column) if "value" in f.slots else F.col(this)
        df = f.df.select(F.col(this).alias("focus"), value.alias("value")).join(focus, "focus", "left_semi")
        return self.report(s, df, "SPARQL")


def _given_within(p: A.Pattern, given: A.Given) -> A.Pattern:
    """A pattern joined with known solutions, which its filters and assignments see too."""
    inner = p.left if isinstance(p, A.Join) and p.right is given else None
    steps = []
    while isinstance(inner, A.Filter | A.Extend):
        steps.append(inner)
        inner = inner.inner
    if not steps:
        return p
    out = A.Join(inner, given) if inner != A.BGP(()) else given
    for x in reversed(steps):
        out = A.Filter(x.condition, out) if isinstance(x, A.Filter) else A.Extend(out, x.var, x.expr)
    return out


def validate(dataset, shapes) -> DataFrame:
    """The violations of a dataset; ``shapes`` is a dataset or quads that hold the shapes."""
    quads = shapes if isinstance(shapes, DataFrame) else shapes.quads
    read = Shapes(quads)
    v = Validator(dataset, read)
    out = []
    for s in read.shapes.values():
        focus = v.targets(s)
        if focus is not None:
            out += v.check(s, materialise(focus))
    return reduce(DataFrame.unionByName, out) if out else dataset.spark.createDataFrame([], COLUMNS)


def rules(dataset, shapes) -> DataFrame:
    """The quads that sh:rule adds: triple rules and SPARQL rules, in the order of sh:order, to a fixpoint."""
    from ..dataset import Dataset
    from .rules import missing

    read = Shapes(shapes if isinstance(shapes, DataFrame) else shapes.quads)
    todo = []
    for s in read.shapes.values():
        for r in s.parameters.get("rule", []):
            order = read.one(r, "order")
            if read.one(r, "deactivated") == encode(Literal("true", "http://www.w3.org/2001/XMLSchema#boolean")):
                continue
            todo.append((float(decode(order).lex) if order else 0.0, s, r))
    todo.sort(key=lambda x: (x[0], x[2]))
    # what is there is made a set where a rule reads it, and only what rules add is compared and written
    base = dataset.quads if getattr(dataset.source, "counts", None) is not None else materialise(dataset.quads)
    parts = [base.distinct()]
    while True:
        added = False
        for _, s, r in todo:
            quads = reduce(DataFrame.unionByName, parts)
            current = Dataset.of_quads(quads)
            v = Validator(current, read)
            focus = v.targets(s)
            if focus is None:
                continue
            for x in read.by.get(r, {}).get("I" + SH + "condition", []):
                focus = focus.join(v.failing(x, focus.select(F.col("focus").alias("value"))).withColumnRenamed("value", "focus"), "focus", "left_anti")
            focus = materialise(focus)
            if (q := read.one(r, "construct")) is not None:
                made = v.construct(r, q, focus)
            else:
                side = {}
                for name in ("subject", "predicate", "object"):
                    x = read.one(r, name)
                    inner = read.one(x, "path") if x[0] == "B" else None
                    if x == "I" + SH + "this":
                        side[name] = focus.select("focus", F.col("focus").alias(name))
                    elif inner:
                        side[name] = v.values(Shape(x, read.path(inner), inner), focus).withColumnRenamed("value", name)
                    else:
                        side[name] = focus.select("focus", F.lit(x).alias(name))
                made = side["subject"].join(side["predicate"], "focus").join(side["object"], "focus").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.lit(None).cast("string").alias("g"))
            new, counts = missing(made.select("s", "p", "o", "g"), quads)
            if counts != {}:
                added = True
                parts.append(new)
        if not added:
            return reduce(DataFrame.unionByName, parts)

