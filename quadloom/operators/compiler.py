"""Algebra to lazy DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, SparkSession, Window
from pyspark.sql import functions as F

from .. import algebra as A
from ..functions import builtins as B
from ..functions.values import Val, as_double, boolean, code, constant, is_kind, null, text_of, tier, truth
from ..governor import Stopped
from ..storage import materialise
from ..terms import IRI, RS, Blank, Triple, Var, encode
from . import aggregates, paths
from . import frame as R
from .frame import Frame


@dataclass
class Context:
    """What a query needs besides its algebra."""

    spark: SparkSession
    source: object
    functions: dict[str, Callable[..., Val]]
    custom_aggregates: dict[str, object] = field(default_factory=dict)
    relations: dict[str, object] = field(default_factory=dict)
    service: Callable | None = None
    graph: object = None  # None: the default graph; an IRI; a Var
    default: tuple[str, ...] | None = None  # FROM
    named: tuple[str, ...] | None = None  # FROM NAMED
    extensions: str = ""  # the namespace of the list functions and heldIn
    standpoint: tuple[str, str] | None = None  # predicates: according to whom, and which standpoint sharpens which


def context(spark: SparkSession, source: object, base: str = "", now: dt.datetime | None = None, **more) -> Context:
    table = B.build(now or dt.datetime.now(dt.UTC).replace(tzinfo=None), base)
    table |= more.pop("functions", None) or {}
    return Context(spark, source, table, **more)


# expressions
def free(e: object) -> set[str]:
    """The variables that an expression mentions."""
    match e:
        case Var(n):
            return {n}
        case A.Call(_, args):
            return set().union(*map(free, args)) if args else set()
        case A.Exists(p):
            return {v.name for v in A.variables(p)}
        case Triple(s, p, o):
            return free(s) | free(p) | free(o)
    return set()


def expression(e: object, scope: dict[str, Val], ctx: Context, flags: dict[int, Val] | None = None) -> Val:
    """An expression over values in scope; a variable out of scope is unbound."""
    go = lambda x: expression(x, scope, ctx, flags)
    match e:
        case Var(n):
            return scope.get(n) or null()
        case A.Call("BOUND", (Var(n),)):
            return boolean(scope[n].col.isNotNull() if n in scope else F.lit(False))
        case A.Call("IN", (x, *options)):
            a = go(x)
            return boolean(reduce(lambda p, q: p | q, [B.equal(a, go(o)) for o in options], F.lit(False)))
        case A.Call(name, args):
            if list_call(e, ctx):
                return LISTS[name[len(ctx.extensions) :]](flags[id(e)].col, *map(go, args[1:]))
            f = ctx.functions.get(name)
            if f is None:
                raise B.Unsupported(name)
            return f(*map(go, args))
        case A.Exists(_):
            return flags[id(e)]
        case IRI() | Triple() | Blank():
            return constant(e)
    return constant(e)


def certain(p: A.Pattern) -> set[str]:
    """Variables that every solution of a pattern binds, as far as its form tells."""
    match p:
        case A.BGP(_) | A.PathPattern():
            return {v.name for v in A.variables(p)}
        case A.Join(a, b):
            return certain(a) | certain(b)
        case A.Union(a, b):
            return certain(a) & certain(b)
        case A.LeftJoin(a, _, _) | A.Minus(a, _) | A.Filter(_, a) | A.Extend(a, _, _) | A.Graph(_, a) | A.Distinct(a) | A.Reduced(a):
            return certain(a)
        case A.Given(_, frame):
            return {n for n, s in frame.slots.items() if s.certain}
    return set()


def exists_in(e: object) -> list[A.Exists]:
    match e:
        case A.Exists(_):
            return [e]
        case A.Call(_, args):
            return [x for a in args for x in exists_in(a)]
    return []


#: functions of an rdf:List, given as an array of codes, by local name; places count from 0
LISTS = {
    "listLength": lambda items: Val("int", F.when(items.isNotNull(), F.size(items).cast("long"))),
    "listGet": lambda items, i: Val("term", F.get(items, as_double(i).cast("int"))),
    "listIndexOf": lambda items, x: Val("int", F.nullif(F.array_position(items, code(x)).cast("long") - 1, F.lit(-1).cast("long"))),
    "listContains": lambda items, x: boolean(F.array_contains(items, code(x))),
}


def list_call(e: object, ctx: Context) -> bool:
    return bool(ctx.extensions) and isinstance(e, A.Call) and e.name.startswith(ctx.extensions) and e.name[len(ctx.extensions) :] in LISTS


def list_calls_in(e: object, ctx: Context) -> list[A.Call]:
    inner = [x for a in e.args for x in list_calls_in(a, ctx)] if isinstance(e, A.Call) else []
    return [*inner, e] if list_call(e, ctx) else inner


def held(e: object, ctx: Context) -> object:
    """An expression whose heldIn(r, s) is spelt out: r is according to s, or to what sharpens s."""
    if not isinstance(e, A.Call):
        return e
    if ctx.extensions and e.name == ctx.extensions + "heldIn":
        if ctx.standpoint is None:
            raise B.Unsupported("heldIn without predicates of standpoints")
        according, sharpens = map(A.Link, ctx.standpoint)
        r, s = e.args
        return A.Exists(A.PathPattern(r, A.Alt(according, A.Seq(according, sharpens)), s))
    return replace(e, args=tuple(held(a, ctx) for a in e.args))


def flagged(f: Frame, e: object, ctx: Context) -> tuple[Frame, dict[int, Val]]:
    """The frame with a column for each EXISTS and each list that an expression needs."""
    flags: dict[int, Val] = {}
    for x in exists_in(e):
        f, flags[id(x)] = exists_flag(f, x.pattern, ctx)
    for x in list_calls_in(e, ctx):
        f, flags[id(x)] = list_items(f, x.args[0], ctx)
    return f, flags


def list_items(f: Frame, arg: object, ctx: Context) -> tuple[Frame, Val]:
    """The frame with the items of the list that an argument names, null where it names none."""
    from .rules import list_members

    head, items = R.fresh("head"), R.fresh("items")
    df = f.df.withColumn(head, code(expression(arg, scope_of(f), ctx)))
    quads = ctx.source.all_quads().where("g IS NULL").select("s", "p", "o")
    heads = df.select(F.col(head).alias("cell")).where("cell IS NOT NULL").distinct()
    members = list_members(quads, heads).groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(items))
    nil = F.when(F.col(head) == encode(IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#nil")), F.array().cast("array<string>"))
    df = df.join(members, F.col(head) == F.col("list"), "left").drop("list").withColumn(items, F.coalesce(items, nil)).drop(head)
    return replace(f, df=df), Val("list", F.col(items))


def scope_of(f: Frame) -> dict[str, Val]:
    return {n: f.val(n) for n in f.slots}


# patterns
def compile(p: A.Pattern, ctx: Context) -> Frame:
    match p:
        case A.BGP(triples):
            return bgp(triples, ctx)
        case A.PathPattern(s, path, o):
            return paths.evaluate(s, path, o, ctx)
        case A.Join(a, b):
            if isinstance(b, A.PropertyFunction):
                return relation(compile(a, ctx), b, ctx)
            if isinstance(b, A.Service) and isinstance(b.name, Var):
                return service(b, ctx, compile(a, ctx))
            return conjunction(conjuncts(p), ctx)
        case A.LeftJoin(a, b, cond):
            right = compile(b, ctx)
            if cond is not None and exists_in(cond):
                right, cond = filtered(cond, right, ctx), None
            make = (lambda values: truth(expression(cond, values, ctx))) if cond is not None else None
            return R.left_join(compile(a, ctx), right, make)
        case A.Lateral(a, b):
            return lateral(compile(a, ctx), b, ctx)
        case A.Filter(cond, inner):
            return filtered(cond, compile(inner, ctx), ctx)
        case A.Union(a, b):
            return R.union(compile(a, ctx), compile(b, ctx))
        case A.Graph(name, inner):
            return graph(name, inner, ctx)
        case A.Extend(inner, var, e):
            return extend(compile(inner, ctx), var.name, e, ctx)
        case A.Minus(a, b):
            return R.minus(compile(a, ctx), compile(b, ctx))
        case A.Service():
            return service(p, ctx, None)
        case A.Values(vs, rows):
            return values(vs, rows, ctx)
        case A.Given(_, frame):
            return R.renamed(frame)
        case A.OrderBy(inner, keys):
            return order_by(compile(inner, ctx), keys, ctx)
        case A.Project(inner, vs):
            return R.project(compile(inner, ctx), [v.name for v in vs])
        case A.Distinct(inner):
            return R.distinct(compile(inner, ctx))
        case A.Reduced(inner):
            return compile(inner, ctx)
        case A.Slice(inner, start, length):
            f = compile(inner, ctx)
            df = f.df
            if length is not None:
                df = df.limit(start + length)
            return replace(f, df=df.offset(start) if start else df)
        case A.Group(inner, keys, aggs):
            return aggregates.group(compile(inner, ctx), [k.name for k in keys], aggs, ctx)
        case A.PropertyFunction():
            return relation(None, p, ctx)
    raise TypeError(p)


def destructure(f: Frame, name: str, t: object) -> Frame:
    """Solutions whose variable ``name`` matches a triple pattern, with the variables inside bound."""
    parts = F.split(F.substr(code(f.val(name)), F.lit(2)), RS, 3)
    f = replace(f, df=f.df.where(is_kind(f.val(name), "T")))
    for i, x in enumerate((t.s, t.p, t.o)):
        part = Val("term", F.get(parts, F.lit(i)))
        if isinstance(x, Var):
            if x.name in f.slots:
                f = replace(f, df=f.df.where(part.col == code(f.val(x.name))))
            else:
                kept = {n: f.val(n) for n in f.slots}
                f = R.build(f.df, kept | {x.name: part}, {n: s.certain for n, s in f.slots.items()})
                parts = F.split(F.substr(code(f.val(name)), F.lit(2)), RS, 3)
        elif isinstance(x, Triple) and not ground(x):
            inner = R.fresh("part")
            kept = {n: f.val(n) for n in f.slots}
            f = destructure(R.build(f.df, kept | {inner: part}, {n: s.certain for n, s in f.slots.items()}), inner, x)
            f = replace(f, slots={n: s for n, s in f.slots.items() if n != inner})
            parts = F.split(F.substr(code(f.val(name)), F.lit(2)), RS, 3)
        else:
            f = replace(f, df=f.df.where(part.col == encode(x)))
    return f


def ground(t: object) -> bool:
    return not isinstance(t, Var) and (not isinstance(t, Triple) or all(map(ground, (t.s, t.p, t.o))))


def bgp(triples: tuple, ctx: Context) -> Frame:
    return conjunction([A.BGP(triples)], ctx) if triples else R.empty_solution(ctx.spark)


def conjuncts(p: A.Pattern) -> list[A.Pattern]:
    """The patterns that a join is made of; one that reads what stands before it stays with that."""
    if isinstance(p, A.Join) and not isinstance(p.right, A.PropertyFunction) and not (isinstance(p.right, A.Service) and isinstance(p.right.name, Var)):
        return conjuncts(p.left) + conjuncts(p.right)
    return [p]


def conjunction(parts: list[A.Pattern], ctx: Context) -> Frame:
    """A conjunction: what the source scans as one, then joins that grow from the most selective part along shared variables."""
    nested: list[tuple[str, Triple]] = []
    plain = []
    for t in (t for p in parts if isinstance(p, A.BGP) for t in p.triples):
        o = t.o
        s = t.s
        if isinstance(s, Triple) and not ground(s):
            v = Var(R.fresh(".triple"))
            nested.append((v.name, s))
            s = v
        if isinstance(o, Triple) and not ground(o):
            v = Var(R.fresh(".triple"))
            nested.append((v.name, o))
            o = v
        plain.append(A.TriplePattern(s, t.p, o))
    scans = sorted(ctx.source.scans(plain, ctx), key=lambda x: x[0]) if plain else []
    # what a scan binds to a subject or an object is a node of the active graph
    ends = {x.name for t in plain for x in (t.s, t.o) if isinstance(x, Var)}
    nodes: dict[str, Frame] = {}
    for _, f in scans:
        for n in f.slots:
            if n in ends:
                nodes.setdefault(n, f)
    for p in parts:
        if isinstance(p, A.PathPattern):
            bound = sum(not isinstance(x, Var) for x in (p.s, p.o))
            scans.append((1e7 / 10.0 ** (3 * bound), paths.evaluate(p.s, p.path, p.o, ctx, nodes)))
        elif not isinstance(p, A.BGP):
            scans.append((1.0 if isinstance(p, A.Values) else 1e5, compile(p, ctx)))
    if not scans:
        return R.empty_solution(ctx.spark)
    scans.sort(key=lambda x: x[0])
    _, out = scans.pop(0)
    while scans:
        linked = [x for x in scans if any(n in out.slots for n in x[1].slots)]
        pick = (linked or scans)[0]
        scans.remove(pick)
        out = R.join(out, pick[1])
    for name, t in nested:
        out = destructure(out, name, t)
        out = replace(out, slots={n: s for n, s in out.slots.items() if n != name})
    return out


def filtered(cond: object, f: Frame, ctx: Context) -> Frame:
    """FILTER: conjuncts that are EXISTS become semi and anti joins."""
    cond = held(cond, ctx)
    match cond:
        case A.Call("&&", (a, b)):
            return filtered(b, filtered(a, f, ctx), ctx)
        case A.Exists(p):
            return exists(f, p, ctx, anti=False)
        case A.Call("!", (A.Exists(p),)):
            return exists(f, p, ctx, anti=True)
    f, flags = flagged(f, cond, ctx)
    # flags are columns of the frame's table, so the scope is taken after all joins
    return replace(f, df=f.df.where(truth(expression(cond, scope_of(f), ctx, flags))))


def _inner(p: A.Pattern, outer: set[str]) -> tuple[A.Pattern, list[object]]:
    """An EXISTS pattern without the filters that look at outer variables, and these."""
    hoisted: list[object] = []
    while isinstance(p, A.Filter):
        scope = {v.name for v in A.variables(p.inner)}
        if (free(p.condition) & outer) - scope:
            hoisted.append(p.condition)
            p = p.inner
        else:
            break
    return p, hoisted


def _with_outer(p: A.Pattern, f: Frame) -> A.Pattern:
    """An EXISTS pattern whose nested groups have the outer variables that they look at joined in.

    A filter, a condition of OPTIONAL or an assignment inside may use a variable
    that only the outer solutions bind.  These values, each combination once,
    become solutions of the group, and the join with the outer solutions
    compares them again.  Outer variables that the group binds come with them,
    so that a group meets its own outer solutions by equality, not all of them.
    """

    def given(missing: set[str], inner: A.Pattern) -> A.Pattern:
        if not missing:
            return inner
        names = sorted(missing | (certain(inner) & set(f.slots)))
        seed = A.Given(tuple(map(Var, names)), R.distinct(R.project(replace(f, order=[]), names)))
        return seed if inner == A.BGP(()) else A.Join(inner, seed)

    def missing(e: object, *inner: A.Pattern) -> set[str]:
        return (free(e) & set(f.slots)) - {v.name for x in inner for v in A.variables(x)}

    def go(p: A.Pattern) -> A.Pattern:
        match p:
            case A.Filter(c, inner):
                inner = go(inner)
                return A.Filter(c, given(missing(c, inner), inner))
            case A.LeftJoin(a, b, c):
                a, b = go(a), go(b)
                return A.LeftJoin(given(missing(c, a, b), a) if c is not None else a, b, c)
            case A.Extend(inner, v, e):
                inner = go(inner)
                return A.Extend(given(missing(e, inner), inner), v, e)
            case A.Join(a, b) | A.Union(a, b) | A.Minus(a, b) | A.Lateral(a, b):
                return type(p)(go(a), go(b))
            case A.Graph(name, inner):
                return A.Graph(name, go(inner))
            case A.Distinct(inner) | A.Reduced(inner):
                return type(p)(go(inner))
        return p

    return go(p)


def exists(f: Frame, p: A.Pattern, ctx: Context, anti: bool) -> Frame:
    p, hoisted = _inner(p, set(f.slots))
    inner = compile(_with_outer(p, f), ctx)
    make = None
    if hoisted:
        make = lambda values: reduce(lambda a, b: a & b, [truth(expression(h, values, ctx)) for h in hoisted])
    return R.semi(f, inner, make, anti)


def exists_flag(f: Frame, p: A.Pattern, ctx: Context) -> tuple[Frame, Val]:
    """The frame with a column that tells whether each solution has a match: those that have one, and those that have none."""
    flag = R.fresh("flag")
    parts = [exists(f, p, ctx, anti).df.withColumn(flag, F.lit(not anti)) for anti in (False, True)]
    return replace(f, df=parts[0].unionByName(parts[1])), boolean(F.col(flag))


def extend(f: Frame, name: str, e: object, ctx: Context) -> Frame:
    e = held(e, ctx)
    f, flags = flagged(f, e, ctx)
    v = expression(e, scope_of(f), ctx, flags)
    kept = {n: f.val(n) for n in f.slots}
    certain = {n: s.certain for n, s in f.slots.items()}
    # a constant or a copy of a certain variable is bound; anything else may be an error
    certain[name] = (isinstance(e, Var) and e.name in f.slots and f.slots[e.name].certain) or not isinstance(e, Var | A.Call | A.Exists)
    out = R.build(f.df, kept | {name: v}, certain, [c for _, c in f.order if c in f.df.columns])
    out.order = f.order
    return out


def graph(name: object, inner: A.Pattern, ctx: Context) -> Frame:
    if isinstance(name, Var):
        f = compile(inner, replace(ctx, graph=name))
        if name.name not in f.slots:  # a pattern that scans nothing holds in every named graph
            f = R.join(f, ctx.source.graph_names(name.name, ctx))
        return f
    return compile(inner, replace(ctx, graph=name))


def values(vs: tuple, rows: tuple, ctx: Context) -> Frame:
    if not vs:
        f = R.empty_solution(ctx.spark)
        return f if len(rows) == 1 else replace(f, df=f.df.join(ctx.spark.range(len(rows)).select(F.lit(1).alias("n"))).drop("n"))
    out: dict[str, Val] = {}
    columns: list[str] = []
    data: list[list] = [[] for _ in rows]
    types: list[str] = []
    for i, v in enumerate(vs):
        terms = [r[i] for r in rows]
        kinds = {constant(t).kind for t in terms if t is not None}
        kind = next(iter(kinds)) if len(kinds) == 1 and next(iter(kinds)) in ("iri", "str", "int") else "term"
        c = f"c{i}"
        columns.append(c)
        types.append("bigint" if kind == "int" else "string")
        for row, t in zip(data, terms, strict=True):
            row.append(None if t is None else int(t.lex) if kind == "int" else t.value if kind == "iri" else t.lex if kind == "str" else encode(t))
        out[v.name] = Val(kind, F.col(c))
    schema = ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True))
    df = ctx.spark.createDataFrame(data, schema)
    return R.build(df, out, {v.name: all(r[i] is not None for r in rows) for i, v in enumerate(vs)})


def sort_columns(v: Val) -> list[Column]:
    """Keys for ORDER BY: unbound, blank nodes, IRIs, literals, triples; literals by value and then by form."""
    if v.kind in ("iri", "ref"):
        return [text_of(v)]
    if v.kind != "term":
        return [v.col] + ([v.lang] if v.kind == "lang" else [])
    rank = F.when(v.col.isNull(), 0).when(is_kind(v, "B"), 1).when(is_kind(v, "I"), 2).when(is_kind(v, "L"), 3).otherwise(4)
    number = F.when(tier(v).isNotNull(), as_double(v))
    return [rank, number.isNull().cast("int"), number, F.when(number.isNull(), text_of(v)), v.col]


def order_by(f: Frame, keys: tuple, ctx: Context) -> Frame:
    df, order = f.df, []
    for down, e in keys:
        for c in sort_columns(expression(e, scope_of(f), ctx)):
            name = R.fresh("key")
            df = df.withColumn(name, c)
            order.append((down, name))
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for down, c in order]
    return Frame(df.orderBy(*by), f.slots, order)


def lateral(left: Frame, p: A.Pattern, ctx: Context) -> Frame:
    """The right side once for each left solution, with its bindings in place.

    Modifiers of the right side work within each left solution: a slice is a
    row number over its ordering, grouping adds the left row as a key.
    """
    steps: list[A.Pattern] = []
    while isinstance(p, A.Slice | A.OrderBy | A.Project | A.Distinct | A.Reduced | A.Group | A.Extend | A.Filter):
        steps.append(p)
        p = p.inner
    if not any(isinstance(x, A.Slice | A.Group | A.Distinct) for x in steps) and not isinstance(p, A.LeftJoin | A.Minus):
        inner = p
        f = R.join(left, compile(inner, ctx)) if inner != A.BGP(()) else left
        for x in reversed(steps):
            f = _step(f, x, ctx, set(left.slots))
        return f
    row = R.fresh(".row")
    base = R.build(left.df, {n: left.val(n) for n in left.slots} | {row: Val("int", F.monotonically_increasing_id())}, {n: s.certain for n, s in left.slots.items()})
    # the rows' numbers are met twice, so they are written
    base = replace(base, df=materialise(base.df))
    # only what a projection shows is injected
    hidden: set[str] = set()
    for x in steps:
        if isinstance(x, A.Project):
            hidden |= set(left.slots) - {v.name for v in x.variables}
    visible = replace(base, slots={n: s for n, s in base.slots.items() if n not in hidden})
    if isinstance(p, A.LeftJoin):
        f = compile_with(visible, p, ctx)
    else:
        f = R.join(visible, compile(p, ctx)) if p != A.BGP(()) else visible
    empty_group = None
    for x in reversed(steps):
        match x:
            case A.Slice(_, start, length):
                by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for down, c in f.order] or [F.lit(0)]
                n = R.fresh("n")
                df = f.df.withColumn(n, F.row_number().over(Window.partitionBy(f.slots[row].column).orderBy(*by)))
                df = df.where(F.col(n) > start)
                f = replace(f, df=df.where(F.col(n) <= start + length) if length is not None else df)
            case A.OrderBy(_, keys):
                ordered, df = [], f.df
                for down, e in keys:
                    for c in sort_columns(expression(e, scope_of(f), ctx)):
                        name = R.fresh("key")
                        df = df.withColumn(name, c)
                        ordered.append((down, name))
                f = Frame(df, f.slots, ordered)
            case A.Group(_, keys, aggs):
                f = aggregates.group(f, [*(k.name for k in keys), row], aggs, ctx)
                empty_group = aggs if not keys else None
            case A.Project(_, vs):
                f = R.project(f, [*(v.name for v in vs), *([row] if row not in [v.name for v in vs] else [])])
            case A.Distinct(_):
                f = R.distinct(f)
            case _:
                f = _step(f, x, ctx, set())
    # what is hidden inside comes back from the left row
    f = replace(f, slots={n: s for n, s in f.slots.items() if n == row or n not in left.slots or n not in hidden})
    rest = replace(f, slots={n: s for n, s in f.slots.items() if n == row or n not in left.slots})
    if empty_group is not None:
        out = R.left_join(base, rest, None)
        counts = [v.name for v, a in empty_group if a.name == "COUNT"]
        vals = {n: out.val(n) for n in out.slots}
        for n in counts:
            if n in vals:
                vals[n] = replace(vals[n], col=F.coalesce(vals[n].col, F.lit(0).cast("long")))
        for x in reversed(steps):  # projected copies of counts
            if isinstance(x, A.Extend) and isinstance(x.expr, Var) and x.expr.name in counts and x.var.name in vals:
                vals[x.var.name] = replace(vals[x.var.name], col=F.coalesce(vals[x.var.name].col, F.lit(0).cast("long")))
        out = R.build(out.df, vals, {n: s.certain for n, s in out.slots.items()})
    else:
        out = R.join(base, rest)
    return replace(out, slots={n: s for n, s in out.slots.items() if n != row})


def compile_with(left: Frame, p: A.LeftJoin, ctx: Context) -> Frame:
    """An OPTIONAL inside LATERAL, with the left solution in place."""
    inner = left if p.left == A.BGP(()) else R.join(left, compile(p.left, ctx))
    make = (lambda values: truth(expression(p.condition, values, ctx))) if p.condition is not None else None
    return R.left_join(inner, compile(p.right, ctx), make)


def _step(f: Frame, x: A.Pattern, ctx: Context, keep: set[str]) -> Frame:
    match x:
        case A.Extend(_, var, e):
            return extend(f, var.name, e, ctx)
        case A.Filter(cond, _):
            return filtered(cond, f, ctx)
        case A.Project(_, vs):
            names = [v.name for v in vs]
            return R.project(f, [*names, *(n for n in keep if n not in names and n in f.slots)])
        case A.OrderBy(_, keys):
            return order_by(f, keys, ctx)
    return f


def service(p: A.Service, ctx: Context, left: Frame | None) -> Frame:
    """A remote scan by the host's transport: service(endpoint, query text, variables) -> rows of terms by name.

    With a variable endpoint the distinct endpoints of the left side are asked
    in turn.  SILENT turns a failure into one solution without bindings.
    """
    if ctx.service is None:
        raise B.Unsupported("SERVICE without a transport")
    names = [v.name for v in A.variables(p.inner)]

    def ask(endpoint: str) -> Frame:
        try:
            rows = list(ctx.service(endpoint, p.text, names))
        except Exception as e:
            # SILENT forgives an endpoint, not a limit
            if not p.silent or isinstance(e, Stopped):
                raise
            return R.empty_solution(ctx.spark)
        return values(tuple(map(Var, names)), tuple(tuple(r.get(n) for n in names) for r in rows), ctx)

    if isinstance(p.name, IRI):
        f = ask(p.name.value)
        return f if left is None else R.join(left, f)
    if left is None or p.name.name not in left.slots:
        raise B.Unsupported("SERVICE with an unbound endpoint")
    key = text_of(left.val(p.name.name))
    out = None
    for (endpoint,) in left.df.select(key).distinct().toLocalIterator():
        part = R.join(replace(left, df=left.df.where(key == endpoint)), ask(endpoint))
        out = part if out is None else R.union(out, part)
    return out if out is not None else replace(left, df=left.df.limit(0))


def relation(left: Frame | None, p: A.PropertyFunction, ctx: Context) -> Frame:
    """A property function: a host relation joined on its arguments.

    The host gives a DataFrame of codes, one column for each argument, or a
    function from the frame so far and its argument names to such a DataFrame.
    """
    host = ctx.relations.get(p.name)
    if host is None:
        raise B.Unsupported(p.name)
    args = [*p.subjects, *p.objects]
    df = host(ctx, left, args) if callable(host) else host
    f: Frame | None = None
    vals: dict[str, Val] = {}
    for c, a in zip(df.columns, args, strict=True):
        if isinstance(a, Var):
            if a.name in vals:
                df = df.where(F.col(c) == vals[a.name].col)
            else:
                vals[a.name] = Val("term", F.col(c))
        else:
            df = df.where(F.col(c) == encode(a))
    f = R.build(df, vals) if vals else Frame(df.select(F.lit(1).alias(R.fresh("unit"))), {})
    return f if left is None else R.join(left, f)

