"""Property paths as tables of (start, end), with semi-naive closures."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from .. import algebra as A
from ..functions.values import Val, code
from ..storage import materialise
from ..terms import Triple, Var
from . import frame as R
from .frame import Frame

S, O, G = ".s", ".o", ".g"


def evaluate(s: object, path: object, o: object, ctx, nodes: dict[str, Frame] | None = None) -> Frame:
    """The solutions of a path pattern; in GRAPH ?g a path stays within one graph.

    ``nodes``: frames that bind variables to nodes of the active graph, and that
    the solutions are joined with.  An end that is such a variable needs no
    other node: zero steps are made for these alone.
    """
    if isinstance(o, Triple) or isinstance(s, Triple):
        raise NotImplementedError("a path that ends in a triple term")
    in_graph = isinstance(ctx.graph, Var)
    known = {}
    for name, t in ((S, s), (O, o)):
        f = (nodes or {}).get(t.name) if isinstance(t, Var) else None
        if f is not None and (not in_graph or ctx.graph.name in f.slots):
            known[name] = replace(f, slots={".n": f.slots[t.name]} | ({G: f.slots[ctx.graph.name]} if in_graph else {}))
    f = pairs(path, ctx, s if not isinstance(s, Var) else None, o if not isinstance(o, Var) else None, known)
    vals: dict[str, Val] = {}
    df = f.df
    for name, t in ((S, s), (O, o)):
        v = f.val(name)
        if isinstance(t, Var):
            if t.name in vals:
                df = df.where(code(v) == code(vals[t.name]))
            else:
                vals[t.name] = v
        else:
            df = df.where(_is(v, t))
    if in_graph:
        g = f.val(G)
        if ctx.graph.name in vals:
            df = df.where(code(g) == code(vals[ctx.graph.name]))
        else:
            vals[ctx.graph.name] = g
    if not vals:
        return Frame(df.select(F.lit(1).alias(R.fresh("unit"))), {})
    return R.build(df, vals)


def _is(v: Val, t: object):
    from ..functions.builtins import same_term
    from ..functions.values import constant

    return same_term(v, constant(t))


def _names(ctx) -> list[str]:
    return [S, O, G] if isinstance(ctx.graph, Var) else [S, O]


def pairs(path: object, ctx, start: object = None, end: object = None, known: dict[str, Frame] | None = None) -> Frame:
    """(start, end[, graph]) of a path; constants at its ends, and frames of all nodes that an end may be, may narrow the search."""
    names = _names(ctx)
    known = known or {}
    back = {{S: O, O: S}[n]: f for n, f in known.items()}
    match path:
        case A.Link(iri):
            return ctx.source.edges([iri], ctx)
        case A.AnyLink():
            return ctx.source.edges(None, ctx, subject=_slot(known))
        case A.Negated(forward, backward):
            parts = []
            if forward or not backward:
                parts.append(ctx.source.edges(None, ctx, without=forward, subject=_slot(known)))
            if backward:
                parts.append(_swap(ctx.source.edges(None, ctx, without=backward, subject=_slot(back))))
            return reduce(R.union, parts)
        case A.Inverse(p):
            return _swap(pairs(p, ctx, end, start, back))
        case A.Alt(a, b):
            return R.union(R.project(pairs(a, ctx, start, end, known), names), R.project(pairs(b, ctx, start, end, known), names))
        case A.Seq(a, b):
            x = pairs(a, ctx, start, None, {n: f for n, f in known.items() if n == S})
            y = pairs(b, ctx, None, end, {n: f for n, f in known.items() if n == O})
            x = replace(x, slots={".m" if n == O else n: s for n, s in x.slots.items()})
            y = replace(y, slots={".m" if n == S else n: s for n, s in y.slots.items()})
            return R.project(R.join(x, y), names)
        case A.Repeat(p, 0, 1):
            return R.distinct(R.union(_identity(ctx, start, end, known), _coded(pairs(p, ctx, None, None, known), names)))
        case A.Repeat(p, least, None):
            return closure(p, least, ctx, start, end, known)
        case A.Repeat(p, least, most):
            return bounded(p, least, most, ctx, start, end, known)
    raise TypeError(path)


def _slot(known: dict[str, Frame]):
    """How the starts of a path are held, if they are known."""
    return known[S].slots[".n"] if S in known else None


def _swap(f: Frame) -> Frame:
    return replace(f, slots={{S: O, O: S}.get(n, n): s for n, s in f.slots.items()})


def _coded(f: Frame, names: list[str]) -> Frame:
    """Both ends as codes; or as they are, if they are of one native kind."""
    a, b = f.slots[S], f.slots[O]
    if a.kind == b.kind == "ref" and a.prefix == b.prefix:
        return R.project(f, names)
    return R.project(R.term_frame(f), names)


def _identity(ctx, start: object, end: object, others: dict[str, Frame] | None = None) -> Frame:
    """Zero steps: every node of the active graph that an end may be, and the constants that the pattern names."""
    from ..terms import encode

    known = [t for t in (start, end) if t is not None]
    in_graph = isinstance(ctx.graph, Var)
    if known and not in_graph:
        df = ctx.spark.createDataFrame([(encode(t),) for t in known[:1]], "n string")
        return R.build(df, {S: Val("term", F.col("n")), O: Val("term", F.col("n"))})
    if others and start is None and end is None:
        one = R.distinct(next(iter(others.values())))
        vals = {S: one.val(".n"), O: one.val(".n")} | ({G: one.val(G)} if in_graph else {})
        return R.project(R.build(one.df, vals), _names(ctx))
    nodes = ctx.source.nodes(ctx)
    vals = {S: nodes.val(".n"), O: nodes.val(".n")}
    if in_graph:
        vals[G] = nodes.val(G)
    out = R.term_frame(R.build(nodes.df, vals))
    for name, t in ((S, start), (O, end)):
        if t is not None:
            out = replace(out, df=out.df.where(_is(out.val(name), t)))
    return R.project(out, _names(ctx))


def closure(path: object, least: int, ctx, start: object, end: object, known: dict[str, Frame] | None = None) -> Frame:
    """``*`` and ``+`` (and {n,}): a set.

    Semi-naive: each round joins only the pairs that the round before found, so
    the rounds are as many as the longest shortest path.  A constant start (or
    end) is the only seed; the table then grows with what it reaches.  Every
    round is written to shared storage, which bounds the plan.
    """
    names = _names(ctx)
    if least > 1:
        head = bounded(path, least - 1, least - 1, ctx, start, None)
        x = replace(head, slots={".m" if n == O else n: s for n, s in head.slots.items()})
        tail = closure(path, 1, ctx, None, end)
        y = replace(tail, slots={".m" if n == S else n: s for n, s in tail.slots.items()})
        return R.distinct(R.project(R.join(x, y), names))
    backward = start is None and end is not None
    edges = _coded(pairs(path, ctx), names)
    if backward:
        edges = _swap(edges)
        edges = R.project(edges, names)
    seed = end if backward else start
    stable = R.distinct(edges)
    stable = replace(stable, df=materialise(stable.df))
    e_s, e_o = stable.slots[S].column, stable.slots[O].column
    graph = [stable.slots[G].column] if G in stable.slots else []
    table = stable.df.select(F.col(e_s).alias("a"), F.col(e_o).alias("b"), *[F.col(g).alias("g") for g in graph])
    keys = ["a", "b"] + ["g"] * bool(graph)
    first = table if seed is None else table.where(_is(replace(stable.val(S), col=F.col("a")), seed))
    seen = delta = materialise(first.distinct())
    step = table.select(F.col("a").alias("m"), F.col("b").alias("z"), *([F.col("g")] if graph else []))
    rounds = [seen]
    while not delta.isEmpty():
        on = delta["b"] == step["m"]
        if graph:
            on = on & (delta["g"] == step["g"])
        found = delta.join(step, on).select(delta["a"], F.col("z").alias("b"), *([delta["g"]] if graph else [])).distinct()
        if seed is not None and not graph:
            # what one node reaches is small beside a round's cost: three steps a round
            for _ in range(2):
                more = found.withColumnRenamed("b", "m").join(step, "m").select("a", F.col("z").alias("b"))
                found = found.union(more).distinct()
        delta = materialise(found.join(seen, keys, "left_anti"))
        rounds.append(delta)
        seen = reduce(lambda x, y: x.union(y), rounds)
    slot = stable.val(S)
    vals = {S: replace(slot, col=F.col("a")), O: replace(slot, col=F.col("b"))}
    if graph:
        vals[G] = replace(stable.val(G), col=F.col("g"))
    out = R.build(seen, vals)
    if backward:
        out = _swap(out)
    out = R.project(out, names)
    if least == 0:
        out = R.distinct(R.union(out, _identity(ctx, start, end, known)))
    return out


def bounded(path: object, least: int, most: int, ctx, start: object, end: object, known: dict[str, Frame] | None = None) -> Frame:
    """{n,m}: a set, by powers of the step doubled."""
    names = _names(ctx)
    one = R.distinct(_coded(pairs(path, ctx), names))
    one = replace(one, df=materialise(one.df))

    def compose(x: Frame, y: Frame) -> Frame:
        a = replace(x, slots={".m" if n == O else n: s for n, s in x.slots.items()})
        b = replace(y, slots={".m" if n == S else n: s for n, s in y.slots.items()})
        z = R.distinct(R.project(R.join(a, b), names))
        return replace(z, df=materialise(z.df))

    def power(base: Frame, n: int) -> Frame | None:
        out, square = None, base
        while n:
            if n & 1:
                out = square if out is None else compose(out, square)
            n >>= 1
            if n:
                square = compose(square, square)
        return out

    exact = power(one, least)
    if most > least:
        # at most k further steps: powers of the step with the identity
        reach: Frame | None = None
        part = exact
        for _ in range(most - least):
            part = one if part is None else compose(part, one)
            reach = part if reach is None else R.union(reach, part)
        out = reach if exact is None else R.union(exact, reach)
        if least == 0:
            out = R.union(out, _identity(ctx, start, end, known))
        return R.distinct(out)
    return exact if exact is not None else _identity(ctx, start, end, known)
