"""Solutions as a DataFrame: one or two columns for each variable, NULL for unbound."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, code, shown, unify


@dataclass(frozen=True)
class Slot:
    """How a variable is held: column, kind, and whether every row binds it."""

    column: str
    kind: str
    prefix: str = ""
    lang: str | None = None
    certain: bool = True


@dataclass
class Frame:
    df: DataFrame
    slots: dict[str, Slot]
    #: order keys of an inner ORDER BY, as (descending, column), for aggregates that depend on order
    order: list[tuple[bool, str]] = field(default_factory=list)

    def val(self, name: str) -> Val:
        s = self.slots[name]
        return Val(s.kind, F.col(s.column), s.prefix, F.col(s.lang) if s.lang else None)

    def columns_of(self, name: str) -> list[str]:
        s = self.slots[name]
        return [s.column] + ([s.lang] if s.lang else [])

    def keys(self) -> list[str]:
        return [c for n in self.slots for c in self.columns_of(n)]


_count = 0


def fresh(name: str) -> str:
    global _count
    _count += 1
    return f"{name.replace('.', '_')}__{_count}"


def build(df: DataFrame, values: dict[str, Val], certain: dict[str, bool] | bool = True, keep: list[str] = ()) -> Frame:
    """A frame of new columns over df; columns in ``keep`` stay."""
    columns: list[Column] = [F.col(c) for c in keep]
    slots: dict[str, Slot] = {}
    for name, v in values.items():
        c = fresh(name)
        columns.append(v.col.alias(c))
        lang = None
        if v.kind == "lang":
            lang = fresh(name + "_lang")
            columns.append(v.lang.alias(lang))
        slots[name] = Slot(c, v.kind, v.prefix, lang, certain if isinstance(certain, bool) else certain.get(name, True))
    return Frame(df.select(*columns), slots)


def empty_solution(spark) -> Frame:
    """One solution that binds nothing."""
    return Frame(spark.range(1).select(F.lit(1).alias(fresh("unit"))), {})


def renamed(f: Frame) -> Frame:
    """The same solutions in new columns, so that a frame may meet itself."""
    columns, slots = [], {}
    mapped: dict[str, str] = {}
    for c in f.df.columns:
        mapped[c] = fresh(c.split("__")[0])
        columns.append(F.col(c).alias(mapped[c]))
    for n, s in f.slots.items():
        slots[n] = replace(s, column=mapped[s.column], lang=mapped[s.lang] if s.lang else None)
    return Frame(f.df.select(*columns), slots, [(d, mapped[c]) for d, c in f.order if c in mapped])


def shared(a: Frame, b: Frame) -> list[str]:
    return [n for n in a.slots if n in b.slots]


def same(a: Frame, b: Frame, name: str) -> tuple[Column, Column]:
    """The two columns of a variable in one kind."""
    x, y = unify(a.val(name), b.val(name))
    return x.col, y.col


def match(a: Frame, b: Frame) -> tuple[Column, bool]:
    """The condition that two solutions are compatible, and whether it is equalities only."""
    parts, equi = [], True
    for n in shared(a, b):
        x, y = same(a, b, n)
        sure = a.slots[n].certain and b.slots[n].certain
        parts.append(x == y if sure else (x == y) | x.isNull() | y.isNull())
        equi &= sure
    return reduce(lambda p, q: p & q, parts) if parts else F.lit(True), equi


def _merged(a: Frame, b: Frame, joined: DataFrame, b_certain: bool, keep: list[str] = ()) -> Frame:
    """The frame of a joined pair: shared variables once."""
    values: dict[str, Val] = {}
    certain: dict[str, bool] = {}
    for n in a.slots:
        v = a.val(n)
        if n in b.slots and not a.slots[n].certain:
            w = b.val(n)
            x, y = unify(v, w)
            v = replace(x, col=F.coalesce(x.col, y.col))
        values[n] = v
        certain[n] = a.slots[n].certain or (b_certain and n in b.slots and b.slots[n].certain)
    for n in b.slots:
        if n not in a.slots:
            values[n] = b.val(n)
            certain[n] = b_certain and b.slots[n].certain
    out = build(joined, values, certain, keep)
    return out


def _part(f: Frame, n: str, bound: bool) -> Frame:
    """The solutions that bind a variable, or those that do not, which then lack it."""
    c = F.col(f.columns_of(n)[0])
    if bound:
        return f if f.slots[n].certain else replace(f, df=f.df.where(c.isNotNull()), slots={k: replace(s, certain=True) if k == n else s for k, s in f.slots.items()})
    return replace(f, df=f.df.where(c.isNull()), slots={k: s for k, s in f.slots.items() if k != n})


def _unsure(a: Frame, b: Frame) -> str | None:
    """A shared variable that some solution may not bind."""
    return next((n for n in shared(a, b) if not (a.slots[n].certain and b.slots[n].certain)), None)


def _sides(f: Frame, n: str) -> list[Frame]:
    return [_part(f, n, True)] + ([] if f.slots[n].certain else [_part(f, n, False)])


def join(a: Frame, b: Frame) -> Frame:
    """Compatible solutions.

    Certain variables make an equi-join.  A variable that may be unbound on a
    side is handled by parts, so that each part is an equi-join too: both bound,
    and either unbound.
    """
    return _join(a, renamed(b), None)


def _join(a: Frame, b: Frame, condition) -> Frame:
    n = _unsure(a, b)
    if n is None:
        cond, _ = match(a, b)
        if condition is not None:
            cond = cond & condition(_values(a, b))
        joined = a.df.join(b.df, cond) if shared(a, b) or condition is not None else a.df.crossJoin(b.df)
        return _merged(a, b, joined, True)
    with_, without = _part(b, n, True), None if b.slots[n].certain else _part(b, n, False)
    parts = [_join(_part(a, n, True), with_, condition)]
    if not a.slots[n].certain:
        parts.append(_join(_part(a, n, False), b, condition))
    if without is not None:
        parts.append(_join(_part(a, n, True), without, condition))
    return reduce(union, parts)


def _values(a: Frame, b: Frame) -> dict[str, Val]:
    """What a condition over a pair of solutions sees."""
    values = {n: a.val(n) for n in a.slots}
    for n in b.slots:
        if n not in values:
            values[n] = b.val(n)
        elif not a.slots[n].certain:
            x, y = unify(values[n], b.val(n))
            values[n] = replace(x, col=F.coalesce(x.col, y.col))
    return values


def left_join(a: Frame, b: Frame, condition) -> Frame:
    """OPTIONAL; ``condition`` makes a column of the merged values, or is None."""
    b = renamed(b)
    if _unsure(a, b) is None:
        cond, _ = match(a, b)
        if condition is not None:
            cond = cond & condition(_values(a, b))
        return _merged(a, b, a.df.join(b.df, cond, "left"), False)
    # by parts: the pairs, and the solutions without one
    return union(_join(a, b, condition), replace(semi(a, b, condition, anti=True), order=[]))


def semi(a: Frame, b: Frame, condition=None, anti: bool = False) -> Frame:
    """EXISTS and NOT EXISTS; a variable that may be unbound is handled by parts, as in a join."""
    kept, parts = _match_parts(a, renamed(b), condition)
    return Frame(kept, a.slots, a.order) if anti else Frame(reduce(DataFrame.unionByName, parts), a.slots, a.order)


def _match_parts(a: Frame, b: Frame, condition) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of a without a match in b, and those with one, in parts without overlap."""
    n = _unsure(a, b)
    if n is None:
        cond, _ = match(a, b)
        if condition is not None:
            cond = cond & condition(_values(a, b))
        # without a variable to compare, one solution is as good as all
        right = b.df if shared(a, b) or condition is not None else b.df.limit(1)
        return a.df.join(right, cond, "left_anti"), [a.df.join(right, cond, "left_semi")]
    rest, found = [], []
    for side in _sides(a, n):
        # what the bound part of b does not match meets the unbound one
        for other in _sides(b, n) if n in side.slots else [b]:
            left, hits = _match_parts(side, renamed(other), condition)
            side = replace(side, df=left)
            found += hits
        rest.append(side.df)
    return reduce(DataFrame.unionByName, rest), found


def minus(a: Frame, b: Frame) -> Frame:
    """MINUS: a compatible solution counts only if it shares a bound variable."""
    if not shared(a, b):
        return a
    return Frame(_minus(a, renamed(b)), a.slots, a.order)


def _minus(a: Frame, b: Frame) -> DataFrame:
    n = _unsure(a, b)
    if n is None:
        return a.df.join(b.df, match(a, b)[0], "left_anti") if shared(a, b) else a.df
    rest = []
    for side in _sides(a, n):
        for other in _sides(b, n) if n in side.slots else [b]:
            side = replace(side, df=_minus(side, renamed(other)))
        rest.append(side.df)
    return reduce(DataFrame.unionByName, rest)


def union(a: Frame, b: Frame) -> Frame:
    """Bag union; a variable of one side only is unbound on the other."""
    names = [*a.slots, *(n for n in b.slots if n not in a.slots)]
    left: dict[str, Val] = {}
    right: dict[str, Val] = {}
    certain: dict[str, bool] = {}
    for n in names:
        if n in a.slots and n in b.slots:
            left[n], right[n] = unify(a.val(n), b.val(n))
            certain[n] = a.slots[n].certain and b.slots[n].certain
        else:
            f, mine, other = (a, left, right) if n in a.slots else (b, right, left)
            v = f.val(n)
            mine[n] = v
            kind = dict(f.df.dtypes)[f.slots[n].column]
            other[n] = replace(v, col=F.lit(None).cast(kind), lang=F.lit(None).cast("string") if v.kind == "lang" else None)
            certain[n] = False
    x, y = build(a.df, left, certain), build(b.df, right, certain)
    if not names:
        unit = lambda f: f.df.select(F.lit(1).alias("unit"))
        return Frame(unit(a).unionByName(unit(b)), {})
    return Frame(x.df.union(y.df), x.slots)


def project(f: Frame, names: list[str]) -> Frame:
    """The named variables, in order; those not in scope are unbound."""
    values = {n: f.val(n) if n in f.slots else Val("str", F.lit(None).cast("string")) for n in names}
    certain = {n: n in f.slots and f.slots[n].certain for n in names}
    keep = [c for _, c in f.order]
    if not names and not keep:
        return Frame(f.df.select(F.lit(1).alias(fresh("unit"))), {})
    out = build(f.df, values, certain, keep)
    out.order = f.order
    return out


def distinct(f: Frame) -> Frame:
    return Frame(f.df.select(*f.keys()).distinct() if f.slots else f.df.limit(1), f.slots)


def term_frame(f: Frame) -> Frame:
    """The same solutions with every variable as a code."""
    return build(f.df, {n: Val("term", code(f.val(n))) for n in f.slots}, {n: s.certain for n, s in f.slots.items()})


def native(f: Frame, names: list[str] | None = None) -> DataFrame:
    """Columns named by the variables: native types, and the text of IRIs, tagged strings and terms of mixed kinds."""
    names = list(f.slots) if names is None else names
    out = []
    for n in names:
        if n not in f.slots:
            out.append(F.lit(None).cast("string").alias(n))
            continue
        out.append(shown(f.val(n)).alias(n))
    return f.df.select(*out)

