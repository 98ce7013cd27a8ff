"""The algebra that SPARQL text becomes and that the compiler turns into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from .terms import Var


class Pattern:
    pass


@dataclass(frozen=True)
class TriplePattern:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class BGP(Pattern):
    triples: tuple[TriplePattern, ...]


@dataclass(frozen=True)
class PathPattern(Pattern):
    s: object
    path: object
    o: object


@dataclass(frozen=True)
class Join(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class LeftJoin(Pattern):
    left: Pattern
    right: Pattern
    condition: object = None


@dataclass(frozen=True)
class Lateral(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Filter(Pattern):
    condition: object
    inner: Pattern


@dataclass(frozen=True)
class Union(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Graph(Pattern):
    name: object
    inner: Pattern


@dataclass(frozen=True)
class Extend(Pattern):
    inner: Pattern
    var: Var
    expr: object


@dataclass(frozen=True)
class Minus(Pattern):
    left: Pattern
    right: Pattern


@dataclass(frozen=True)
class Service(Pattern):
    name: object
    inner: Pattern
    silent: bool
    text: str = ""


@dataclass(frozen=True)
class Values(Pattern):
    variables: tuple[Var, ...]
    rows: tuple[tuple[object, ...], ...]


@dataclass(frozen=True)
class OrderBy(Pattern):
    inner: Pattern
    keys: tuple[tuple[bool, object], ...]  # (descending, expression)


@dataclass(frozen=True)
class Project(Pattern):
    inner: Pattern
    variables: tuple[Var, ...]


@dataclass(frozen=True)
class Distinct(Pattern):
    inner: Pattern


@dataclass(frozen=True)
class Reduced(Pattern):
    inner: Pattern


@dataclass(frozen=True)
class Slice(Pattern):
    inner: Pattern
    start: int
    length: int | None


@dataclass(frozen=True)
class Group(Pattern):
    inner: Pattern
    keys: tuple[Var, ...]
    aggregates: tuple[tuple[Var, Aggregate], ...]


@dataclass(frozen=True)
class PropertyFunction(Pattern):
    name: str
    subjects: tuple[object, ...]
    objects: tuple[object, ...]


@dataclass(frozen=True, eq=False)
class Given(Pattern):
    """Solutions that are known already, as a frame with these variables."""

    names: tuple[Var, ...]
    frame: object


# paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class AnyLink:
    pass


@dataclass(frozen=True)
class Seq:
    left: object
    right: object


@dataclass(frozen=True)
class Alt:
    left: object
    right: object


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


@dataclass(frozen=True)
class Repeat:
    """least to most repetitions; most None for no bound."""

    path: object
    least: int
    most: int | None


# expressions: a term or variable, or one of
@dataclass(frozen=True)
class Call:
    """An operator or function with its arguments; IRIs name functions of the host."""

    name: str
    args: tuple[object, ...] = ()


@dataclass(frozen=True)
class Exists:
    pattern: Pattern


@dataclass(frozen=True)
class Aggregate:
    name: str
    args: tuple[object, ...]
    distinct: bool = False
    options: tuple[tuple[str, object], ...] = ()


# queries
@dataclass
class Query:
    form: str  # SELECT ASK CONSTRUCT DESCRIBE
    pattern: Pattern
    variables: tuple[Var, ...] = ()
    template: tuple = ()
    terms: tuple = ()
    default: tuple[str, ...] = ()
    named: tuple[str, ...] = ()
    has_dataset: bool = False
    prefixes: dict = field(default_factory=dict)
    version: str = ""


@dataclass
class Operation:
    """One update: kind and what it needs."""

    kind: str
    delete: tuple = ()
    insert: tuple = ()
    pattern: Pattern | None = None
    source: object = None
    target: object = None
    silent: bool = False
    with_graph: str | None = None
    default: tuple[str, ...] = ()
    named: tuple[str, ...] = ()
    has_dataset: bool = False


def variables(p: object) -> list[Var]:
    """The variables in scope of a pattern, in the order they are first seen."""
    seen: dict[Var, None] = {}

    def term(t: object) -> None:
        from .terms import Triple

        if isinstance(t, Var):
            seen[t] = None
        elif isinstance(t, Triple):
            for x in (t.s, t.p, t.o):
                term(x)

    def go(p: object) -> None:
        match p:
            case BGP(triples):
                for t in triples:
                    for x in (t.s, t.p, t.o):
                        term(x)
            case PathPattern(s, _, o):
                term(s)
                term(o)
            case Join(a, b) | Union(a, b) | Lateral(a, b) | LeftJoin(a, b, _):
                go(a)
                go(b)
            case Minus(a, _):
                go(a)
            case Graph(name, inner) | Service(name, inner, _, _):
                term(name)
                go(inner)
            case Extend(inner, var, _):
                go(inner)
                seen[var] = None
            case Values(vs, _) | Given(vs, _):
                seen.update(dict.fromkeys(vs))
            case Project(_, vs):
                seen.update(dict.fromkeys(vs))
            case Group(_, keys, aggs):
                seen.update(dict.fromkeys(keys))
                seen.update(dict.fromkeys(v for v, _ in aggs))
            case PropertyFunction(_, a, b):
                for x in (*a, *b):
                    term(x)
            case Filter(_, inner) | OrderBy(inner, _) | Distinct(inner) | Reduced(inner) | Slice(inner, _, _):
                go(inner)

    go(p)
    return list(seen)
