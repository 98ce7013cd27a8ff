"""Rules over triples to a fixpoint, and the RDFS and OWL 2 RL rule sets.

A rule is text: triple patterns, ``->``, and the patterns that follow, or
``false`` for an inconsistency.  Evaluation is semi-naive: in each round every
rule runs once for each body pattern, with that pattern reading only what the
round before found.  Rules whose constants the data cannot meet are left out.
Rules over lists read a table of list members made beforehand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, code, is_kind, well_formed
from ..storage import materialise as write
from ..terms import OWL, RDF, RDFS, US, XSD

PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "list": "urn:list:"}
MEMBER = "I" + PREFIXES["list"] + "member"
#: so many distinct predicates of a round's triples are looked at to leave rules out; with more, none is left out
MOST = 5000
#: a pattern of so few triples is sent to all executors
FEW = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[tuple[str, str, str], ...]  # empty: a clash
    different: tuple[tuple[str, str], ...] = ()
    negated: tuple[tuple[str, str, str], ...] = ()


def _term(x: str) -> str:
    if x.startswith("?"):
        return x
    if x == "a":
        return "I" + RDF + "type"
    if x.startswith("<"):
        return "I" + x[1:-1]
    if x.startswith('"'):
        m = re.fullmatch(r'"(.*)"\^\^(\w+):(\w+)', x)
        return f"Lx:{m[3]}{US}{US}{m[1]}" if m else f"Lx:string{US}{US}{x[1:-1]}"
    prefix, _, local = x.partition(":")
    return "I" + PREFIXES[prefix] + local


def rule(name: str, text: str) -> Rule:
    """``?x a ?c . ?c rdfs:subClassOf ?d -> ?x a ?d``; ``?x != ?y`` and ``not ?x a ?y`` may stand in the body."""
    body, head = text.split("->")
    atoms, different, negated = [], [], []
    for part in body.split(" . "):
        words = part.split()
        if not words:
            continue
        if words[1] == "!=":
            different.append((_term(words[0]), _term(words[2])))
        elif words[0] == "not":
            negated.append(tuple(map(_term, words[1:4])))
        else:
            atoms.append(tuple(map(_term, words[:3])))
    heads = [] if head.strip() == "false" else [tuple(map(_term, h.split()[:3])) for h in head.split(" . ")]
    return Rule(name, tuple(atoms), tuple(heads), tuple(different), tuple(negated))


def _table(text: str) -> list[Rule]:
    return [rule(*line.split(" : ", 1)) for line in map(str.strip, text.strip().splitlines()) if line]


RDF_RULES = _table("""
rdfD2 : ?x ?p ?y -> ?p a rdf:Property
""")
RDFS_RULES = RDF_RULES + _table("""
rdfs2 : ?p rdfs:domain ?c . ?x ?p ?y -> ?x a ?c
rdfs3 : ?p rdfs:range ?c . ?x ?p ?y -> ?y a ?c
rdfs4a : ?x ?p ?y -> ?x a rdfs:Resource
rdfs4b : ?x ?p ?y -> ?y a rdfs:Resource
rdfs5 : ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r -> ?p rdfs:subPropertyOf ?r
rdfs6 : ?p a rdf:Property -> ?p rdfs:subPropertyOf ?p
rdfs7 : ?p rdfs:subPropertyOf ?q . ?x ?p ?y -> ?x ?q ?y
rdfs8 : ?c a rdfs:Class -> ?c rdfs:subClassOf rdfs:Resource
rdfs9 : ?c rdfs:subClassOf ?d . ?x a ?c -> ?x a ?d
rdfs10 : ?c a rdfs:Class -> ?c rdfs:subClassOf ?c
rdfs11 : ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e -> ?c rdfs:subClassOf ?e
rdfs12 : ?p a rdfs:ContainerMembershipProperty -> ?p rdfs:subPropertyOf rdfs:member
rdfs13 : ?d a rdfs:Datatype -> ?d rdfs:subClassOf rdfs:Literal
rdfs14 : ?c rdfs:subClassOf ?d -> ?c a rdfs:Class . ?d a rdfs:Class
""")
OWL_RULES = _table("""
eq-sym : ?x owl:sameAs ?y -> ?y owl:sameAs ?x
eq-trans : ?x owl:sameAs ?y . ?y owl:sameAs ?z -> ?x owl:sameAs ?z
eq-rep-s : ?s owl:sameAs ?t . ?s ?p ?o -> ?t ?p ?o
eq-rep-p : ?p owl:sameAs ?q . ?s ?p ?o -> ?s ?q ?o
eq-rep-o : ?o owl:sameAs ?q . ?s ?p ?o -> ?s ?p ?q
eq-diff1 : ?x owl:sameAs ?y . ?x owl:differentFrom ?y -> false
eq-diff2 : ?d a owl:AllDifferent . ?d owl:members ?l . ?l list:member ?x . ?l list:member ?y . ?x != ?y . ?x owl:sameAs ?y -> false
eq-diff3 : ?d a owl:AllDifferent . ?d owl:distinctMembers ?l . ?l list:member ?x . ?l list:member ?y . ?x != ?y . ?x owl:sameAs ?y -> false
prp-dom : ?p rdfs:domain ?c . ?x ?p ?y -> ?x a ?c
prp-rng : ?p rdfs:range ?c . ?x ?p ?y -> ?y a ?c
prp-fp : ?p a owl:FunctionalProperty . ?x ?p ?y . ?x ?p ?z . ?y != ?z -> ?y owl:sameAs ?z
prp-ifp : ?p a owl:InverseFunctionalProperty . ?x ?p ?y . ?z ?p ?y . ?x != ?z -> ?x owl:sameAs ?z
prp-irp : ?p a owl:IrreflexiveProperty . ?x ?p ?x -> false
prp-symp : ?p a owl:SymmetricProperty . ?x ?p ?y -> ?y ?p ?x
prp-asyp : ?p a owl:AsymmetricProperty . ?x ?p ?y . ?y ?p ?x -> false
prp-trp : ?p a owl:TransitiveProperty . ?x ?p ?y . ?y ?p ?z -> ?x ?p ?z
prp-spo1 : ?p rdfs:subPropertyOf ?q . ?x ?p ?y -> ?x ?q ?y
prp-eqp1 : ?p owl:equivalentProperty ?q . ?x ?p ?y -> ?x ?q ?y
prp-eqp2 : ?p owl:equivalentProperty ?q . ?x ?q ?y -> ?x ?p ?y
prp-pdw : ?p owl:propertyDisjointWith ?q . ?x ?p ?y . ?x ?q ?y -> false
prp-adp : ?d a owl:AllDisjointProperties . ?d owl:members ?l . ?l list:member ?p . ?l list:member ?q . ?p != ?q . ?x ?p ?y . ?x ?q ?y -> false
prp-inv1 : ?p owl:inverseOf ?q . ?x ?p ?y -> ?y ?q ?x
prp-inv2 : ?p owl:inverseOf ?q . ?x ?q ?y -> ?y ?p ?x
prp-npa1 : ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetIndividual ?y . ?x ?p ?y -> false
prp-npa2 : ?n owl:sourceIndividual ?x . ?n owl:assertionProperty ?p . ?n owl:targetValue ?y . ?x ?p ?y -> false
cls-nothing2 : ?x a owl:Nothing -> false
cls-int2 : ?c owl:intersectionOf ?l . ?l list:member ?d . ?x a ?c -> ?x a ?d
cls-uni : ?c owl:unionOf ?l . ?l list:member ?d . ?x a ?d -> ?x a ?c
cls-com : ?c owl:complementOf ?d . ?x a ?c . ?x a ?d -> false
cls-svf1 : ?c owl:someValuesFrom ?d . ?c owl:onProperty ?p . ?x ?p ?y . ?y a ?d -> ?x a ?c
cls-svf2 : ?c owl:someValuesFrom owl:Thing . ?c owl:onProperty ?p . ?x ?p ?y -> ?x a ?c
cls-avf : ?c owl:allValuesFrom ?d . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y -> ?y a ?d
cls-hv1 : ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x a ?c -> ?x ?p ?y
cls-hv2 : ?c owl:hasValue ?y . ?c owl:onProperty ?p . ?x ?p ?y -> ?x a ?c
cls-maxc1 : ?c owl:maxCardinality "0"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y -> false
cls-maxc2 : ?c owl:maxCardinality "1"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?x a ?c . ?x ?p ?y . ?x ?p ?z . ?y != ?z -> ?y owl:sameAs ?z
cls-maxqc1 : ?c owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x a ?c . ?x ?p ?y . ?y a ?d -> false
cls-maxqc2 : ?c owl:maxQualifiedCardinality "0"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x a ?c . ?x ?p ?y -> false
cls-maxqc3 : ?c owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?c owl:onClass ?d . ?x a ?c . ?x ?p ?y . ?y a ?d . ?x ?p ?z . ?z a ?d . ?y != ?z -> ?y owl:sameAs ?z
cls-maxqc4 : ?c owl:maxQualifiedCardinality "1"^^xsd:nonNegativeInteger . ?c owl:onProperty ?p . ?c owl:onClass owl:Thing . ?x a ?c . ?x ?p ?y . ?x ?p ?z . ?y != ?z -> ?y owl:sameAs ?z
cls-oo : ?c owl:oneOf ?l . ?l list:member ?x -> ?x a ?c
cax-sco : ?c rdfs:subClassOf ?d . ?x a ?c -> ?x a ?d
cax-eqc1 : ?c owl:equivalentClass ?d . ?x a ?c -> ?x a ?d
cax-eqc2 : ?c owl:equivalentClass ?d . ?x a ?d -> ?x a ?c
cax-dw : ?c owl:disjointWith ?d . ?x a ?c . ?x a ?d -> false
cax-adc : ?e a owl:AllDisjointClasses . ?e owl:members ?l . ?l list:member ?c . ?l list:member ?d . ?c != ?d . ?x a ?c . ?x a ?d -> false
scm-cls : ?c a owl:Class -> ?c rdfs:subClassOf ?c . ?c owl:equivalentClass ?c . ?c rdfs:subClassOf owl:Thing . owl:Nothing rdfs:subClassOf ?c
scm-sco : ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?e -> ?c rdfs:subClassOf ?e
scm-eqc1 : ?c owl:equivalentClass ?d -> ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c
scm-eqc2 : ?c rdfs:subClassOf ?d . ?d rdfs:subClassOf ?c -> ?c owl:equivalentClass ?d
scm-op : ?p a owl:ObjectProperty -> ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-dp : ?p a owl:DatatypeProperty -> ?p rdfs:subPropertyOf ?p . ?p owl:equivalentProperty ?p
scm-spo : ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?r -> ?p rdfs:subPropertyOf ?r
scm-eqp1 : ?p owl:equivalentProperty ?q -> ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p
scm-eqp2 : ?p rdfs:subPropertyOf ?q . ?q rdfs:subPropertyOf ?p -> ?p owl:equivalentProperty ?q
scm-dom1 : ?p rdfs:domain ?c . ?c rdfs:subClassOf ?d -> ?p rdfs:domain ?d
scm-dom2 : ?q rdfs:domain ?c . ?p rdfs:subPropertyOf ?q -> ?p rdfs:domain ?c
scm-rng1 : ?p rdfs:range ?c . ?c rdfs:subClassOf ?d -> ?p rdfs:range ?d
scm-rng2 : ?q rdfs:range ?c . ?p rdfs:subPropertyOf ?q -> ?p rdfs:range ?c
scm-hv : ?c owl:hasValue ?i . ?c owl:onProperty ?p . ?d owl:hasValue ?i . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?c rdfs:subClassOf ?d
scm-svf1 : ?c owl:someValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?z . ?d owl:onProperty ?p . ?y rdfs:subClassOf ?z -> ?c rdfs:subClassOf ?d
scm-svf2 : ?c owl:someValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:someValuesFrom ?y . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?c rdfs:subClassOf ?d
scm-avf1 : ?c owl:allValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?z . ?d owl:onProperty ?p . ?y rdfs:subClassOf ?z -> ?c rdfs:subClassOf ?d
scm-avf2 : ?c owl:allValuesFrom ?y . ?c owl:onProperty ?p . ?d owl:allValuesFrom ?y . ?d owl:onProperty ?q . ?p rdfs:subPropertyOf ?q -> ?d rdfs:subClassOf ?c
scm-int : ?c owl:intersectionOf ?l . ?l list:member ?d -> ?c rdfs:subClassOf ?d
scm-uni : ?c owl:unionOf ?l . ?l list:member ?d -> ?d rdfs:subClassOf ?c
ext-eq-diff-sym : ?x owl:differentFrom ?y -> ?y owl:differentFrom ?x
""")
#: whole-table rules of OWL 2 RL, as functions of (triples, lists)
WHOLE = ("cls-int1", "prp-spo2", "prp-key")
#: Axioms that hold in any graph.
OWL_AXIOMS = [("I" + OWL + x, "I" + RDF + "type", "I" + OWL + "Class") for x in ("Thing", "Nothing")]


def regime(name: str) -> list[Rule]:
    return {"SIMPLE": [], "RDF": RDF_RULES, "RDFS": RDFS_RULES, "D": RDF_RULES, "OWL-RL": OWL_RULES}[name.upper()]


def implemented_rules(name: str) -> list[str]:
    return [r.name for r in regime(name)] + ([*WHOLE, "dt-not-type"] if name.upper() == "OWL-RL" else [])


def list_members(triples: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(list, pos, item) of every rdf:List that ends at nil, by its first cell; lists that run into a cycle are left out.

    A first cell is one of ``heads``(cell), or if these are not given one that no
    other cell goes on to, or that something other than a cell refers to.  Cells are found by jumps of 1, 2, 4 ... cells, so the
    rounds grow with the logarithm of the longest list; a list that is still
    going after as many cells as there are goes round in a circle.
    """
    nil, rest_of = "I" + RDF + "nil", "I" + RDF + "rest"
    first = triples.where(F.col("p") == "I" + RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("item"))
    rest = write(triples.where(F.col("p") == rest_of).select(F.col("s").alias("cell"), F.col("o").alias("tail")).distinct())
    cells = rest.count()
    if not cells:
        return triples.sparkSession.createDataFrame([], "list string, pos int, item string")
    tails = rest.select(F.col("tail").alias("cell")).distinct()
    some = rest.select("cell").distinct()
    # all other triples are looked at, but only the cells among their objects are kept
    named = triples.where(F.col("p") != rest_of).select(F.col("o").alias("cell")).join(some, "cell", "left_semi").distinct()
    if heads is None:
        heads = some.join(tails, "cell", "left_anti").union(named).distinct()
    else:
        heads = some.join(heads, "cell", "left_semi")
    found = write(heads.select(F.col("cell").alias("list"), "cell", F.lit(0).cast("long").alias("pos")))
    jump, step = rest.where(F.col("tail") != nil), 1
    while step <= cells:
        more = write(found.join(jump, "cell").select("list", F.col("tail").alias("cell"), (F.col("pos") + step).alias("pos")))
        if more.isEmpty():
            break
        found = write(found.union(more).distinct())
        next_ = jump.select(F.col("cell").alias("tail"), F.col("tail").alias("_to"))
        jump, step = write(jump.join(next_, "tail").select("cell", F.col("_to").alias("tail")).distinct()), 2 * step
    # a whole list meets a cell whose rest is nil, and no cell twice
    ends = found.join(rest.where(F.col("tail") == nil), "cell", "left_semi").select("list").distinct()
    circles = found.groupBy("list").agg(F.max("pos").alias("last"), F.count_distinct("cell").alias("n")).where("last >= n").select("list")
    return found.join(ends, "list", "left_semi").join(circles, "list", "left_anti").join(first, "cell").select("list", F.col("pos").cast("int").alias("pos"), "item")


def _may_meet(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Whether some triple can be an instance of both patterns."""
    return all(x.startswith("?") or y.startswith("?") or x == y for x, y in zip(a, b, strict=True))


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in layers: a rule stands above all that can give what it negates.

    ValueError if a rule depends on its own negation.
    """
    if not any(r.negated for r in rules):
        return [rules]
    level = dict.fromkeys(range(len(rules)), 0)
    below = [(i, j, int(negated)) for i, r in enumerate(rules) for negated, atoms in ((False, r.body), (True, r.negated)) for j, q in enumerate(rules) if any(_may_meet(h, x) for h in q.head for x in atoms)]
    changed = True
    while changed:
        changed = False
        for i, j, up in below:
            if level[i] < level[j] + up:
                level[i] = level[j] + up
                changed = True
                if level[i] > len(rules):
                    raise ValueError(f"rule {rules[i].name} depends on its own negation")
    return [[r for i, r in enumerate(rules) if level[i] == k] for k in range(max(level.values(), default=0) + 1)]


def _relevant(rules: list[Rule], triples: DataFrame) -> list[Rule]:
    """The rules whose constant predicates, and classes of type patterns, the data or other rules can supply."""
    wanted = {t[1] for r in rules for t in r.body if not t[1].startswith("?")} | {MEMBER}
    kinds = {t[2] for r in rules for t in r.body if t[1] == "I" + RDF + "type" and not t[2].startswith("?")}
    have = {row[0] for row in triples.where(F.col("p").isin(sorted(wanted))).select("p").distinct().collect()}
    types = {row[0] for row in triples.where((F.col("p") == "I" + RDF + "type") & F.col("o").isin(sorted(kinds))).select("o").distinct().collect()} if kinds else set()
    active: list[Rule] = []
    changed = True
    while changed:
        changed = False
        for r in rules:
            if r in active:
                continue
            if all(t[1].startswith("?") or (t[1] in have and (t[1] != "I" + RDF + "type" or t[2].startswith("?") or t[2] in types or "*" in types)) for t in r.body):
                active.append(r)
                changed = True
                for s, p, o in r.head:
                    have.add(p) if not p.startswith("?") else have.update(wanted - {MEMBER})
                    if p == "I" + RDF + "type" or p.startswith("?"):
                        types.add("*" if o.startswith("?") else o)
    return active


def _match(atom: tuple[str, str, str], table: DataFrame, n: int) -> DataFrame:
    df, columns, seen = table, [], {}
    for c, x in zip("spo", atom, strict=True):
        if not x.startswith("?"):
            df = df.where(F.col(c) == x)
        elif x in seen:
            df = df.where(F.col(c) == F.col(seen[x]))
        else:
            seen[x] = c
            columns.append(F.col(c).alias(x[1:]))
    return df.select(*columns)


def count(triples: DataFrame) -> dict[str, int] | None:
    """The triples of each predicate; None if these are too many."""
    found = triples.groupBy("p").count().limit(MOST + 1).collect()
    return {r["p"]: r["count"] for r in found} if len(found) <= MOST else None


def _known(r: Rule, head: tuple[str, str, str], value) -> list[tuple[set[str], object]]:
    """Conditions, with their variables, that a head is not the instance of a body pattern, which is known already."""
    out = []
    for atom in r.body:
        pairs = [(x, y) for x, y in zip(head, atom, strict=True) if x != y]
        if all(x.startswith("?") or y.startswith("?") for x, y in pairs):
            differs = reduce(lambda a, b: a | b, [value(x) != value(y) for x, y in pairs], F.lit(False))
            out.append(({x[1:] for pair in pairs for x in pair if x.startswith("?")}, differs))
    return out


def _variables(r: Rule) -> list[str]:
    """A rule's variables as a join in the order of its text has them, those compared last in front."""
    names, todo = [], list(r.body)
    while todo:
        atom = next((a for a in todo if {x[1:] for x in a if x.startswith("?")} & set(names)), todo[0])
        todo.remove(atom)
        mine = list(dict.fromkeys(x[1:] for x in atom if x.startswith("?")))
        on = [x for x in mine if x in names]
        names = on + [x for x in names if x not in on] + [x for x in mine if x not in on]
    return names


def _apply(r: Rule, delta: DataFrame, every: DataFrame, everywhere: bool, new: dict[str, int] | None = None, sizes: dict[str, int] | None = None) -> list[DataFrame]:
    """What a rule gives with each body pattern in turn reading the delta.

    ``new`` and ``sizes`` count the triples of each predicate in the delta and in
    all.  Joins begin with the smallest pattern; small ones are broadcast, and the
    predicates that they bind narrow what is read.  Patterns of predicates that
    are not there have nothing to read.
    """
    out = []
    value = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    tests = [({x[1:] for x in pair if x.startswith("?")}, value(pair[0]) != value(pair[1])) for pair in r.different]
    if len(r.head) == 1:
        tests += _known(r, r.head[0], value)
    for i in range(1 if everywhere else len(r.body)):
        reads = lambda j: (delta, new) if j == i and not everywhere else (every, sizes)  # noqa: B023, E731
        size = {}
        for j, (_, p, _) in enumerate(r.body):
            counts = reads(j)[1]
            size[j] = float("inf") if counts is None else sum(counts.values()) if p.startswith("?") else counts.get(p, 0)
        if not all(size.values()):
            continue
        df, rows, todo, waiting = None, 1.0, list(range(len(r.body))), tests[:]
        while todo:
            bound = set(df.columns) if df is not None else set()
            linked = [j for j in todo if df is None or bound & {x[1:] for x in r.body[j] if x.startswith("?")}]
            j = min(linked or todo, key=lambda k: size[k])  # noqa: B023
            todo.remove(j)
            table, p = reads(j)[0], r.body[j][1]
            if df is not None and rows <= FEW and size[j] > FEW and p[1:] in bound and p.startswith("?"):
                found = [row[0] for row in df.select(p[1:]).distinct().limit(MOST + 1).collect()]
                if not found:
                    df = None
                    break
                if len(found) <= MOST:
                    table = table.where(F.col("p").isin(sorted(found)))
            part = _match(r.body[j], table, j)
            on = [c for c in part.columns if c in bound]
            if size[j] <= FEW:
                part = F.broadcast(part)
            if df is None:
                df = part
            else:
                df = (F.broadcast(df) if rows <= FEW < size[j] else df).join(part, on) if on else df.crossJoin(part)
            rows *= size[j]
            for names, condition in waiting:
                if names <= set(df.columns):
                    df = df.where(condition)
            waiting = [t for t in waiting if not t[0] <= set(df.columns)]
        if df is None:
            continue
        for atom in r.negated:
            part = _match(atom, every, -1)
            df = df.join(part, part.columns, "left_anti")
        if len(r.head) == 1:
            s, p, o = r.head[0]
            out.append(df.select(value(s).alias("s"), value(p).alias("p"), value(o).alias("o")))
        elif r.head:
            made = F.explode(F.array(*[F.struct(value(s).alias("s"), value(p).alias("p"), value(o).alias("o")) for s, p, o in r.head]))
            out.append(df.select(made.alias("t")).select("t.*"))
        else:
            picked = [F.col(x) for x in _variables(r)[:3]]
            out.append(df.select(F.lit(r.name).alias("rule"), F.concat_ws(" ", *picked).alias("witness")))
    return out


def _intersections(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """cls-int1: who is in every class of an intersection is in the intersection."""
    parts = triples.where(F.col("p") == "I" + OWL + "intersectionOf").select(F.col("s").alias("c"), F.col("o").alias("list")).join(lists, "list").select("c", F.col("item").alias("d")).distinct()
    size = parts.groupBy("c").agg(F.count("*").alias("n"))
    types = triples.where(F.col("p") == "I" + RDF + "type").select(F.col("s").alias("x"), F.col("o").alias("d"))
    held = types.join(parts, "d").groupBy("x", "c").agg(F.count_distinct("d").alias("n"))
    return held.join(size, ["c", "n"]).select(F.col("x").alias("s"), F.lit("I" + RDF + "type").alias("p"), F.col("c").alias("o"))


def _chains(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """prp-spo2: a chain of properties, one link after another."""
    chain = triples.where(F.col("p") == "I" + OWL + "propertyChainAxiom").select(F.col("s").alias("q"), F.col("o").alias("list")).join(lists, "list").select("q", "list", "pos", F.col("item").alias("link"))
    length = chain.groupBy("q", "list").agg(F.max("pos").alias("last"))
    links = write(triples.join(chain.select(F.col("link").alias("p")).distinct(), "p", "left_semi"))
    most = length.agg(F.max("last")).first()[0]
    empty = triples.select("s", "p", "o").limit(0)
    if most is None:
        return empty
    step = chain.where("pos = 0").join(links, F.col("link") == F.col("p")).select("q", "list", F.col("s").alias("x"), F.col("o").alias("y"))
    out = []
    for k in range(most + 1):
        if k:
            here = chain.where(F.col("pos") == k).select("q", "list", "link").join(links, F.col("link") == F.col("p")).select("q", "list", F.col("s").alias("y"), F.col("o").alias("z"))
            step = step.join(here, ["q", "list", "y"]).select("q", "list", "x", F.col("z").alias("y")).distinct()
        out.append(step.join(length.where(F.col("last") == k), ["q", "list"]).select(F.col("x").alias("s"), F.col("q").alias("p"), F.col("y").alias("o")))
    return reduce(DataFrame.union, out)


def _keys(triples: DataFrame, lists: DataFrame) -> DataFrame:
    """prp-key: instances of a class that agree on all its key properties are the same."""
    keys = triples.where(F.col("p") == "I" + OWL + "hasKey").select(F.col("s").alias("c"), F.col("o").alias("list")).join(lists, "list").select("c", "list", F.col("item").alias("p"))
    size = keys.groupBy("c", "list").agg(F.count_distinct("p").alias("n"))
    types = triples.where(F.col("p") == "I" + RDF + "type").select(F.col("s").alias("s"), F.col("o").alias("c"))
    held = triples.join(keys, "p").join(types, ["s", "c"]).select("c", "list", "s", "p", "o")
    other = held.withColumnRenamed("s", "t")
    same = held.join(other, ["c", "list", "p", "o"]).where("s <> t").groupBy("c", "list", "s", "t").agg(F.count_distinct("p").alias("n"))
    return same.join(size, ["c", "list", "n"]).select("s", F.lit("I" + OWL + "sameAs").alias("p"), F.col("t").alias("o"))


def closure(triples: DataFrame, rules: list[Rule], owl: bool = False, stored: bool = False) -> DataFrame:
    """The closure of a table s, p, o, list members included; with negation, layer by layer, so that what is negated is complete.

    A table that is not ``stored`` is written first.  It is read as it is and made
    a set where it is used, since only some of its predicates may be.
    """
    triples = triples.select("s", "p", "o")
    base, deltas = [triples if stored else write(triples)], []
    sizes = count(base[0])
    for layer in strata([r for r in rules if r.head]):
        sizes = _closure(base, deltas, layer, owl, sizes)
    return reduce(DataFrame.union, [reduce(DataFrame.union, base).distinct(), *deltas])


def missing(found: DataFrame, every: DataFrame) -> tuple[DataFrame, dict[str, int] | None]:
    """The rows of found that are not among all, as a set, and their number by predicate; of all only found's predicates are read."""
    found = write(found.distinct())
    counts = count(found)
    if counts is not None:
        every = every.where(F.col("p").isin(sorted(counts)))
    same = reduce(lambda a, b: a & b, [found[c].eqNullSafe(every[c]) if c == "g" else found[c] == every[c] for c in found.columns])
    delta = write(found.join(every, same, "left_anti"))
    return delta, count(delta)


def _closure(base: list[DataFrame], deltas: list[DataFrame], rules: list[Rule], owl: bool, sizes: dict[str, int] | None) -> dict[str, int] | None:
    """Adds to ``deltas`` what rules give; what is there already may repeat rows, what is added does not."""
    added = lambda a, b: None if a is None or b is None else {p: a.get(p, 0) + b.get(p, 0) for p in {*a, *b}}
    every = delta = reduce(DataFrame.union, base + deltas)
    lists = None
    if owl:
        lists = write(list_members(every))
        extra = every.sparkSession.createDataFrame(OWL_AXIOMS, "s string, p string, o string")
        extra = write(extra.union(lists.select(F.col("list").alias("s"), F.lit(MEMBER).alias("p"), F.col("item").alias("o"))).distinct())
        base.append(extra)
        sizes = added(sizes, count(extra))
        every = delta = reduce(DataFrame.union, base + deltas)
    active = [r for r in _relevant(rules, every) if r.head]
    present = {row[0] for row in every.where(F.col("p").isin("I" + OWL + "intersectionOf", "I" + OWL + "propertyChainAxiom", "I" + OWL + "hasKey")).select("p").distinct().collect()} if owl else set()
    whole = [f for name, f in (("intersectionOf", _intersections), ("propertyChainAxiom", _chains), ("hasKey", _keys)) if "I" + OWL + name in present]
    new, first = sizes, True
    while True:
        # at first all is new, and each rule runs once
        made = [df for r in active for df in _apply(r, delta, every, first, new, sizes)] + [f(every, lists) for f in whole]
        if not made:
            return sizes
        found = reduce(DataFrame.unionByName, made)
        # a literal is no subject, and only IRIs are predicates
        found = found.where(~is_kind(Val("term", F.col("s")), "L") & is_kind(Val("term", F.col("p")), "I"))
        delta, new = missing(found, every)
        if new == {}:
            return sizes
        first = False
        sizes = added(sizes, new)
        deltas.append(delta)
        every = reduce(DataFrame.union, base + deltas)


def materialise(quads: DataFrame, name: str, rules: list[Rule | str] | None = None, stored: bool = False) -> DataFrame:
    """The closure of the default graph's triples under a regime and further rules; named graphs stay."""
    triples = quads.where(F.col("g").isNull()).select("s", "p", "o")
    own = [rule(f"rule{i}", r) if isinstance(r, str) else r for i, r in enumerate(rules or [])]
    closed = closure(triples, regime(name) + own, name.upper() == "OWL-RL", stored).where(F.col("p") != MEMBER)
    return closed.withColumn("g", F.lit(None).cast("string")).unionByName(quads.where(F.col("g").isNotNull()))


def clashes(quads: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(rule, witness) of the inconsistencies in a closure."""
    triples = quads.where(F.col("g").isNull()).select("s", "p", "o")
    lists = write(list_members(triples))
    triples = write(triples.union(lists.select(F.col("list").alias("s"), F.lit(MEMBER).alias("p"), F.col("item").alias("o"))))
    found = [df for r in _relevant(rules or OWL_RULES, triples) if not r.head for df in _apply(r, triples, triples, True)]
    # dt-not-type: a literal outside its datatype
    o = Val("term", F.col("o"))
    kind = F.substring_index(F.col("o"), US, 1)
    for name in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "decimal", "double", "float", "boolean", "date", "dateTime"):
        bad = (kind == f"Lx:{name}") & ~well_formed(o, XSD + name)
        found.append(triples.where(bad).select(F.lit("dt-not-type").alias("rule"), code(o).alias("witness")))
    return reduce(DataFrame.unionByName, found).distinct()
