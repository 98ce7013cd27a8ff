"""RDF terms, and the string code by which a DataFrame holds a term of any kind.

A code is unique to its term, so term identity is string equality: joins,
grouping and DISTINCT need nothing else.

==========  =============================================
IRI         ``I`` iri
blank node  ``B`` label
literal     ``L`` datatype US language US lexical form
triple      ``T`` subject RS predicate RS object
==========  =============================================

US and RS are the ASCII unit and record separators; the lexical form and the
object come last and may hold anything.  Datatypes of XML Schema are shortened
to ``x:`` and the local name.  A language is in lower case, followed by ``--``
and the base direction if there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

US, RS = "\x1f", "\x1e"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
LANG_STRING, DIR_STRING = RDF + "langString", RDF + "dirLangString"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    lex: str
    datatype: str = XSD + "string"
    lang: str = ""
    direction: str = ""


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


def short(datatype: str) -> str:
    return "x:" + datatype[len(XSD) :] if datatype.startswith(XSD) else datatype


def full(datatype: str) -> str:
    return XSD + datatype[2:] if datatype.startswith("x:") else datatype


def encode(t: object) -> str:
    """The code of a term."""
    if isinstance(t, IRI):
        return "I" + t.value
    if isinstance(t, Blank):
        return "B" + t.label
    if isinstance(t, Literal):
        lang = t.lang.lower() + ("--" + t.direction if t.direction else "")
        return f"L{short((DIR_STRING if t.direction else LANG_STRING) if t.lang else t.datatype)}{US}{lang}{US}{t.lex}"
    if isinstance(t, Triple):
        return f"T{encode(t.s)}{RS}{encode(t.p)}{RS}{encode(t.o)}"
    raise TypeError(t)


def decode(code: str) -> object:
    """The term of a code."""
    kind, rest = code[0], code[1:]
    if kind == "I":
        return IRI(rest)
    if kind == "B":
        return Blank(rest)
    if kind == "L":
        datatype, lang, lex = rest.split(US, 2)
        lang, _, direction = lang.partition("--")
        return Literal(lex, full(datatype), lang, direction)
    s, p, o = rest.split(RS, 2)
    return Triple(decode(s), decode(p), decode(o))


def integer(n: int) -> Literal:
    return Literal(str(n), XSD + "integer")


def n3(t: object) -> str:
    """The term in N-Triples syntax."""
    if isinstance(t, IRI):
        return "<" + "".join(f"\\u{ord(c):04X}" if c <= " " or c in '<>"{}|^`\\' else c for c in t.value) + ">"
    if isinstance(t, Blank):
        return "_:" + t.label
    if isinstance(t, Triple):
        return f"<<( {n3(t.s)} {n3(t.p)} {n3(t.o)} )>>"
    lex = t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    if t.lang:
        return f'"{lex}"@{t.lang}' + (f"--{t.direction}" if t.direction else "")
    return f'"{lex}"' + ("" if t.datatype == XSD + "string" else f"^^<{t.datatype}>")
