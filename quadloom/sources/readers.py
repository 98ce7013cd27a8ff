"""RDF files to quads of codes.

Line formats (N-Triples, N-Quads, HexTuples) are read by line, so a file splits
over tasks.  The others are one document each: a file is one task's work, and
files are spread over tasks.  Blank nodes get the file's name in their labels,
so those of different files never meet.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import RDF, XSD, Blank, IRI, Literal, Triple, encode
from .quads import SCHEMA

MEDIA = {
    "nt": "ntriples", "nq": "nquads", "ttl": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "trix": "trix", "hext": "hextuples", "jsonld": "jsonld", "yamlld": "yamlld",
    "application/n-triples": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/trig": "trig", "application/rdf+xml": "rdfxml", "application/trix": "trix",
    "application/x-ndjson": "hextuples", "application/ld+json": "jsonld", "application/ld+yaml": "yamlld", "parquet": "columnar",
}


class BadSyntax(ValueError):
    """A file is not what its media type says."""


def media_of(path: str, media: str | None) -> str:
    name = media or path.rstrip("/*").rsplit(".", 1)[-1]
    if name in MEDIA.values():
        return name
    if name not in MEDIA:
        raise BadSyntax(f"no reader for {name}")
    return MEDIA[name]


def read(spark: SparkSession, path: str, media: str | None = None) -> DataFrame:
    """The quads of a file, a folder or a pattern."""
    kind = media_of(path, media)
    if kind == "columnar":
        from .columnar import read_tables

        return read_tables(spark, path)
    if kind in ("ntriples", "nquads", "hextuples"):
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
        parse: Callable[[str, str], Iterable] = hextuple if kind == "hextuples" else quad_line
    else:
        lines = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
        parse = PARSERS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for text, file in zip(part["value"], part["file"], strict=True) for row in parse(text, hashlib.sha1(file.encode()).hexdigest()[:8])]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "g"])

    return lines.mapInPandas(run, SCHEMA).distinct()


def parse(text: str, kind: str, scope: str = "d", base: str = "") -> list[tuple]:
    """The coded quads of one text."""
    if kind in ("ntriples", "nquads"):
        return [q for line in text.splitlines() for q in quad_line(line, scope)]
    if kind == "hextuples":
        return [q for line in text.splitlines() for q in hextuple(line, scope)]
    return list(PARSERS[kind](text, scope, base) if kind in ("turtle", "trig") else PARSERS[kind](text, scope))


# N-Triples and N-Quads
_T = re.compile(r'\s*(?:<(?P<iri>[^<>\x00-\x20]*)>|_:(?P<blank>[\w](?:[\w.\-·]*[\w\-·])?)|"(?P<lex>(?:[^"\\]|\\.)*)"(?:@(?P<lang>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)(?:--(?P<dir>ltr|rtl))?|\^\^<(?P<dt>[^<>\x00-\x20]*)>)?|(?P<open><<\()|(?P<end>\.))')
_ESC = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESC[m[1]], s) if "\\" in s else s


def _term(line: str, at: int, scope: str) -> tuple[object, int]:
    m = _T.match(line, at)
    if not m:
        raise BadSyntax(f"at {line[at : at + 40]!r}")
    if m["iri"] is not None:
        return IRI(unescape(m["iri"])), m.end()
    if m["blank"]:
        return Blank(f"{scope}_{m['blank']}"), m.end()
    if m["lex"] is not None:
        lang, way = m["lang"] or "", m["dir"] or ""
        return Literal(unescape(m["lex"]), unescape(m["dt"]) if m["dt"] else RDF + ("dirLangString" if way else "langString") if lang else XSD + "string", lang.lower(), way), m.end()
    if m["open"]:
        s, at = _term(line, m.end(), scope)
        p, at = _term(line, at, scope)
        o, at = _term(line, at, scope)
        close = re.compile(r"\s*\)>>").match(line, at)
        if not close:
            raise BadSyntax("a triple term has no end")
        return Triple(s, p, o), close.end()
    return None, m.end()


def quad_line(line: str, scope: str) -> list[tuple]:
    text = line.strip()
    if not text or text.startswith("#") or text.upper().startswith("VERSION"):
        return []
    terms, at = [], 0
    while True:
        t, at = _term(text, at, scope)
        if t is None:
            break
        terms.append(encode(t))
    if len(terms) not in (3, 4):
        raise BadSyntax(line)
    return [(*terms, None) if len(terms) == 3 else tuple(terms)]


def hextuple(line: str, scope: str) -> list[tuple]:
    if not line.strip():
        return []
    s, p, value, datatype, lang, g = json.loads(line)
    node = lambda x: Blank(f"{scope}_{x[2:]}") if x.startswith("_:") else IRI(x)
    if datatype == "globalId":
        o: object = IRI(value)
    elif datatype == "localId":
        o = node(value)
    else:
        o = Literal(value, datatype, lang.lower())
    return [(encode(node(s)), encode(IRI(p)), encode(o), encode(node(g)) if g else None)]


# Turtle and TriG
_TTL = re.compile(
    r"""(?P<skip>\s+|\#[^\n\r]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*(?:--[a-z]+)?)|(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-·]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z]+)|(?P<op><<\(|\)>>|<<|>>|\{\||\|\}|\^\^|[{}()\[\];,.~])""",
    re.X,
)


class Turtle:
    """A recursive reader of Turtle and TriG."""

    def __init__(self, text: str, scope: str, base: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TTL.match(text, at)
            if not m:
                raise BadSyntax(f"cannot read {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i, self.scope, self.base, self.prefixes, self.n = 0, scope, base, {}, 0
        self.out: list[tuple] = []
        self.graph: object = None

    def peek(self) -> str:
        return self.tokens[self.i][1]

    def take(self, *ops: str) -> bool:
        if self.tokens[self.i][1] in ops and self.tokens[self.i][0] in ("op", "word", "lang"):
            self.i += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise BadSyntax(f"expected {op} and found {self.peek()!r}")

    def fresh(self) -> Blank:
        self.n += 1
        return Blank(f"{self.scope}_a{self.n}")

    def iri(self) -> str:
        from urllib.parse import urljoin

        k, v = self.tokens[self.i]
        self.i += 1
        if k == "iri":
            v = unescape(v[1:-1])
            return v if re.match(r"[A-Za-z][\w+.-]*:", v) or not self.base else urljoin(self.base, v)
        if k == "name":
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                raise BadSyntax(f"no prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise BadSyntax(f"expected an IRI and found {v!r}")

    def read(self) -> list[tuple]:
        while self.tokens[self.i][0] != "end":
            k, v = self.tokens[self.i]
            if v.lower() in ("@prefix", "prefix"):
                self.i += 1
                name = self.tokens[self.i][1][:-1]
                self.i += 1
                self.prefixes[name] = self.iri()
                self.take(".")
            elif v.lower() in ("@base", "base"):
                self.i += 1
                self.base = self.iri()
                self.take(".")
            elif v.lower() in ("@version", "version"):
                self.i += 2
                self.take(".")
            elif v == "{" or v.upper() == "GRAPH" or (k in ("iri", "name", "blank") and self.tokens[self.i + 1][1] == "{") or (v == "[" and self.tokens[self.i + 1][1] == "]" and self.tokens[self.i + 2][1] == "{"):
                self.block()
            else:
                self.triples()
                self.need(".")
        return [tuple(encode(x) if x is not None else None for x in q) for q in self.out]

    def block(self) -> None:
        if self.peek().upper() == "GRAPH":
            self.i += 1
        self.graph = None if self.peek() == "{" else self.term()
        self.need("{")
        while not self.take("}"):
            self.triples()
            self.take(".")
        self.graph = None

    def emit(self, s: object, p: object, o: object) -> None:
        self.out.append((s, p, o, self.graph))

    def triples(self) -> None:
        alone = self.peek() in ("[", "<<")
        s = self.term()
        if alone and self.peek() in (".", "}"):
            return
        self.predicates(s)

    def predicates(self, s: object) -> None:
        while True:
            k, v = self.tokens[self.i]
            if k == "word" and v == "a":
                self.i += 1
                p: object = IRI(RDF + "type")
            else:
                p = IRI(self.iri())
            while True:
                o = self.term()
                self.emit(s, p, o)
                self.annotations(s, p, o)
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek() in (".", "]", "}", "|}", ""):
                return

    def annotations(self, s: object, p: object, o: object) -> None:
        r = None
        while self.peek() in ("~", "{|"):
            if self.take("~"):
                r = self.term() if self.tokens[self.i][0] in ("iri", "name", "blank") else self.fresh()
                self.emit(r, IRI(RDF + "reifies"), Triple(s, p, o))
            else:
                self.need("{|")
                if r is None:
                    r = self.fresh()
                    self.emit(r, IRI(RDF + "reifies"), Triple(s, p, o))
                self.predicates(r)
                self.need("|}")
                r = None

    def verb(self) -> object:
        if self.tokens[self.i] == ("word", "a"):
            self.i += 1
            return IRI(RDF + "type")
        return IRI(self.iri())

    def term(self) -> object:
        k, v = self.tokens[self.i]
        if k in ("iri", "name"):
            return IRI(self.iri())
        self.i += 1
        if k == "blank":
            return Blank(f"{self.scope}_{v[2:]}")
        if k in ("string", "long"):
            q = 3 if k == "long" else 1
            lex = unescape(v[q:-q])
            k2, v2 = self.tokens[self.i]
            if k2 == "lang":
                self.i += 1
                lang, _, way = v2[1:].partition("--")
                return Literal(lex, RDF + ("dirLangString" if way else "langString"), lang.lower(), way)
            if self.take("^^"):
                return Literal(lex, self.iri())
            return Literal(lex)
        if k == "number":
            return Literal(v, XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if k == "word" and v in ("true", "false"):
            return Literal(v, XSD + "boolean")
        if v == "[":
            b = self.fresh()
            if self.peek() != "]":
                self.predicates(b)
            self.need("]")
            return b
        if v == "(":
            items = []
            while not self.take(")"):
                items.append(self.term())
            head: object = IRI(RDF + "nil")
            for x in reversed(items):
                b = self.fresh()
                self.emit(b, IRI(RDF + "first"), x)
                self.emit(b, IRI(RDF + "rest"), head)
                head = b
            return head
        if v == "<<(":
            s, p, o = self.term(), self.verb(), self.term()
            self.need(")>>")
            return Triple(s, p, o)
        if v == "<<":
            s, p, o = self.term(), self.verb(), self.term()
            r = self.term() if self.take("~") and self.peek() != ">>" else self.fresh()
            self.need(">>")
            self.emit(r, IRI(RDF + "reifies"), Triple(s, p, o))
            return r
        raise BadSyntax(f"no term at {v!r}")


def turtle(text: str, scope: str, base: str = "") -> list[tuple]:
    return Turtle(text, scope, base).read()


# RDF/XML and TriX
def rdfxml(text: str, scope: str) -> list[tuple]:
    from urllib.parse import urljoin
    from xml.etree import ElementTree as ET

    XML = "{http://www.w3.org/XML/1998/namespace}"
    out: list[tuple] = []
    count = 0

    def fresh() -> Blank:
        nonlocal count
        count += 1
        return Blank(f"{scope}_x{count}")

    iri = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag
    r = lambda name: "{" + RDF + "}" + name

    def node(e, base: str, lang: str) -> object:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        if e.get(r("about")) is not None:
            s: object = IRI(urljoin(base, e.get(r("about"))))
        elif e.get(r("ID")) is not None:
            s = IRI(urljoin(base, "#" + e.get(r("ID"))))
        elif e.get(r("nodeID")) is not None:
            s = Blank(f"{scope}_{e.get(r('nodeID'))}")
        else:
            s = fresh()
        if e.tag != r("Description"):
            out.append((s, IRI(RDF + "type"), IRI(iri(e.tag)), None))
        attributes(e, s, base, lang)
        n = 0
        for c in e:
            n += c.tag == r("li")
            prop(c, s, IRI(RDF + f"_{n}") if c.tag == r("li") else IRI(iri(c.tag)), base, lang)
        return s

    def attributes(e, s: object, base: str, lang: str) -> bool:
        found = False
        for k, v in e.attrib.items():
            if k.startswith(XML) or k in map(r, ("about", "ID", "nodeID", "resource", "parseType", "datatype", "annotation", "annotationNodeID")):
                continue
            found = True
            if k == r("type"):
                out.append((s, IRI(RDF + "type"), IRI(urljoin(base, v)), None))
            else:
                out.append((s, IRI(iri(k)), Literal(v, RDF + "langString", lang.lower()) if lang else Literal(v), None))
        return found

    def prop(e, s: object, p: IRI, base: str, lang: str) -> None:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        kind = e.get(r("parseType"))
        if e.get(r("resource")) is not None:
            o: object = IRI(urljoin(base, e.get(r("resource"))))
            attributes(e, o, base, lang)
        elif e.get(r("nodeID")) is not None:
            o = Blank(f"{scope}_{e.get(r('nodeID'))}")
            attributes(e, o, base, lang)
        elif kind == "Resource":
            o = fresh()
            n = 0
            for c in e:
                n += c.tag == r("li")
                prop(c, o, IRI(RDF + f"_{n}") if c.tag == r("li") else IRI(iri(c.tag)), base, lang)
        elif kind == "Collection":
            o = IRI(RDF + "nil")
            for item in reversed([node(c, base, lang) for c in e]):
                b = fresh()
                out.append((b, IRI(RDF + "first"), item, None))
                out.append((b, IRI(RDF + "rest"), o, None))
                o = b
        elif kind is not None:
            o = Literal((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), RDF + "XMLLiteral")
        elif len(e):
            o = node(e[0], base, lang)
        else:
            blank = fresh()
            if attributes(e, blank, base, lang):
                o = blank
            else:
                text_ = e.text or ""
                o = Literal(text_, urljoin(base, e.get(r("datatype")))) if e.get(r("datatype")) else Literal(text_, RDF + "langString", lang.lower()) if lang else Literal(text_)
        out.append((s, p, o, None))
        if e.get(r("ID")) is not None:
            stmt = IRI(urljoin(base, "#" + e.get(r("ID"))))
            for name, x in (("type", IRI(RDF + "Statement")), ("subject", s), ("predicate", p), ("object", o)):
                out.append((stmt, IRI(RDF + name), x, None))

    root = ET.fromstring(text)
    base, lang = root.get(XML + "base", ""), root.get(XML + "lang", "")
    for e in root if root.tag == r("RDF") else [root]:
        node(e, base, lang)
    return [tuple(encode(x) if x is not None else None for x in q) for q in out]


def trix(text: str, scope: str) -> list[tuple]:
    from xml.etree import ElementTree as ET

    XML = "{http://www.w3.org/XML/1998/namespace}"
    name = lambda e: e.tag.rsplit("}", 1)[-1]

    def term(e) -> object:
        match name(e):
            case "uri":
                return IRI((e.text or "").strip())
            case "id":
                return Blank(f"{scope}_{(e.text or '').strip()}")
            case "plainLiteral":
                lang = e.get(XML + "lang", "")
                return Literal(e.text or "", RDF + "langString", lang.lower()) if lang else Literal(e.text or "")
            case "typedLiteral":
                return Literal(e.text or "", e.get("datatype"))
            case "triple":
                return Triple(*map(term, e))
        raise BadSyntax(e.tag)

    out = []
    for g in ET.fromstring(text):
        graph = None
        for e in g:
            if name(e) == "triple":
                out.append((*map(encode, map(term, e)), encode(graph) if graph is not None else None))
            else:
                graph = term(e)
    return out


# JSON-LD, expanded by its context
def jsonld(text: str, scope: str) -> list[tuple]:
    return _jsonld(json.loads(text), scope)


def yamlld(text: str, scope: str) -> list[tuple]:
    try:
        import yaml
    except ImportError as e:
        raise BadSyntax("YAML-LD needs a YAML library") from e
    return _jsonld(yaml.safe_load(text), scope)


def _jsonld(doc: object, scope: str) -> list[tuple]:
    out: list[tuple] = []
    count = 0

    def fresh() -> Blank:
        nonlocal count
        count += 1
        return Blank(f"{scope}_j{count}")

    def context(ctx: dict, new: object) -> dict:
        if new is None:
            return {}
        for part in new if isinstance(new, list) else [new]:
            if isinstance(part, str):
                raise BadSyntax(f"a remote context: {part}")
            ctx = ctx | (part or {})
        return ctx

    def expand(name: str, ctx: dict, vocab: bool = True) -> str:
        if name.startswith("@") or name.startswith("_:"):
            return name
        if vocab and name in ctx:
            d = ctx[name]
            d = d.get("@id", "") if isinstance(d, dict) else d
            return expand(d, {k: v for k, v in ctx.items() if k != name}) if d else d
        prefix, colon, rest = name.partition(":")
        if colon and prefix in ctx and not rest.startswith("//"):
            return expand(prefix, ctx) + rest
        if colon:
            return name
        if vocab:
            return ctx.get("@vocab", "") + name if ctx.get("@vocab") else ""
        from urllib.parse import urljoin

        return urljoin(ctx.get("@base", ""), name)

    def ref(x: str) -> object:
        return Blank(f"{scope}_{x[2:]}") if x.startswith("_:") else IRI(x)

    def literal(v: object, kind: str | None, lang: str = "", way: str = "") -> Literal:
        if lang:
            return Literal(str(v), RDF + ("dirLangString" if way else "langString"), lang.lower(), way)
        if isinstance(v, bool):
            return Literal(str(v).lower(), kind or XSD + "boolean")
        if isinstance(v, int) or (isinstance(v, float) and v.is_integer() and abs(v) < 1e21 and kind != XSD + "double"):
            return Literal(str(int(v)), kind or XSD + "integer")
        if isinstance(v, float):
            m, e = f"{v:.15E}".split("E")
            return Literal((m.rstrip("0") + ("0" if m.rstrip("0").endswith(".") else "")) + "E" + str(int(e)), kind or XSD + "double")
        return Literal(str(v), kind or XSD + "string")

    def value(v: object, ctx: dict, d: dict, g: object) -> object | None:
        if isinstance(v, dict):
            if "@context" in v:
                ctx = context(ctx, v["@context"])
            keys = {expand(k, ctx): k for k in v}
            if "@value" in keys:
                x = v[keys["@value"]]
                if x is None:
                    return None
                kind = v.get(keys.get("@type", ""), None)
                if kind == "@json":
                    return Literal(json.dumps(x, sort_keys=True, separators=(",", ":")), RDF + "JSON")
                return literal(x, expand(kind, ctx) if kind else None, v.get(keys.get("@language", ""), "") or "", v.get(keys.get("@direction", ""), "") or "")
            if "@list" in keys:
                return collection(v[keys["@list"]], ctx, d, g)
            return node(v, ctx, g)
        kind = d.get("@type")
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return ref(expand(v, ctx, vocab=kind == "@vocab"))
        if v is None:
            return None
        lang = d.get("@language", ctx.get("@language")) if isinstance(v, str) and not kind else None
        return literal(v, expand(kind, ctx) if kind and kind not in ("@none", "@id", "@vocab") else None, lang or "")

    def collection(xs: object, ctx: dict, d: dict, g: object) -> object:
        head: object = IRI(RDF + "nil")
        for x in reversed(xs if isinstance(xs, list) else [xs]):
            item = value(x, ctx, d, g)
            if item is not None:
                b = fresh()
                out.append((b, IRI(RDF + "first"), item, g))
                out.append((b, IRI(RDF + "rest"), head, g))
                head = b
        return head

    def node(n: dict, ctx: dict, g: object) -> object:
        if "@context" in n:
            ctx = context(ctx, n["@context"])
        keys = {k: expand(k, ctx) for k in n}
        ident = next((n[k] for k, e in keys.items() if e == "@id"), None)
        s = ref(expand(ident, ctx, vocab=False)) if ident is not None else fresh()
        for k, e in keys.items():
            v = n[k]
            d = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            many = v if isinstance(v, list) else [v]
            if e == "@type":
                for x in many:
                    out.append((s, IRI(RDF + "type"), ref(expand(x, ctx)), g))
            elif e == "@graph":
                for x in many:
                    node(x, ctx, s if len(n) > ("@context" in n) + 1 else g)
            elif e == "@reverse":
                for kk, vv in v.items():
                    for x in vv if isinstance(vv, list) else [vv]:
                        out.append((value(x, ctx, {"@type": "@id"}, g), IRI(expand(kk, ctx)), s, g))
            elif e == "@included":
                for x in many:
                    node(x, ctx, g)
            elif e and not e.startswith("@"):
                if "@reverse" in d:
                    for x in many:
                        out.append((value(x, ctx, {"@type": "@id"}, g), IRI(expand(d["@reverse"], ctx)), s, g))
                    continue
                box = d.get("@container")
                if box == "@list":
                    out.append((s, IRI(e), collection(v, ctx, d, g), g))
                elif box == "@language" and isinstance(v, dict):
                    for lang, xs in v.items():
                        for x in xs if isinstance(xs, list) else [xs]:
                            out.append((s, IRI(e), literal(x, None, "" if lang == "@none" else lang), g))
                elif box in ("@index", "@id") and isinstance(v, dict):
                    for kk, xs in v.items():
                        for x in xs if isinstance(xs, list) else [xs]:
                            o = value({"@id": kk} | x if box == "@id" else x, ctx, d, g)
                            out.append((s, IRI(e), o, g))
                else:
                    for x in many:
                        xs = x["@set"] if isinstance(x, dict) and "@set" in x else [x]
                        for y in xs if isinstance(xs, list) else [xs]:
                            o = value(y, ctx, d, g)
                            if o is not None:
                                out.append((s, IRI(e), o, g))
        return s

    for n in doc if isinstance(doc, list) else [doc]:
        node(n, {}, None)
    return [tuple(encode(x) if x is not None else None for x in q) for q in out]


PARSERS: dict[str, Callable] = {"turtle": turtle, "trig": turtle, "rdfxml": rdfxml, "trix": trix, "jsonld": jsonld, "yamlld": yamlld}
