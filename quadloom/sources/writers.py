"""Quads to RDF files, the same bytes for the same quads."""

from __future__ import annotations

import json
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Val, datatype, is_kind, language, lexical
from ..terms import RDF, XSD, Blank, IRI, Literal, Triple, decode, n3


def term_text(c: Column) -> Column:
    """N-Triples syntax of codes, by Spark functions; triple terms nest by way of a UDF."""
    v = Val("term", c)
    lex = lexical(c)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), lex, F.lit('"'))
    d, lang = datatype(v), language(v)
    iri = F.when(d.startswith("x:"), F.concat(F.lit(XSD), F.substr(d, F.lit(3)))).otherwise(d)
    literal = F.when(lang != "", F.concat(quoted, F.lit("@"), lang)).when(d == "x:string", quoted).otherwise(F.concat(quoted, F.lit("^^<"), iri, F.lit(">")))
    rest = F.substr(c, F.lit(2))
    nested = F.udf(lambda code: n3(decode(code)) if code else None)
    return F.when(is_kind(v, "I"), F.concat(F.lit("<"), rest, F.lit(">"))).when(is_kind(v, "B"), F.concat(F.lit("_:"), rest)).when(is_kind(v, "L"), literal).when(is_kind(v, "T"), nested(F.when(is_kind(v, "T"), c)))


def lines(quads: DataFrame) -> DataFrame:
    """One N-Quads line for each quad, sorted."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), term_text(F.col("g")))).otherwise(F.lit(""))
    line = F.concat(term_text(F.col("s")), F.lit(" "), term_text(F.col("p")), F.lit(" "), term_text(F.col("o")), g, F.lit(" ."))
    return quads.select(line.alias("value")).orderBy("value")


def write(quads: DataFrame, path: str, media: str = "nquads") -> None:
    """N-Triples and N-Quads are written by all tasks; the other formats are one text from sorted quads."""
    if media in ("ntriples", "nquads"):
        lines(quads if media == "nquads" else quads.withColumn("g", F.lit(None).cast("string"))).write.text(path)
        return
    if media == "columnar":
        from .columnar import write_tables

        write_tables(quads, path)
        return
    if media == "hextuples":
        rows = quads.orderBy("g", "s", "p", "o")
        to_line = F.udf(lambda s, p, o, g: hextuple(*(decode(x) if x else None for x in (s, p, o, g))))
        rows.select(to_line("s", "p", "o", "g").alias("value")).write.text(path)
        return
    text = serialise((tuple(decode(x) if x else None for x in row) for row in quads.select("s", "p", "o", "g").orderBy("g", "s", "p", "o").toLocalIterator()), media)
    quads.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "").text(path)


def hextuple(s, p, o, g) -> str:
    ref = lambda x: "_:" + x.label if isinstance(x, Blank) else x.value
    if isinstance(o, Literal):
        value, kind, lang = o.lex, o.datatype, o.lang
    else:
        value, kind, lang = ref(o), "localId" if isinstance(o, Blank) else "globalId", ""
    return json.dumps([ref(s), p.value, value, kind, lang, ref(g) if g is not None else ""], ensure_ascii=False, separators=(",", ":"))


def serialise(quads: Iterable[tuple], media: str) -> str:
    """Sorted quads of terms as one text."""
    by_graph: dict[object, list[tuple]] = {}
    for s, p, o, *g in quads:
        by_graph.setdefault(g[0] if g else None, []).append((s, p, o))
    if media in ("turtle", "trig"):
        if media == "turtle":
            by_graph = {None: [t for ts in by_graph.values() for t in ts]}
        return "".join(_turtle(ts) if g is None else f"{n3(g)} {{\n{_turtle(ts)}}}\n" for g, ts in by_graph.items())
    if media == "rdfxml":
        return _rdfxml(t for ts in by_graph.values() for t in ts)
    if media == "trix":
        return _trix(by_graph)
    if media == "jsonld":
        return json.dumps(_jsonld(by_graph), indent=1, ensure_ascii=False, sort_keys=True)
    raise ValueError(f"no writer for {media}")


def _turtle(triples: list[tuple]) -> str:
    out, subject, predicate = [], None, None
    for s, p, o in triples:
        verb = "a" if p == IRI(RDF + "type") else n3(p)
        if s != subject:
            out.append((" .\n" if out else "") + f"{n3(s)} {verb} {n3(o)}")
        elif p != predicate:
            out.append(f" ;\n    {verb} {n3(o)}")
        else:
            out.append(f" , {n3(o)}")
        subject, predicate = s, p
    return "".join(out) + (" .\n" if out else "")


def _rdfxml(triples: Iterable[tuple]) -> str:
    out = ['<?xml version="1.0" encoding="utf-8"?>\n', f'<rdf:RDF xmlns:rdf="{RDF}">\n']
    for s, p, o in triples:
        about = f"rdf:nodeID={quoteattr(s.label)}" if isinstance(s, Blank) else f"rdf:about={quoteattr(s.value)}"
        cut = max(p.value.rfind("#"), p.value.rfind("/")) + 1
        tag = f"p:{p.value[cut:]} xmlns:p={quoteattr(p.value[:cut])}"
        name = tag.split(" ", 1)[0]
        if isinstance(o, IRI):
            body = f"<{tag} rdf:resource={quoteattr(o.value)}/>"
        elif isinstance(o, Blank):
            body = f"<{tag} rdf:nodeID={quoteattr(o.label)}/>"
        elif isinstance(o, Triple):
            raise ValueError("RDF/XML holds no triple terms")
        else:
            kind = f" xml:lang={quoteattr(o.lang)}" if o.lang else "" if o.datatype == XSD + "string" else f" rdf:datatype={quoteattr(o.datatype)}"
            body = f"<{tag}{kind}>{escape(o.lex)}</{name}>"
        out.append(f" <rdf:Description {about}>{body}</rdf:Description>\n")
    return "".join(out) + "</rdf:RDF>\n"


def _trix(by_graph: dict) -> str:
    def term(t: object) -> str:
        if isinstance(t, IRI):
            return f"<uri>{escape(t.value)}</uri>"
        if isinstance(t, Blank):
            return f"<id>{escape(t.label)}</id>"
        if isinstance(t, Triple):
            return f"<triple>{term(t.s)}{term(t.p)}{term(t.o)}</triple>"
        if t.lang:
            return f"<plainLiteral xml:lang={quoteattr(t.lang)}>{escape(t.lex)}</plainLiteral>"
        return f"<plainLiteral>{escape(t.lex)}</plainLiteral>" if t.datatype == XSD + "string" else f"<typedLiteral datatype={quoteattr(t.datatype)}>{escape(t.lex)}</typedLiteral>"

    body = "".join("<graph>" + (term(g) if g is not None else "") + "".join(f"<triple>{term(s)}{term(p)}{term(o)}</triple>\n" for s, p, o in ts) + "</graph>\n" for g, ts in by_graph.items())
    return f'<?xml version="1.0" encoding="utf-8"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">\n{body}</TriX>\n'


def _jsonld(by_graph: dict) -> list:
    def ref(t: object) -> str:
        return "_:" + t.label if isinstance(t, Blank) else t.value

    def value(t: object) -> dict:
        if not isinstance(t, Literal):
            return {"@id": ref(t)}
        out = {"@value": t.lex}
        if t.lang:
            out["@language"] = t.lang
            if t.direction:
                out["@direction"] = t.direction
        elif t.datatype != XSD + "string":
            out["@type"] = t.datatype
        return out

    def nodes(triples: list[tuple]) -> list[dict]:
        found: dict[str, dict] = {}
        for s, p, o in triples:
            n = found.setdefault(ref(s), {"@id": ref(s)})
            if p == IRI(RDF + "type") and not isinstance(o, Literal):
                n.setdefault("@type", []).append(ref(o))
            else:
                n.setdefault(p.value, []).append(value(o))
        return list(found.values())

    out: list = []
    for g, ts in by_graph.items():
        out += nodes(ts) if g is None else [{"@id": ref(g), "@graph": nodes(ts)}]
    return out
