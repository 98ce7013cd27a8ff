"""SPARQL results as JSON, XML, CSV and TSV, written from and read to terms."""

from __future__ import annotations

import csv
import io
import json
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from ..terms import RDF, XSD, Blank, IRI, Literal, Triple, n3

NS = "http://www.w3.org/2005/sparql-results#"


def _json_term(t: object) -> dict:
    if isinstance(t, IRI):
        return {"type": "uri", "value": t.value}
    if isinstance(t, Blank):
        return {"type": "bnode", "value": t.label}
    if isinstance(t, Triple):
        return {"type": "triple", "value": {"subject": _json_term(t.s), "predicate": _json_term(t.p), "object": _json_term(t.o)}}
    out = {"type": "literal", "value": t.lex}
    if t.lang:
        out["xml:lang"] = t.lang
        if t.direction:
            out["its:dir"] = t.direction
    elif t.datatype != XSD + "string":
        out["datatype"] = t.datatype
    return out


def to_json(variables: list[str], rows, boolean: bool | None = None) -> str:
    if boolean is not None:
        return json.dumps({"head": {}, "boolean": boolean})
    return json.dumps({"head": {"vars": variables}, "results": {"bindings": [{n: _json_term(t) for n, t in r.items()} for r in rows]}}, ensure_ascii=False)


def _xml_term(t: object) -> str:
    if isinstance(t, IRI):
        return f"<uri>{escape(t.value)}</uri>"
    if isinstance(t, Blank):
        return f"<bnode>{escape(t.label)}</bnode>"
    if isinstance(t, Triple):
        return f"<triple><subject>{_xml_term(t.s)}</subject><predicate>{_xml_term(t.p)}</predicate><object>{_xml_term(t.o)}</object></triple>"
    mark = f" xml:lang={quoteattr(t.lang)}" if t.lang else "" if t.datatype == XSD + "string" else f" datatype={quoteattr(t.datatype)}"
    return f"<literal{mark}>{escape(t.lex)}</literal>"


def to_xml(variables: list[str], rows, boolean: bool | None = None) -> str:
    head = "<head>" + "".join(f"<variable name={quoteattr(v)}/>" for v in variables if boolean is None) + "</head>"
    if boolean is not None:
        body = f"<boolean>{str(boolean).lower()}</boolean>"
    else:
        body = "<results>" + "".join("<result>" + "".join(f"<binding name={quoteattr(n)}>{_xml_term(t)}</binding>" for n, t in r.items()) + "</result>" for r in rows) + "</results>"
    return f'<?xml version="1.0"?>\n<sparql xmlns="{NS}">{head}{body}</sparql>\n'


def to_csv(variables: list[str], rows) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(variables)
    plain = lambda t: "" if t is None else t.value if isinstance(t, IRI) else "_:" + t.label if isinstance(t, Blank) else t.lex if isinstance(t, Literal) else n3(t)
    for r in rows:
        w.writerow([plain(r.get(v)) for v in variables])
    return out.getvalue()


def to_tsv(variables: list[str], rows) -> str:
    lines = ["\t".join("?" + v for v in variables)]
    lines += ["\t".join(n3(r[v]) if v in r else "" for v in variables) for r in rows]
    return "\n".join(lines) + "\n"


def _from_json(d: dict) -> object:
    if d["type"] == "uri":
        return IRI(d["value"])
    if d["type"] == "bnode":
        return Blank(d["value"])
    if d["type"] == "triple":
        v = d["value"]
        return Triple(*(_from_json(v[k]) for k in ("subject", "predicate", "object")))
    lang, way = d.get("xml:lang", ""), d.get("its:dir", "")
    return Literal(d["value"], RDF + ("dirLangString" if way else "langString") if lang else d.get("datatype", XSD + "string"), lang.lower(), way)


def from_json(text: str, most: int | None = None) -> tuple[list[str], list[dict], bool | None]:
    """(variables, rows, boolean); more than ``most`` cells are refused."""
    d = json.loads(text)
    if "boolean" in d:
        return [], [], d["boolean"]
    rows = [{n: _from_json(t) for n, t in b.items()} for b in d["results"]["bindings"]]
    _bounded(rows, most)
    return d["head"]["vars"], rows, None


def from_xml(text: str, most: int | None = None) -> tuple[list[str], list[dict], bool | None]:
    root = ET.fromstring(text)
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    xml = "{http://www.w3.org/XML/1998/namespace}lang"

    def term(e) -> object:
        match name(e):
            case "uri":
                return IRI(e.text or "")
            case "bnode":
                return Blank(e.text or "")
            case "triple":
                return Triple(*(term(x[0]) for x in e))
        lang = e.get(xml, "")
        way = next((v for k, v in e.attrib.items() if k.endswith("dir")), "")
        return Literal(e.text or "", RDF + ("dirLangString" if way else "langString") if lang else e.get("datatype", XSD + "string"), lang.lower(), way)

    variables = [e.get("name") for e in root.iter() if name(e) == "variable"]
    for e in root:
        if name(e) == "boolean":
            return [], [], (e.text or "").strip() == "true"
    rows = [{b.get("name"): term(b[0]) for b in r} for r in root.iter() if name(r) == "result"]
    _bounded(rows, most)
    return variables, rows, None


def _bounded(rows: list[dict], most: int | None) -> None:
    if most is not None and sum(map(len, rows)) > most:
        raise ValueError("too many cells")


def write_results(result, media: str) -> str:
    """A query's result in one of json, xml, csv, tsv."""
    if result.form == "ASK":
        return (to_json if media == "json" else to_xml)([], [], result.boolean)
    return {"json": to_json, "xml": to_xml, "csv": to_csv, "tsv": to_tsv}[media](result.variables, list(result.rows()))
