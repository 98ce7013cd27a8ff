"""Readers, writers and result formats against each other."""

from __future__ import annotations

import pytest

from quadloom.operators import projections
from quadloom.sources import results
from quadloom.sources.quads import SCHEMA
from quadloom.sources.readers import BadSyntax, parse
from quadloom.sources.writers import hextuple, lines, serialise
from quadloom.terms import XSD, Blank, IRI, Literal, Triple, decode, encode

TEXT = """@prefix : <http://t.test/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p "x\\ny"@en, 1, 2.5, 1e3, true, "q\\"r" ; :list (1 :b) ; a :C . _:n :q [ :r "2024-01-01"^^xsd:date ] ."""


def terms(quads):
    return [tuple(decode(x) if x else None for x in q) for q in quads]


def test_codes_round_trip():
    for t in (IRI("http://a"), Blank("x"), Literal("a\x1fb"), Literal("1", XSD + "integer"), Literal("a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en"), Triple(IRI("a"), IRI("b"), Triple(IRI("c"), IRI("d"), Literal("e\x1ef")))):
        assert decode(encode(t)) == t


@pytest.mark.parametrize("media", ["turtle", "trig", "rdfxml", "trix", "jsonld"])
def test_text_formats_round_trip(spark, media):
    quads = parse(TEXT, "turtle")
    again = parse(serialise(terms(quads), media), media)
    a, b = (spark.createDataFrame(sorted(set(q), key=str), SCHEMA) for q in (quads, again))
    assert projections.isomorphic(a, b)


def test_line_formats(spark):
    quads = parse(TEXT, "turtle")
    df = spark.createDataFrame(quads, SCHEMA)
    again = [q for (line,) in lines(df).collect() for q in parse(line, "nquads", "z")]
    assert projections.isomorphic(df, spark.createDataFrame(again, SCHEMA))
    hexed = [q for t in terms(quads) for q in parse(hextuple(*t), "hextuples", "z")]
    assert len(hexed) == len(quads)


def test_bad_lines():
    with pytest.raises(BadSyntax):
        parse("<a> <b> .", "ntriples")


def test_results_round_trip():
    rows = [{"x": IRI("http://a"), "y": Literal("l<&", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")}, {"x": Triple(IRI("s"), IRI("p"), Literal("1", XSD + "integer"))}]
    assert results.from_json(results.to_json(["x", "y"], rows)) == (["x", "y"], rows, None)
    assert results.from_xml(results.to_xml(["x", "y"], rows)) == (["x", "y"], rows, None)
    assert results.to_csv(["x"], [{"x": Literal('a"b')}]) == 'x\r\n"a""b"\r\n'
    with pytest.raises(ValueError, match="cells"):
        results.from_json(results.to_json(["x", "y"], rows), most=1)
