"""SPARQL over a small graph, case by case."""

from __future__ import annotations

import pytest

from quadloom.dataset import Dataset
from quadloom.functions.builtins import Unsupported
from quadloom.parser import SyntaxProblem, parse_query
from quadloom.sources.quads import SCHEMA
from quadloom.sources.readers import parse
from quadloom.terms import XSD, IRI, Literal

P = "PREFIX : <http://t.test/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX agg: <http://t.test/agg#> "
DATA = """@prefix : <http://t.test/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a :p 1 ; :name "Ann"@en ; :knows :b . :b :p 2.5 ; :name "Bob" ; :knows :c . :c :p "x" ; :knows :a . :d :q 7 .
:a :when "2024-03-01T10:00:00+05:00"^^xsd:dateTime ."""


@pytest.fixture(scope="module")
def data(spark):
    return Dataset.of_quads(spark.createDataFrame(parse(DATA, "turtle"), SCHEMA))


def rows(data, text):
    return sorted((tuple(sorted((k, v) for k, v in r.items())) for r in data.query(P + text).rows()), key=repr)


def one(data, expr):
    found = list(data.query(P + f"SELECT ?v WHERE {{ BIND({expr} AS ?v) }}").rows())
    return found[0].get("v")


def lit(lex, kind="string"):
    return Literal(lex, XSD + kind)


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("1 + 2", lit("3", "integer")), ("7 / 2", lit("3.5", "decimal")), ("1 / 0", None), ("1.5 * 2", lit("3", "decimal")), ("1e0 / 0", lit("INF", "double")),
        ('"1"^^xsd:integer = "1.0"^^xsd:decimal', lit("true", "boolean")), ('sameTerm(1, 1.0)', lit("false", "boolean")), ('"a" < 1', None), ('IF(1 = 1, "y", 2)', lit("y")),
        ("ROUND(-2.5)", lit("-2", "decimal")), ("ROUND(2.5)", lit("3", "decimal")), ('SUBSTR("foobar", 4)', lit("bar")), ('SUBSTR("foobar", 0, 3)', lit("fo")), ('STRBEFORE("abc"@en, "b")', Literal("a", lang="en", datatype="http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")),
        ('STRBEFORE("abc", "z")', lit("")), ('STRAFTER("abc", "")', lit("abc")), ('CONCAT("a"@en, "b"@en)', Literal("ab", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en")), ('CONCAT("a"@en, "b")', lit("ab")),
        ('ENCODE_FOR_URI("a b~*")', lit("a%20b~%2A")), ('REPLACE("abab", "B", "Z", "i")', lit("aZaZ")), ('REGEX("a.c", ".", "q")', lit("true", "boolean")), ('LANGMATCHES("en-GB", "EN")', lit("true", "boolean")),
        ('STRDT("1", xsd:integer) + 1', lit("2", "integer")), ('DATATYPE("x"@en)', IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")), ('xsd:integer("12")', lit("12", "integer")), ('xsd:integer("1x")', None), ('xsd:boolean("0")', lit("false", "boolean")),
        ('YEAR("2024-06-15T10:00:00+05:00"^^xsd:dateTime)', lit("2024", "integer")), ('HOURS("2024-06-15T10:00:00+05:00"^^xsd:dateTime)', lit("10", "integer")), ('TZ("2024-06-15T10:00:00+05:00"^^xsd:dateTime)', lit("+05:00")),
        ('TIMEZONE("2024-06-15T10:00:00-05:30"^^xsd:dateTime)', lit("-PT5H30M", "dayTimeDuration")), ('ADJUST("2024-06-15T10:00:00+05:00"^^xsd:dateTime, "PT1H"^^xsd:dayTimeDuration)', lit("2024-06-15T06:00:00+01:00", "dateTime")),
        ('ADJUST("2024-06-15T10:00:00+05:00"^^xsd:dateTime, "")', lit("2024-06-15T10:00:00", "dateTime")), ('ADJUST("2024-06-15T10:00:00+05:00"^^xsd:dateTime, "PT15H"^^xsd:dayTimeDuration)', None),
        ('"2024-01-31T00:00:00Z"^^xsd:dateTime + "P1M"^^xsd:yearMonthDuration', lit("2024-02-29T00:00:00Z", "dateTime")), ('"P1Y"^^xsd:duration / "P1M"^^xsd:duration', lit("12", "decimal")), ('"P1D"^^xsd:dayTimeDuration * 3', lit("P3D", "dayTimeDuration")),
        ('"2024-03-10T00:00:00Z"^^xsd:dateTime - "2024-03-01T00:00:00Z"^^xsd:dateTime', lit("P9D", "dayTimeDuration")), ('"2024-03-10T00:00:00"^^xsd:dateTime > "2024-03-01T00:00:00Z"^^xsd:dateTime', None),
        ('MD5("abc")', lit("900150983cd24fb0d6963f7d28e17f72")), ("COALESCE(1/0, 5)", lit("5", "integer")), ("1 IN (2, 1.0)", lit("true", "boolean")), ("SUBJECT(TRIPLE(:a, :p, 1))", IRI("http://t.test/a")), ("isTRIPLE(TRIPLE(:a, :p, 1))", lit("true", "boolean")),
        ('STRLEN("a😀")', lit("2", "integer")), ('UCASE("é"@fr)', Literal("É", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "fr")), ('LANGDIR(STRLANGDIR("a", "ar", "rtl"))', lit("rtl")), ('"NaN"^^xsd:double = "NaN"^^xsd:double', lit("false", "boolean")),
    ],
)
def test_expressions(data, expr, want):
    assert one(data, expr) == want


def test_optional_and_unbound_joins(data):
    found = rows(data, "SELECT ?x ?n WHERE { ?x :knows ?y OPTIONAL { ?x :name ?n } }")
    assert len(found) == 3 and sum(len(r) == 1 for r in found) == 1
    # an unbound variable joins with anything
    joined = rows(data, 'SELECT ?x ?n ?m WHERE { ?x :knows ?y OPTIONAL { ?x :name ?n } VALUES (?n ?m) { ("Bob" 1) ("Zed" 2) } }')
    assert len(joined) == 3


def test_minus_and_not_exists_differ(data):
    assert len(rows(data, "SELECT * WHERE { ?x :knows ?y MINUS { ?u :q ?v } }")) == 3
    assert rows(data, "SELECT * WHERE { ?x :knows ?y FILTER NOT EXISTS { ?u :q ?v } }") == []


def test_aggregates_over_mixed_values(data):
    assert rows(data, "SELECT (SUM(?v) AS ?s) WHERE { ?x :p ?v }") == [()]  # "x" is no number
    assert rows(data, "SELECT (SUM(?v) AS ?s) (AVG(?v) AS ?a) WHERE { ?x :p ?v FILTER(isNumeric(?v)) }") == [(("a", lit("1.75", "decimal")), ("s", lit("3.5", "decimal")))]
    assert rows(data, "SELECT (COUNT(*) AS ?n) WHERE { ?x :nothing ?v }") == [(("n", lit("0", "integer")),)]
    assert rows(data, "SELECT (AGG(agg:MEDIAN, ?v) AS ?m) WHERE { VALUES ?v { 1 2 3 4 5 } }")[0][0][1].lex in ("3.0E0", "3")
    assert rows(data, "SELECT (AGG(agg:TOPK, ?v; K=3) AS ?m) WHERE { VALUES ?v { 30 10 50 20 40 } }") == [(("m", lit("50 40 30")),)]


def test_paths_on_a_cycle(data):
    assert len(rows(data, "SELECT ?x ?y WHERE { ?x :knows+ ?y }")) == 9
    assert len(rows(data, "SELECT ?y WHERE { :a :knows* ?y }")) == 3
    assert rows(data, "SELECT ?y WHERE { :nowhere :knows* ?y }") == [(("y", IRI("http://t.test/nowhere")),)]
    assert len(rows(data, "SELECT ?y WHERE { :a :knows{2} ?y }")) == 1
    assert len(rows(data, "SELECT ?x WHERE { ?x ^:knows/:p 1 }")) == 1


def test_lateral(data):
    assert len(rows(data, "SELECT ?x ?v WHERE { ?x :knows ?y LATERAL { SELECT ?x ?v WHERE { ?x ?p ?v } ORDER BY STR(?v) LIMIT 1 } }")) == 3


def test_order_of_kinds(data):
    got = [r["v"] for r in data.query(P + 'SELECT ?v WHERE { VALUES ?v { "z" :a 3 2.5 } } ORDER BY ?v').rows()]
    assert got == [IRI("http://t.test/a"), lit("2.5", "decimal"), lit("3", "integer"), lit("z")]


def test_construct_makes_fresh_blanks_and_skips_ill_formed(data):
    df = data.query(P + "CONSTRUCT { [] :of ?x . ?n :bad ?x } WHERE { ?x :knows ?y OPTIONAL { ?x :name ?n } }").df
    assert df.count() == 3 and df.select("s").distinct().count() == 3


def test_describe_follows_blanks(spark):
    d = Dataset.of_quads(spark.createDataFrame(parse("@prefix : <http://t.test/> . :a :p [ :q [ :r 1 ] ] . :z :p :a . :y :p 2 .", "turtle"), SCHEMA))
    assert d.query("DESCRIBE <http://t.test/a>").df.count() == 4


def test_update_sequence(spark, data):
    d = data.update(P + "DELETE { ?x :p ?v } INSERT { GRAPH :g { ?x :was ?v } } WHERE { ?x :p ?v } ; INSERT DATA { :e :p 9 } ; DELETE DATA { :d :q 7 }")
    assert d.query(P + "ASK { GRAPH :g { :a :was 1 } }").boolean
    assert len(rows(d, "SELECT ?x WHERE { ?x :p ?v }")) == 1 and not d.query(P + "ASK { :d :q ?v }").boolean


def test_reified_statements(spark):
    d = Dataset.of_quads(spark.createDataFrame(parse("@prefix : <http://t.test/> . :a :age 42 {| :sure 'high' |} .", "turtle"), SCHEMA))
    assert rows(d, "SELECT ?v ?c WHERE { << :a :age ?v ~ ?r >> :sure ?c }") == [(("c", lit("high")), ("v", lit("42", "integer")))]


def test_refusals(data):
    with pytest.raises(Unsupported):
        data.query(P + "SELECT (:unknown(1) AS ?x) WHERE {}")
    with pytest.raises(SyntaxProblem):
        parse_query("SELECT ?x WHERE { ?x ")
    with pytest.raises(ValueError, match="basic"):
        data.query('VERSION "1.2-basic" SELECT * WHERE { ?s ?p <<( ?a ?b ?c )>> }')


def test_governed_answers(data):
    assert data.query(P + "SELECT * WHERE { ?s ?p ?o }", limit=3).df.count() == 3


def graph(spark, text):
    return Dataset.of_quads(spark.createDataFrame(parse("@prefix : <http://t.test/> . " + text, "turtle"), SCHEMA))


def test_exists_sees_outer_variables_in_nested_groups(spark):
    d = graph(spark, ":a :v 1 ; :w 5 . :b :v 9 ; :w 5 ; :z 20 . :c :v 3 ; :z 4 . :e :v 0 .")
    xs = lambda q: sorted(r["x"].value[-1] for r in d.query(P + q).rows())
    either = "{ ?x :w ?t FILTER(?t > ?b) } UNION { ?x :z ?t FILTER(?t > ?b) }"
    assert xs(f"SELECT ?x WHERE {{ ?x :v ?b FILTER EXISTS {{ {either} }} }}") == ["a", "b", "c"]
    assert xs(f"SELECT ?x WHERE {{ ?x :v ?b FILTER NOT EXISTS {{ {either} }} }}") == ["e"]
    assert xs("SELECT ?x WHERE { ?x :v ?b FILTER EXISTS { ?x :z ?t OPTIONAL { ?x :w ?u FILTER(?u > ?b) } FILTER(!BOUND(?u)) } }") == ["b", "c"]
    assert xs("SELECT ?x WHERE { ?x :v ?b FILTER(EXISTS { { ?x :w ?t FILTER(?t > ?b) } } || ?b = 3) }") == ["a", "c"]
    assert xs("SELECT ?x WHERE { ?x :v ?b FILTER EXISTS { BIND(?b + 1 AS ?c) FILTER(?c > 4) } }") == ["b"]


def test_patterns_with_a_triple_as_subject(spark):
    d = graph(spark, "<< :a :v 5 >> :said :bob . << :b :v 6 >> :said :ann . :c :v 5 .")
    found = d.query(P + "SELECT ?s ?o WHERE { ?r <http://www.w3.org/1999/02/22-rdf-syntax-ns#reifies> <<( ?s :v 5 )>> ; :said ?o }").rows()
    assert [(r["s"].value[-1], r["o"].value[-3:]) for r in found] == [("a", "bob")]


def test_rules_in_layers(spark):
    from quadloom.operators import rules as R

    d = graph(spark, "<urn:list:b> <urn:list:m> :x . <urn:list:a> <urn:list:m> :x ; <urn:list:p> :x .")
    out = d.materialise("Simple", ["?a list:m ?b . not ?a list:q ?b -> ?a list:r ?b", "?a list:p ?b -> ?a list:q ?b"])
    assert [r.s for r in out.quads.where("p = 'Iurn:list:r'").collect()] == ["Iurn:list:b"]
    with pytest.raises(ValueError, match="negation"):
        R.strata([R.rule("odd", "?a list:m ?b . not ?a list:r ?b -> ?a list:r ?b")])


def test_lists_and_circles(spark):
    from quadloom.operators import rules as R

    rdf = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    text = f":h {rdf}rest> :m ; {rdf}first> 1 . :m {rdf}rest> :n ; {rdf}first> 2 . :n {rdf}rest> :m ; {rdf}first> 3 . :k :has (1 2 3 4 5 6 7 8 9) , () , (7) ."
    found = sorted((r.list, r.pos, r.item.rsplit("\x1f", 1)[-1]) for r in R.list_members(graph(spark, text).quads).collect())
    assert sorted((p, i) for _, p, i in found) == sorted([(k, str(k + 1)) for k in range(9)] + [(0, "7")])


def test_shacl_rules_bind_this(spark):
    from quadloom.operators import shapes as S

    text = """@prefix sh: <http://www.w3.org/ns/shacl#> . :S a sh:NodeShape ; sh:targetNode :a , :c ; sh:rule [ sh:prefixes :pre ; sh:condition [ sh:property [ sh:path :v ; sh:maxInclusive 5 ] ] ;
      sh:construct "CONSTRUCT { $this t:big ?v } WHERE { $this t:v ?v FILTER(?v > 0) }" ] . :pre sh:declare [ sh:prefix "t" ; sh:namespace "http://t.test/" ] ."""
    out = S.rules(graph(spark, ":a :v 1 . :b :v 9 . :c :v 8 ."), graph(spark, text))
    assert [r.s[-1] for r in out.where("p = 'Ihttp://t.test/big'").collect()] == ["a"]
    loop = "@prefix sh: <http://www.w3.org/ns/shacl#> . :L a sh:NodeShape ; sh:targetNode :a ; sh:property [ sh:path :v ; sh:node :L ] ."
    with pytest.raises(ValueError, match="recursive"):
        graph(spark, ":a :v :a .").validate(graph(spark, loop)).count()


def test_list_functions_in_queries(spark):
    d = graph(spark, ":k :has (7 8 9) . :m :has () . :n :has 5 .")
    d.extensions = "http://t.test/"
    q = P + "SELECT ?x ?n ?g ?i ?c WHERE { ?x :has ?l BIND(:listLength(?l) AS ?n) BIND(:listGet(?l, 1) AS ?g) BIND(:listIndexOf(?l, 9) AS ?i) BIND(:listContains(?l, 8) AS ?c) }"
    found = {r["x"].value[-1]: tuple(r[v].lex if v in r else None for v in "ngic") for r in d.query(q).rows()}
    assert found == {"k": ("3", "8", "2", "true"), "m": ("0", None, None, "false"), "n": (None, None, None, None)}
    assert [r["x"].value[-1] for r in d.query(P + "SELECT ?x WHERE { ?x :has ?l FILTER(:listLength(?l) > 2 && EXISTS { ?x :has ?l }) }").rows()] == ["k"]


def test_standpoints(spark):
    d = graph(spark, "<< :earth :shape :sphere ~ :claim >> :x 1 . :claim :accordingTo :geodesy . :geodesy :sharpens :common . :common :sharpens :all .")
    d.extensions, d.standpoint = "http://t.test/", ("http://t.test/accordingTo", "http://t.test/sharpens")
    ask = lambda s: d.query(P + f"ASK {{ ?r :accordingTo ?a FILTER(:heldIn(?r, {s})) }}").boolean
    assert ask(":common") and ask(":geodesy") and not ask(":all") and not ask(":other")


def test_axioms_round_trip(spark):
    from quadloom.operators import projections as P_

    d = graph(spark, "<< :a :v 5 ~ :r >> :said :bob . :b :v 6 .")
    axioms = P_.to_axioms(d.quads)
    assert axioms.where("p LIKE '%reifies'").count() == 0 and axioms.where("p LIKE '%annotatedTarget'").count() == 1
    assert sorted(map(tuple, P_.from_axioms(axioms).collect()), key=repr) == sorted(map(tuple, d.quads.collect()), key=repr)


def test_governors(spark, data):
    import time

    from quadloom.governor import Stopped, governed, limited

    def wait(batches):
        for b in batches:
            time.sleep(40)
            yield b

    slow = spark.range(0, 4, 1, 2).mapInPandas(wait, "id long")
    began = time.time()
    with pytest.raises(Stopped, match="time"), governed(spark, seconds=1.5):
        slow.collect()
    assert time.time() - began < 30
    with governed(spark, seconds=60) as h:
        assert data.query(P + "SELECT ?x WHERE { ?x :p 1 }").df.count() == 1 and h.why is None
    with pytest.raises(Stopped, match="cancelled"), governed(spark) as h:
        import threading

        threading.Timer(1.5, h.cancel).start()
        slow.collect()
    asked = []
    d = data.with_quads(data.quads)
    d.service = limited(lambda e, t, n: asked.append(e) or [], 1)
    text = "SELECT ?x WHERE { SERVICE SILENT <http://one.test/> { ?x :p ?y } SERVICE SILENT <http://two.test/> { ?x :p ?y } }"
    with pytest.raises(Stopped, match="remote"):
        d.query(P + text)
    assert len(asked) == 1
