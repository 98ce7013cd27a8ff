"""Typed values: a column with the kind of term that it holds.

A kind that is known before the query runs keeps its native Spark type, so
expressions over tables stay in generated code.  ``term`` is any kind: a string
code (see ``quadloom.terms``) that is taken apart as needed.  NULL is unbound or
an error; SPARQL's three-valued logic is SQL's.

kind    column                       kind    column
iri     the IRI, a string            bool    boolean
ref     a key; the IRI is prefix+key dt      timestamp, no time zone
str     plain literal                date    date
lang    text, with ``lang`` beside   term    code of any term
int     bigint                       dbl     double
dec     decimal(38,18)               flt     float
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import RS, US, XSD, IRI, Literal, encode, short

NUMERIC = ("int", "dec", "flt", "dbl")
INTEGERS = "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte".split()
DEC = "decimal(38,18)"
_DATATYPE = {"str": "string", "int": "integer", "dec": "decimal", "flt": "float", "dbl": "double", "bool": "boolean", "dt": "dateTime", "date": "date"}


@dataclass
class Val:
    kind: str
    col: Column
    prefix: str = ""
    lang: Column | None = None
    #: known to be unbound in every row
    absent: bool = False

    def map(self, f) -> Val:
        return replace(self, col=f(self.col), lang=f(self.lang) if self.lang is not None else None)


def null(kind: str = "term") -> Val:
    return Val(kind, F.lit(None).cast("string"), absent=True)


def shown(v: Val) -> Column:
    """What a reader is shown: text of IRIs, strings and terms of mixed kinds, native values otherwise."""
    if v.kind == "term":
        return F.coalesce(text_of(v), F.when(is_kind(v, "B"), F.concat(F.lit("_:"), F.substr(v.col, F.lit(2)))), v.col)
    return text_of(v) if v.kind in ("iri", "ref", "lang") else v.col


def constant(t: object) -> Val:
    """A term as a value of the narrowest kind."""
    if isinstance(t, IRI):
        return Val("iri", F.lit(t.value))
    if isinstance(t, Literal) and not t.lang:
        d, lex = t.datatype.removeprefix(XSD), t.lex
        try:
            if d == "string":
                return Val("str", F.lit(lex))
            if d == "boolean" and lex in ("true", "false", "0", "1"):
                return Val("bool", F.lit(lex in ("true", "1")))
            if d == "integer" and abs(int(lex)) < 1 << 63:
                return Val("int", F.lit(int(lex)).cast("long"))
            if d == "decimal" and len(lex.strip("+-").split(".")[0]) <= 18:
                return Val("dec", F.lit(lex).cast(DEC))
            if d == "double":
                return Val("dbl", F.lit(float(lex.replace("INF", "inf"))))
            if d == "dateTime" and not (lex.endswith("Z") or lex[-6:-5] in "+-"):
                return Val("dt", F.lit(lex).cast("timestamp_ntz"))
            if d == "date" and len(lex) == 10:
                return Val("date", F.lit(lex).cast("date"))
        except ValueError:
            pass
    if isinstance(t, Literal) and t.lang and not t.direction:
        return Val("lang", F.lit(t.lex), lang=F.lit(t.lang.lower()))
    return Val("term", F.lit(encode(t)))


def literal_code(datatype: str, lex: Column, lang: Column | str = "") -> Column:
    return F.concat(F.lit(f"L{short(datatype)}{US}"), F.lit(lang) if isinstance(lang, str) else lang, F.lit(US), lex)


def decimal_text(c: Column) -> Column:
    """A decimal without idle zeros."""
    s = c.cast(DEC).cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def double_text(c: Column) -> Column:
    """The canonical form: one digit before the point, and an exponent."""
    exponent = F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c))))
    mantissa = F.regexp_replace(F.format_string("%.16e", c), r"(\.\d+?)0*e.*$", "$1")
    plain = c.cast("string")
    usual = F.when(plain.contains("E"), plain).otherwise(
        F.when(c == 0, F.lit("0.0E0")).otherwise(F.concat(F.regexp_replace((c / F.pow(F.lit(10.0), exponent)).cast("string"), r"(\.\d{15})\d+$", "$1"), F.lit("E"), exponent.cast("string")))
    )
    return F.when(F.isnan(c), F.lit("NaN")).when(plain == "Infinity", F.lit("INF")).when(plain == "-Infinity", F.lit("-INF")).otherwise(F.when(F.length(plain) > 30, mantissa).otherwise(usual))


def text_of(v: Val) -> Column:
    """STR(): the IRI or lexical form; NULL for blank nodes and triples."""
    c = v.col
    match v.kind:
        case "iri" | "str" | "lang":
            return c
        case "ref":
            return F.concat(F.lit(v.prefix), c.cast("string"))
        case "int" | "bool":
            return c.cast("string")
        case "dec":
            return decimal_text(c)
        case "flt" | "dbl":
            return double_text(c.cast("double"))
        case "dt":
            return _timestamp_text(c)
        case "date":
            return F.date_format(c, "yyyy-MM-dd")
    return F.when(is_kind(v, "I"), F.substr(c, F.lit(2))).when(is_kind(v, "L"), lexical(c))


def _timestamp_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def lexical(code: Column) -> Column:
    """The lexical form of a literal's code."""
    return F.get(F.split(code, US, 3), F.lit(2))


def code(v: Val) -> Column:
    """The value as a code."""
    match v.kind:
        case "term":
            return v.col
        case "iri":
            return F.concat(F.lit("I"), v.col)
        case "ref":
            return F.concat(F.lit("I" + v.prefix), v.col.cast("string"))
        case "lang":
            return F.when(v.lang == "", literal_code(XSD + "string", v.col)).otherwise(literal_code("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", v.col, v.lang))
    return literal_code(XSD + _DATATYPE[v.kind], text_of(v))


def term(v: Val) -> Val:
    return Val("term", code(v))


def is_kind(v: Val, letter: str) -> Column:
    """Whether the value is an IRI (I), blank node (B), literal (L) or triple (T); NULL if unbound."""
    if v.kind == "term":
        return F.substr(v.col, F.lit(1), F.lit(1)) == letter
    known = "I" if v.kind in ("iri", "ref") else "L"
    return F.when(v.col.isNotNull(), F.lit(known == letter))


def datatype(v: Val) -> Column:
    """The shortened datatype of a literal, NULL for others."""
    if v.kind == "term":
        return F.when(is_kind(v, "L"), F.substr(F.get(F.split(v.col, US, 3), F.lit(0)), F.lit(2)))
    if v.kind in ("iri", "ref"):
        return F.lit(None).cast("string")
    if v.kind == "lang":
        return F.when(v.lang == "", F.lit("x:string")).when(v.col.isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"))
    return F.when(v.col.isNotNull(), F.lit("x:" + _DATATYPE[v.kind]))


def language(v: Val) -> Column:
    """The language, with its direction, of a literal; empty if it has none."""
    if v.kind == "term":
        return F.when(is_kind(v, "L"), F.get(F.split(v.col, US, 3), F.lit(1)))
    if v.kind in ("iri", "ref"):
        return F.lit(None).cast("string")
    return v.lang if v.kind == "lang" else F.when(v.col.isNotNull(), F.lit(""))


def tier(v: Val) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; NULL for what is no number."""
    if v.kind in NUMERIC:
        return F.when(v.col.isNotNull(), F.lit(NUMERIC.index(v.kind) + 1))
    if v.kind != "term":
        return F.lit(None).cast("int")
    d = datatype(v)
    return F.when(d.isin(["x:" + n for n in INTEGERS]), 1).when(d == "x:decimal", 2).when(d == "x:float", 3).when(d == "x:double", 4)


def as_double(v: Val) -> Column:
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind != "term":
        return F.lit(None).cast("double")
    lex = F.trim(lexical(v.col))
    return F.when(tier(v).isNotNull(), F.when(lex == "INF", F.lit("Infinity")).when(lex == "-INF", F.lit("-Infinity")).otherwise(lex).try_cast("double"))


def as_decimal(v: Val, kind: str = DEC) -> Column:
    if v.kind in NUMERIC:
        return v.col.try_cast(kind) if v.kind in ("flt", "dbl") else v.col.cast(kind)
    if v.kind != "term":
        return F.lit(None).cast(kind)
    return F.when(tier(v) <= 2, F.trim(lexical(v.col)).try_cast(kind))


def as_string(v: Val) -> Column:
    """The text of a plain or language-tagged string; NULL for anything else."""
    if v.kind in ("str", "lang"):
        return v.col
    if v.kind != "term":
        return F.lit(None).cast("string")
    return F.when((datatype(v) == "x:string") | (language(v) != ""), lexical(v.col))


def truth(v: Val) -> Column:
    """The effective boolean value."""
    match v.kind:
        case "bool":
            return v.col
        case "str":
            return F.length(v.col) > 0
        case "lang":
            return F.length(v.col) > 0
        case "int" | "dec":
            return v.col != 0
        case "flt" | "dbl":
            return (v.col != 0) & ~F.isnan(v.col)
        case "term":
            d, lex = datatype(v), lexical(v.col)
            number = as_double(v)
            return (
                F.when(d == "x:boolean", lex.isin("true", "1"))
                .when((d == "x:string"), F.length(lex) > 0)
                .when(tier(v).isNotNull(), F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
            )
    return F.lit(None).cast("boolean")


def boolean(c: Column) -> Val:
    return Val("bool", c)


def triple_code(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("T"), s, F.lit(RS), p, F.lit(RS), o)


def unify(a: Val, b: Val) -> tuple[Val, Val]:
    """Both values in one kind, the native one if they share it."""
    if a.kind == b.kind and a.prefix == b.prefix and a.kind != "lang":
        return a, b
    if {a.kind, b.kind} <= {"iri", "ref"}:
        return Val("iri", text_of(a)), Val("iri", text_of(b))
    return term(a), term(b)


def well_formed(v: Val, iri: str) -> Column:
    """Whether a lexical form belongs to its datatype."""
    name = iri.rsplit("#", 1)[-1]
    lex = lexical(v.col)
    if name in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger"):
        return lex.rlike(r"^[+-]?\d+$")
    if name == "decimal":
        return lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    if name in ("double", "float"):
        return lex.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$")
    if name == "boolean":
        return lex.isin("true", "false", "1", "0")
    if name == "date":
        return lex.rlike(r"^-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?$")
    if name == "dateTime":
        return lex.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
    return F.lit(True)
