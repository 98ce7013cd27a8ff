"""SPARQL's operators and functions over typed values."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import RDF, RS, XSD
from .values import (
    DEC, INTEGERS, NUMERIC, Val, as_decimal, as_double, as_string, boolean, code, constant, datatype, decimal_text, double_text,
    is_kind, language, lexical, literal_code, null, term, text_of, tier, triple_code, truth, unify,
)

LANG_STRING = RDF + "langString"
_TEMPORAL = ("x:dateTime", "x:date", "x:time")
_TZ = r"(Z|[+-]\d\d:\d\d)$"


class Unsupported(NotImplementedError):
    """The host has registered no such function."""


# comparison
def _zoned(lex: Column) -> Column:
    return lex.rlike(_TZ)


def _instant(v: Val) -> Column:
    """Microseconds of a dateTime, date or time, in UTC."""
    if v.kind in ("dt", "date"):
        return F.unix_micros(v.col.cast("timestamp"))
    d, lex = datatype(v), F.trim(lexical(v.col))
    full = F.when(d == "x:time", F.concat(F.lit("1972-12-31T"), lex)).when(d == "x:date", F.regexp_replace(lex, r"^(-?\d+-\d\d-\d\d)", "$1T00:00:00")).when(d == "x:dateTime", lex)
    return F.unix_micros(full.try_cast("timestamp"))


_DURATIONS = ("x:duration", "x:dayTimeDuration", "x:yearMonthDuration")


def _duration(v: Val) -> tuple[Column, Column]:
    """Months and microseconds of a duration."""
    d, lex = datatype(v), lexical(term(v).col)
    ok = d.isin(*_DURATIONS) & lex.rlike(r"^-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    sign = F.when(lex.startswith("-"), -1).otherwise(1)
    part = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(lex, pattern, 1), F.lit("")).try_cast("decimal(30,6)"), F.lit(0).cast("decimal(30,6)"))
    months = (part(r"P(?:\d+Y)?(\d+)M") + part(r"P(\d+)Y") * 12).cast("long") * sign
    seconds = part(r"(\d+)D") * 86400 + part(r"T(?:\d+)?(?<=T)(\d+)H") * 3600 + part(r"T(?:\d+H)?(\d+)M") * 60 + part(r"(\d+(?:\.\d+)?)S")
    return F.when(ok, months), F.when(ok, (seconds * 1000000).cast("long") * sign)


def _duration_code(months: Column, micros: Column, kind: Column) -> Column:
    """The canonical duration, as a code of the given kind."""
    neg = (months < 0) | ((months == 0) & (micros < 0))
    m, u = F.abs(months), F.abs(micros)
    put = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    whole = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    day = 86_400_000_000
    rest = u % day
    secs = rest % 60_000_000
    sec = F.when(secs > 0, F.concat(decimal_text((secs.cast(DEC) / 1000000).cast(DEC)), F.lit("S"))).otherwise(F.lit(""))
    time = F.concat(put(whole(rest, 3_600_000_000), "H"), put(whole(rest % 3_600_000_000, 60_000_000), "M"), sec)
    date = F.concat(put(whole(m, 12), "Y"), put(m % 12, "M"), put(whole(u, day), "D"))
    body = F.when((date == "") & (time == ""), F.when(kind == "x:yearMonthDuration", F.lit("0M")).otherwise(F.lit("T0S"))).otherwise(F.concat(date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit(""))))
    return F.concat(F.lit("L"), kind, F.lit("\x1f\x1f"), F.when(neg, F.lit("-P")).otherwise(F.lit("P")), body)


def equal(a: Val, b: Val) -> Column:
    """``=`` in the value space: NULL where it is a type error."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return _numeric(a, b, lambda x, y: x == y)
    if a.kind == b.kind and a.kind in ("str", "bool", "dt", "date", "iri") or (a.kind == b.kind == "ref" and a.prefix == b.prefix):
        return a.col == b.col
    if {a.kind, b.kind} <= {"iri", "ref"}:
        return text_of(a) == text_of(b)
    same = code(a) == code(b)
    ta, tb, da, db = tier(a), tier(b), datatype(a), datatype(b)
    la, lb = lexical(code(a)), lexical(code(b))
    known = lambda d: d.isin("x:string", "x:boolean", LANG_STRING, RDF + "dirLangString", *_TEMPORAL, *_DURATIONS) | d.isin(["x:" + n for n in INTEGERS]) | d.isin("x:decimal", "x:float", "x:double")
    (ma, ua), (mb, ub) = _duration(a), _duration(b)
    return (
        F.when(ta.isNotNull() & tb.isNotNull(), F.when((ta <= 2) & (tb <= 2), as_decimal(a) == as_decimal(b)).otherwise((as_double(a) == as_double(b)) & ~F.isnan(as_double(a))))
        .when(same, F.lit(True))
        .when(~(is_kind(a, "L") & is_kind(b, "L")), F.when(code(a).isNotNull() & code(b).isNotNull(), F.lit(False)))
        .when((da == "x:boolean") & (db == "x:boolean"), la.isin("true", "1") == lb.isin("true", "1"))
        .when((da == db) & da.isin(*_TEMPORAL), F.when(_zoned(la) == _zoned(lb), _instant(a) == _instant(b)))
        .when(da.isin(*_DURATIONS) & db.isin(*_DURATIONS), (ma == mb) & (ua == ub))
        .when((da == db) & da.isin("x:string", LANG_STRING), F.lit(False))
        # two literals of different known kinds differ; an unknown kind cannot be told
        .when(known(da) & known(db), F.when((da == db) | (da.isin("x:string", LANG_STRING) | db.isin("x:string", LANG_STRING)), F.lit(False)))
    )


def _numeric(a: Val, b: Val, f: Callable[[Column, Column], Column]) -> Column:
    kinds = {a.kind, b.kind}
    if kinds <= {"int"}:
        return f(a.col, b.col)
    if kinds <= {"int", "dec"}:
        return f(as_decimal(a), as_decimal(b))
    x, y = as_double(a), as_double(b)
    # Spark takes NaN for equal to itself and greater than all
    return f(x, y) & ~F.isnan(x) & ~F.isnan(y)


def less(a: Val, b: Val, op: str) -> Column:
    """One of < <= > >=."""
    f = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return _numeric(a, b, f)
    if a.kind == b.kind and a.kind in ("str", "bool", "dt", "date"):
        return f(a.col, b.col)
    ta, tb, da, db = tier(a), tier(b), datatype(a), datatype(b)
    la, lb = lexical(code(a)), lexical(code(b))
    x, y = as_double(a), as_double(b)
    (ma, ua), (mb, ub) = _duration(a), _duration(b)
    return (
        F.when(ta.isNotNull() & tb.isNotNull(), F.when((ta <= 2) & (tb <= 2), f(as_decimal(a), as_decimal(b))).otherwise(f(x, y) & ~F.isnan(x) & ~F.isnan(y)))
        .when((da == "x:string") & (db == "x:string"), f(la, lb))
        .when((da == "x:boolean") & (db == "x:boolean"), f(la.isin("true", "1"), lb.isin("true", "1")))
        .when((da == db) & da.isin(*_TEMPORAL), F.when(_zoned(la) == _zoned(lb), f(_instant(a), _instant(b))))
        # durations are ordered where months or seconds alone decide
        .when(da.isin(*_DURATIONS) & db.isin(*_DURATIONS), F.when(ma == mb, f(ua, ub)).when(ua == ub, f(ma, mb)))
    )


# arithmetic
def _native(op: str, a: Column, b: Column, kind: str) -> Column:
    if op == "/":
        return F.try_divide(a, b) if kind in ("dbl", "flt") else F.when(b != 0, F.try_divide(a, b)).try_cast(DEC)
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    if a.kind in NUMERIC and b.kind in NUMERIC:
        kind = NUMERIC[max(NUMERIC.index(a.kind), NUMERIC.index(b.kind))]
        if kind == "int" and op == "/":
            return Val("dec", F.when(b.col != 0, F.try_divide(a.col.cast("decimal(38,0)").cast("decimal(29,9)"), b.col.cast("decimal(19,0)"))).try_cast(DEC))
        if kind in ("dbl", "flt"):
            x, y = as_double(a), as_double(b)
            quotient = F.when(y != 0, x / y).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            return Val(kind, quotient if op == "/" else _native(op, x, y, kind))
        if kind == "dec":
            return Val("dec", _native(op, as_decimal(a, "decimal(29,9)"), as_decimal(b, "decimal(29,9)"), kind).try_cast(DEC))
        return Val(kind, _native(op, a.col, b.col, kind))
    ta, tb, da, db = tier(a), tier(b), datatype(a), datatype(b)
    t = F.when(ta.isNotNull() & tb.isNotNull(), F.greatest(ta, tb))
    whole = _native(op, as_decimal(a, "decimal(38,0)"), as_decimal(b, "decimal(38,0)"), "int") if op != "/" else None
    exact = _native(op, as_decimal(a, "decimal(29,9)"), as_decimal(b, "decimal(29,9)"), "dec").try_cast(DEC)
    x, y = as_double(a), as_double(b)
    rough = _native(op, x, y, "dbl") if op != "/" else F.when(y != 0, x / y).when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    out = F.when(t >= 3, F.when(t == 4, literal_code(XSD + "double", double_text(rough))).otherwise(literal_code(XSD + "float", double_text(rough.cast("float").cast("double")))))
    if whole is not None:
        out = out.when(t == 1, literal_code(XSD + "integer", F.regexp_replace(whole.try_cast("decimal(38,0)").cast("string"), r"\..*", "")))
    out = out.when(t <= 2, literal_code(XSD + "decimal", decimal_text(exact)))
    # instants and durations
    (ma, ua), (mb, ub) = _duration(a), _duration(b)
    kind = F.when(da == db, da).otherwise(F.lit("x:duration"))
    if op in "+-":
        sign = 1 if op == "+" else -1
        out = out.when(da.isin(*_DURATIONS) & db.isin(*_DURATIONS), _duration_code(ma + mb * sign, ua + ub * sign, kind))
        out = out.when(da.isin("x:dateTime", "x:date") & db.isin(*_DURATIONS), _shifted(a, mb * sign, ub * sign))
        if op == "+":
            out = out.when(db.isin("x:dateTime", "x:date") & da.isin(*_DURATIONS), _shifted(b, ma, ua))
        else:
            la, lb = lexical(code(a)), lexical(code(b))
            out = out.when((da == db) & da.isin(*_TEMPORAL), F.when(_zoned(la) == _zoned(lb), _duration_code(F.lit(0), _instant(a) - _instant(b), F.lit("x:dayTimeDuration"))))
    else:
        scaled = lambda m, u, by, d: _duration_code(F.round(m * by).cast("long"), F.round(u * by).cast("long"), d)
        factor = y if op == "*" else F.when(y != 0, 1.0 / y)
        out = out.when(da.isin(*_DURATIONS) & tb.isNotNull(), scaled(ma, ua, factor, da))
        if op == "*":
            out = out.when(ta.isNotNull() & db.isin(*_DURATIONS), scaled(mb, ub, x, db))
        else:
            ratio = F.when((ua == 0) & (ub == 0) & (mb != 0), ma.cast("decimal(29,9)") / mb.cast("decimal(19,0)")).when((ma == 0) & (mb == 0) & (ub != 0), ua.cast("decimal(29,9)") / ub.cast("decimal(19,0)"))
            out = out.when(da.isin(*_DURATIONS) & db.isin(*_DURATIONS), literal_code(XSD + "decimal", decimal_text(ratio)))
    return Val("term", out)


def _shifted(a: Val, months: Column, micros: Column) -> Column:
    """A dateTime or date moved by months, kept within the month, and then by microseconds."""
    d, lex = datatype(a), lexical(code(a))
    zone = F.regexp_extract(lex, _TZ, 1)
    local = F.regexp_replace(lex, _TZ, "").try_cast("timestamp")
    day = F.add_months(local.cast("date"), months.cast("int"))
    moved = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + (F.unix_micros(local) - F.unix_micros(local.cast("date").cast("timestamp"))) + micros)
    text = F.when(d == "x:date", F.date_format(moved, "yyyy-MM-dd")).otherwise(F.regexp_replace(F.regexp_replace(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.concat(F.lit("L"), d, F.lit("\x1f\x1f"), text, zone)


# strings
def _like(first: Val, text: Column) -> Val:
    """A string with the language of the first argument."""
    if first.kind == "str":
        return Val("str", text)
    if first.kind == "lang":
        return Val("lang", text, lang=first.lang)
    lang = language(first)
    return Val("term", F.when(text.isNotNull(), F.when(lang == "", literal_code(XSD + "string", text)).otherwise(literal_code(LANG_STRING, text, lang))))


def _compatible(a: Val, b: Val) -> Column:
    if a.kind == b.kind == "str" or (b.kind == "str" and a.kind == "lang"):
        return F.lit(True)
    la, lb = language(a), language(b)
    return (lb == "") | (la == lb)


def _two_strings(f: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    return lambda a, b: boolean(F.when(_compatible(a, b), f(as_string(a), as_string(b))))


def _before(a: Val, b: Val) -> Val:
    x, y = as_string(a), as_string(b)
    at = F.instr(x, y)
    found = _like(a, F.when(_compatible(a, b) & (at > 0), F.substr(x, F.lit(1), at - 1)))
    return _or_empty(found, F.when(_compatible(a, b) & (at == 0), F.lit("")))


def _after(a: Val, b: Val) -> Val:
    x, y = as_string(a), as_string(b)
    at = F.instr(x, y)
    found = _like(a, F.when(_compatible(a, b) & (at > 0), F.substr(x, at + F.length(y))))
    return _or_empty(found, F.when(_compatible(a, b) & (at == 0), F.lit("")))


def _or_empty(v: Val, empty: Column) -> Val:
    if v.kind == "str":
        return Val("str", F.coalesce(v.col, empty))
    if v.kind == "lang":
        return Val("lang", F.coalesce(v.col, empty), lang=F.when(v.col.isNotNull(), v.lang).otherwise(F.lit("")))
    return Val("term", F.coalesce(v.col, literal_code(XSD + "string", empty)))


def _concat(*args: Val) -> Val:
    texts = [as_string(a) for a in args]
    joined = F.concat(*texts) if texts else F.lit("")
    if all(a.kind == "str" for a in args):
        return Val("str", joined)
    langs = [language(a) for a in args]
    same = F.lit(True)
    for x in langs[1:]:
        same = same & (x == langs[0])
    return Val("term", F.when(joined.isNotNull(), F.when(same & (langs[0] != ""), literal_code(LANG_STRING, joined, langs[0])).otherwise(literal_code(XSD + "string", joined))))


def _flags(pattern: Column, flags: Val | None) -> Column:
    if flags is None:
        return pattern
    f = as_string(flags)
    plain = F.when(f.contains("q"), F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))).otherwise(pattern)
    letters = F.regexp_replace(f, "[^ismx]", "")
    return F.when(letters == "", plain).otherwise(F.concat(F.lit("(?"), letters, F.lit(")"), plain))


def _regex(a: Val, p: Val, flags: Val | None = None) -> Val:
    return boolean(F.rlike(as_string(a), _flags(as_string(p), flags)))


def _replace(a: Val, p: Val, r: Val, flags: Val | None = None) -> Val:
    # XPath and Java write groups alike
    return _like(a, F.regexp_replace(as_string(a), _flags(as_string(p), flags), as_string(r)))


def _substr(a: Val, start: Val, length: Val | None = None) -> Val:
    x, s = as_string(a), F.round(as_double(start)).cast("int")
    if length is None:
        return _like(a, F.substr(x, F.greatest(s, F.lit(1))))
    end = s + F.round(as_double(length)).cast("int")
    first = F.greatest(s, F.lit(1))
    return _like(a, F.substr(x, first, F.greatest(end - first, F.lit(0))))


def _encode_uri(a: Val) -> Val:
    out = F.url_encode(as_string(a))
    for x, y in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(x), F.lit(y))
    return Val("str", out)


def _digest(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda a: Val("str", f(F.when(language(a) == "", as_string(a))) if a.kind == "term" else f(as_string(a)))


# numbers
def _round(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    def run(a: Val) -> Val:
        if a.kind == "int":
            return Val("int", f(a.col).cast("long"))
        if a.kind == "dec":
            return Val("dec", f(a.col).cast(DEC))
        if a.kind in ("flt", "dbl"):
            return Val(a.kind, F.when(F.isnan(a.col), a.col).otherwise(f(a.col.cast("double")).cast("double")))
        t, x = tier(a), as_double(a)
        return Val(
            "term",
            F.when(t == 1, literal_code(XSD + "integer", F.regexp_replace(f(as_decimal(a)).cast("string"), r"\..*", "")))
            .when(t == 2, literal_code(XSD + "decimal", decimal_text(f(as_decimal(a)).cast(DEC))))
            .when(t == 3, literal_code(XSD + "float", double_text(f(x).cast("double"))))
            .when(t == 4, literal_code(XSD + "double", double_text(f(x).cast("double")))),
        )

    return run


# dates
def _clock(name: str) -> Callable[[Val], Val]:
    native = {"YEAR": F.year, "MONTH": F.month, "DAY": F.day, "HOURS": F.hour, "MINUTES": F.minute}
    at = {"YEAR": r"^(-?\d+)-", "MONTH": r"^-?\d+-(\d\d)", "DAY": r"^-?\d+-\d\d-(\d\d)", "HOURS": r"(?:T|^)(\d\d):", "MINUTES": r"(?:T|^)\d\d:(\d\d)", "SECONDS": r"(?:T|^)\d\d:\d\d:(\d\d(?:\.\d+)?)"}

    def run(a: Val) -> Val:
        if a.kind in ("dt", "date"):
            if name == "SECONDS":
                return Val("dec", (F.unix_micros(a.col.cast("timestamp")) % 60_000_000).cast(DEC) / F.lit(1_000_000).cast("decimal(8,0)"))
            return Val("int", native[name](a.col).cast("long"))
        found = F.when(datatype(a).isin(*_TEMPORAL), F.nullif(F.regexp_extract(lexical(term(a).col), at[name], 1), F.lit("")))
        return Val("dec", found.try_cast(DEC)) if name == "SECONDS" else Val("int", found.try_cast("long"))

    return run


def _tz(a: Val) -> Val:
    return Val("str", F.when(datatype(a).isin(*_TEMPORAL), F.regexp_extract(text_of(a), _TZ, 1)))


def _timezone(a: Val) -> Val:
    zone = _tz(a).col
    micros = F.when(zone == "Z", F.lit(0)).when(zone != "", (F.substr(zone, F.lit(2), F.lit(2)).cast("long") * 60 + F.substr(zone, F.lit(5), F.lit(2)).cast("long")) * F.when(zone.startswith("-"), -60_000_000).otherwise(60_000_000))
    return Val("term", _duration_code(F.lit(0), micros.cast("long"), F.lit("x:dayTimeDuration")))


def _adjust(a: Val, to: Val) -> Val:
    """The same instant in another time zone; a plain empty string takes the zone away."""
    d, lex = datatype(a), lexical(code(a))
    local, zone = F.regexp_replace(lex, _TZ, ""), F.regexp_extract(lex, _TZ, 1)
    months, micros = _duration(to)
    valid = (months == 0) & (F.abs(micros) <= 14 * 3_600_000_000) & (micros % 60_000_000 == 0)
    minutes = F.abs(micros / 60_000_000).cast("int")
    name = F.when(micros == 0, F.lit("Z")).otherwise(F.format_string("%s%02d:%02d", F.when(micros < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")))
    moved = F.timestamp_micros(_instant(a) + micros)
    out = F.when(d == "x:time", F.date_format(moved, "HH:mm:ss.SSSSSS")).when(d == "x:date", F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    out = F.regexp_replace(F.regexp_replace(out, r"(:\d\d\.\d*?)0+$", "$1"), r"\.$", "")
    text = F.when(as_string(to) == "", local).when(valid, F.concat(F.when(zone == "", local).otherwise(out), name))
    return Val("term", F.when(d.isin(*_TEMPORAL) & text.isNotNull(), F.concat(F.lit("L"), d, F.lit("\x1f\x1f"), text)))


# terms
def _iri(a: Val, base: str = "") -> Val:
    if a.kind in ("iri", "ref"):
        return a
    text = F.when(is_kind(a, "I"), text_of(a)).otherwise(as_string(a))
    if not base:
        return Val("iri", text)
    root = base[: base.rfind("/") + 1]
    site = "/".join(base.split("/")[:3])
    return Val("iri", F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).when(text == "", F.lit(base)).when(text.startswith("/"), F.concat(F.lit(site), text)).when(text.startswith("#"), F.concat(F.lit(base.split("#")[0]), text)).otherwise(F.concat(F.lit(root), text)))


def _datatype(a: Val) -> Val:
    d = datatype(a)
    return Val("iri", F.when(d.startswith("x:"), F.concat(F.lit(XSD), F.substr(d, F.lit(3)))).otherwise(d))


def _str_dt(a: Val, d: Val) -> Val:
    iri = text_of(d)
    name = F.when(iri.startswith(XSD), F.concat(F.lit("x:"), F.substr(iri, F.lit(len(XSD) + 1)))).otherwise(iri)
    plain = F.when(language(a) == "", as_string(a))
    return Val("term", F.concat(F.lit("L"), name, F.lit("\x1f\x1f"), plain))


def _str_lang(a: Val, tag: Val) -> Val:
    plain = F.when(language(a) == "", as_string(a))
    return Val("term", literal_code(LANG_STRING, plain, F.lower(F.nullif(as_string(tag), F.lit("")))))


def _str_lang_dir(a: Val, tag: Val, direction: Val) -> Val:
    plain = F.when(language(a) == "", as_string(a))
    side = F.when(as_string(direction).isin("ltr", "rtl"), as_string(direction))
    return Val("term", literal_code(RDF + "dirLangString", plain, F.concat(F.lower(F.nullif(as_string(tag), F.lit(""))), F.lit("--"), side)))


def _lang_matches(a: Val, pattern: Val) -> Val:
    x, p = F.lower(as_string(a)), F.lower(as_string(pattern))
    return boolean(F.when(p == "*", x != "").otherwise((x == p) | F.startswith(x, F.concat(p, F.lit("-")))))


def _part(i: int) -> Callable[[Val], Val]:
    return lambda a: Val("term", F.when(is_kind(a, "T"), F.get(F.split(F.substr(term(a).col, F.lit(2)), RS, 3), F.lit(i))))


def _triple(s: Val, p: Val, o: Val) -> Val:
    ok = F.coalesce(is_kind(s, "I") | is_kind(s, "B"), F.lit(False)) & F.coalesce(is_kind(p, "I"), F.lit(False))
    return Val("term", F.when(ok, triple_code(code(s), code(p), code(o))))


def cast(name: str, a: Val) -> Val:
    """xsd: constructor functions."""
    text = F.when(is_kind(a, "I") | is_kind(a, "B"), F.lit(None)).otherwise(text_of(a)) if a.kind == "term" else text_of(a)
    trimmed = F.trim(text)
    is_bool = datatype(a) == "x:boolean"
    number = F.when(is_bool, F.when(trimmed.isin("true", "1"), 1.0).otherwise(0.0)).otherwise(F.coalesce(as_double(a), F.when(trimmed.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double")), F.when(trimmed == "INF", F.lit(float("inf"))).when(trimmed == "-INF", F.lit(float("-inf"))).when(trimmed == "NaN", F.lit(float("nan")))))
    if name == "string":
        return Val("str", text_of(a))
    if a.kind in ("iri", "ref"):
        return null()
    if name == "integer" or name in INTEGERS:
        if a.kind == "int":
            return a
        whole = F.when(tier(a).isNotNull() | is_bool, F.when(~F.isnan(number) & (F.abs(number) < 9.2e18), number.try_cast("long"))).otherwise(F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("long")))
        return Val("int", whole)
    if name == "decimal":
        exact = F.when(tier(a) <= 2, as_decimal(a)) if a.kind in (*NUMERIC, "term") else F.lit(None).cast(DEC)
        return Val("dec", F.coalesce(exact, F.when(tier(a).isNotNull() | is_bool, number.try_cast(DEC)).otherwise(F.when(trimmed.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), trimmed.try_cast(DEC)))))
    if name == "double":
        return Val("dbl", number)
    if name == "float":
        return Val("flt", number.cast("float"))
    if name == "boolean":
        n = as_double(a)
        return boolean(F.when(is_bool | (datatype(a) == "x:string"), F.when(trimmed.isin("true", "1"), True).when(trimmed.isin("false", "0"), False)).when(n.isNotNull(), (n != 0) & ~F.isnan(n)))
    if name == "dateTime":
        if a.kind == "dt":
            return a
        return Val("term", F.when(trimmed.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$"), literal_code(XSD + "dateTime", trimmed)))
    if name == "date":
        if a.kind in ("dt", "date"):
            return Val("date", a.col.cast("date"))
        return Val("term", F.when(trimmed.rlike(r"^-?\d{4,}-\d\d-\d\d"), literal_code(XSD + "date", F.substr(trimmed, F.lit(1), F.lit(10)))))
    raise Unsupported(XSD + name)


def choose(cases: list[tuple[Column, Val]]) -> Val:
    """The value of the first case that holds, in one kind."""
    cases = [(c, v) for c, v in cases if not v.absent] or cases[:1]
    kinds = {(v.kind, v.prefix) for _, v in cases}
    if len(kinds) == 1 and (kind := next(iter(kinds)))[0] != "lang":
        out = None
        for c, v in cases:
            out = F.when(c, v.col) if out is None else out.when(c, v.col)
        return Val(kind[0], out, kind[1])
    out = None
    for c, v in cases:
        out = F.when(c, code(v)) if out is None else out.when(c, code(v))
    return Val("term", out)


def _coalesce(*args: Val) -> Val:
    return choose([(a.col.isNotNull(), a) for a in args])


def _bnode(a: Val | None = None) -> Val:
    # one label for each row and string; uuid() is fresh by row
    return Val("term", F.concat(F.lit("B"), F.replace(F.uuid(), F.lit("-"), F.lit("")))) if a is None else Val("term", F.concat(F.lit("Bs"), F.sha1(as_string(a)), F.hex(F.monotonically_increasing_id())))


def same_term(a: Val, b: Val) -> Column:
    x, y = unify(a, b)
    return x.col == y.col


def build(now: dt.datetime, base: str = "") -> dict[str, Callable[..., Val]]:
    """The functions by name, for one query."""
    stamp = constant_now(now)
    half_up = lambda c: F.floor(c + 0.5)
    table: dict[str, Callable[..., Val]] = {
        "=": lambda a, b: boolean(equal(a, b)),
        **{op: (lambda a, b, op=op: boolean(less(a, b, op))) for op in ("<", "<=", ">", ">=")},
        **{op: (lambda a, b, op=op: arithmetic(op, a, b)) for op in "+-*/"},
        "neg": lambda a: arithmetic("-", Val("int", F.lit(0).cast("long")), a),
        "pos": lambda a: arithmetic("+", Val("int", F.lit(0).cast("long")), a),
        "||": lambda a, b: boolean(truth(a) | truth(b)),
        "&&": lambda a, b: boolean(truth(a) & truth(b)),
        "!": lambda a: boolean(~truth(a)),
        "SAMETERM": lambda a, b: boolean(same_term(a, b)),
        "IF": lambda c, a, b: choose([(truth(c), a), (~truth(c), b)]),
        "COALESCE": _coalesce,
        "STR": lambda a: Val("str", text_of(a)),
        "LANG": lambda a: Val("str", F.regexp_replace(language(a), "--.*", "")),
        "LANGDIR": lambda a: Val("str", F.regexp_extract(language(a), "--(.*)$", 1)),
        "HASLANG": lambda a: boolean(F.coalesce(language(a) != "", F.when(code(a).isNotNull(), F.lit(False)))),
        "HASLANGDIR": lambda a: boolean(F.coalesce(language(a).contains("--"), F.when(code(a).isNotNull(), F.lit(False)))),
        "LANGMATCHES": _lang_matches,
        "DATATYPE": _datatype,
        "IRI": lambda a: _iri(a, base),
        "BNODE": _bnode,
        "RAND": lambda: Val("dbl", F.rand()),
        "NOW": lambda: stamp,
        "UUID": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
        "STRUUID": lambda: Val("str", F.uuid()),
        "ABS": _round(F.abs),
        "CEIL": _round(F.ceil),
        "FLOOR": _round(F.floor),
        "ROUND": _round(half_up),
        "CONCAT": _concat,
        "STRLEN": lambda a: Val("int", F.length(as_string(a)).cast("long")),
        "UCASE": lambda a: _like(a, F.upper(as_string(a))),
        "LCASE": lambda a: _like(a, F.lower(as_string(a))),
        "ENCODE_FOR_URI": _encode_uri,
        "CONTAINS": _two_strings(F.contains),
        "STRSTARTS": _two_strings(F.startswith),
        "STRENDS": _two_strings(F.endswith),
        "STRBEFORE": _before,
        "STRAFTER": _after,
        "REGEX": _regex,
        "REPLACE": _replace,
        "SUBSTR": _substr,
        **{n: _clock(n) for n in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS")},
        "TZ": _tz,
        "TIMEZONE": _timezone,
        "ADJUST": _adjust,
        "MD5": _digest(F.md5),
        "SHA1": _digest(F.sha1),
        **{f"SHA{n}": _digest(lambda c, n=n: F.sha2(c, n)) for n in (256, 384, 512)},
        "STRLANG": _str_lang,
        "STRLANGDIR": _str_lang_dir,
        "STRDT": _str_dt,
        "ISIRI": lambda a: boolean(is_kind(a, "I")),
        "ISBLANK": lambda a: boolean(is_kind(a, "B")),
        "ISLITERAL": lambda a: boolean(is_kind(a, "L")),
        "ISNUMERIC": lambda a: boolean(F.when(code(a).isNotNull(), as_double(a).isNotNull())),
        "ISTRIPLE": lambda a: boolean(is_kind(a, "T")),
        "TRIPLE": _triple,
        "SUBJECT": _part(0),
        "PREDICATE": _part(1),
        "OBJECT": _part(2),
    }
    for name in ("string", "integer", "decimal", "double", "float", "boolean", "dateTime", "date", *INTEGERS[1:]):
        table[XSD + name] = lambda a, name=name: cast(name, a)
    return table


def constant_now(now: dt.datetime) -> Val:
    from ..terms import Literal

    return constant(Literal(now.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z", XSD + "dateTime"))
