"""GROUP BY and its aggregates, each a built-in of Spark that combines before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.builtins import Unsupported
from ..functions.values import DEC, NUMERIC, Val, as_decimal, as_double, code, decimal_text, double_text, literal_code, text_of, tier
from ..terms import XSD, Literal
from . import frame as R
from .frame import Frame

#: statistical aggregates by the local name of their IRI
STATISTICS = ("MEDIAN", "PERCENTILE", "STDDEV", "STDDEV_POP", "VARIANCE", "VAR_POP", "MODE", "FIRST", "LAST", "TOPK")


def group(f: Frame, keys: list[str], aggs: tuple, ctx) -> Frame:
    """One row for each key; without keys one row even if there is no solution."""
    from .compiler import expression, scope_of

    scope = scope_of(f)
    key_columns = [c for k in keys if k in f.slots for c in f.columns_of(k)]
    columns: list[Column] = []
    out: dict[str, Val] = {}
    for var, a in aggs:
        args = [expression(x, scope, ctx) for x in a.args]
        name = R.fresh(var.name)
        kind, col, finish = _aggregate(a, args, f, ctx)
        columns.append(col.alias(name))
        out[var.name] = finish(F.col(name)) if finish else Val(kind, F.col(name))
    grouped = f.df.groupBy(*key_columns)
    if columns:
        df = grouped.agg(*columns)
    else:
        df = f.df.select(*key_columns).distinct() if key_columns else f.df.select(F.lit(1).alias("unit")).limit(1)
    result = {k: f.val(k) for k in keys if k in f.slots} | out
    certain = {k: f.slots[k].certain for k in keys if k in f.slots} | {v.name: a.name == "COUNT" for v, a in aggs}
    g = R.build(df, result, certain) if result else Frame(df, {})
    for k in keys:
        if k not in f.slots:  # a key that nothing binds
            g = R.project(g, [*g.slots, k])
    return g


def _ordered(v: Val, f: Frame, distinct: bool) -> Column:
    """The values of a group in the order of an inner ORDER BY, or by value where there is none."""
    keys = [F.col(c) for _, c in f.order]
    item = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], v.col.alias("v"))
    got = F.collect_list(F.when(v.col.isNotNull(), item))
    if not keys:
        got = F.sort_array(F.collect_set(v.col) if distinct else F.collect_list(v.col))
        return got

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for i, (down, _) in reversed(list(enumerate(f.order))):
            a, b = (y[f"k{i}"], x[f"k{i}"]) if down else (x[f"k{i}"], y[f"k{i}"])
            out = F.when(a.isNull() & b.isNotNull(), -1).when(a.isNotNull() & b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(out)
        return out

    plain = F.transform(F.array_sort(got, compare), lambda x: x["v"])
    return F.array_distinct(plain) if distinct else plain


def _aggregate(a, args: list[Val], f: Frame, ctx):
    """(kind, aggregate column, function that makes the value of its column, or None)."""
    name = a.name
    if name == "COUNT":
        if not args:
            return "int", (F.count_distinct(F.struct(*f.keys())) if a.distinct and f.slots else F.count(F.lit(1))), None
        c = identity(args[0])
        return "int", F.count_distinct(c) if a.distinct else F.count(c), None
    if name in ("SUM", "AVG"):
        return _sum(name, args[0], a.distinct)
    if name in ("MIN", "MAX"):
        v = args[0]
        fn = F.min if name == "MIN" else F.max
        if v.kind in (*NUMERIC, "str", "iri", "ref", "bool", "dt", "date"):
            return v.kind, fn(v.col), lambda c: Val(v.kind, c, v.prefix)
        from .compiler import sort_columns

        by = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_columns(Val("term", code(v))))])
        picked = (F.min_by if name == "MIN" else F.max_by)(code(v), F.when(code(v).isNotNull(), by))
        return "term", picked, None
    if name == "SAMPLE":
        v = args[0]
        return v.kind, F.any_value(v.col if v.kind != "lang" else code(v), F.lit(True)), (lambda c: Val("term" if v.kind == "lang" else v.kind, c, v.prefix))
    if name == "GROUP_CONCAT":
        text = Val("str", text_of(args[0]))
        sep = next((x.lex for k, x in a.options if k == "SEPARATOR" and isinstance(x, Literal)), " ")
        return "str", F.concat_ws(sep, _ordered(text, f, a.distinct)), None
    local = name.rsplit("#", 1)[-1].rsplit("/", 1)[-1].upper()
    if name in ctx.custom_aggregates:
        return ctx.custom_aggregates[name](args, a)
    if local in STATISTICS:
        return _statistic(local, a, args[0], f)
    raise Unsupported(name)


def identity(v: Val) -> Column:
    """A column that is equal for equal terms."""
    return code(v) if v.kind == "lang" else v.col


def _sum(name: str, v: Val, distinct: bool):
    if v.kind == "int":
        if name == "SUM":
            return "int", F.coalesce(F.sum_distinct(v.col) if distinct else F.sum(v.col), F.lit(0).cast("long")), None
        mean = F.try_divide((F.sum_distinct(v.col) if distinct else F.sum(v.col)).cast("decimal(29,9)"), (F.count_distinct(v.col) if distinct else F.count(v.col)).cast("decimal(19,0)"))
        return "dec", F.coalesce(mean.try_cast(DEC), F.lit(0).cast(DEC)), None
    if v.kind in ("dbl", "flt"):
        total = F.sum_distinct(v.col) if distinct else F.sum(v.col)
        count = F.count_distinct(v.col) if distinct else F.count(v.col)
        return v.kind, F.coalesce(total if name == "SUM" else F.when(count > 0, total / count), F.lit(0.0)), None
    if v.kind == "dec":
        total = (F.sum_distinct(v.col) if distinct else F.sum(v.col)).try_cast(DEC)
        count = F.count_distinct(v.col) if distinct else F.count(v.col)
        mean = F.try_divide(total.cast("decimal(29,9)"), count.cast("decimal(19,0)")).try_cast(DEC)
        return "dec", F.coalesce(total if name == "SUM" else mean, F.lit(0).cast(DEC)), None
    # any kind: the widest tier decides; a value that is no number makes the aggregate an error
    t, x, d = tier(v), as_double(v), as_decimal(v)
    if distinct:
        once = F.collect_set(code(v))
        vals = F.transform(once, lambda c: F.struct(tier(Val("term", c)).alias("t"), as_double(Val("term", c)).alias("x"), as_decimal(Val("term", c)).alias("d")))
        packed = F.aggregate(
            vals,
            F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("x"), F.lit(0).cast(DEC).alias("d"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad")),
            lambda s, y: F.struct(
                F.greatest(s["t"], F.coalesce(y["t"], F.lit(0))).alias("t"), (s["x"] + F.coalesce(y["x"], F.lit(0.0))).alias("x"), (s["d"] + F.coalesce(y["d"], F.lit(0).cast(DEC))).cast(DEC).alias("d"),
                (s["n"] + 1).alias("n"), (s["bad"] + y["t"].isNull().cast("long")).alias("bad"),
            ),
        )
    else:
        packed = F.struct(F.max(t).alias("t"), F.sum(x).alias("x"), F.sum(d).try_cast(DEC).alias("d"), F.count(v.col).alias("n"), F.count_if(t.isNull() & v.col.isNotNull()).alias("bad"))

    def finish(c: Column) -> Val:
        n = c["n"]
        exact = c["d"] if name == "SUM" else F.try_divide(c["d"].cast("decimal(29,9)"), n.cast("decimal(19,0)")).try_cast(DEC)
        rough = c["x"] if name == "SUM" else c["x"] / n
        out = (
            F.when(n == 0, literal_code(XSD + "integer", F.lit("0")))
            .when(c["bad"] > 0, F.lit(None))
            .when(c["t"] == 4, literal_code(XSD + "double", double_text(rough)))
            .when(c["t"] == 3, literal_code(XSD + "float", double_text(rough)))
        )
        whole = literal_code(XSD + "integer", F.regexp_replace(c["d"].cast("string"), r"\..*", ""))
        if name == "SUM":
            out = out.when(c["t"] == 1, whole)
        return Val("term", out.otherwise(literal_code(XSD + "decimal", decimal_text(exact))))

    return "term", packed, finish


def _statistic(local: str, a, v: Val, f: Frame):
    options = dict(a.options)
    x = as_double(v)

    def decimal(c: Column) -> tuple:
        if v.kind == "term":
            return "term", c, lambda y: Val("term", literal_code(XSD + "decimal", decimal_text(F.round(y, 15).try_cast(DEC))))
        return "dbl", c, None

    if local == "MEDIAN":
        return decimal(F.median(x))
    if local == "PERCENTILE":
        p = options.get("P")
        share = float(p.lex) if p is not None else 0.5
        if not 0 <= share <= 1:
            return "term", F.max(F.lit(None).cast("string")), None
        return decimal(F.percentile(x, F.lit(share)))
    if local in ("STDDEV", "STDDEV_POP", "VARIANCE", "VAR_POP"):
        fn = {"STDDEV": F.stddev_samp, "STDDEV_POP": F.stddev_pop, "VARIANCE": F.var_samp, "VAR_POP": F.var_pop}[local]
        if local.startswith("STD"):
            return ("term", fn(x), lambda y: Val("term", literal_code(XSD + "double", double_text(y)))) if v.kind == "term" else ("dbl", fn(x), None)
        return decimal(fn(x))
    if local == "MODE":
        return v.kind, F.mode(v.col, True), lambda c: Val(v.kind, c, v.prefix)
    if local in ("FIRST", "LAST"):
        w = v if v.kind != "lang" else Val("term", code(v))
        downs = {down for down, _ in f.order}
        if len(downs) < 2:
            # one direction: the least or greatest key tells, without the group's values together
            by = F.when(w.col.isNotNull(), F.struct(*[F.col(c).alias(f"k{i}") for i, (_, c) in enumerate(f.order)], *([] if f.order else [w.col.alias("v")])))
            least = (local == "FIRST") != (True in downs)
            return w.kind, (F.min_by if least else F.max_by)(w.col, by), lambda c: Val(w.kind, c, w.prefix)
        got = _ordered(w, f, False)
        return w.kind, F.element_at(got, 1) if local == "FIRST" else F.element_at(got, -1), lambda c: Val(w.kind, c, w.prefix)
    k = int(options["K"].lex) if "K" in options else 1
    best = F.slice(F.sort_array(F.collect_list(F.struct(x.alias("x"), text_of(v).alias("s"))), asc=False), 1, k)
    return "str", F.array_join(F.transform(best, lambda y: y["s"]), " "), None

