"""SPARQL 1.1 and 1.2 text, with LATERAL, AGG and path ranges, to algebra."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from . import algebra as A
from .terms import RDF, XSD, Blank, IRI, Literal, Triple, Var


class SyntaxProblem(ValueError):
    """The text is not a query or update of this language."""


_TOKEN = re.compile(
    r"""(?P<skip>[\s]+|\#[^\n\r]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<var>[?$][\w·]+)
    |(?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*(?:--[a-z]+)?)
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:\-·]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9a-fA-F]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>[A-Za-z][A-Za-z0-9_]*)
    |(?P<op><<\(|\)>>|<<|>>|\{\||\|\}|\^\^|&&|\|\||!=|<=|>=|[{}()\[\];,.=<>!+\-*/|^?~])
    """,
    re.X,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(s: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1]) or _bad(m[0]), s)


def _bad(what: str):
    raise SyntaxProblem(f"bad escape {what}")


AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
FUNCTIONS = {
    *"STR LANG LANGMATCHES DATATYPE BOUND IRI URI BNODE RAND ABS CEIL FLOOR ROUND CONCAT STRLEN UCASE LCASE ENCODE_FOR_URI CONTAINS STRSTARTS STRENDS STRBEFORE STRAFTER".split(),
    *"YEAR MONTH DAY HOURS MINUTES SECONDS TIMEZONE TZ NOW UUID STRUUID MD5 SHA1 SHA256 SHA384 SHA512 COALESCE IF STRLANG STRDT SAMETERM ISIRI ISURI ISBLANK ISLITERAL ISNUMERIC".split(),
    *"REGEX SUBSTR REPLACE LANGDIR STRLANGDIR HASLANG HASLANGDIR TRIPLE SUBJECT PREDICATE OBJECT ISTRIPLE ADJUST".split(),
}


class Parser:
    def __init__(self, text: str, base: str = "", property_functions: frozenset[str] = frozenset()):
        # code points may be written as escapes anywhere
        text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(f"cannot read {text[at : at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i, self.base, self.prefixes, self.blanks, self.fresh = 0, base, {}, {}, 0
        self.property_functions = property_functions
        self.aggregates: list | None = None
        self.version = ""
        self.extra: list[A.Pattern] = []

    # tokens
    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    @property
    def value(self) -> str:
        return self.tokens[self.i][1]

    def next(self) -> str:
        self.i += 1
        return self.tokens[self.i - 1][1]

    def at(self, *words: str) -> bool:
        k, v, _ = self.tokens[self.i]
        return (k == "op" and v in words) or (k == "word" and v.upper() in words)

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> str:
        if not self.at(*words):
            raise SyntaxProblem(f"expected {' or '.join(words)} and found {self.value!r}")
        return self.next()

    def new_var(self) -> Var:
        self.fresh += 1
        return Var(f".{self.fresh}")

    # terms
    def iri(self) -> str:
        k, v = self.kind, self.value
        if k == "iri":
            self.i += 1
            return urljoin(self.base, v[1:-1]) if self.base and not re.match(r"[A-Za-z][\w+.-]*:", v[1:]) else v[1:-1]
        if k == "name":
            self.i += 1
            prefix, _, local = v.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"no prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SyntaxProblem(f"expected an IRI and found {v!r}")

    def number(self) -> Literal:
        sign = self.next() if self.at("+", "-") else ""
        v = self.next()
        kind = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
        return Literal((sign if sign == "-" else sign) + v, XSD + kind)

    def literal(self) -> Literal | None:
        k, v = self.kind, self.value
        if k in ("string", "long"):
            self.i += 1
            q = 3 if k == "long" else 1
            lex = unescape(v[q:-q])
            if self.kind == "lang":
                lang, _, direction = self.next()[1:].partition("--")
                return Literal(lex, RDF + ("dirLangString" if direction else "langString"), lang.lower(), direction)
            if self.take("^^"):
                return Literal(lex, self.iri())
            return Literal(lex)
        if k == "number" or (self.at("+", "-") and self.tokens[self.i + 1][0] == "number"):
            return self.number()
        if self.at("TRUE", "FALSE"):
            return Literal(self.next().lower(), XSD + "boolean")
        return None

    def blank(self, label: str | None) -> object:
        if label is None:
            return self.new_var()
        return self.blanks.setdefault(label, self.new_var())

    def var_or_term(self) -> object:
        k, v = self.kind, self.value
        if k == "var":
            self.i += 1
            return Var(v[1:])
        if k in ("iri", "name"):
            return IRI(self.iri())
        if k == "blank":
            self.i += 1
            return self.blank(v[2:])
        if self.at("<<("):
            return self.triple_term()
        if (lit := self.literal()) is not None:
            return lit
        if self.at("["):
            j = self.i + 1
            if self.tokens[j][1] == "]":
                self.i += 2
                return self.blank(None)
        raise SyntaxProblem(f"expected a term and found {v!r}")

    def triple_term(self) -> Triple:
        self.need("<<(")
        s = self.var_or_term()
        p = self.verb()
        o = self.var_or_term()
        self.need(")>>")
        return Triple(s, p, o)

    def verb(self) -> object:
        if self.kind == "word" and self.value == "a":
            self.i += 1
            return IRI(RDF + "type")
        return Var(self.next()[1:]) if self.kind == "var" else IRI(self.iri())

    # queries
    def prologue(self) -> None:
        while True:
            if self.take("BASE"):
                self.base = urljoin(self.base, self.next()[1:-1])
            elif self.take("PREFIX"):
                name = self.next()
                if self.kind != "iri":
                    raise SyntaxProblem("a prefix needs an IRI")
                self.prefixes[name[:-1]] = urljoin(self.base, self.next()[1:-1]) if self.base else self.next()[1:-1]
            elif self.take("VERSION"):
                self.version = self.next().strip("\"'")
            else:
                return

    def query(self) -> A.Query:
        self.prologue()
        if self.at("SELECT"):
            q = self.select(top=True)
        elif self.take("ASK"):
            q = self._with_where(A.Query("ASK", A.BGP(())))
        elif self.take("CONSTRUCT"):
            q = self.construct()
        elif self.take("DESCRIBE"):
            q = self.describe()
        else:
            raise SyntaxProblem(f"no query form at {self.value!r}")
        if self.kind != "end":
            raise SyntaxProblem(f"unexpected {self.value!r}")
        q.prefixes, q.version = self.prefixes, self.version
        return q

    def dataset(self) -> tuple[tuple, tuple, bool]:
        default, named, any_ = [], [], False
        while self.take("FROM"):
            any_ = True
            (named if self.take("NAMED") else default).append(self.iri())
        return tuple(default), tuple(named), any_

    def _with_where(self, q: A.Query) -> A.Query:
        q.default, q.named, q.has_dataset = self.dataset()
        self.take("WHERE")
        q.pattern = self.modifiers(self.group(), None)
        return q

    def construct(self) -> A.Query:
        q = A.Query("CONSTRUCT", A.BGP(()))
        if self.at("{"):
            q.template = self.template()
            q.default, q.named, q.has_dataset = self.dataset()
            self.need("WHERE") if not self.at("{") else None
            q.pattern = self.modifiers(self.group(), None)
        else:
            q.default, q.named, q.has_dataset = self.dataset()
            self.need("WHERE")
            start = self.i
            q.template = tuple((t, None) for t in self._template_triples())
            self.i = start
            q.pattern = self.modifiers(self.group(), None)
        return q

    def _template_triples(self) -> list:
        """The triples of { ... }, blank nodes kept."""
        keep, self.blank = self.blank, lambda label: Blank(label or f"t{self._count()}")
        self.need("{")
        out: list = []
        while not self.at("}"):
            self.triples_same_subject(out, paths=False)
            if not self.take("."):
                break
        self.need("}")
        self.blank = keep
        return out

    def _count(self) -> int:
        self.fresh += 1
        return self.fresh

    def template(self) -> tuple:
        return tuple((t, None) for t in self._template_triples())

    def describe(self) -> A.Query:
        terms: list = []
        if not self.take("*"):
            while self.kind in ("var", "iri", "name"):
                terms.append(self.var_or_term())
        q = A.Query("DESCRIBE", A.Values((), ((),)))
        q.default, q.named, q.has_dataset = self.dataset()
        if self.at("WHERE", "{"):
            self.take("WHERE")
            q.pattern = self.modifiers(self.group(), None)
        q.terms = tuple(terms) or tuple(A.variables(q.pattern))
        return q

    def select(self, top: bool = False) -> A.Query:
        self.need("SELECT")
        distinct, reduced = self.take("DISTINCT"), self.take("REDUCED")
        items: list[tuple[Var, object]] | None = None
        outer, self.aggregates = self.aggregates, []
        if not self.take("*"):
            items = []
            while self.kind == "var" or self.at("("):
                if self.take("("):
                    e = self.expression()
                    self.need("AS")
                    items.append((Var(self.next()[1:]), e))
                    self.need(")")
                else:
                    items.append((Var(self.next()[1:]), None))
            if not items:
                raise SyntaxProblem("SELECT needs variables")
        q = A.Query("SELECT", A.BGP(()))
        q.default, q.named, q.has_dataset = self.dataset() if top else ((), (), False)
        self.take("WHERE")
        pattern = self.group()
        q.pattern = self.modifiers(pattern, items, distinct, reduced, select=True)
        q.variables = tuple(v for v, _ in items) if items is not None else tuple(v for v in A.variables(pattern) if not v.name.startswith("."))
        self.aggregates = outer
        return q

    def modifiers(self, p: A.Pattern, items: list | None, distinct: bool = False, reduced: bool = False, select: bool = False) -> A.Pattern:
        outer_aggs = self.aggregates
        if not select:
            self.aggregates = []
        keys: list[Var] | None = None
        if self.take("GROUP"):
            self.need("BY")
            keys = []
            while True:
                if self.kind == "var":
                    keys.append(Var(self.next()[1:]))
                elif self.take("("):
                    e = self.expression()
                    v = self.new_var()
                    if self.take("AS"):
                        v = Var(self.next()[1:])
                    self.need(")")
                    p = A.Extend(p, v, e)
                    keys.append(v)
                elif self.kind in ("iri", "name") or (self.kind == "word" and self.value.upper() in FUNCTIONS):
                    v = self.new_var()
                    p = A.Extend(p, v, self.primary())
                    keys.append(v)
                else:
                    break
        having = []
        if self.take("HAVING"):
            while self.at("(") or self.kind in ("iri", "name") or (self.kind == "word" and self.value.upper() in FUNCTIONS | AGGREGATES | {"NOT", "EXISTS", "AGG"}):
                having.append(self.primary())
        order: list[tuple[bool, object]] = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if self.at("ASC", "DESC"):
                    down = self.next().upper() == "DESC"
                    order.append((down, self.primary()))
                elif self.kind == "var":
                    order.append((False, Var(self.next()[1:])))
                elif self.at("(") or self.kind in ("iri", "name") or (self.kind == "word" and self.value.upper() in FUNCTIONS | AGGREGATES):
                    order.append((False, self.primary()))
                else:
                    break
        start, length = 0, None
        while self.at("LIMIT", "OFFSET"):
            if self.next().upper() == "LIMIT":
                length = int(self.next())
            else:
                start = int(self.next())
        # aggregates of the select list were met while parsing it
        if keys is not None or self.aggregates:
            p = A.Group(p, tuple(keys or ()), tuple((v, a) for v, a in self.aggregates))
        for h in having:
            p = A.Filter(h, p)
        if self.take("VALUES"):
            p = A.Join(p, self.values())
        for v, e in items or []:
            if e is not None:
                p = A.Extend(p, v, e)
        if order:
            p = A.OrderBy(p, tuple(order))
        if select:
            shown = tuple(v for v, _ in items) if items is not None else tuple(v for v in A.variables(p) if not v.name.startswith("."))
            p = A.Project(p, shown)
        if distinct:
            p = A.Distinct(p)
        elif reduced:
            p = A.Reduced(p)
        if start or length is not None:
            p = A.Slice(p, start, length)
        self.aggregates = outer_aggs
        return p

    def values(self) -> A.Values:
        vs: list[Var] = []
        rows: list[tuple] = []
        if self.kind == "var":
            vs.append(Var(self.next()[1:]))
            self.need("{")
            while not self.take("}"):
                rows.append((None if self.take("UNDEF") else self.var_or_term(),))
        else:
            self.need("(")
            while not self.take(")"):
                vs.append(Var(self.next()[1:]))
            self.need("{")
            while not self.take("}"):
                self.need("(")
                row: list = []
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.var_or_term())
                if len(row) != len(vs):
                    raise SyntaxProblem("a VALUES row has another length")
                rows.append(tuple(row))
        return A.Values(tuple(vs), tuple(rows))

    # group graph patterns
    def group(self) -> A.Pattern:
        self.need("{")
        if self.at("SELECT"):
            p: A.Pattern = self.select().pattern
            if self.take("VALUES"):
                p = A.Join(p, self.values())
            self.need("}")
            return p
        p = A.BGP(())
        filters: list = []
        triples: list = []

        def flush() -> None:
            nonlocal p, triples
            for q in self._bgps(triples):
                p = _join(p, q)
            triples = []

        while not self.take("}"):
            if self.take("FILTER"):
                filters.append(self.primary())
            elif self.take("OPTIONAL"):
                flush()
                inner = self.group()
                cond = None
                if isinstance(inner, A.Filter):
                    cond, inner = inner.condition, inner.inner
                p = A.LeftJoin(p, inner, cond)
            elif self.take("MINUS"):
                flush()
                p = A.Minus(p, self.group())
            elif self.take("LATERAL"):
                flush()
                p = A.Lateral(p, self.group())
            elif self.take("BIND"):
                flush()
                self.need("(")
                e = self.expression()
                self.need("AS")
                v = Var(self.next()[1:])
                self.need(")")
                if v in A.variables(p):
                    raise SyntaxProblem(f"BIND of ?{v.name}, which is in use")
                p = A.Extend(p, v, e)
            elif self.take("VALUES"):
                flush()
                p = _join(p, self.values())
            elif self.take("GRAPH"):
                flush()
                name = Var(self.next()[1:]) if self.kind == "var" else IRI(self.iri())
                p = _join(p, A.Graph(name, self.group()))
            elif self.take("SERVICE"):
                flush()
                silent = self.take("SILENT")
                name = Var(self.next()[1:]) if self.kind == "var" else IRI(self.iri())
                start = self.tokens[self.i][2]
                inner = self.group()
                end = self.tokens[self.i - 1][2] + 1
                p = _join(p, A.Service(name, inner, silent, self.text[start:end]))
            elif self.at("{"):
                flush()
                q = self.group()
                while self.take("UNION"):
                    q = A.Union(q, self.group())
                p = _join(p, q)
            else:
                self.triples_same_subject(triples, paths=True)
                if not self.at("}"):
                    if not self.take(".") and not self.at("FILTER", "OPTIONAL", "MINUS", "LATERAL", "BIND", "VALUES", "GRAPH", "SERVICE", "{"):
                        raise SyntaxProblem(f"unexpected {self.value!r}")
                continue
            self.take(".")
        flush()
        for f in filters:
            p = A.Filter(f, p)
        return p

    def _bgps(self, triples: list) -> list[A.Pattern]:
        """Neighbouring triple patterns as one BGP; paths and property functions by themselves."""
        out: list[A.Pattern] = []
        plain: list[A.TriplePattern] = []
        for s, p, o in triples:
            if isinstance(p, IRI | Var):
                if isinstance(p, IRI) and p.value in self.property_functions:
                    as_list = lambda x: x if isinstance(x, tuple) else (x,)
                    out.append(A.PropertyFunction(p.value, as_list(s), as_list(o)))
                else:
                    plain.append(A.TriplePattern(s, p, o))
            else:
                out.append(A.PathPattern(s, p, o))
        return ([A.BGP(tuple(plain))] if plain else []) + out

    def triples_same_subject(self, out: list, paths: bool) -> None:
        if self.at("<<"):
            s = self.reified(out, paths)
            if not (self.at(".", "}")):
                self.property_list(s, out, paths)
            return
        s, listed = self.node(out, paths)
        if listed and (self.at(".", "}")):
            return
        self.property_list(s, out, paths)

    def reified(self, out: list, paths: bool) -> object:
        """<< s p o ~ r >> : its reifier."""
        self.need("<<")
        s, _ = self.node(out, paths)
        p = self.verb()
        o, _ = self.node(out, paths)
        r = self.var_or_term() if self.take("~") and not self.at(">>") else self.blank(None)
        self.need(">>")
        out.append((r, IRI(RDF + "reifies"), Triple(s, p, o)))
        return r

    def node(self, out: list, paths: bool) -> tuple[object, bool]:
        """A term, a [property list] or a (collection), and whether it may stand alone."""
        if self.at("<<"):
            return self.reified(out, paths), True
        if self.take("["):
            b = self.blank(None)
            if not self.at("]"):
                self.property_list(b, out, paths)
            self.need("]")
            return b, True
        if self.take("("):
            items: list = []
            while not self.take(")"):
                items.append(self.node(out, paths)[0])
            if self.property_functions and self._list_for_function(items):
                return tuple(items), True
            head: object = IRI(RDF + "nil")
            for x in reversed(items):
                b = self.blank(None)
                out.append((b, IRI(RDF + "first"), x))
                out.append((b, IRI(RDF + "rest"), head))
                head = b
            return head, bool(items)
        return self.var_or_term(), False

    def _list_for_function(self, items: list) -> bool:
        """Whether the list just read is an argument of a property function, before or after it."""
        def is_fn(i: int) -> bool:
            k, v, _ = self.tokens[i]
            if k == "iri":
                return v[1:-1] in self.property_functions
            if k == "name":
                prefix, _, local = v.partition(":")
                return self.prefixes.get(prefix, "") + local in self.property_functions
            return False

        if is_fn(self.i):
            return True
        depth, j = 0, self.i - 1
        while j >= 0:  # back to the opening bracket
            v = self.tokens[j][1] if self.tokens[j][0] == "op" else ""
            depth += (v == ")") - (v == "(")
            if depth == 0:
                break
            j -= 1
        return j > 0 and is_fn(j - 1)

    def property_list(self, s: object, out: list, paths: bool) -> None:
        while True:
            verb = self.path() if paths else self.verb()
            if isinstance(verb, A.Link):
                verb = IRI(verb.iri)
            while True:
                o, _ = self.node(out, paths)
                out.append((s, verb, o))
                r = None
                while self.at("~", "{|"):
                    if self.take("~"):
                        r = self.var_or_term() if self.kind in ("var", "iri", "name", "blank") else self.blank(None)
                        out.append((r, IRI(RDF + "reifies"), Triple(s, verb, o)))
                    else:
                        self.need("{|")
                        if r is None:
                            r = self.blank(None)
                            out.append((r, IRI(RDF + "reifies"), Triple(s, verb, o)))
                        self.property_list(r, out, paths)
                        self.need("|}")
                        r = None
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.at(".", "}", "]", "|}"):
                return

    # paths
    def path(self) -> object:
        if self.kind == "var":
            return Var(self.next()[1:])
        p = self.path_seq()
        while self.take("|"):
            p = A.Alt(p, self.path_seq())
        return p

    def path_seq(self) -> object:
        p = self.path_elt()
        while self.take("/"):
            p = A.Seq(p, self.path_elt())
        return p

    def path_elt(self) -> object:
        if self.take("^"):
            return A.Inverse(self.path_elt())
        p = self.path_primary()
        if self.kind == "op" and self.value in "?*+":
            # "?" before a variable is read as one token, so this is a modifier
            return A.Repeat(p, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[self.next()])
        if self.at("{") and self.tokens[self.i + 1][0] == "number" or self.at("{") and self.tokens[self.i + 1][1] == ",":
            self.need("{")
            least = int(self.next()) if self.kind == "number" else 0
            most: int | None = least
            if self.take(","):
                most = int(self.next()) if self.kind == "number" else None
            self.need("}")
            return A.Repeat(p, least, most)
        return p

    def path_primary(self) -> object:
        if self.kind == "word" and self.value == "a":
            self.i += 1
            return A.Link(RDF + "type")
        if self.take("!"):
            forward, backward = [], []

            def one() -> None:
                side = backward if self.take("^") else forward
                if self.kind == "word" and self.value == "a":
                    self.i += 1
                    side.append(RDF + "type")
                else:
                    side.append(self.iri())

            if self.take("("):
                while not self.take(")"):
                    one()
                    self.take("|")
            else:
                one()
            return A.Negated(tuple(forward), tuple(backward))
        if self.take("("):
            p = self.path()
            self.need(")")
            return p
        if self.kind == "iri" and self.value == "<any>":
            self.i += 1
            return A.AnyLink()
        return A.Link(self.iri())

    # expressions
    def expression(self) -> object:
        e = self.conjunction()
        while self.take("||"):
            e = A.Call("||", (e, self.conjunction()))
        return e

    def conjunction(self) -> object:
        e = self.relation()
        while self.take("&&"):
            e = A.Call("&&", (e, self.relation()))
        return e

    def relation(self) -> object:
        e = self.additive()
        if self.at("=", "!=", "<", ">", "<=", ">="):
            op = self.next()
            r = self.additive()
            return A.Call("!", (A.Call("=", (e, r)),)) if op == "!=" else A.Call(op, (e, r))
        negated = self.at("NOT")
        if negated or self.at("IN"):
            if negated:
                self.next()
            self.need("IN")
            self.need("(")
            args: list = []
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            call = A.Call("IN", (e, *args))
            return A.Call("!", (call,)) if negated else call
        return e

    def additive(self) -> object:
        e = self.multiplicative()
        while True:
            if self.at("+", "-"):
                op = self.next()
                e = A.Call(op, (e, self.multiplicative()))
            else:
                return e

    def multiplicative(self) -> object:
        e = self.unary()
        while self.at("*", "/"):
            op = self.next()
            e = A.Call(op, (e, self.unary()))
        return e

    def unary(self) -> object:
        if self.take("!"):
            return A.Call("!", (self.unary(),))
        if self.at("-", "+") and self.tokens[self.i + 1][0] != "number":
            return A.Call("neg" if self.next() == "-" else "pos", (self.unary(),))
        return self.primary()

    def primary(self) -> object:
        k, v = self.kind, self.value
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if k == "var":
            self.i += 1
            return Var(v[1:])
        if self.at("<<("):
            t = self.triple_term()
            return A.Call("TRIPLE", (t.s, t.p, t.o))
        if (lit := self.literal()) is not None:
            return lit
        if k in ("iri", "name"):
            name = self.iri()
            if self.at("("):
                return A.Call(name, self.arguments())
            return IRI(name)
        if k == "word":
            w = v.upper()
            if w == "NOT":
                self.next()
                self.need("EXISTS")
                return A.Call("!", (A.Exists(self.group()),))
            if w == "EXISTS":
                self.next()
                return A.Exists(self.group())
            if w in AGGREGATES or w == "AGG":
                return self.aggregate()
            if w in FUNCTIONS:
                self.next()
                return A.Call({"URI": "IRI", "ISURI": "ISIRI"}.get(w, w), self.arguments())
        raise SyntaxProblem(f"no expression at {v!r}")

    def arguments(self) -> tuple:
        self.need("(")
        args: list = []
        while not self.take(")"):
            self.take("DISTINCT")
            args.append(self.expression())
            if not self.at(")"):
                self.need(",")
        return tuple(args)

    def aggregate(self) -> Var:
        if self.aggregates is None:
            raise SyntaxProblem("no aggregate may stand here")
        name = self.next().upper()
        self.need("(")
        if name == "AGG":
            name = self.iri()
            self.take(",")
        distinct = self.take("DISTINCT")
        args: list = []
        options: list = []
        if self.take("*"):
            if name != "COUNT":
                raise SyntaxProblem(f"{name} of *")
        else:
            while not self.at(")", ";"):
                args.append(self.expression())
                self.take(",")
        while self.take(";"):
            key = self.next().upper()
            self.need("=")
            options.append((key, self.expression()))
        self.need(")")
        a = A.Aggregate(name, tuple(args), distinct, tuple(options))
        for v, b in self.aggregates:
            if a == b:
                return v
        v = self.new_var()
        self.aggregates.append((v, a))
        return v

    # updates
    def update(self) -> list[A.Operation]:
        ops: list[A.Operation] = []
        self.prologue()
        while self.kind != "end":
            ops.append(self.operation())
            if not self.take(";"):
                break
            self.prologue()
        if self.kind != "end":
            raise SyntaxProblem(f"unexpected {self.value!r}")
        return ops

    def quads(self) -> tuple:
        """The (triple, graph) of { ... GRAPH g { ... } ... }, blank nodes kept."""
        keep, self.blank = self.blank, lambda label: Blank(label or f"t{self._count()}")
        out: list = []
        self.need("{")
        while not self.take("}"):
            if self.take("GRAPH"):
                g = self.var_or_term()
                self.need("{")
                inner: list = []
                while not self.take("}"):
                    self.triples_same_subject(inner, paths=False)
                    self.take(".")
                out += [(t, g) for t in inner]
            else:
                inner = []
                self.triples_same_subject(inner, paths=False)
                out += [(t, None) for t in inner]
            self.take(".")
        self.blank = keep
        return tuple(out)

    def graph_ref(self) -> object:
        if self.at("DEFAULT", "NAMED", "ALL"):
            return self.next().upper()
        self.take("GRAPH")
        return IRI(self.iri())

    def operation(self) -> A.Operation:
        if self.take("LOAD"):
            silent = self.take("SILENT")
            src = self.iri()
            target = self.graph_ref() if self.take("INTO") else None
            return A.Operation("LOAD", source=src, target=target, silent=silent)
        for kind in ("CLEAR", "DROP", "CREATE"):
            if self.take(kind):
                silent = self.take("SILENT")
                return A.Operation(kind, target=self.graph_ref(), silent=silent)
        for kind in ("ADD", "MOVE", "COPY"):
            if self.take(kind):
                silent = self.take("SILENT")
                src = self.graph_ref()
                self.need("TO")
                return A.Operation(kind, source=src, target=self.graph_ref(), silent=silent)
        with_graph = self.iri() if self.take("WITH") else None
        if self.take("INSERT"):
            if self.take("DATA"):
                return A.Operation("INSERT DATA", insert=self.quads())
            return self._modify((), self.quads(), with_graph)
        self.need("DELETE")
        if self.take("DATA"):
            return A.Operation("DELETE DATA", delete=self.quads())
        if self.take("WHERE"):
            start = self.i
            quads = self.quads()
            self.i = start
            return A.Operation("MODIFY", delete=quads, pattern=self.group(), with_graph=with_graph)
        delete = self.quads()
        return self._modify(delete, self.quads() if self.take("INSERT") else (), with_graph)

    def _modify(self, delete: tuple, insert: tuple, with_graph: str | None) -> A.Operation:
        default, named, any_ = [], [], False
        while self.take("USING"):
            any_ = True
            (named if self.take("NAMED") else default).append(self.iri())
        self.need("WHERE")
        return A.Operation("MODIFY", delete, insert, self.group(), with_graph=with_graph, default=tuple(default), named=tuple(named), has_dataset=any_)


def _join(a: A.Pattern, b: A.Pattern) -> A.Pattern:
    if a == A.BGP(()):
        return b
    if isinstance(a, A.BGP) and isinstance(b, A.BGP):
        return A.BGP(a.triples + b.triples)
    return b if a == A.BGP(()) else A.Join(a, b)


def parse_query(text: str, base: str = "", property_functions: frozenset[str] = frozenset()) -> A.Query:
    return Parser(text, base, property_functions).query()


def parse_update(text: str, base: str = "", property_functions: frozenset[str] = frozenset()) -> list[A.Operation]:
    return Parser(text, base, property_functions).update()
