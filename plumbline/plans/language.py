"""Queries as text: `#>{db.orders}#->filter(x|$x.o_totalprice > 1000)->groupBy(~[o_custkey], ~[n: x|$x : y|$y->count()])`.

Text is parsed to nested tuples and these are evaluated straight to DataFrame plans. What is covered: table accessors,
class extents (`Person.all()`), the relation functions, window and aggregate columns, every scalar and list function by
its name, lambdas, `let`, `if`, enumerations, dates, graph fetch trees. Errors carry the place in the text.
"""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lookup, nulls, python_name
from plumbline.functions.dates import DateLiteral
from plumbline.functions.nulls import col
from plumbline.operators import aggs, ranks, windows
from plumbline.operators.relation import Rel, Row
from plumbline.plans import graph
from plumbline.plans.model import Extent, Model

_TOKEN = re.compile(
    r"""\s*(?:(?P<table>\#>\{[^}]*\}\#)|(?P<tree>\#\{.*?\}\#)|(?P<latest>%latest)|(?P<date>%\d{4}(?:-\d\d){0,2}(?:T[\d:.]+(?:[+-]\d{4})?)?)|(?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?[dD]?)
    |(?P<string>'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*(?:::[A-Za-z_][A-Za-z_0-9]*)*)|(?P<op>->|==|!=|<=|>=|&&|\|\||[-+*/<>!$~.,:;=|(){}\[\]]))""",
    re.X | re.S,
)
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"can't read {text[at:at + 20]!r} at {at}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "", -1)

    def take(self, want: str | None = None) -> str:
        kind, text, where = self.peek()
        if kind == "end" or (want is not None and text != want):
            raise SyntaxError(f"expected {want or 'more'!r} but found {text or 'the end'!r} at {where}")
        self.at += 1
        return text

    def parse(self) -> tuple:
        out = self.statements()
        if self.peek()[0] != "end":
            raise SyntaxError(f"unexpected {self.peek()[1]!r} at {self.peek()[2]}")
        return out

    def statements(self) -> tuple:
        """`let a = 1; $a + 1`: the last one is the value."""
        out = [self.statement()]
        while self.peek()[1] == ";":
            self.take()
            if self.peek()[0] == "end" or self.peek()[1] in ("}", ")"):
                break
            out.append(self.statement())
        return out[0] if len(out) == 1 else ("block", out)

    def statement(self) -> tuple:
        if self.peek()[1] != "let" or self.peek(1)[0] != "name":
            return self.expression()
        self.take()
        name = self.take()
        self.take("=")
        return ("let", name, self.expression())

    def expression(self, level: int = 0) -> tuple:
        if level == len(_LEVELS):
            return self.unary()
        out = self.expression(level + 1)
        while self.peek()[1] in _LEVELS[level] and self.peek()[0] == "op":
            out = ("op", self.take(), out, self.expression(level + 1))
        return out

    def unary(self) -> tuple:
        if self.peek()[1] in ("!", "-") and self.peek()[0] == "op":
            return ("unary", self.take(), self.unary())
        out = self.primary()
        while self.peek()[1] in ("->", "."):
            if self.take() == "->":
                out = ("call", self.take(), [out, *self.arguments()])
            else:
                name = self.take()
                out = ("call", name, [out, *self.arguments()]) if self.peek()[1] == "(" else ("get", out, name)
        return out

    def arguments(self) -> list[tuple]:
        self.take("(")
        return self.until(")")

    def until(self, end: str) -> list[tuple]:
        out = []
        while self.peek()[1] != end:
            out.append(self.expression())
            if self.peek()[1] != end:
                self.take(",")
        self.take(end)
        return out

    def body(self) -> tuple:
        """A lambda after its parameters' names or at its bar."""
        names = []
        while self.peek()[1] != "|":
            names.append(self.take())
            if self.peek()[1] == ",":
                self.take()
        self.take("|")
        return ("lambda", names, self.statements())

    def primary(self) -> tuple:
        kind, text, where = self.peek()
        if kind == "name" and self.peek(1)[1] == "|":
            return self.body()
        self.at += 1
        if kind == "table":
            return ("table", text[3:-2].strip().rpartition(".")[2])
        if kind == "tree":
            return ("tree", *_tree(text[2:-2], where))
        if kind == "number":
            return ("value", float(text.rstrip("dD")) if re.search(r"[.eEdD]", text) else int(text))
        if kind == "string":
            return ("value", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind in ("date", "latest"):
            return ("date", text)
        if kind == "name":
            if text in ("true", "false"):
                return ("value", text == "true")
            return ("call", text, self.arguments()) if self.peek()[1] == "(" else ("name", text)
        if text == "$":
            return ("var", self.take())
        if text == "(":
            out = self.expression()
            self.take(")")
            return out
        if text == "[":
            return ("list", self.until("]"))
        if text == "{":
            out = self.body()
            self.take("}")
            return out
        if text == "|":
            self.at -= 1
            return self.body()
        if text == "~":
            if self.peek()[1] != "[":
                return ("columns", [self.column()])
            self.take("[")
            out = []
            while self.peek()[1] != "]":
                out.append(self.column())
                if self.peek()[1] == ",":
                    self.take()
            self.take("]")
            return ("columns", out)
        raise SyntaxError(f"unexpected {text or 'end'!r} at {where}")

    def column(self) -> tuple:
        name = self.take().strip("'")
        parts = []
        while self.peek()[1] == ":":
            self.take()
            parts.append(self.expression())
        return (name, *parts)


def _tree(text: str, where: int) -> tuple[str, dict[str, Any]]:
    """Class and properties of `Person{name, firm{legalName}}`; a property without a tree maps to None."""
    words = re.findall(r"[\w:$]+|[{},]", text)
    if re.sub(r"\s", "", text) != "".join(words) or len(words) < 3:
        raise SyntaxError(f"can't read the tree {text!r} at {where}")
    at = 1

    def level() -> dict[str, Any]:
        nonlocal at
        out: dict[str, Any] = {}
        at += 1
        while at < len(words) and words[at] != "}":
            name = words[at]
            at += 1
            out[name] = level() if at < len(words) and words[at] == "{" else None
            at += at < len(words) and words[at] == ","
        if at >= len(words):
            raise SyntaxError(f"the tree {text!r} at {where} isn't closed")
        at += 1
        return out

    return words[0], level()


class _Group:
    """The values of a group inside a reducing lambda; name: the column, where it is one as it is."""

    def __init__(self, column: Column | None, whole_row: bool = False, name: str | None = None):
        self.column, self.whole_row, self.distinct, self.key, self.name = column, whole_row, False, None, name


class _Outer(Row):
    """The row around a lateral query."""

    def __init__(self, outer):
        object.__setattr__(self, "_outer", outer)

    def __getattr__(self, name: str) -> Column:
        return self._outer(name)

    __getitem__ = __getattr__


class _Fetched:
    """The frame of a graph fetch."""

    def __init__(self, df):
        self.df = df


class _Partition:
    def __init__(self, over: windows.Over):
        self.over = over


class _RowAt:
    def __init__(self, read):
        self.read = read


class _Path:
    """A property path from an extent's variable; becomes a column when it is used."""

    def __init__(self, root: _Start, names: tuple[str, ...]):
        self.root, self.names = root, names

    def column(self) -> Column:
        return self.root.use(".".join(self.names))


class _Start:
    def __init__(self, extent: Extent):
        self.extent, self.seen = extent, []

    def use(self, path: str) -> Column:
        self.seen.append(path)
        step = path.rpartition(".")[0]
        if step:
            self.extent = self.extent.navigate(step)
        return self.extent.at(path)


_FRAME = ("rows", "range", "_range")


class Engine:
    """run(text) gives the frame of a query over a model's tables and classes."""

    def __init__(self, model: Model):
        self.model = model

    def run(self, text: str, **parameters: Any):
        """parameters: values for the text's `$name`s: numbers, texts, booleans, dates, lists of these, relations, null.

        They are bound as values and never become part of the text.
        """
        out = self.value(Parser(text).parse(), {name: self._parameter(v) for name, v in parameters.items()})
        if isinstance(out, Rel):
            return out.df
        if isinstance(out, (Extent, _Fetched)):
            return out.df
        return self.model.database.spark.range(1).select(self.column(out).alias("value"))

    # values

    def _parameter(self, v: Any) -> Any:
        if isinstance(v, (list, tuple)):
            return [self._parameter(x) for x in v]
        if isinstance(v, dt.datetime):
            return F.lit(v).cast("timestamp_ntz")
        return F.lit(v) if v is None or isinstance(v, dt.date) else v

    def column(self, x: Any) -> Column:
        if isinstance(x, _Path):
            return x.column()
        if isinstance(x, list):
            return F.array(*map(self.column, x))
        if isinstance(x, DateLiteral):
            return x.column()
        return col(x)

    def value(self, e: tuple, env: dict[str, Any]) -> Any:
        return getattr(self, f"_{e[0]}")(e, env)

    def _block(self, e, env):
        env = dict(env)
        for part in e[1]:
            out = self.value(part, env)
            if part[0] == "let":
                env[part[1]] = out
        return out

    def _let(self, e, env):
        return self.value(e[2], env)

    def _tree(self, e, env):
        return e

    def _value(self, e, env):
        return e[1]

    def _date(self, e, env):
        return e[1] if e[1] == "%latest" else DateLiteral(e[1])

    def _var(self, e, env):
        return env[e[1]]

    def _name(self, e, env):
        return e[1]

    def _list(self, e, env):
        return [self.value(x, env) for x in e[1]]

    def _columns(self, e, env):
        return e

    def _lambda(self, e, env):
        return e

    def _table(self, e, env):
        return self.model.database.table(e[1])

    def _get(self, e, env):
        owner = self.value(e[1], env)
        if isinstance(owner, _Start):
            return _Path(owner, (e[2],))
        if isinstance(owner, _Path):
            return _Path(owner.root, (*owner.names, e[2]))
        if isinstance(owner, Row):
            return owner[e[2]]
        if isinstance(owner, _RowAt):
            return owner.read(e[2])
        if isinstance(owner, Column):
            return owner[e[2]]
        return e[2]  # a value of an enumeration

    def _unary(self, e, env):
        x = self.value(e[2], env)
        return (not x if e[1] == "!" else -x) if isinstance(x, (bool, int, float)) else (~self.column(x) if e[1] == "!" else -self.column(x))

    def _op(self, e, env):
        a, b = self.value(e[2], env), self.value(e[3], env)
        if e[1] in ("==", "!="):
            a, b = (None if isinstance(x, list) and not x else x for x in (a, b))
            a, b = (x if x is None else self.column(x) for x in (a, b))
            return nulls.equal(a, b) if e[1] == "==" else nulls.not_equal(a, b)
        a, b = self.column(a), self.column(b)
        simple = {"<": nulls.less_than, "<=": nulls.less_than_equal, ">": nulls.greater_than, ">=": nulls.greater_than_equal, "&&": nulls.and_, "||": nulls.or_}
        if e[1] in simple:
            return simple[e[1]](a, b)
        if e[1] == "/":
            return lookup("divide")(a, b)
        if e[1] == "+" and "string" in (self._kind(e[2], env), self._kind(e[3], env)):
            return F.concat(a.cast("string"), b.cast("string"))
        return {"+": a + b, "-": a - b, "*": a * b}[e[1]]

    def _kind(self, e, env) -> str:
        return "string" if e[0] == "value" and isinstance(e[1], str) else self._kind(e[2], env) if e[0] == "op" and e[1] == "+" else ""

    def apply(self, f: tuple, *args: Any, env: dict[str, Any] | None = None) -> Any:
        return self.value(f[2], {**(env or {}), **dict(zip(f[1], args))})

    # calls

    def _call(self, e, env):
        name, args = e[1].rpartition("::")[2], e[2]
        if args and args[0][0] == "name" and args[0][1] in self.model.classes and name in ("all", "getAll", "allVersions", "allVersionsInRange"):
            dates = [d if isinstance(d, str) else self._day(d) for d in (self.value(a, env) for a in args[1:])]
            return {"allVersions": self.model.all_versions, "allVersionsInRange": self.model.all_versions_in_range}.get(name, self.model.all)(args[0][1], *dates)
        if name == "over":
            return self.over(args, env)
        if name in _FRAME:
            return (windows.rows if name == "rows" else windows.range_)(*(self.value(a, env) for a in args))
        if name == "unbounded":
            return None
        if name == "if":
            condition, then, other = (self.value(a, env) for a in args)
            then, other = (self.apply(x, env=env) if isinstance(x, tuple) and x[0] == "lambda" else x for x in (then, other))
            return nulls.if_(self.column(condition), self.column(then), self.column(other))
        owner = self.value(args[0], env) if args else None
        rest = args[1:]
        if isinstance(owner, tuple) and owner and owner[0] == "lambda" and name == "eval":
            return self.apply(owner, *(self.value(a, env) for a in rest), env=env)
        if isinstance(owner, _Fetched) and name in ("serialize", "graphFetch", "graphFetchChecked"):
            return Rel(graph.serialize(owner.df)) if name == "serialize" else owner
        if isinstance(owner, Rel):
            return self.relation(owner, name, rest, env)
        if isinstance(owner, Extent):
            return self.extent(owner, name, rest, env)
        if isinstance(owner, _Group):
            return self.reduce(owner, name, rest, env)
        if isinstance(owner, _Partition):
            return self.window(owner, name, rest, env)
        if isinstance(owner, tuple) and owner and owner[0] == "columns" and name in ("ascending", "descending", "asc", "desc"):
            return [(c[0], name.startswith("asc")) for c in owner[1]]
        return self.scalar(name, owner, rest, env) if args else lookup(name)()

    @staticmethod
    def _day(d: DateLiteral) -> dt.datetime:
        y, m, day, h, mi, s, _ = (int(p) if p else 0 for p in d.parts)
        return dt.datetime(y, m or 1, day or 1, h, mi, s)

    def scalar(self, name: str, owner: Any, rest: list[tuple], env) -> Column:
        args = []
        for a in rest:
            v = self.value(a, env)
            if isinstance(v, tuple) and v[0] == "lambda":
                args.append(self._function(v, env))
            else:
                args.append(v.column() if isinstance(v, (_Path, DateLiteral)) else v)
        listed = isinstance(owner, list) or any(callable(a) and not isinstance(a, Column) for a in args)
        for family in (["collections"] if listed else []) + [None]:
            try:
                return lookup(name, family)(self.column(owner) if not isinstance(owner, DateLiteral) or not name.startswith("has") else owner, *args)
            except KeyError:
                continue
        raise NameError(f"no function {name!r}")

    def _function(self, f: tuple, env):
        """A Python function with as many parameters as the lambda: Spark looks at their number."""
        run = lambda *xs: self.column(self.apply(f, *xs, env=env))
        return {0: lambda: run(), 1: lambda x: run(x), 2: lambda x, y: run(x, y), 3: lambda x, y, z: run(x, y, z)}[len(f[1])]

    def over(self, args: list[tuple], env) -> windows.Over:
        parts, sort, frame = [], [], None
        for a in args:
            v = self.value(a, env)
            if isinstance(v, tuple) and v[0] == "columns":
                parts += [c[0] for c in v[1]]
            elif isinstance(v, windows.Frame):
                frame = v
            elif isinstance(v, list):
                sort += [x for y in v for x in (y if isinstance(y, list) else [y])]
        return windows.over(parts, sort, frame)

    def reduce(self, g: _Group, name: str, rest: list[tuple], env):
        if name == "distinct":
            g.distinct = True
            return g
        args = [self.value(a, env) for a in rest]
        if name in ("count", "size"):
            return aggs.count_distinct(g.column) if g.distinct else aggs.count(None if g.whole_row else g.column)
        if name == "percentile":
            p, ascending, continuous = (*args, True, True)[:3] if len(args) < 3 else args[:3]
            if continuous:
                return F.percentile(g.column, F.lit(p if ascending else 1 - p))
            if g.name is None:
                raise NameError("a discrete percentile is of a column as it is")
            return aggs.percentile(g.name, p, ascending, False)
        for spelled in (python_name(name), python_name(name) + "_"):
            if hasattr(aggs, spelled):
                return getattr(aggs, spelled)(g.column, *args)
        raise NameError(f"no reducer {name!r}")

    def window(self, p: _Partition, name: str, rest: list[tuple], env):
        numbers = [v for v in (self.value(a, env) for a in rest) if isinstance(v, int)]
        f = getattr(windows, python_name(name))
        if name in ("rowNumber", "rank", "denseRank", "percentRank", "cumulativeDistribution", "averageRank"):
            return f(p.over)
        if name == "ntile":
            return f(p.over, numbers[0])
        return _RowAt(lambda c: f(p.over, c, *numbers))

    def _reduced(self, row: Any, spec: tuple, env) -> Column:
        """name: map : reduce"""
        mapped = self.apply(spec[1], row, env=env)
        whole = isinstance(mapped, (Row, _Start))
        body = spec[1][2]
        name = body[2] if body[0] == "get" and body[1] == ("var", spec[1][1][0]) and isinstance(row, Row) else None
        return self.column(self.apply(spec[2], _Group(None if whole else self.column(mapped), whole, name), env=env))

    def _names(self, e: tuple, env) -> list[str]:
        v = self.value(e, env)
        items = v if isinstance(v, list) else [v]
        return [c[0] for x in items for c in x[1]]

    def relation(self, r: Rel, name: str, rest: list[tuple], env) -> Any:
        value = lambda i: self.value(rest[i], env)
        one = lambda f: lambda row: self.column(self.apply(f, row, env=env))
        if name == "filter":
            return r.filter(one(value(0)))
        if name == "map":
            return r.map(one(value(0)))
        if name in ("select", "distinct"):
            return getattr(r, name)(*(self._names(rest[0], env) if rest else ()))
        if name == "project":
            return r.project(**{c[0]: one(c[1]) for c in value(0)[1]})
        if name == "rename":
            return r.rename(**{self._names(rest[0], env)[0]: self._names(rest[1], env)[0]})
        if name in ("limit", "take", "drop", "slice"):
            return getattr(r, name)(*(value(i) for i in range(len(rest))))
        if name in ("first", "head", "size"):
            return getattr(r, name)()
        if name == "sort":
            keys = [value(i) for i in range(len(rest))]
            flat = [k for v in keys for x in (v if isinstance(v, list) else [v]) for k in (x if isinstance(x, list) else [x])]
            return r.sort(*(k if isinstance(k[0], str) and k[0] != "columns" else k[1][0][0] for k in flat))
        if name in ("sortBy", "sortByReversed"):
            return getattr(r, python_name(name))(one(value(0)))
        if name == "lateral":
            return r.lateral(lambda outer: self.apply(value(0), _Outer(outer), env=env).df)
        if name == "concatenate":
            return r.concatenate(value(0))
        if name == "extend":
            return self.extend(r, [value(i) for i in range(len(rest))], env)
        if name in ("groupBy", "aggregate"):
            keys = self._names(rest[0], env) if name == "groupBy" else []
            made = {c[0]: self._reduced(r.row, c, env) for c in value(len(rest) - 1)[1]}
            return r.group_by(keys, **made) if name == "groupBy" else r.aggregate(**made)
        if name == "pivot":
            specs = value(len(rest) - 1)[1]
            used = sorted({n for c in specs for n in r.df.columns if f"'{n}'" in repr(c[1])})
            return r.pivot(self._names(rest[0], env), value(1) if len(rest) == 3 else None, using=used, **{c[0]: self._reduced(r.row, c, env) for c in specs})
        if name == "join":
            kind = value(1).replace("_OUTER", "")
            return r.join(value(0), kind, lambda t, v: self.column(self.apply(value(2), t, v, env=env)), prefix=value(3) if len(rest) > 3 else None)
        if name == "asOfJoin":
            return self.as_of(r, value(0), value(1), value(2) if len(rest) > 2 else None, value(3) if len(rest) > 3 else None)
        if name == "flatten":
            return r.flatten(self._names(rest[0], env)[0])
        if name == "write":
            return r.write()
        raise NameError(f"no relation function {name!r}")

    def extend(self, r: Rel, args: list, env) -> Rel:
        over = args[0] if isinstance(args[0], windows.Over) else None
        specs = args[-1][1]
        made = {}
        for c in specs:
            if over is not None and len(c) == 3:
                row = self.apply(c[1], _Partition(over), over, r.row, env=env)
                whole = isinstance(row, Row)
                made[c[0]] = windows.reduce(over, self.column(self.apply(c[2], _Group(None if whole else self.column(row), whole), env=env)))
            elif over is not None:
                made[c[0]] = self.column(self.apply(c[1], _Partition(over), over, r.row, env=env))
            elif len(c) == 3:
                return r.extend_total(**{c[0]: self._reduced(r.row, c, env) for c in specs})
            else:
                made[c[0]] = self.column(self.apply(c[1], r.row, env=env))
        return Rel(r.df.withColumns(made))

    def as_of(self, left: Rel, right: Rel, match: tuple, keys: tuple | None, prefix: str | None) -> Rel:
        def sides(f: tuple, e: tuple) -> tuple[str, str, str]:
            op, a, b = e[1], e[2], e[3]
            if not (a[0] == b[0] == "get" and a[1][0] == b[1][0] == "var"):
                raise SyntaxError("an as-of condition compares a column of either side")
            if a[1][1] == f[1][0]:
                return a[2], op, b[2]
            return b[2], {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), a[2]

        pairs, todo = [], [keys[2]] if keys else []
        while todo:
            e = todo.pop()
            if e[1] == "&&":
                todo += [e[2], e[3]]
            else:
                a, _, b = sides(keys, e)
                pairs.append((a, b))
        time, op, other = sides(match, match[2])
        strip = lambda n: n.removeprefix(prefix) if prefix else n
        return left.as_of_join(right, time, op, strip(other), keys=[(a, strip(b)) for a, b in pairs], prefix=prefix)

    def extent(self, x: Extent, name: str, rest: list[tuple], env) -> Any:
        value = lambda i: self.value(rest[i], env)
        if name == "filter":
            f = value(0)
            test = f[2]
            # exists over a to-many property is a semi join
            if test[0] == "call" and test[1] in ("exists", "isNotEmpty", "isEmpty") and test[2][0][0] == "get" and test[2][0][1] == ("var", f[1][0]):
                inner = (lambda t, g=test[2][1]: self.column(self.apply(g, _Start(t), env=env))) if test[1] == "exists" else None
                return x.exists(test[2][0][2], inner, negate=test[1] == "isEmpty")
            start = _Start(x)
            condition = self.column(self.apply(f, start, env=env))
            return start.extent._with(start.extent.df.where(condition))
        if name == "project":
            start = _Start(x)
            made = [self.column(self.apply(c[1], start, env=env)).alias(c[0]) for c in value(0)[1]]
            return Rel(start.extent.df.select(*made))
        if name == "groupBy":
            start = _Start(x)
            keys = [self.column(self.apply(c[1], start, env=env)).alias(c[0]) for c in value(0)[1]]
            made = {c[0]: self._reduced(start, c, env) for c in value(1)[1]}
            return Rel(ranks.aggregate(start.extent.df, keys, made))
        if name in ("limit", "take"):
            return x.limit(value(0))
        if name in ("drop", "slice"):
            rows = Rel(x.df)
            return x._with(getattr(rows, name)(*(value(i) for i in range(len(rest)))).df)
        if name in ("first", "head"):
            return x.limit(1)
        if name in ("size", "count"):
            return Rel(x.df).size()
        if name in ("sortBy", "sortByReversed"):
            start = _Start(x)
            key = self.column(self.apply(value(0), start, env=env))
            # a later sort comes first, and keeps the order of the one before
            keys = [key.desc_nulls_first() if name == "sortByReversed" else key.asc_nulls_last(), *getattr(x, "order", ())]
            out = start.extent._with(start.extent.df.orderBy(*keys))
            out.order = keys
            return out
        if name in ("graphFetch", "graphFetchChecked"):
            return _Fetched(getattr(graph, python_name(name))(x, value(0)[2]))
        if name == "subType":
            return x.sub_type(value(0))
        raise NameError(f"no function {name!r} of a class")
