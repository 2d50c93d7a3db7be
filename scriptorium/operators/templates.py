"""Templates with fields, conditions and loops, as column expressions.

`rendered(rows, template)` adds a column with the template's text for each row; nothing
leaves the JVM.  Known are `{{ expression }}`, `{% if %} {% elif %} {% else %} {% endif %}`,
`{% for name in list %} {% else %} {% endfor %}` with `loop.index`, `loop.first` and
`loop.last`, and `{# remarks #}`.  Expressions have fields (`a`, `a.b`), strings, whole
numbers, true, false, none, `not`, `and`, `or`, comparisons, brackets, and filters after a
bar: upper, lower, trim, length, first, last, join(string), default(value), basename,
escape and safe.  With escape=True everything shown is escaped as for the web, but for what
`safe` lets through.

Null shows as nothing, and counts as false, as do '', 0, false and empty lists.  A tag that
stands alone on a line takes the line with it.  What a template names and the rows do not
have is an error when the template is read, with its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.report import html_escape

_TAG = re.compile(r"\{\{(.*?)\}\}|(?:(?<=\n)|\A)[ \t]*\{%((?:(?!%\}).)*)%\}[ \t]*(?:\n|\Z)|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*(?:\.\w+)*)|'([^']*)'|\"([^\"]*)\"|(==|!=|<=|>=|[<>()|,]))")
_ORDER = {"==": None, "!=": None, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


@dataclass(frozen=True)
class Value:
    """A column, its type, and whether it may be shown as it is."""

    column: Column
    kind: T.DataType
    safe: bool = False

    def text(self) -> Column:
        shown = F.initcap(self.column.cast("string")) if isinstance(self.kind, T.BooleanType) else self.column.cast("string")
        return F.coalesce(shown, F.lit(""))

    def truth(self) -> Column:
        if isinstance(self.kind, T.BooleanType):
            found = self.column
        elif isinstance(self.kind, T.NumericType):
            found = self.column != 0
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            found = F.size(self.column) > 0
        elif isinstance(self.kind, T.StringType):
            found = F.length(self.column) > 0
        else:
            found = self.column.isNotNull()
        return F.coalesce(found, F.lit(False))


Scope = dict[str, Value]
Part = Callable[[Scope], Column]


def _string(make: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(make(v.text()), T.StringType(), v.safe)


def _element(at: int) -> Callable[[Value], Value]:
    return lambda v: Value(F.try_element_at(v.column, F.lit(at)), v.kind.elementType)


def _length(v: Value) -> Value:
    return Value(F.coalesce(F.size(v.column) if isinstance(v.kind, (T.ArrayType, T.MapType)) else F.length(v.text()), F.lit(0)), T.IntegerType())


def _default(v: Value, other: Value) -> Value:
    return Value(F.when(v.truth(), v.text()).otherwise(other.text()), T.StringType())


def _join(v: Value, by: Value | None = None) -> Value:
    return Value(F.array_join(v.column.cast("array<string>"), "") if by is None else F.concat_ws("", F.aggregate(v.column.cast("array<string>"), F.lit(None).cast("string"), lambda a, x: F.when(x.isNull(), a).otherwise(F.when(a.isNull(), x).otherwise(F.concat(a, by.text(), x))))), T.StringType())


FILTERS: dict[str, Callable[..., Value]] = {
    "upper": _string(F.upper),
    "lower": _string(F.lower),
    "trim": _string(lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")),
    "basename": _string(lambda c: F.element_at(F.split(c, "/"), -1)),
    "escape": lambda v: Value(html_escape(v.text()), T.StringType(), True),
    "safe": lambda v: replace(v, safe=True),
    "length": _length,
    "first": _element(1),
    "last": _element(-1),
    "default": _default,
    "join": _join,
}


class _Expression:
    """Reads one expression, by descent."""

    def __init__(self, source: str, scope: Scope):
        self.source, self.scope, self.tokens, at = source, scope, [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"not understood: {source[at:].strip()!r}")
            self.tokens.append(m)
            at = m.end()
        self.next = 0

    def whole(self) -> Value:
        found = self.either()
        if self.next < len(self.tokens):
            raise ValueError(f"not understood: {self.tokens[self.next][0].strip()!r} in {self.source.strip()!r}")
        return found

    def word(self) -> str | None:
        """The next token, unless it is a string."""
        if self.next >= len(self.tokens):
            return None
        m = self.tokens[self.next]
        return m[2] or m[5]

    def take(self, word: str) -> bool:
        yes = self.word() == word
        self.next += yes
        return yes

    def must(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word!r} is missing in {self.source.strip()!r}")

    def either(self) -> Value:
        found = self.both()
        while self.take("or"):
            found = Value(found.truth() | self.both().truth(), T.BooleanType())
        return found

    def both(self) -> Value:
        found = self.negated()
        while self.take("and"):
            found = Value(found.truth() & self.negated().truth(), T.BooleanType())
        return found

    def negated(self) -> Value:
        return Value(~self.negated().truth(), T.BooleanType()) if self.take("not") else self.compared()

    def compared(self) -> Value:
        left, sign = self.filtered(), self.word()
        if sign not in _ORDER:
            return left
        self.next += 1
        right = self.filtered()
        if _ORDER[sign] is None:
            same = left.column.eqNullSafe(right.column)
            return Value(same if sign == "==" else ~same, T.BooleanType())
        return Value(F.coalesce(_ORDER[sign](left.column, right.column), F.lit(False)), T.BooleanType())

    def filtered(self) -> Value:
        found = self.atom()
        while self.take("|"):
            name, given = self.word(), []
            if name not in FILTERS:
                raise ValueError(f"no filter {name!r}; there are {sorted(FILTERS)}")
            self.next += 1
            if self.take("("):
                while not self.take(")"):
                    given.append(self.either())
                    if self.word() != ")":
                        self.must(",")
            found = FILTERS[name](found, *given)
        return found

    def atom(self) -> Value:
        if self.take("("):
            found = self.either()
            self.must(")")
            return found
        if self.next >= len(self.tokens):
            raise ValueError(f"something is missing in {self.source.strip()!r}")
        m = self.tokens[self.next]
        self.next += 1
        if m[1]:
            return Value(F.lit(int(m[1])), T.LongType())
        if m[5]:
            raise ValueError(f"not understood: {m[5]!r} in {self.source.strip()!r}")
        if m[2] is None:
            return Value(F.lit(m[3] if m[3] is not None else m[4]), T.StringType())
        if m[2] in ("true", "false"):
            return Value(F.lit(m[2] == "true"), T.BooleanType())
        if m[2] == "none":
            return Value(F.lit(None), T.NullType())
        return self.field(m[2])

    def field(self, path: str) -> Value:
        head, *rest = path.split(".")
        if head not in self.scope:
            raise ValueError(f"the rows have no {head!r}; they have {sorted(self.scope)}")
        found = self.scope[head]
        for name in rest:
            if not isinstance(found.kind, T.StructType) or name not in found.kind.names:
                raise ValueError(f"no {name!r} in {path!r}")
            found = Value(found.column[name], found.kind[name].dataType)
        return found


class _Template:
    """Reads a template into parts, each a column of a scope."""

    def __init__(self, source: str, escape: bool):
        self.escape, self.pieces, at = escape, [], 0
        for m in _TAG.finditer(source):
            self.pieces.append(("text", source[at : m.start()], at))
            if m[1] is not None:
                self.pieces.append(("show", m[1], m.start()))
            elif (tag := m[2] if m[2] is not None else m[3]) is not None:
                self.pieces.append(("tag", tag.strip(), m.start()))
            at = m.end()
        self.pieces.append(("text", source[at:], at))
        self.next, self.source = 0, source

    def whole(self) -> Part:
        found = self.until(())
        if self.next < len(self.pieces):
            raise ValueError(f"line {self.line(self.pieces[self.next][2])}: {self.pieces[self.next][1]!r} closes nothing")
        return found

    def line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    def until(self, ends: tuple[str, ...]) -> Part:
        """Parts up to a tag that begins with one of the words, which stays."""
        parts: list[Part] = []
        while self.next < len(self.pieces):
            kind, body, at = self.pieces[self.next]
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "tag" and word in (*ends, "elif", "else", "endif", "endfor"):
                break
            self.next += 1
            if kind == "text":
                if body:
                    parts.append(lambda scope, body=body: F.lit(body))
            elif kind == "show":
                parts.append(lambda scope, body=body, at=at: self.shown(body, at, scope))
            elif word == "if":
                parts.append(self.chosen(body[2:], at))
            elif word == "for":
                parts.append(self.repeated(body[3:], at))
            else:
                raise ValueError(f"line {self.line(at)}: no tag {word!r}")
        return lambda scope: F.concat(F.lit(""), *[part(scope) for part in parts])

    def value(self, body: str, at: int, scope: Scope) -> Value:
        try:
            return _Expression(body, scope).whole()
        except ValueError as error:
            raise ValueError(f"line {self.line(at)}: {error}") from None

    def shown(self, body: str, at: int, scope: Scope) -> Column:
        found = self.value(body, at, scope)
        return html_escape(found.text()) if self.escape and not found.safe else found.text()

    def closing(self, at: int, *words: str) -> str:
        """The tag that ends a part, which must be one of these."""
        found = self.pieces[self.next][1] if self.next < len(self.pieces) else ""
        if not found or found.split(None, 1)[0] not in words:
            raise ValueError(f"line {self.line(at)}: {' or '.join(words)} is missing")
        self.next += 1
        return found

    def chosen(self, condition: str, at: int) -> Part:
        yes, end, no = self.until(()), self.closing(at, "elif", "else", "endif"), None
        if end.startswith("elif"):
            no = self.chosen(end[4:], at)
        elif end == "else":
            no = self.until(())
            self.closing(at, "endif")
        return lambda scope: F.when(self.value(condition, at, scope).truth(), yes(scope)).otherwise(no(scope) if no else F.lit(""))

    def repeated(self, head: str, at: int) -> Part:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", head, re.DOTALL)
        if not m:
            raise ValueError(f"line {self.line(at)}: 'for name in list' is missing")
        body, end, none = self.until(()), self.closing(at, "else", "endfor"), None
        if end == "else":
            none = self.until(())
            self.closing(at, "endfor")

        def made(scope: Scope) -> Column:
            held = self.value(m[2], at, scope)
            if not isinstance(held.kind, T.ArrayType):
                raise ValueError(f"line {self.line(at)}: {m[2].strip()!r} is no list")
            number = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])

            def one(x: Column, k: Column) -> Column:
                loop = F.struct((k + 1).alias("index"), (k == 0).alias("first"), (k + 1 == F.size(held.column)).alias("last"))
                return body({**scope, m[1]: Value(x, held.kind.elementType), "loop": Value(loop, number)})

            text = F.array_join(F.transform(F.coalesce(held.column, F.array().cast(held.kind)), one), "")
            return F.when(held.truth(), text).otherwise(none(scope) if none else F.lit(""))

        return made


def compiled(schema: T.StructType, template: str, escape: bool = False) -> Column:
    """The template's text as a column of rows with this schema."""
    scope = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in schema}
    return _Template(template, escape).whole()(scope)


def rendered(rows: DataFrame, template: str, out: str = "entry", escape: bool = False) -> DataFrame:
    """rows with the template's text."""
    return rows.withColumn(out, compiled(rows.schema, template, escape))
