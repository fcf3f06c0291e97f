"""Computed-field expressions, compiled to columns.

The language: literals, ``$.field`` paths, ``concat round now lower upper abs``,
``new Date(x).getFullYear()``, arithmetic, comparison, ``&& || !``, ``?:`` and
parentheses. ``a || b`` gives a unless a is null, empty, zero or false.
A comparison with null is null, and a null condition takes the else branch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<path>\$(?:\.\w+)+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>===|!==|==|!=|<=|>=|&&|\|\||[-+*/%<>?:(),.!]))""")


class ExpressionError(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected text at {at} in {source!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


def _truthy(value: Column) -> Column:
    text = value.cast("string")
    return value.isNotNull() & ~text.isin("", "0", "0.0", "false")


_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "concat": lambda *a: F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in a]),
    "round": lambda x, digits=None: F.round(x, F.lit(0) if digits is None else digits.cast("int")),
    "now": lambda: F.current_timestamp(),
    "lower": lambda x: F.lower(x),
    "upper": lambda x: F.upper(x),
    "abs": lambda x: F.abs(x),
}
_DATE_PARTS = {"getFullYear": lambda d: F.year(d), "getMonth": lambda d: F.month(d) - 1, "getDate": lambda d: F.dayofmonth(d), "getHours": lambda d: F.hour(d)}
_BINARY = [
    {"||": lambda a, b: F.when(_truthy(a), a).otherwise(b)},
    {"&&": lambda a, b: a & b},
    {"==": lambda a, b: a == b, "===": lambda a, b: a == b, "!=": lambda a, b: a != b, "!==": lambda a, b: a != b},
    {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b)},
]


class Compiler:
    """Recursive descent; ``field`` gives the column of a path."""

    def __init__(self, source: str, field: Callable[[str], Column]):
        self.source, self.list, self.at, self.field = source, tokens(source), 0, field

    def peek(self) -> tuple[str, str]:
        return self.list[self.at]

    def take(self, value: str | None = None) -> str:
        kind, text = self.list[self.at]
        if value is not None and text != value or kind == "end":
            raise ExpressionError(f"expected {value or 'more'}, found {text or 'the end'!r} in {self.source!r}")
        self.at += 1
        return text

    def compile(self) -> Column:
        out = self.ternary()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return out

    def ternary(self) -> Column:
        condition = self.binary(0)
        if self.peek()[1] != "?":
            return condition
        self.take("?")
        yes = self.ternary()
        self.take(":")
        return F.when(condition, yes).otherwise(self.ternary())

    def binary(self, level: int) -> Column:
        if level == len(_BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek()[0] == "sign" and self.peek()[1] in _BINARY[level]:
            left = _BINARY[level][self.take()](left, self.binary(level + 1))
        return left

    def unary(self) -> Column:
        if self.peek() == ("sign", "-"):
            self.take()
            return -self.unary()
        if self.peek() == ("sign", "!"):
            self.take()
            return ~self.unary()
        return self.primary()

    def arguments(self) -> list[Column]:
        self.take("(")
        out = []
        while self.peek()[1] != ")":
            out.append(self.ternary())
            if self.peek()[1] == ",":
                self.take(",")
        self.take(")")
        return out

    def primary(self) -> Column:
        kind, text = self.peek()
        if kind == "number":
            self.take()
            return F.lit(float(text) if "." in text else int(text))
        if kind == "text":
            self.take()
            return F.lit(re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "path":
            self.take()
            return self.field(text[2:])
        if text == "(":
            self.take("(")
            out = self.ternary()
            self.take(")")
            return out
        if kind == "word":
            self.take()
            if text in ("true", "false"):
                return F.lit(text == "true")
            if text == "null":
                return F.lit(None)
            if text == "new":
                self.take("Date")
                (value,) = self.arguments()
                self.take(".")
                part = self.take()
                if part not in _DATE_PARTS:
                    raise ExpressionError(f"unknown date part {part!r} in {self.source!r}")
                if self.arguments():
                    raise ExpressionError(f"{part} takes no argument in {self.source!r}")
                return _DATE_PARTS[part](value.try_cast("timestamp"))
            if text in _FUNCTIONS:
                return _FUNCTIONS[text](*self.arguments())
        raise ExpressionError(f"unexpected {text or 'end'!r} in {self.source!r}")


def compile_expression(source: str, field: Callable[[str], Column] = F.col) -> Column:
    return Compiler(source, field).compile()
