"""Two small languages compiled to Columns: derived expressions and filter predicates.

Nothing is evaluated in Python. Both parse with ast, walk a list of allowed nodes, and build Columns,
so Catalyst sees plain expressions.

Expressions follow numpy on floats: a null operand gives null (minimum and maximum too), a
comparison with null is false and != true, division by zero and every infinity is null in the end,
// and % round down. Predicates have two values: a comparison with null is false, != is true.
"""

from __future__ import annotations

import ast
import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError


def finite(c: Column) -> Column:
    """c as double; NaN and infinities are null."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


_ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: F.try_divide,
    ast.FloorDiv: _floor_div,
    ast.Mod: lambda a, b: a - _floor_div(a, b) * b,
    ast.Pow: F.pow,
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


def two_valued(op: type, a: Column, b: Column) -> Column:
    return F.coalesce(_COMPARE[op](a, b), F.lit(op is ast.NotEq))


def _both(f: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    """Null if either is null."""
    return lambda a, b: F.when(a.isNull() | b.isNull(), None).otherwise(f(a, b))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, low), high))


class _Expression:
    """Numbers stay doubles and conditions booleans; each node says which it is."""

    FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
        "log": (1, F.ln),
        "log1p": (1, F.log1p),
        "exp": (1, F.exp),
        "sqrt": (1, F.sqrt),
        "abs": (1, F.abs),
        "sign": (1, F.signum),
        "clip": (3, _clip),
        "minimum": (2, _both(F.least)),
        "maximum": (2, _both(F.greatest)),
        "fillna": (2, F.coalesce),
    }

    def __init__(self, known: Iterable[str], where: str) -> None:
        self.known, self.where, self.used = set(known), where, []

    def fail(self, what: str) -> ConfigError:
        return ConfigError(f"{self.where}: {what}")

    def number(self, node: ast.AST) -> Column:
        kind, c = self.visit(node)
        return c if kind == "number" else F.when(c, 1.0).otherwise(0.0)

    def condition(self, node: ast.AST) -> Column:
        kind, c = self.visit(node)
        # As in numpy, a number that is not zero is true, and so is a missing one.
        return c if kind == "boolean" else F.coalesce(c != 0, F.lit(True))

    def visit(self, node: ast.AST) -> tuple[str, Column]:
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return "boolean", F.lit(node.value)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return "number", F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id not in self.known:
                raise self.fail(f"there is no feature {node.id!r}")
            if node.id not in self.used:
                self.used.append(node.id)
            return "number", finite(F.col(f"`{node.id}`"))
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return "number", _ARITHMETIC[type(node.op)](self.number(node.left), self.number(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return "number", self.number(node.operand) * (-1.0 if isinstance(node.op, ast.USub) else 1.0)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return "boolean", ~self.condition(node.operand)
        if isinstance(node, ast.BoolOp):
            join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
            return "boolean", functools.reduce(join, map(self.condition, node.values))
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [self.number(x) for x in (node.left, *node.comparators)]
            return "boolean", functools.reduce(operator.and_, (two_valued(type(o), a, b) for o, a, b in zip(node.ops, sides, sides[1:], strict=False)))
        if isinstance(node, ast.IfExp):
            return "number", F.when(self.condition(node.test), self.number(node.body)).otherwise(self.number(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return self.call(node.func.id, node.args)
        raise self.fail(f"{type(node).__name__} is not allowed")

    def call(self, name: str, args: list[ast.AST]) -> tuple[str, Column]:
        if name in ("isnull", "notnull") and len(args) == 1:
            c = finite(self.number(args[0]))
            return "boolean", c.isNull() if name == "isnull" else c.isNotNull()
        if name == "where" and len(args) == 3:
            return "number", F.when(self.condition(args[0]), self.number(args[1])).otherwise(self.number(args[2]))
        if name not in self.FUNCTIONS:
            raise self.fail(f"there is no function {name!r}")
        count, f = self.FUNCTIONS[name]
        if len(args) != count:
            raise self.fail(f"{name} takes {count} arguments, not {len(args)}")
        return "number", f(*map(self.number, args))


def expression(text: str, known: Iterable[str], where: str = "expression") -> tuple[Column, list[str]]:
    """The Column of a derived expression, and the features it uses."""
    try:
        tree = ast.parse(" ".join(text.split()), mode="eval")
    except SyntaxError as error:
        raise ConfigError(f"{where}: cannot be parsed: {error}") from error
    compiler = _Expression(known, where)
    out = compiler.number(tree.body)
    return finite(out), compiler.used


class _Predicate:
    def __init__(self, columns: Iterable[str], where: str, text: str) -> None:
        self.columns, self.where, self.text = list(columns), where, text
        self.quoted: dict[str, str] = {}

    def fail(self, what: str) -> ConfigError:
        return ConfigError(f"{self.where}: `{self.text}`: {what}. Columns: {sorted(self.columns)}")

    def value(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            name = self.quoted.get(node.id, node.id)
            if name not in self.columns:
                raise self.fail(f"there is no column {name!r}")
            return F.col(f"`{name}`")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -self.value(node.operand) if isinstance(node.op, ast.USub) else self.value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](self.value(node.left), self.value(node.right))
        raise self.fail(f"{type(node).__name__} is not allowed")

    def visit(self, node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            return functools.reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(self.visit, node.values))
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = self.visit(node.left), self.visit(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~self.visit(node.operand)
        if isinstance(node, ast.Compare):
            parts, left = [], node.left
            for op, right in zip(node.ops, node.comparators, strict=True):
                parts.append(self.compare(op, left, right))
                left = right
            return functools.reduce(operator.and_, parts)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            return F.coalesce(self.value(node).cast("boolean"), F.lit(False))
        raise self.fail(f"{type(node).__name__} is not allowed")

    def compare(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        if isinstance(right, (ast.List, ast.Tuple)) and isinstance(op, (ast.In, ast.NotIn, ast.Eq, ast.NotEq)):
            found = F.coalesce(self.value(left).isin([x.value for x in right.elts if isinstance(x, ast.Constant)]), F.lit(False))
            return found if isinstance(op, (ast.In, ast.Eq)) else ~found
        if type(op) not in _COMPARE:
            raise self.fail(f"{type(op).__name__} is not allowed")
        return two_valued(type(op), self.value(left), self.value(right))


def predicate(text: str, columns: Iterable[str], where: str = "filter") -> Column:
    """The Column of a row filter such as "status == 'failed' and amount > 3"."""
    quoted, source = {}, []
    for i, part in enumerate(text.split("`")):
        if i % 2:
            quoted[key := f"__quoted_{i}"] = part
            source.append(key)
        else:
            source.append(part)
    compiler = _Predicate(columns, where, text)
    compiler.quoted = quoted
    # & and | bind like `and` and `or` there, as they do between comparisons in such filters.
    try:
        tree = ast.parse(_loosen("".join(source)).strip(), mode="eval")
    except SyntaxError as error:
        raise compiler.fail(f"it cannot be parsed ({error.msg})") from error
    return compiler.visit(tree.body)


def _loosen(text: str) -> str:
    """& | ~ outside of string literals as and, or, not."""
    out, quote = [], ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "&|~":
            c = {"&": " and ", "|": " or ", "~": " not "}[c]
        out.append(c)
    return "".join(out)
