"""Row predicates and formulas written as text, translated to columns through a whitelist of syntax."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.names import q

_BACKTICK = re.compile(r"`([^`]+)`")
FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "log1p": F.log1p,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "round": F.round,
}
METHODS = {
    "isna": lambda c: c.isNull(), "isnull": lambda c: c.isNull(), "notna": lambda c: c.isNotNull(), "notnull": lambda c: c.isNotNull(),
    "lower": F.lower, "upper": F.upper, "len": F.char_length, "strip": F.trim, "abs": F.abs,
    "contains": lambda c, s: F.coalesce(F.contains(c, s), F.lit(False)), "startswith": lambda c, s: F.coalesce(F.startswith(c, s), F.lit(False)),
    "endswith": lambda c, s: F.coalesce(F.endswith(c, s), F.lit(False)), "isin": lambda c, *v: F.coalesce(c.isin(*v), F.lit(False)),
}


class ExpressionError(ValueError):
    """The text is not in the supported language."""


def translate(text: str, columns: list[str]) -> Column:
    """A formula such as ``age > 30 and `home town` == 'Lima'`` as a column.

    Missing values compare as in data frames: every comparison with one is false but !=, which is true.
    Division by zero gives null. Anything but names, literals, operators and the listed functions is refused.
    """
    named: dict[str, str] = {}

    def place(m: re.Match) -> str:
        key = f"__c{len(named)}"
        named[key] = m[1]
        return key

    plain = _BACKTICK.sub(place, text.strip())
    try:
        tree = ast.parse(plain, mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"can't read {text!r}") from e
    known = {c: c for c in columns} | named

    def truth(c: Column) -> Column:
        return F.coalesce(c.cast("boolean"), F.lit(False))

    def compare(op: ast.cmpop, a: Column, b: Column | list) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(b, list):
                raise ExpressionError("in needs a list of literals")
            inside = F.coalesce(a.isin(*b), F.lit(False)) if b else F.lit(False)
            return ~inside if isinstance(op, ast.NotIn) else inside
        kinds = {ast.Eq: lambda: a == b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}
        if isinstance(op, ast.NotEq):
            return ~F.coalesce(a == b, F.lit(False))
        if type(op) not in kinds:
            raise ExpressionError(f"comparison {type(op).__name__} is not supported")
        return F.coalesce(kinds[type(op)](), F.lit(False))

    def literals(node: ast.expr) -> list:
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)) and all(isinstance(x, ast.Constant) for x in node.elts):
            return [x.value for x in node.elts]
        raise ExpressionError("only lists of literals are supported")

    def walk(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in known:
                raise ExpressionError(f"there is no column {node.id!r}")
            return q(known[node.id])
        if isinstance(node, ast.BoolOp):
            parts = [truth(walk(v)) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp):
            inner = walk(node.operand)
            return {ast.Not: lambda: ~truth(inner), ast.Invert: lambda: ~truth(inner), ast.USub: lambda: -inner, ast.UAdd: lambda: inner}[type(node.op)]()
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            kinds = {
                ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a.cast("double"), b.cast("double")),
                ast.FloorDiv: lambda: F.floor(F.try_divide(a.cast("double"), b.cast("double"))), ast.Mod: lambda: F.pmod(a, F.nullif(b, F.lit(0))),
                ast.Pow: lambda: F.pow(a, b), ast.BitAnd: lambda: truth(a) & truth(b), ast.BitOr: lambda: truth(a) | truth(b),
            }
            if type(node.op) not in kinds:
                raise ExpressionError(f"operator {type(node.op).__name__} is not supported")
            return kinds[type(node.op)]()
        if isinstance(node, ast.Compare):
            left, out = node.left, None
            for op, right in zip(node.ops, node.comparators, strict=True):
                b = literals(right) if isinstance(op, (ast.In, ast.NotIn)) else walk(right)
                one = compare(op, walk(left), b)
                out, left = one if out is None else out & one, right
            return out
        if isinstance(node, ast.Call) and not node.keywords:
            if isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS:
                return FUNCTIONS[node.func.id](*[walk(a) for a in node.args])
            if isinstance(node.func, ast.Attribute) and node.func.attr in METHODS:
                target = node.func.value
                if isinstance(target, ast.Attribute) and target.attr == "str":
                    target = target.value
                if node.func.attr == "isin":
                    return METHODS["isin"](walk(target), *literals(node.args[0]))
                return METHODS[node.func.attr](walk(target), *[walk(a) for a in node.args])
        raise ExpressionError(f"{type(node).__name__} is not supported")

    return walk(tree.body)
