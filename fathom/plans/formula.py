"""Wilkinson formulas: ``y ~ x + C(g) * bs(x, df=5)`` to designs, constraints to matrices."""

from __future__ import annotations

import ast
import re
import sys
from itertools import combinations

import numpy as np
from numpy.polynomial import polynomial as P
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .design import Design, Factor, make_factors

_TOKEN = re.compile(r"\s*(?:(\{[^}]*\})|(`[^`]*`)|([A-Za-z_][\w.]*)|(\d+\.?\d*)|(\*\*|[-+*:()~,=]))")
#: Functions of NumPy that formulas may use, by their Spark counterparts.
FUNCTIONS = {"log": F.ln, "exp": F.exp, "sqrt": F.sqrt, "log1p": F.log1p, "expm1": F.expm1, "log10": F.log10, "log2": F.log2, "abs": F.abs, "sin": F.sin, "cos": F.cos, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil}
_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Pow: lambda a, b: F.pow(a, b), ast.Mod: lambda a, b: a % b}
_COMPARE = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def captured(context, depth: int = 1) -> dict | None:
    """The names that a formula may use beside columns: a mapping, or how many calls up they are.

    0 are the names where the method was called, 1 those of its caller, and so on.
    """
    if context is None or isinstance(context, dict):
        return context
    if not isinstance(context, int) or isinstance(context, bool):
        raise TypeError("context must be a mapping of names or a number of calls")
    frame = sys._getframe(depth + 1 + context)
    return {**frame.f_globals, **frame.f_locals}


def expression(source: str, columns: list[str], context: dict | None = None) -> Column:
    """A Python expression over columns as a Column; names of ``context`` may be values or functions of Columns."""
    context = context or {}

    def name_of(node):
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id in ("np", "numpy") else None

    def walk(node):
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](walk(node.left), walk(node.comparators[0])).cast("double")
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in columns:
                return F.col(f"`{node.id}`")
            if node.id in context and not callable(context[node.id]):
                return context[node.id] if isinstance(context[node.id], Column) else F.lit(context[node.id])
        if isinstance(node, ast.Call) and not node.keywords:
            name = name_of(node.func)
            made = context.get(name) if callable(context.get(name)) else FUNCTIONS.get(name)
            if made:
                return made(*map(walk, node.args))
        raise ValueError(f"the formula's {ast.unparse(node)!r} is not known")

    return walk(ast.parse(source, mode="eval").body)


class _Parser:
    """Sums, products and calls of a formula to lists of terms; a term is a tuple of factor texts."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise ValueError(f"the formula cannot be read from {text[at:]!r}")
            self.tokens.append(found[0].strip())
            at = found.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self):
        self.at += 1
        return self.tokens[self.at - 1]

    def sum(self):
        terms: list[tuple] = []
        intercept = None
        sign = "+"
        while True:
            if self.peek() in ("+", "-"):
                sign = self.take()
            for t in self.product():
                if t in (("1",), ("0",)):
                    intercept = (t == ("1",)) == (sign == "+")
                elif sign == "+":
                    terms += [t] if t not in terms else []
                else:
                    terms = [x for x in terms if x != t]
            if self.peek() not in ("+", "-"):
                return terms, intercept
            sign = self.take()

    def product(self):
        left = self.interaction()
        while self.peek() == "*":
            self.take()
            right = self.interaction()
            left = left + [t for t in right if t not in left] + [_merged(a, b) for a in left for b in right]
        return left

    def interaction(self):
        left = self.power()
        while self.peek() == ":":
            self.take()
            left = [_merged(a, b) for a in left for b in self.power()]
        return left

    def power(self):
        """``(a + b) ** 2``: the terms and their interactions of up to so many of them."""
        left = self.atom()
        while self.peek() == "**":
            self.take()
            order = self.take()
            if not order.isdigit() or int(order) < 1:
                raise ValueError(f"the power of the formula must be a positive integer; got {order!r}")
            out = []
            for size in range(1, int(order) + 1):
                for chosen in combinations(left, size):
                    term = ()
                    for t in chosen:
                        term = _merged(term, t)
                    out += [term] if term not in out else []
            left = out
        return left

    def atom(self):
        token = self.take()
        if token == "(":
            terms, _ = self.sum()
            if self.take() != ")":
                raise ValueError("a bracket of the formula is not closed")
            return terms
        if self.peek() == "(" and re.match(r"[A-Za-z_]", token):
            depth, text = 0, token
            while True:
                part = self.take()
                text += part + (" " if part == "," else "")
                depth += (part == "(") - (part == ")")
                if not depth:
                    return [(text,)]
        return [(token.strip("`"),)]


def _merged(a: tuple, b: tuple) -> tuple:
    return (*a, *(x for x in b if x not in a))


def parse(formula: str) -> tuple[str | None, list[tuple], bool | None]:
    """``(left side, terms, intercept)``; intercept is None where the formula says nothing."""
    if not isinstance(formula, str):
        raise TypeError("formula must be a string")
    left, sep, right = formula.partition("~")
    if not sep:
        left, right = "", formula
    if left.strip():
        whole = left.strip()
        if not (whole.startswith("{") and whole.endswith("}")) and len(_Parser(whole).sum()[0]) != 1:
            raise ValueError("formula must have exactly one term on the left-hand side")
    terms, intercept = _Parser(right).sum()
    order = sorted(range(len(terms)), key=lambda k: (len(terms[k]), k))
    return left.strip() or None, [terms[k] for k in order], intercept


def _arguments(call: str):
    node = ast.parse(call, mode="eval").body
    return node.func.id, node.args, {k.arg: ast.literal_eval(k.value) for k in node.keywords}


def knots(df: DataFrame, x: Column, count: int) -> tuple[float, list[float], float]:
    """Bounds and ``count`` inner quantiles of a column, exact, in one job."""
    inner = [(k + 1) / (count + 1) for k in range(count)]
    row = df.agg(F.min(x).alias("a"), F.max(x).alias("b"), (F.percentile(x, F.array(*map(F.lit, inner))) if inner else F.array().cast("array<double>")).alias("q")).first()
    return float(row.a), [float(v) for v in row.q], float(row.b)


def bspline(x: Column, low: float, inner: list[float], high: float, degree: int = 3) -> list[Column]:
    """B-spline basis functions of a column, each a choice among polynomials by the interval of ``x``.

    The recursion runs on polynomial coefficients here, so a function is at most degree + 1
    polynomials in the plan. Outside of the outer knots all functions are 0.
    """
    t = [low] * (degree + 1) + list(inner) + [high] * (degree + 1)
    # pieces[j] has the polynomial, in x, of a function on the interval [t_j, t_j + 1).
    functions: list[dict[int, np.ndarray]] = [{k: np.ones(1)} if t[k] < t[k + 1] else {} for k in range(len(t) - 1)]
    for d in range(1, degree + 1):
        raised = []
        for k in range(len(functions) - 1):
            pieces: dict[int, np.ndarray] = {}
            for at, root, sign, width in ((k, t[k], 1.0, t[k + d] - t[k]), (k + 1, t[k + d + 1], -1.0, t[k + d + 1] - t[k + 1])):
                if width > 0:
                    for j, p in functions[at].items():
                        pieces[j] = P.polyadd(pieces.get(j, np.zeros(1)), P.polymul(p, np.array([-root, 1.0]) * (sign / width)))
            raised.append(pieces)
        functions = raised
    top = max((j for j in range(len(t) - 1) if t[j] < t[j + 1]), default=0)

    def value(p: np.ndarray, at: float) -> Column:
        """Horner's rule about ``at``, where the digits are."""
        about = np.polynomial.Polynomial(p)(np.polynomial.Polynomial([at, 1.0])).coef
        out = F.lit(float(about[-1]))
        for c in about[-2::-1]:
            out = out * (x - F.lit(at)) + F.lit(float(c))
        return out

    out = []
    for pieces in functions:
        c = F.lit(0.0)
        for j, p in sorted(pieces.items(), reverse=True):
            inside = (x >= t[j]) & ((x <= t[j + 1]) if j == top else (x < t[j + 1]))
            c = F.when(inside, value(p, t[j])).otherwise(c)
        out.append(c)
    return out


def orthogonal(df: DataFrame, x: Column, degree: int) -> list[Column]:
    """Orthonormal polynomials of a column over the table: a three-term recurrence from its moments."""
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    u = (x - row.m) / (row.s or 1.0)
    sums = df.agg(*(F.sum(F.pow(u, F.lit(float(k)))).alias(f"p{k}") for k in range(2 * degree + 2))).first()
    inner = lambda a, b: sum(p * q * sums[f"p{i + j}"] for i, p in enumerate(a) for j, q in enumerate(b))
    polys: list[np.ndarray] = []
    for k in range(degree + 1):
        p = np.zeros(degree + 1)
        p[k] = 1.0
        for _ in range(2):
            for q in polys:
                p = p - inner(p, q) * q
        polys.append(p / np.sqrt(inner(p, p)))
    return [sum((float(c) * F.pow(u, F.lit(float(k))) for k, c in enumerate(p)), F.lit(0.0)) for p in polys[1:]]


def to_design(df: DataFrame, terms: list[tuple], *, intercept: bool, drop_first=False, context=None, levels=None, separator=":", format="{name}[{category}]", missing_method="fail", missing_name="(MISSING)") -> Design:
    """The right side of a formula over ``df``; knots, moments and levels are learned from it."""
    columns = df.columns
    texts = list(dict.fromkeys(x for t in terms for x in t))
    plain: list[tuple[str, Column, bool, str]] = []
    made: dict[str, Factor] = {}
    variable: dict[str, str] = {}
    for text in texts:
        if re.match(r"cc\(", text):
            raise ValueError(f"cyclic splines are not available, with or without monotonic constraints: {text}")
        call = re.match(r"(C|bs|poly)\(", text)
        if call:
            kind, args, named = _arguments(text)
            source = expression(ast.unparse(args[0]), columns, context)
            if kind == "C":
                name = ast.unparse(args[0])
                plain.append((text, source, True, named.get("missing_method", missing_method)))
                variable[text] = name
                continue
            number = int(ast.literal_eval(args[1])) if len(args) > 1 else named.get("df", named.get("degree", 1 if kind == "poly" else None))
            x = source.cast("double")
            if kind == "poly":
                basis = orthogonal(df, x, number)
            else:
                degree = named.get("degree", 3)
                basis = bspline(x, *knots(df, x, number - degree - (1 if named.get("include_intercept") else 0)), degree)[0 if named.get("include_intercept") else 1 :]
            made[text] = Factor(text, source, [(f"{text}[{k}]", b) for k, b in enumerate(basis, 1)], variable=ast.unparse(args[0]), ordered=kind == "bs")
        else:
            source = expression(text.strip("{}"), columns, context)
            is_level = text in columns and isinstance(df.schema[text].dataType, T.StringType) or bool(levels and text in levels)
            plain.append((text.strip("{}").strip() if text.startswith("{") else text, source, is_level, missing_method))
            if text.startswith("{"):
                made[text] = Factor(plain.pop()[0], source, [(text.strip("{}").strip(), source.cast("double"))])
    made |= make_factors(df, plain, levels, missing_name)
    for text, name in variable.items():
        made[text].variable = name
    present = {frozenset(t) for t in terms} | ({frozenset()} if intercept else set())
    out = []
    for t in terms:
        reduced = tuple(drop_first and made[x].categorical and frozenset(set(t) - {x}) in present for x in t)
        out.append((separator.join(t), [made[x] for x in t], reduced))
    return Design(out, separator, format, missing_name)


def constraint(text: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``a + b = 2 * c - 1, d`` as R and r of ``R coefficients = r`` over ``names``."""
    rows, values = [], []
    for part in text.split(","):
        left, _, right = part.partition("=")
        row, constant = np.zeros(len(names)), 0.0
        for side, sign in ((left, 1.0), (right, -1.0)):
            for minus, number, name in _linear(side, names):
                factor = sign * (-1.0 if minus else 1.0) * number
                if name is None:
                    constant += factor
                else:
                    row[names.index(name)] += factor
        rows.append(row)
        values.append(-constant)
    return np.array(rows), np.array(values)


def _linear(side: str, names: list[str]):
    known = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    at, side = 0, side.strip()
    pattern = re.compile(rf"\s*([+-]?)\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)\s*\*?\s*)?(?:`?({known})`?)?(?:\s*\*\s*(\d+\.?\d*))?\s*")
    while at < len(side):
        found = pattern.match(side, at)
        if not found or found.end() == at or not (found[2] or found[3]):
            raise ValueError(f"the constraint cannot be read from {side[at:]!r}")
        yield found[1] == "-", float(found[2] or 1) * float(found[4] or 1), found[3]
        at = found.end()
