"""Symbolic weights.

A weight is the JSON form itself: a number or bool, a parameter name, or a
one-key object such as ``{"*": [a, b]}``. Constructors simplify as they build;
``column`` compiles a weight to a Spark Column, so Catalyst folds and generates
code for whatever is left.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY = ("*", "+", "-", "/", "pow")
UNARY = ("log", "exp", "not", "geomsum")


def is_number(w) -> bool:
    return isinstance(w, (int, float)) and not isinstance(w, bool)


def parse_json(x):
    """Validate and simplify a JSON weight; numbers keep the int/float distinction."""
    if isinstance(x, bool):
        return int(x)
    if is_number(x) or (isinstance(x, str) and x):
        return x
    if isinstance(x, dict) and len(x) == 1:
        ((op, a),) = x.items()
        if op == "expr" and isinstance(a, str):
            return parse_infix(a)
        if op in UNARY:
            return BUILD[op](parse_json(a))
        if op in BINARY and isinstance(a, list) and len(a) == 2:
            return BUILD[op](*map(parse_json, a))
    raise ValueError(f"not a weight expression: {json.dumps(x)[:200]}")


def mul(a, b):
    if a == 0 and is_number(a) or b == 0 and is_number(b):
        return 0
    if is_number(a) and is_number(b):
        return a * b
    if is_number(a) and a == 1:
        return b
    if is_number(b) and b == 1:
        return a
    return {"*": [a, b]}


def add(a, b):
    if is_number(a) and is_number(b):
        return a + b
    if is_number(a) and a == 0:
        return b
    if is_number(b) and b == 0:
        return a
    if isinstance(b, dict) and "-" in b and is_number(b["-"][0]) and b["-"][0] == 0:
        return sub(a, b["-"][1])
    return {"+": [a, b]}


def sub(a, b):
    return a if is_number(b) and b == 0 else {"-": [a, b]}


def div(a, b):
    if is_number(b) and b == 1:
        return a
    if is_number(a) and a == 0:
        return 0
    if is_number(a) and is_number(b) and not (isinstance(a, int) and isinstance(b, int)):
        return a / b
    return {"/": [a, b]}


def power(a, b):
    if is_number(b) and b in (0, 1):
        return a if b == 1 else 1
    return {"pow": [a, b]}


def log(a):
    if is_number(a) and a == 1:
        return 0
    return a["exp"] if isinstance(a, dict) and "exp" in a else {"log": a}


def exp(a):
    if is_number(a) and a == 0:
        return 1
    return a["log"] if isinstance(a, dict) and "log" in a else {"exp": a}


def negate(a):
    """1 - a."""
    return {"not": a} if not is_number(a) else 1 - a


def geometric(a):
    """1 / (1 - a)."""
    return {"geomsum": a} if not is_number(a) or a == 1 else 1 / (1 - a)


BUILD = {"*": mul, "+": add, "-": sub, "/": div, "pow": power, "log": log, "exp": exp, "not": negate, "geomsum": geometric}


def product(ws):
    out = 1
    for w in ws:
        out = mul(out, w)
    return out


def total(ws):
    out = 0
    for w in ws:
        out = add(out, w)
    return out


def parts(w):
    """Operator and operands."""
    if isinstance(w, dict):
        ((op, a),) = w.items()
        return op, (a if isinstance(a, list) else [a])
    return None, []


def params(w, defs: dict | None = None, seen=frozenset()) -> set[str]:
    """Free parameters, looking through definitions."""
    if isinstance(w, str):
        if defs and w in defs:
            if w in seen:
                raise ValueError(f"cyclic definition of {w}")
            return params(defs[w], defs, seen | {w})
        return {w}
    return set().union(*(params(a, defs, seen) for a in parts(w)[1])) if isinstance(w, dict) else set()


def check_defs(defs: dict) -> list[str]:
    """Names in an order that defines before use; a cycle is an error that names it."""
    order, state = [], {}

    def visit(name, path):
        if state.get(name) == 2 or name not in defs:
            return
        if name in path:
            raise ValueError("cyclic definitions: " + " -> ".join([*path[path.index(name) :], name]))
        for p in sorted(params(defs[name])):
            visit(p, [*path, name])
        if state.get(name) != 2:
            state[name] = 2
            order.append(name)

    for n in defs:
        visit(n, [])
    return order


def bind(w, defs: dict):
    """Substitute definitions, all the way down."""
    check_defs({k: v for k, v in defs.items()})

    def go(x):
        if isinstance(x, str):
            return go(defs[x]) if x in defs else x
        op, a = parts(x)
        return BUILD[op](*map(go, a)) if op else x

    return go(w)


def evaluate(w, values: dict, _open: tuple = ()) -> float:
    """Numeric value; ``values`` may hold numbers or weights."""
    if is_number(w):
        return w
    if isinstance(w, str):
        if w not in values or w in _open:
            raise KeyError(f"parameter {w} is not defined")
        return evaluate(values[w], values, (*_open, w))
    op, a = parts(w)
    x = [evaluate(v, values, _open) for v in a]
    if op == "*":
        return x[0] * x[1]
    if op == "+":
        return x[0] + x[1]
    if op == "-":
        return x[0] - x[1]
    if op == "/":
        return x[0] / x[1]
    if op == "pow":
        return x[0] ** x[1]
    if op == "log":
        return math.log(x[0]) if x[0] > 0 else -math.inf
    if op == "exp":
        return math.exp(x[0])
    return 1 - x[0] if op == "not" else 1 / (1 - x[0])


def derive(w, name: str, defs: dict | None = None):
    """Symbolic derivative by a parameter, through definitions."""
    defs = defs or {}
    if is_number(w):
        return 0
    if isinstance(w, str):
        return 1 if w == name else derive(defs[w], name, defs) if w in defs else 0
    op, a = parts(w)
    d = [derive(x, name, defs) for x in a]
    if all(is_number(x) and x == 0 for x in d):
        return 0
    if op == "*":
        return add(mul(d[0], a[1]), mul(a[0], d[1]))
    if op == "+":
        return add(*d)
    if op == "-":
        return sub(*d)
    if op == "/":
        return sub(div(d[0], a[1]), mul(a[0], div(d[1], power(a[1], 2))))
    if op == "pow":
        return mul(w, add(mul(d[1], log(a[0])), div(mul(a[1], d[0]), a[0])))
    if op == "log":
        return div(d[0], a[0])
    if op == "exp":
        return mul(w, d[0])
    if op == "not":
        return sub(0, d[0])
    return mul(power(w, 2), d[0])  # (1/(1-x))' = x' / (1-x)^2


LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2, "pow": 3}


def show(w) -> str:
    """Infix text."""
    if is_number(w):
        return repr(w)
    if isinstance(w, str):
        return w
    op, a = parts(w)
    if op in ("log", "exp", "geomsum"):
        return f"{op}({show(a[0])})"
    if op == "not":
        return f"(1 - {_inner(a[0], 2)})"
    sign = {"pow": "^"}.get(op, f" {op} ")
    return _inner(a[0], LEVEL[op]) + sign + _inner(a[1], LEVEL[op] + (op in "-/pow"))


def _inner(w, level):
    op = parts(w)[0]
    return f"({show(w)})" if op in LEVEL and LEVEL[op] < level else show(w)


TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|\$?([A-Za-z][A-Za-z0-9]*)|(.))", re.S)


def parse_infix(text: str):
    """Infix weights: ``+ - * / ^``, unary ``-`` and ``!``, log, exp, not, geomsum, ``$name`` or ``name``."""
    tokens = [(m[1], m[2], m[3]) for m in TOKEN.finditer(text.strip())]
    at = 0

    def peek():
        return tokens[at][2] if at < len(tokens) else None

    def take(sign=None):
        nonlocal at
        if at >= len(tokens) or (sign and tokens[at][2] != sign):
            raise ValueError(f"can't read weight expression {text!r}")
        at += 1
        return tokens[at - 1]

    def atom():
        number, name, sign = take()
        if number:
            return int(number) if re.fullmatch(r"\d+", number) else float(number)
        if name:
            if name in UNARY and peek() == "(":
                take("(")
                x = sums()
                take(")")
                return BUILD[name](x)
            return name
        if sign == "(":
            x = sums()
            take(")")
            return x
        if sign == "-":
            return sub(0, factor())
        if sign == "!":
            return negate(factor())
        raise ValueError(f"can't read weight expression {text!r}")

    def factor():
        x = atom()
        if peek() == "^":
            take()
            x = power(x, atom())
        return x

    def chain(inner, signs):
        def run():
            x = inner()
            while peek() and peek() in signs:
                x = BUILD[take()[2]](x, inner())
            return x

        return run

    products = chain(factor, "*/")
    sums = chain(products, "+-")
    out = sums()
    if at != len(tokens):
        raise ValueError(f"can't read weight expression {text!r}")
    return out


def macro(text: str, symbol: str, size: int):
    """Weight text with ``%`` for the symbol and ``#`` for the alphabet's size; a plain number or JSON is fine too."""
    s = str(text).replace("%", symbol).replace("#", str(size))
    try:
        return parse_json(json.loads(s))
    except ValueError:
        return parse_infix(s)


def column(w, values: dict | None = None) -> Column:
    """A Spark Column of the weight: parameters from ``values`` (numbers, weights or Columns), else columns of that name."""
    values = values or {}
    if is_number(w):
        return F.lit(float(w))
    if isinstance(w, str):
        v = values.get(w)
        if v is None:
            return F.col(w)
        return v if isinstance(v, Column) else column(v, {k: x for k, x in values.items() if k != w})
    op, a = parts(w)
    x = [column(v, values) for v in a]
    if op == "/":
        return F.when(x[1] != 0, x[0] / x[1])
    if op == "log":
        return safe_log(x[0])
    if op == "pow":
        return F.pow(*x)
    if op in ("*", "+", "-"):
        return x[0] * x[1] if op == "*" else x[0] + x[1] if op == "+" else x[0] - x[1]
    return F.exp(x[0]) if op == "exp" else 1 - x[0] if op == "not" else 1 / (1 - x[0])


def safe_log(c: Column) -> Column:
    """Natural log with -inf for 0 (Spark's ln gives null there)."""
    return F.when(c > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
