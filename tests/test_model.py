"""Random expressions: what Spark computes equals a plain evaluator of the dialect's rules."""

from __future__ import annotations

import math
import random
import re

import pytest

from tessera.plans.nodes import Relation
from tessera.plans.parser import parse_expression
from tessera.plans.nodes import Binary, Items, Literal, Name, Null, Unary
from tessera.session import Session
from tessera.sources.base import ORDER, Column

ROWS = [("7", "2.5", "abc", None), ("-3", "0", "", "x"), ("10", "10.0", "10", "false"), ("0", "1e2", "b_d", "0"), ("12", "-0.25", " 5", "B%d")]
NUMBERS, TEXTS = ("m", "n"), ("s", "t")


def number(x):
    if isinstance(x, float) or x is None:
        return x
    return float(x) if re.match(r"[ \t\n\r\f\v]*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z", x) else None


def text(x):
    if not isinstance(x, float):
        return x
    if math.isnan(x) or math.isinf(x):
        return "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"
    return str(round(x)) if abs(x - round(x)) < 1e-9 else f"{x:.6g}"


def truth(x):
    if x is None:
        return False
    n = number(x)
    return abs(n) > 1e-9 if n is not None else x not in ("", "0", "false", "FALSE")


def compare(op, a, b):
    if a is None or b is None:
        return False
    x, y = number(a), number(b)
    if x is None or y is None:
        x, y = text(a), text(b)
    elif op in ("=", "!="):
        return (abs(x - y) < 1e-9) == (op == "=")
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def evaluate(e, row):
    """A text, a float, or None."""
    go = lambda x: evaluate(x, row)
    match e:
        case Literal(t, quoted):
            return t if quoted else float(t)
        case Null():
            return None
        case Name(n):
            return row.get(n, n)
        case Unary("!", x):
            return float(not truth(go(x)))
        case Unary("-", x):
            return None if (v := go(x)) is None else -number(v)
        case Binary("&&", a, b):
            return float(truth(go(a)) and truth(go(b)))
        case Binary("||", a, b):
            return float(truth(go(a)) or truth(go(b)))
        case Binary("IS" | "IS NOT" as op, a, _):
            return float((go(a) is None) == (op == "IS"))
        case Binary("IN" | "NOT IN" as op, a, Items(items)):
            left = go(a)
            found = any(compare("=", left, v) for x in items if (v := go(x)) is not None)
            return float(left is not None and found == (op == "IN"))
        case Binary("LIKE", a, b):
            left, right = go(a), go(b)
            if left is None or right is None:
                return 0.0
            pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in text(right))
            return float(bool(re.fullmatch(pattern, text(left), re.DOTALL)))
        case Binary("=" | "!=" | "<" | "<=" | ">" | ">=" as op, a, b):
            return float(compare(op, go(a), go(b)))
        case Binary(op, a, b):
            left, right = go(a), go(b)
            if left is None or right is None:
                return None
            x, y = number(left), number(right)
            if op == "+":
                return x + y if x is not None and y is not None else text(left) + text(right)
            if op == "/":
                return x / y if y else math.nan if x == 0 else math.copysign(math.inf, x)
            return x - y if op == "-" else x * y
    raise TypeError(e)


def random_expression(rng, depth, numeric):
    if depth == 0:
        options = [rng.choice(NUMBERS), str(rng.choice([0, 1, 2.5, 10]))] if numeric else [rng.choice(NUMBERS + TEXTS), rng.choice(["'abc'", "''", "'10'", "'b_%'", "7", "NULL", "loose"])]
        return rng.choice(options)
    sub = lambda n=numeric: random_expression(rng, depth - 1, n)
    if numeric:
        return rng.choice([lambda: f"({sub()} {rng.choice('-*')} {sub()})", lambda: f"(- {sub()})", lambda: f"({sub()} / {rng.choice(['2', 'm'])})", lambda: f"({sub()} + {sub()})"])()
    return rng.choice([
        lambda: f"({sub()} {rng.choice(['=', '!=', '<', '<=', '>', '>='])} {sub()})",
        lambda: f"({sub()} {rng.choice(['AND', 'OR', '&&', '||'])} {sub()})",
        lambda: f"(NOT ({sub()}))",
        lambda: f"({sub()} IS {rng.choice(['', 'NOT '])}NULL)",
        lambda: f"({sub()} {rng.choice(['', 'NOT '])}IN ({sub()}, {sub()}, NULL))",
        lambda: f"({sub()} LIKE {rng.choice(['s', repr('%b%'), repr('1_'), sub()])})",
        lambda: f"({sub()} + {rng.choice([sub(), random_expression(rng, 1, True)])})",
        lambda: random_expression(rng, depth, True),
    ])()


@pytest.mark.parametrize("seed", range(6))
def test_random_expressions(spark, seed):
    rng = random.Random(seed)
    session = Session(spark)
    session.store.save(Relation("r"), [Column(c) for c in "mnst"], spark.createDataFrame([(*r, k) for k, r in enumerate(ROWS)], f"c0 string, c1 string, c2 string, c3 string, {ORDER} long"))
    exprs = [random_expression(rng, 1 + k % 3, False) for k in range(30)]
    trees = [parse_expression(x) for x in exprs]
    select = ", ".join(f"{x} AS e{k}" for k, x in enumerate(exprs)).replace("loose", "'loose'")
    got = [tuple(r) for r in session.sql(f"SELECT {select} FROM r").rows]
    rows = [dict(zip("mnst", r)) for r in ROWS]
    for k, tree in enumerate(trees):
        for r, row in enumerate(rows):
            want = text(evaluate(tree, row))
            assert got[r][k] == ("NULL" if want is None else want), (exprs[k], row)
    for k, x in enumerate(exprs[:8]):  # the same as filters, where a word may stand for itself
        kept = [tuple(None if v == "NULL" else v for v in r) for r in session.sql(f"SELECT * FROM r WHERE {x}").rows]
        assert kept == [r for r, row in zip(ROWS, rows) if truth(evaluate(trees[k], row))], x
