"""Arithmetic in texts: safe evaluation of expressions, detection of questions that hold one, and tool tags."""

from __future__ import annotations

import ast
import math
import operator
import re
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_normal = NormalDist()


def _whole(f):
    return lambda *xs: float(f(*(int(x) for x in xs)))


def _binomial(k: float, n: float, p: float) -> float:
    return math.comb(int(n), int(k)) * p**k * (1 - p) ** (n - k) if 0 <= k <= n else 0.0


def _poisson(k: float, mu: float) -> float:
    return math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) if k >= 0 and mu > 0 else float(k == 0)


def _rising(inside, p: float, low: float, high: float) -> float:
    """The point at which a rising function takes the value p, by halving."""
    if not 0 < p < 1:
        raise ValueError("a probability lies between 0 and 1")
    while inside(high) < p:
        low, high = high, high * 2 + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < p else (low, middle)
    return (low + high) / 2


def _gamma_share(a: float, x: float) -> float:
    """The regularized lower incomplete gamma function, by its series, or by its continued fraction far out."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _chi2_ppf(p: float, df: float) -> float:
    return _rising(lambda x: _gamma_share(df / 2, x / 2), p, 0.0, df + 1.0)


def _t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -_t_ppf(1 - p, df)
    return _rising(lambda t: 1 - _beta_share(df / 2, 0.5, df / (df + t * t)) / 2, p, 0.0, 2.0)


# The names an expression may use.
FUNCTIONS = {
    "abs": abs, "round": round, "min": min, "max": max,
    "sqrt": math.sqrt, "floor": math.floor, "ceil": math.ceil, "exp": math.exp, "hypot": math.hypot,
    "factorial": _whole(math.factorial), "comb": _whole(math.comb), "perm": _whole(math.perm), "gcd": _whole(math.gcd),
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan, "atan2": math.atan2,
    "degrees": math.degrees, "radians": math.radians, "log": math.log, "log2": math.log2, "log10": math.log10,
    "norm_cdf": _normal.cdf, "norm_pdf": _normal.pdf, "norm_ppf": _normal.inv_cdf, "t_ppf": _t_ppf, "chi2_ppf": _chi2_ppf,
    "binom_pmf": _binomial, "binom_cdf": lambda k, n, p: sum(_binomial(i, n, p) for i in range(int(k) + 1)),
    "poisson_pmf": _poisson, "poisson_cdf": lambda k, mu: sum(_poisson(i, mu) for i in range(int(k) + 1)),
}
CONSTANTS = {"pi": math.pi, "e": math.e, "tau": math.tau, "inf": math.inf}
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow, ast.UAdd: operator.pos, ast.USub: operator.neg}
SIGNS = str.maketrans({"×": "*", "÷": "/", "^": "**", "−": "-"})
#: Exponents over this are refused, so that no row can hold up a task.
LARGEST_POWER = 10_000


def value(node: ast.AST) -> float:
    """The value of a parsed expression; anything but arithmetic is a ValueError."""
    match node:
        case ast.Expression(body=body):
            return value(body)
        case ast.Constant(value=bool()) | ast.Constant(value=str()):
            raise ValueError("only numbers are allowed")
        case ast.Constant(value=int() | float() as x):
            return float(x)
        case ast.Name(id=name) if name in CONSTANTS:
            return CONSTANTS[name]
        case ast.UnaryOp(op=op, operand=x) if type(op) in OPERATORS:
            return OPERATORS[type(op)](value(x))
        case ast.BinOp(left=a, op=op, right=b) if type(op) in OPERATORS:
            x, y = value(a), value(b)
            if isinstance(op, ast.Pow) and abs(y) > LARGEST_POWER:
                raise OverflowError("exponent")
            return OPERATORS[type(op)](x, y)
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](*map(value, args))
    raise ValueError(f"{type(node).__name__} isn't arithmetic")


def shown(x: float) -> str:
    """Whole numbers without a point, others with six significant digits."""
    if math.isnan(x) or math.isinf(x):
        return "nan" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if float(x).is_integer() and abs(x) < 1e15:
        return str(int(x))
    return f"{round(x, max(0, 5 - math.floor(math.log10(abs(x))))):g}"


def evaluate(expression: str) -> tuple[str | None, str | None]:
    """(result, error), one of them None."""
    try:
        return shown(value(ast.parse(expression.translate(SIGNS).strip(), mode="eval"))), None
    except ZeroDivisionError:
        return None, "division by zero"
    except OverflowError:
        return None, "result is too large"
    except RecursionError:
        return None, "expression is too deeply nested"
    except (ValueError, TypeError, SyntaxError, AttributeError) as e:
        return None, str(e)


# What counts as a question for arithmetic.
DICE = re.compile(r"\b\d+d\d+\b", re.I)
PERCENT_OF = re.compile(r"(\d+(?:\.\d+)?)\s*%\s+of\s+(\d+(?:\.\d+)?)", re.I)
ASKS = re.compile(r"\b(?:calculat\w*|comput\w*|evaluat\w*|what\s+is|what'?s|how\s+much\s+is|result\s+of)\b", re.I)
_names = "sqrt|floor|ceil|abs|round|exp|factorial|comb|perm|gcd|hypot|log(?:2|10)?|sin|cos|tan|asin|acos|atan2?|degrees|radians|norm_(?:cdf|pdf|ppf)|binom_(?:pmf|cdf)|poisson_(?:pmf|cdf)|t_ppf|chi2_ppf"
EXPRESSION = re.compile(rf"(?:(?:{_names})\s*\([\d\s.+\-*/%(),]+\))|(?:[(\s]*-?\d+(?:\.\d+)?(?:\s*(?:\*\*|[+\-*/%])\s*\(?\s*-?\d+(?:\.\d+)?\s*\)?)+)")
PLAIN = re.compile(r"\d\s*[-+*/]\s*\d")
TAG = re.compile(r"<TOOL:python>(.*?)</TOOL>", re.S)


def detect(question: str | None) -> str | None:
    """The expression in a question; none where dice are rolled or nothing asks for arithmetic."""
    if not question or DICE.search(question):
        return None
    text = question.translate(SIGNS)
    if m := PERCENT_OF.search(text):
        return f"{m[1]} / 100 * {m[2]}"
    m = EXPRESSION.search(text)
    found = m.group().strip() if m else None
    return found if found and (ASKS.search(text) or PLAIN.search(found)) else None


def answered(question: str | None) -> str | None:
    """`expression = result` for a question that holds an expression which can be evaluated."""
    found = detect(question)
    result = evaluate(found)[0] if found else None
    return None if result is None else f"{found.replace('**', '^').replace('/ 100 *', '% of')} = {result}"


def with_results(reply: str | None) -> str | None:
    """A reply with its tool tags replaced by expression and result, or by an error note."""
    if reply is None or "<TOOL:" not in reply:
        return reply

    def one(m: re.Match) -> str:
        result, error = evaluate(m[1])
        return f"{m[1].strip()} [error: {error}]" if error else f"{m[1].strip()} = {result}"

    return TAG.sub(one, reply)


@F.pandas_udf(T.StringType())
def answer_arithmetic(questions: pd.Series) -> pd.Series:
    return questions.map(answered)


@F.pandas_udf(T.StringType())
def replace_tool_tags(replies: pd.Series) -> pd.Series:
    return replies.map(with_results)


@F.pandas_udf(T.StringType())
def evaluate_expression(expressions: pd.Series) -> pd.Series:
    return expressions.map(lambda x: None if x is None else evaluate(x)[0])
