"""Log-gamma and polygamma functions as SQL text, Spark columns and numpy.

Spark has none of them. The argument is shifted up by SHIFT with the recurrence and put into the
asymptotic series there; the relative error is below 1e-12 for positive arguments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SHIFT = 8
#: Bernoulli-number coefficients of the asymptotic series. Fixed values.
LGAMMA_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)


def _lift(x: str, term: str, join: str) -> str:
    return join.join(term.format(x=f"(({x}) + {i}e0)") for i in range(SHIFT))


def lgamma(x: str) -> str:
    z = f"(({x}) + {SHIFT}e0)"
    series = " + ".join(f"({c!r}) / power({z}, {2 * k + 1})" for k, c in enumerate(LGAMMA_SERIES))
    return f"(({z} - 0.5e0) * ln({z}) - {z} + {0.5 * math.log(2 * math.pi)!r} + {series} - ln({_lift(x, '{x}', ' * ')}))"


def digamma(x: str) -> str:
    z = f"(({x}) + {SHIFT}e0)"
    series = " + ".join(f"({c!r}) / power({z}, {2 * k + 2})" for k, c in enumerate(DIGAMMA_SERIES))
    return f"(ln({z}) - 0.5e0 / {z} + {series} - ({_lift(x, '1e0 / {x}', ' + ')}))"


def trigamma(x: str) -> str:
    z = f"(({x}) + {SHIFT}e0)"
    series = " + ".join(f"({c!r}) / power({z}, {2 * k + 3})" for k, c in enumerate(TRIGAMMA_SERIES))
    return f"(1e0 / {z} + 0.5e0 / power({z}, 2) + {series} + ({_lift(x, '1e0 / power({x}, 2)', ' + ')}))"


def betaln(a: str, b: str) -> str:
    return f"({lgamma(a)} + {lgamma(b)} - {lgamma(f'({a}) + ({b})')})"


def mv_lgamma(x: str, p: int) -> str:
    """Multivariate log-gamma of dimension p."""
    parts = " + ".join(lgamma(f"({x}) + {(1 - i) / 2}") for i in range(1, p + 1))
    return f"({p * (p - 1) / 4 * math.log(math.pi)!r} + {parts})"


def mv_polygamma(x: str, p: int, order: int = 0) -> str:
    """Multivariate digamma (order 0) or trigamma (order 1) of dimension p."""
    f = (digamma, trigamma)[order]
    return "(" + " + ".join(f(f"({x}) + {(1 - i) / 2}") for i in range(1, p + 1)) + ")"


def column(text: str) -> Column:
    return F.expr(text)


def np_digamma(x: float) -> float:
    z = x + SHIFT
    return math.log(z) - 0.5 / z + sum(c / z ** (2 * k + 2) for k, c in enumerate(DIGAMMA_SERIES)) - sum(1 / (x + i) for i in range(SHIFT))


def np_mv_digamma(x: float, p: int) -> float:
    return sum(np_digamma(x + (1 - i) / 2) for i in range(1, p + 1))


def np_mv_lgamma(x: float, p: int) -> float:
    return p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x + (1 - i) / 2) for i in range(1, p + 1))


def np_trigamma(x: float) -> float:
    total = 0.0
    while x < 12:
        total += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return total + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def np_mv_trigamma(x: float, p: int) -> float:
    return sum(np_trigamma(x - i / 2) for i in range(p))
