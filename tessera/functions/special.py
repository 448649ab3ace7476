"""Special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the recurrence before the asymptotic series, whose error is then below 1e-13.
SHIFT = 10


def log_gamma(x: Column | str) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + SHIFT, less the logarithms of the steps down to x."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = x + float(SHIFT)
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    steps = x
    for k in range(1, SHIFT):
        steps = steps * (x + float(k))
    return series - F.ln(steps)


def log_factorial(n: Column | str) -> Column:
    return log_gamma((F.col(n) if isinstance(n, str) else n) + 1)


def signed_log_sum(sign_a: Column, log_a: Column, sign_b: Column, log_b: Column) -> Column:
    """Sign and relative size of sign_a exp(log_a) + sign_b exp(log_b), scaled by the larger of the two; a term of sign 0 leaves
    the other's sign."""
    top = F.greatest(log_a, log_b)
    both = sign_a * F.exp(log_a - top) + sign_b * F.exp(log_b - top)
    return F.when(sign_a == 0, sign_b).when(sign_b == 0, sign_a).otherwise(both)


def finite_or_null(x: Column | str) -> Column:
    """Null for what isn't a finite number."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def geometric_middle(a: Column, b: Column) -> Column:
    return F.exp((F.ln(a) + F.ln(b)) / 2)


def root_between(value, low: Column, high: Column, steps: int = 50) -> Column:
    """Where ``value``, a function of a column, changes its sign between low and high, by ``steps`` bisections; null if the
    ends have the same sign. A fold over a sequence, so it can run inside arrays."""
    start = F.struct(low.alias("lo"), high.alias("hi"), value(low).alias("f"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fm = value(mid)
        left = s["f"] * fm <= 0
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"), F.when(left, s["f"]).otherwise(fm).alias("f"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(value(low) * value(high) <= 0, done)


def golden_minimum(value, low: Column, high: Column, steps: int = 60) -> Column:
    """Where ``value``, unimodal between low and high, is least, by golden section; ends count too."""
    ratio = (math.sqrt(5) - 1) / 2

    def inner(lo: Column, hi: Column) -> tuple[Column, Column]:
        return hi - ratio * (hi - lo), lo + ratio * (hi - lo)

    def step(s: Column, _: Column) -> Column:
        a, b = inner(s["lo"], s["hi"])
        left = value(a) <= value(b)
        return F.struct(F.when(left, s["lo"]).otherwise(a).alias("lo"), F.when(left, b).otherwise(s["hi"]).alias("hi"))

    middle = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(low.alias("lo"), high.alias("hi")), step, lambda s: (s["lo"] + s["hi"]) / 2)
    best = F.array_min(F.transform(F.array(middle, low, high), lambda x: F.struct(value(x).alias("f"), x.alias("x"))))
    return best["x"]
