"""Column expressions of the path mixture: copies on a path, read probability, loss, posterior, slopes.

``paths`` is an array of structs (switch, first, second, log_prior); phi, alt, nonalt and the scaling c are columns. All of
them stay inside one row, so a likelihood costs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
CURVATURE_FLOOR = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mass(p: Column, phi: Column) -> Column:
    """Mutant copies per cell on path p: ``first`` up to the switch, ``second`` beyond it."""
    return p["first"] * F.least(phi, p["switch"]) + p["second"] * F.greatest(phi - p["switch"], F.lit(0.0))


def clipped(x: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps))


def probability(p: Column, phi: Column, c: Column, eps: float = EPS) -> Column:
    return clipped(c * mass(p, phi), eps)


def slope(p: Column, phi: Column, c: Column, eps: float = EPS, right: bool = False) -> Column:
    """Derivative of the probability from the left (or right); 0 where it is clipped."""
    raw = c * mass(p, phi)
    before = phi < p["switch"] if right else phi <= p["switch"]
    low, high = (raw >= eps, raw < 1.0 - eps) if right else (raw > eps, raw <= 1.0 - eps)
    return F.when(low & high, c * F.when(before, p["first"]).otherwise(p["second"])).otherwise(F.lit(0.0))


def log_terms(paths="paths", alt="alt", nonalt="nonalt", phi="phi", c="scaling", eps: float = EPS) -> Column:
    a, r, f, s = map(_c, (alt, nonalt, phi, c))

    def one(p: Column) -> Column:
        q = probability(p, f, s, eps)
        return a * F.ln(q) + r * F.ln(1.0 - q) + p["log_prior"]

    return F.transform(_c(paths), one)


def log_sum_exp(terms="terms") -> Column:
    t = _c(terms)
    top = F.array_max(t)
    return top + F.ln(F.aggregate(t, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def loss(terms="terms", observed="observed") -> Column:
    """Negative log likelihood; 0 for an unobserved unit."""
    return F.when(_c(observed), -log_sum_exp(terms)).otherwise(F.lit(0.0))


def posterior(terms="terms", paths="paths", observed="observed") -> Column:
    """Probability of each path; the prior for an unobserved unit."""
    t = _c(terms)
    total = log_sum_exp(terms)
    return F.when(_c(observed), F.transform(t, lambda x: F.exp(x - total))).otherwise(F.transform(_c(paths), lambda p: F.exp(p["log_prior"])))


def _weighted(post, paths, value) -> Column:
    return F.aggregate(F.zip_with(_c(post), _c(paths), value), F.lit(0.0), lambda acc, x: acc + x)


def gradient(post="post", paths="paths", alt="alt", nonalt="nonalt", phi="phi", c="scaling", observed="observed", eps: float = EPS, right: bool = False) -> Column:
    a, r, f, s = map(_c, (alt, nonalt, phi, c))

    def one(w: Column, p: Column) -> Column:
        q = probability(p, f, s, eps)
        return w * slope(p, f, s, eps, right) * (a / q - r / (1.0 - q))

    return F.when(_c(observed), -_weighted(post, paths, one)).otherwise(F.lit(0.0))


def curvature(post="post", paths="paths", alt="alt", nonalt="nonalt", phi="phi", c="scaling", observed="observed", eps: float = EPS) -> Column:
    """Bound of the second derivative, with a floor; 0 for an unobserved unit."""
    a, r, f, s = map(_c, (alt, nonalt, phi, c))

    def one(w: Column, p: Column) -> Column:
        q, d = probability(p, f, s, eps), slope(p, f, s, eps)
        return w * d * d * (a / (q * q) + r / ((1.0 - q) * (1.0 - q)))

    return F.when(_c(observed), F.greatest(_weighted(post, paths, one), F.lit(CURVATURE_FLOOR))).otherwise(F.lit(0.0))


def expected_loss(resp="resp", terms="terms", observed="observed") -> Column:
    """Expected complete loss under given path weights less their entropy (an upper bound of the loss)."""
    total = F.aggregate(F.zip_with(_c(resp), _c(terms), lambda w, t: F.when(w > 0, w * (F.ln(w) - t)).otherwise(F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(_c(observed), total).otherwise(F.lit(0.0))


def bends(paths="paths", c="scaling", eps: float = EPS) -> Column:
    """Every point where a path's probability changes its slope, wherever it lies: switches and clip crossings."""
    s = _c(c)

    def cross(p: Column, y: float) -> Column:
        at = F.lit(y) / s
        bend = p["first"] * p["switch"]
        return F.when(at <= bend, at / p["first"]).otherwise(p["switch"] + (at - bend) / p["second"])

    return F.flatten(F.transform(_c(paths), lambda p: F.array(p["switch"], cross(p, eps), cross(p, 1.0 - eps))))


def breakpoints(paths="paths", c="scaling", upper: float = 1.0, eps: float = EPS) -> Column:
    """The different bends inside (0, upper), to twelve decimals."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(bends(paths, c, eps), lambda x: (x > 0) & (x < upper)), lambda x: F.round(x, 12))))


def path_summary(paths="paths", post="post", phi="phi", boundary_tol: float = 1e-8, amplified_tol: float = 1e-8) -> dict[str, Column]:
    """Posterior summaries of the path that a mutation took, as columns by name."""
    f, q, ps = _c(phi), _c(post), _c(paths)

    def add(value) -> Column:
        return _weighted(q, ps, value)

    masses = F.transform(ps, lambda p: mass(p, f))
    best = F.array_position(q, F.array_max(q))
    expected, best_mass = add(lambda w, p: w * mass(p, f)), F.element_at(masses, best.cast("int"))
    amplified = add(lambda w, p: F.when(mass(p, f) > f + amplified_tol, w).otherwise(0.0))
    return {
        "map_path": best.cast("int"),
        "pre_switch_path_probability": add(lambda w, p: F.when(f < p["switch"] - boundary_tol, w).otherwise(0.0)),
        "post_switch_path_probability": add(lambda w, p: F.when(f > p["switch"] + boundary_tol, w).otherwise(0.0)),
        "switch_boundary_ambiguity_probability": add(lambda w, p: F.when(F.abs(f - p["switch"]) <= boundary_tol, w).otherwise(0.0)),
        "posterior_mutant_copy_mass": expected,
        "posterior_effective_multiplicity": F.when(f > 0, expected / f),
        "map_mutant_copy_mass": best_mass,
        "map_effective_multiplicity": F.when(f > 0, best_mass / f),
        "amplified_mutant_copy_probability": amplified,
        "path_entropy": F.aggregate(F.transform(q, lambda w: F.when(w > 0, -w * F.ln(w)).otherwise(0.0)), F.lit(0.0), lambda acc, x: acc + x),
        "amplified_mutant_copy_call": (amplified >= 0.5).cast("int"),
    }


def pilot_curvature(phi="phi", upper="phi_upper", eps: float = EPS, floor: float = 1e-6) -> Column:
    """Second difference of a unit's loss over unequal steps at phi, not below the floor; the floor where a bound leaves no
    room to step."""
    up = _c(upper)
    x = F.least(F.greatest(_c(phi), F.lit(eps)), up)
    step = F.greatest(F.lit(1e-4), 1e-3 * F.greatest(up - eps, F.abs(x), F.lit(1.0)))
    a, b = x - F.greatest(F.lit(eps), x - step), F.least(up, x + step) - x

    def at(y: Column) -> Column:
        return F.when(F.col("observed"), -log_sum_exp(log_terms(phi=y))).otherwise(F.lit(0.0))

    second = 2.0 * (a * at(x + b) - (a + b) * at(x) + b * at(x - a)) / (a * b * (a + b))
    return F.when((a > 1e-12) & (b > 1e-12), F.greatest(second, F.lit(floor))).otherwise(F.lit(floor))
