"""Column functions over ARRAY<DOUBLE> vectors, Euclidean and on the hyperboloid (time coordinate first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8
WIDEST = 40.0  # hyperbolic angles are cut here: cosh stays finite


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm_squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(norm_squared(v))


def scaled(v: Column, factor: Column) -> Column:
    """The vector times a number, which is computed once and not for every entry."""
    return F.transform(F.array(factor), lambda f: F.transform(v, lambda x: x * f))[0]


def added(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda x, y: x + y)


def summed(v: Column, width: int, weight: Column | float = 1.0) -> Column:
    """Aggregate: the weighted sum of vectors of that width, an accumulator an entry, so that tasks add up before they shuffle."""
    return F.array(*[F.sum(v[i] * weight) for i in range(width)])


def unit(v: Column, least: float = 1e-12) -> Column:
    return scaled(v, 1 / F.greatest(norm(v), F.lit(least)))


def cosine(u: Column, v: Column, least: float = 1e-12) -> Column:
    return dot(u, v) / (F.greatest(norm(u), F.lit(least)) * F.greatest(norm(v), F.lit(least)))


def euclidean(u: Column, v: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(u, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    raised = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def space(v: Column) -> Column:
    """The vector without its time coordinate."""
    return F.slice(v, F.lit(2), F.size(v) - 1)


def lorentz_dot(u: Column, v: Column) -> Column:
    return dot(u, v) - 2 * u[0] * v[0]


def lorentz_distance(u: Column, v: Column, c: float = 1.0, least: float = 1.0) -> Column:
    """sqrt(c) * acosh(-<u, v>), with the product held at least as large as given."""
    return lorentz_distance_of(lorentz_dot(u, v), c, least)


def lorentz_distance_of(product: Column, c: float = 1.0, least: float = 1.0) -> Column:
    return F.lit(c**0.5) * F.acosh(F.greatest(-product, F.lit(least)))


def lift(v: Column, c: float = 1.0) -> Column:
    """Onto the hyperboloid: time is sqrt(|v|^2 + 1/c)."""
    return F.concat(F.array(F.sqrt(norm_squared(v) + 1 / c)), v)


def capped(v: Column, most: float) -> Column:
    """The vector, shortened to the given norm if it is longer."""
    return scaled(v, F.least(F.lit(1.0), F.lit(most) / F.greatest(norm(v), F.lit(TINY))))


def exp_zero(v: Column, c: float = 1.0) -> Column:
    """Exponential map at the origin of a tangent vector without time coordinate."""
    length = F.greatest(norm(v), F.lit(TINY))
    angle = F.least(F.lit(c**0.5) * length, F.lit(WIDEST))
    return F.concat(F.array(F.cosh(angle) / c**0.5), scaled(v, F.sinh(angle) / (F.lit(c**0.5) * length)))


def log_zero(x: Column, c: float = 1.0) -> Column:
    """Logarithmic map at the origin; time 0. It inverts exp_zero up to a factor sqrt(c)."""
    angle = F.acosh(F.greatest(F.lit(c**0.5) * x[0], F.lit(1 + 1e-5)))
    return F.concat(F.array(F.lit(0.0)), scaled(space(x), F.lit(c**0.5) * angle / F.sinh(angle)))


def off_manifold(x: Column, c: float = 1.0) -> Column:
    """How far <x, x> is from -1/c."""
    return F.abs(lorentz_dot(x, x) + 1 / c)


def transported(v: Column, x: Column, y: Column, c: float = 1.0) -> Column:
    """Parallel transport of v from x to y."""
    alpha = F.greatest(-c * lorentz_dot(x, y), F.lit(1.0))
    return added(v, scaled(added(x, y), c * lorentz_dot(y, v) / (alpha + 1)))


def radius(x: Column) -> Column:
    return x[0]


def adaptive_margin(x: Column, base: float, c: float = 1.0) -> Column:
    """Base margin times sech of the hyperbolic radius: smaller far from the origin."""
    return base / F.cosh(F.acosh(F.greatest(F.lit(c**0.5) * x[0], F.lit(1 + 1e-6))))


def onto_manifold(x: Column, c: float = 1.0, tolerance: float = 1e-4) -> Column:
    """The point itself if it lies on the hyperboloid, else its space part lifted again."""
    return F.when(off_manifold(x, c) < tolerance, x).otherwise(lift(space(x), c))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean over the vectors of a list whose mask is 1; zeros if there is none."""
    kept = F.zip_with(rows, mask, lambda v, m: scaled(v, m.cast("double")))
    zero = F.transform(rows[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: added(s, v))
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return scaled(total, 1 / F.greatest(n, F.lit(1e-9)))


def mixed(experts: Column, gates: Column) -> Column:
    """Weighted sum of expert outputs: experts is a list of vectors, gates (expert, weight) structs."""
    zero = F.transform(experts[0], lambda x: F.lit(0.0))
    return F.aggregate(gates, zero, lambda s, g: added(s, scaled(F.element_at(experts, g["expert"] + 1), g["weight"])))
