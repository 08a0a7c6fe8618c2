"""Random draws as Column expressions of a seed, a stream's name, a row's key and the number of the draw.

A draw follows from those alone, so it does not depend on partitions, order or retries, and two streams
are independent whatever their keys. Every family is its quantile at a uniform draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the hash that make a draw: as many as a double holds.
DIGITS = 13


def uniform(seed: int, stream: str, key: Column, draw: int | Column = 0) -> Column:
    """A number above 0 and below 1, never either. The key may be of any type that reads as text; null is a key of its own."""
    name = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), (draw if isinstance(draw, Column) else F.lit(draw)).cast("string"), key.cast("string"))
    number = F.conv(F.substring(F.md5(name.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (number + 0.5) / float(16**DIGITS)


def uniform_sql(seed: int, stream: str, key: str, draw: str = "0") -> str:
    """The same draw in DuckDB's SQL."""
    digest = f"md5(concat_ws('|', '{seed}', '{stream}', {draw}, {key}))"
    return f"((('0x' || substr({digest}, 1, {DIGITS}))::bigint::double + 0.5) / {float(16**DIGITS)!r}::double)"


# The published rational approximations of the normal quantile to 16 digits (algorithm AS 241),
# numerators and denominators with the constant first, for the middle, the tails and the far tails.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247510770e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Where the middle ends (distance from one half) and its constant; the reach of the tails and the offsets of both.
HALF, CENTRE, REACH, NEAR, DEEP = 0.425, 0.180625, 5.0, 1.6, 5.0


def _poly(coefficients: tuple[float, ...], x, lit=F.lit):
    out = lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + lit(c)
    return out


def _ratio(pair, x, lit=F.lit):
    return _poly(pair[0], x, lit) / _poly(pair[1], x, lit)


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile to about 16 digits; null outside the open interval from 0 to 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= REACH, _ratio(TAIL, r - NEAR)).otherwise(_ratio(FAR, r - DEEP)) * F.signum(q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= HALF, q * _ratio(MIDDLE, CENTRE - q * q)).otherwise(tail))


class _Text(str):
    """SQL text with the operators that ``_poly`` needs."""

    def __mul__(self, other):
        return _Text(f"({self} * {other})")

    def __add__(self, other):
        return _Text(f"({self} + {other})")

    def __truediv__(self, other):
        return _Text(f"({self} / {other})")


def normal_quantile_sql(p: str) -> str:
    """The same in SQL."""
    lit = lambda c: _Text(f"{c!r}::double")
    q, r = f"({p} - 0.5::double)", f"sqrt(-ln(least({p}, 1::double - {p})))"
    middle = _ratio(MIDDLE, _Text(f"({CENTRE}::double - {q} * {q})"), lit)
    near, far = _ratio(TAIL, _Text(f"({r} - {NEAR}::double)"), lit), _ratio(FAR, _Text(f"({r} - {DEEP}::double)"), lit)
    return f"(case when abs({q}) <= {HALF} then {q} * {middle} else (case when {r} <= {REACH} then {near} else {far} end) * sign({q}) end)"


# ---- priors ----


@dataclass(frozen=True)
class Prior:
    """A distribution: its quantile at a uniform draw, its log density, and finite bounds (of unbounded sides the quantile of ``TAIL_SHARE``)."""

    quantile: Callable[[Column], Column]
    log_density: Callable[[Column], Column]
    bounds: tuple[float, float]

    def draw(self, seed: int, stream: str, key: Column, number: int | Column = 0) -> Column:
        return self.quantile(uniform(seed, stream, key, number))


#: Probability beyond a bound of an unbounded side.
TAIL_SHARE = 0.001


def _need(right: bool, what: str) -> None:
    if not right:
        raise ValueError(f"a prior needs {what}")


def _inside(x: Column, low: float, high: float, density: Column) -> Column:
    """The density from low to high, minus infinity outside and for NaN, null for null."""
    return F.when(x.isNull(), None).when((x >= low) & (x <= high) & ~F.isnan(x), density).otherwise(float("-inf"))


def _normal_log(z: Column, scale: float) -> Column:
    return -0.5 * z * z - math.log(scale) - 0.5 * math.log(2 * math.pi)


def even(low: float, high: float) -> Prior:
    """Every value from low to high alike."""
    _need(low < high, "low below high")
    return Prior(lambda u: low + (high - low) * u, lambda x: _inside(x, low, high, F.lit(-math.log(high - low))), (low, high))


def normal(loc: float, scale: float) -> Prior:
    _need(scale > 0, "a positive scale")
    reach = -scale * NormalDist().inv_cdf(TAIL_SHARE)
    return Prior(lambda u: loc + scale * normal_quantile(u), lambda x: _normal_log((x - loc) / scale, scale), (loc - reach, loc + reach))


def log_normal(mu: float, sigma: float) -> Prior:
    """The logarithm is normal."""
    log = normal(mu, sigma)
    ln = lambda x: F.log(F.when(x > 0, x))
    density = lambda x: F.when(x.isNull(), None).otherwise(F.coalesce(log.log_density(ln(x)) - ln(x), F.lit(float("-inf"))))
    return Prior(lambda u: F.exp(log.quantile(u)), density, (math.exp(log.bounds[0]), math.exp(log.bounds[1])))


def half_normal(scale: float) -> Prior:
    """A normal about zero, folded."""
    _need(scale > 0, "a positive scale")
    top = scale * NormalDist().inv_cdf(1 - TAIL_SHARE / 2)
    density = lambda x: _inside(x, 0.0, float("inf"), math.log(2) + _normal_log(x / scale, scale))
    return Prior(lambda u: scale * normal_quantile(0.5 + 0.5 * u), density, (0.0, top))


def truncated_normal(loc: float, scale: float, low: float, high: float) -> Prior:
    """A normal between low and high."""
    _need(scale > 0 and low < high, "a positive scale and low below high")
    # Reflected so that the bounds' probabilities lie in the lower tail, where they keep their digits.
    side = 1.0 if low + high <= 2 * loc else -1.0
    a, b = (0.5 * math.erfc(-z / (scale * math.sqrt(2))) for z in sorted((side * (low - loc), side * (high - loc))))
    _need(a < b, "mass between its bounds")
    spot = lambda u: a + (b - a) * (u if side > 0 else 1 - u)
    return Prior(
        # Rounding must not leave the bounds.
        lambda u: F.greatest(F.lit(low), F.least(F.lit(high), loc + side * scale * normal_quantile(spot(u)))),
        lambda x: _inside(x, low, high, _normal_log((x - loc) / scale, scale) - math.log(b - a)), (low, high),
    )


def bounds(priors: dict[str, Prior]) -> dict[str, tuple[float, float]]:
    return {n: p.bounds for n, p in priors.items()}


def sample(rows: DataFrame, key: str, priors: dict[str, Prior], seed: int = 0, sizes: dict[str, int] | None = None) -> DataFrame:
    """``rows`` with one column for each prior, drawn from the stream of its name at the row's ``key``.

    A prior with a size gives an array of so many draws. Equal keys draw alike, a null key is a key like
    others. A prior does not see the others: adding one leaves their draws as they are. A name that
    ``rows`` already has is an error.
    """
    if there := [n for n in priors if n in rows.columns]:
        raise ValueError(f"there are columns {', '.join(there)} already")
    sizes = sizes or {}

    def column(n: str, p: Prior) -> Column:
        if n not in sizes:
            return p.draw(seed, n, F.col(key))
        return F.transform(F.sequence(F.lit(0), F.lit(sizes[n] - 1)), lambda i: p.draw(seed, n, F.col(key), i))

    return rows.withColumns({n: column(n, p) for n, p in priors.items()})


def log_density(priors: dict[str, Prior]) -> Column:
    """The joint log density of independent columns named as their priors: minus infinity if one is outside, null if one is null."""
    out = F.lit(0.0)
    for n, p in sorted(priors.items()):
        out = out + p.log_density(F.col(n))
    return out
