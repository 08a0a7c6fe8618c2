"""Day length, temperature, mortality and cohort functions, predator and prey, cart and pole, as Column expressions.

A null argument gives null; nothing else is dropped or replaced, but for layers that are not there, which are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tilt of the earth and the day of the equinox in the formula of the day length, the
# scale of the temperature correction, and the odds at a day's distance from the age of recruitment.
TILT, EQUINOX, YEAR = 23.45, 284.0, 365.0
FREEZING = 273.0
SHARPNESS = math.log(99.0) / 86400.0


def day_length(latitude: Column, day_of_year: Column) -> Column:
    """Fraction of the day with light."""
    tilt = F.radians(F.lit(TILT) * F.sin(F.radians(F.lit(360.0) * (F.lit(EQUINOX) + day_of_year) / F.lit(YEAR))))
    arg = -F.tan(F.radians(latitude)) * F.tan(tilt)
    return F.when(arg.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), arg))) / F.lit(math.pi))


def layer_weighted_mean(forcing: Column, day_length: Column, day_layer: Column, night_layer: Column) -> Column:
    """The day layer's value by day and the night layer's by night; layers count from 0, one that is not there is an error."""

    def at(layer: Column) -> Column:
        there = (layer >= 0) & (layer < F.size(forcing))
        wrong = F.raise_error(F.concat(F.lit("no layer "), layer.cast("string"))).cast("double")
        return F.when(there, F.get(forcing, layer.cast("int"))).when(layer.isNull() | forcing.isNull(), F.lit(None).cast("double")).otherwise(wrong)

    day, night = at(day_layer), at(night_layer)
    return day * day_length + night * (F.lit(1.0) - day_length)


def threshold_temperature(temp: Column, min_temp: Column) -> Column:
    return F.when(temp.isNotNull() & min_temp.isNotNull(), F.greatest(temp, min_temp))


def gillooly_temperature(temp: Column) -> Column:
    return temp / (F.lit(1.0) + temp / F.lit(FREEZING))


def recruitment_age(temp: Column, tau_r_0: Column, gamma: Column, t_ref: Column) -> Column:
    return tau_r_0 * F.exp(-gamma * (temp - t_ref))


def mortality(biomass: Column, temp: Column, lambda_0: Column, gamma: Column, t_ref: Column) -> Column:
    return -lambda_0 * F.exp(gamma * (temp - t_ref)) * biomass


def cohort_durations(ages: Column) -> Column:
    """Differences of consecutive ages, the last repeated."""
    n = F.size(ages)
    return F.transform(
        ages,
        lambda a, i: F.when(i < n - 1, F.get(ages, i + 1) - a).otherwise(F.get(ages, n - 1) - F.get(ages, n - 2)),
    )


def npp_injection(npp: Column, efficiency: Column, production: Column) -> Column:
    """Primary production times efficiency goes into the first cohort."""
    return F.transform(production, lambda p, i: F.when(i == 0, npp * efficiency).otherwise(F.lit(0.0)))


def _share(age: Column, rec_age: Column) -> Column:
    """Share of a cohort recruited at an age."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-SHARPNESS) * (age - rec_age)))


def _outflow(production: Column, ages: Column, rec_age: Column, stay: bool) -> Column:
    """Flow out of each cohort per second: the recruited share, or the rest."""
    rates = F.zip_with(cohort_durations(ages), ages, lambda d, a: ((F.lit(1.0) - _share(a, rec_age)) if stay else _share(a, rec_age)) / d)
    return F.zip_with(production, rates, lambda p, r: p * r)


def aging_flow(production: Column, cohort_ages: Column, rec_age: Column) -> Column:
    """What is not recruited moves to the next cohort; nothing leaves the last one. The flows sum to zero."""
    n = F.size(production)
    out = F.transform(_outflow(production, cohort_ages, rec_age, True), lambda x, i: F.when(i < n - 1, x).otherwise(F.lit(0.0)))
    shifted = F.concat(F.array(F.lit(0.0)), F.slice(out, 1, n - 1))
    return F.zip_with(shifted, out, lambda a, b: a - b)


def recruitment_flow(production: Column, cohort_ages: Column, rec_age: Column) -> tuple[Column, Column]:
    """The recruited share leaves every cohort; the sum of it is gained by the biomass."""
    out = _outflow(production, cohort_ages, rec_age, False)
    return F.transform(out, lambda x: -x), F.aggregate(out, F.lit(0.0), lambda a, x: a + x)


def prey_growth(N: Column, alpha: Column) -> Column:  # noqa: N803
    return alpha * N


def predation(N: Column, P: Column, beta: Column, delta: Column) -> tuple[Column, Column]:  # noqa: N803
    return -beta * N * P, delta * beta * N * P


def predator_death(P: Column, gamma: Column) -> Column:  # noqa: N803
    return -gamma * P


def logistic(biomass: Column, rate: Column, capacity: Column) -> Column:
    return rate * biomass * (F.lit(1.0) - biomass / capacity)


def angular_acceleration(angle: Column, spin: Column, force: Column, m_cart: Column, m_pole: Column, length: Column, gravity: Column) -> Column:
    total = m_cart + m_pole
    push = (-force - m_pole * length * spin * spin * F.sin(angle)) / total
    return (gravity * F.sin(angle) + F.cos(angle) * push) / (length * (F.lit(4.0 / 3.0) - m_pole * F.cos(angle) * F.cos(angle) / total))


def linear_acceleration(angle: Column, spin: Column, spin_rate: Column, force: Column, m_cart: Column, m_pole: Column, length: Column) -> Column:
    return (force + m_pole * length * (spin * spin * F.sin(angle) - spin_rate * F.cos(angle))) / (m_cart + m_pole)
