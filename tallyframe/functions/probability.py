"""Count distributions as Columns: normal mixtures and sums of independent events."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile at 1 - 1e-5 as a 32-bit number, by which the largest count of a mixture is bounded.
Z = 4.2645878
#: Cody's rational Chebyshev approximations (1969) of the error function up to 0.46875, and of the
#: complementary one up to 4 and beyond; numerators and denominators from the highest power.
ERF = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
TAIL = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(table: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    """A quotient of polynomials."""
    top, low = (functools.reduce(lambda s, c: s * x + F.lit(c), own[1:], F.lit(own[0])) for own in table)
    return top / low


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f has it: as a variable, where an expression would be repeated."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _erfc_above(x: Column) -> Column:
    """The complementary error function from 0.46875 on."""
    power = _once(F.floor(x * 16.0) / 16.0, lambda cut: F.exp(-cut * cut) * F.exp(-(x - cut) * (x + cut)))  # the cut's square is exact, so nothing is lost
    tail = _once(1.0 / (x * x), lambda v: (F.lit(1 / math.sqrt(math.pi)) - v * _ratio(TAIL, v)) / x)
    return power * F.when(x <= 4.0, _ratio(ERFC, x)).otherwise(tail)


def _by_size(x: Column, near: Callable[[Column, Column], Column], far: Callable[[Column, Column], Column]) -> Column:
    """near(x, erf(x)) up to 0.46875, beyond that far(x, erfc(|x|))."""
    whole = lambda v: F.when(F.abs(v) <= 0.46875, near(v, _once(v * v, lambda q: v * _ratio(ERF, q)))).otherwise(far(v, _once(F.abs(v), _erfc_above)))
    return _once(x, whole)


def erf(x: Column) -> Column:
    """To the last digits of a double; Spark has no built-in one."""
    return _by_size(x, lambda v, e: e, lambda v, c: F.signum(v) * (1.0 - c))


def erfc(x: Column) -> Column:
    """1 - erf(x), as exact where that is tiny."""
    return _by_size(x, lambda v, e: 1.0 - e, lambda v, c: _once(c, lambda d: F.when(v > 0, d).otherwise(2.0 - d)))


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(z * F.lit(-math.sqrt(0.5)))


def normal_pdf(x: Column, mu: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mu) / sigma, F.lit(2.0))) / (sigma * F.lit(math.sqrt(2 * math.pi)))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda v: v / total(powers))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mixture(pi: Column, mu: Column, sigma: Column) -> Column:
    """Array of struct(pi, mu, sigma)."""
    return F.arrays_zip(pi.alias("pi"), mu.alias("mu"), sigma.alias("sigma"))


def mixture_mean(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p.pi * p.mu)


def mixture_cdf(parts: Column, c: Column) -> Column:
    """P(X <= c), without continuity correction or truncation at 0."""
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p.pi * normal_cdf((c - p.mu) / p.sigma))


def mixture_pdf(parts: Column, x: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p.pi * normal_pdf(x, p.mu, p.sigma))


def mixture_draw(parts: Column, u: Column, z: Column) -> Column:
    """The number that a uniform u and a standard normal z make: of the part whose cumulative weight first reaches u (else the last), mu + sigma z."""
    start = F.struct(u.alias("left"), F.lit(-1).alias("found"), F.lit(0).alias("i"))
    chosen = F.aggregate(parts, start, lambda s, p: F.struct((s["left"] - p.pi).alias("left"), F.when((s["found"] < 0) & (s["left"] <= p.pi), s["i"]).otherwise(s["found"]).alias("found"), (s["i"] + 1).alias("i")))
    part = F.get(parts, F.when(chosen["found"] < 0, F.size(parts) - 1).otherwise(chosen["found"]))
    return part.mu + part.sigma * z


def mixture_sample(parts: Column, seed: int) -> Column:
    """A draw: a part by its weight, then a normal number of it; the same for a seed and a dealing of rows."""
    return mixture_draw(parts, F.rand(seed), F.randn(seed + 1))


def linear(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Array of w . x + b for each row of weights."""
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.array(*(dot(w) + F.lit(b) for w, b in zip(weights, bias, strict=True)))


def mixture_head(x: Column, pi: tuple, sigma: tuple, mu: tuple) -> Column:
    """A mixture from features by three linear heads, each (weights, bias): softmax weights, exponential deviations, plain means."""
    return mixture(softmax(linear(x, *pi)), linear(x, *mu), F.transform(linear(x, *sigma), lambda v: F.exp(v)))


def mixture_bound(parts: Column, z: float = Z) -> Column:
    """The largest mu + z * sigma."""
    return F.array_max(F.transform(parts, lambda p: p.mu + F.lit(z) * p.sigma))


def count_pmf(p: Column) -> Column:
    """Distribution of how many of independent events with probabilities `p` happen: counts 0 to n (Poisson-binomial)."""
    zero = F.array(F.lit(0.0))
    step = lambda d, q: F.zip_with(F.concat(d, zero), F.concat(zero, d), lambda a, b: a * (1.0 - q) + b * q)
    return F.aggregate(p, F.array(F.lit(1.0)), step)


def running(pmf: Column) -> Column:
    """Cumulative sums: a CDF of a pmf."""
    last = lambda acc: F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)).otherwise(0.0)
    return F.aggregate(pmf, F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(last(acc) + v)))


def mean_count(pmf: Column) -> Column:
    return F.aggregate(F.transform(pmf, lambda v, i: v * i.cast("double")), F.lit(0.0), lambda s, v: s + v)


def quantised(x: Column) -> Column:
    """To 6 decimals by a rule that other engines share."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def linspace(low: float, high: float, n: int) -> Column:
    """Array of n numbers at equal distances, both ends included."""
    step = (high - low) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit(step))


def reshaped(values: Column, width: int) -> Column:
    """Array of rows of `width` values."""
    rows = F.sequence(F.lit(0), F.ceil(F.size(values) / width).cast("int") - 1)
    return F.transform(rows, lambda i: F.slice(values, i * width + 1, F.lit(width)))
