"""Tail probabilities of the usual tests as column expressions: no Python on executors, no table of values.

The regularised incomplete beta and gamma functions are continued fractions and series, evaluated by `aggregate` over a fixed
number of terms. They are good to about ten digits for degrees of freedom up to some hundreds of thousands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 600
TINY = 1e-300
# The coefficients of Lanczos' approximation to the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _double(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def log_gamma(z: Column | float) -> Column:
    """The logarithm of the gamma function, for z of 0.5 and more."""
    x = _double(z) - 1
    total = sum((F.lit(c) / (x + i) for i, c in enumerate(LANCZOS) if i), start=F.lit(LANCZOS[0]))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(total)


def _away(x: Column) -> Column:
    """x, or a tiny number where it is 0."""
    return F.when(F.abs(x) < TINY, TINY).otherwise(x)


def _fraction(first: Column, step, before: float = 1.0) -> Column:
    """A continued fraction by Lentz' method: `first` is its first denominator, step(k, s) the terms (numerator, denominator)
    of round k, one or several. before: what the ratio of numerators is before the first round."""
    start = F.struct(F.lit(before).alias("c"), (1 / _away(first)).alias("d"), (1 / _away(first)).alias("h"))

    def one(s: Column, k: Column) -> Column:
        c, d, h = s["c"], s["d"], s["h"]
        for numerator, denominator in step(k):
            d = 1 / _away(denominator + numerator * d)
            c = _away(denominator + numerator / c)
            h = h * d * c
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double")), start, one, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column | float, b: Column | float) -> Column:
    """The regularised incomplete beta function of x for a, b of 0.5 and more; null for a null."""
    x, a, b = _double(x), _double(a), _double(b)

    def lower(x: Column, a: Column, b: Column) -> Column:
        def even(m: Column) -> list[tuple[Column, Column]]:
            return [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), F.lit(1.0))]

        def odd(m: Column) -> list[tuple[Column, Column]]:
            return [(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), F.lit(1.0))]

        # one round of the fraction has an even and an odd term; as rounds of their own they stay small expressions
        def step(k: Column) -> list[tuple[Column, Column]]:
            m = F.floor((k + 1) / 2)
            term = F.when(k % 2 == 1, even(m)[0][0]).otherwise(odd(m)[0][0])
            return [(term, F.lit(1.0))]

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        return front * _fraction(1 - (a + b) * x / (a + 1), step)

    inside = F.when(x < (a + 1) / (a + b + 2), lower(x, a, b)).otherwise(1 - lower(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull(), inside)


def upper_gamma(a: Column | float, x: Column) -> Column:
    """The regularised upper incomplete gamma function for a of 0.5 and more; null for a null."""
    a, x = _double(a), _double(x)
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    zero = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double"))
    series = F.aggregate(numbers, zero, lambda s, k: F.struct((s["term"] * x / (a + k)).alias("term"), (s["sum"] + s["term"] * x / (a + k)).alias("sum")), lambda s: s["sum"])
    tail = _fraction(x + 1 - a, lambda k: [(-k * (k - a), x + 2 * k + 1 - a)], 1 / TINY)
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).when(x.isNotNull(), front * tail)


def p_of_f(f: Column, df1: Column, df2: Column) -> Column:
    """Chance of an F value of at least f."""
    f, df1, df2 = _double(f), _double(df1), _double(df2)
    return incomplete_beta(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def p_of_t(t: Column, df: Column) -> Column:
    """Chance of a t value at least as far from 0, on either side."""
    t, df = _double(t), _double(df)
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def p_of_chi_square(x: Column, df: Column) -> Column:
    return upper_gamma(_double(df) / 2, _double(x) / 2)


def p_of_r(r: Column, n: Column) -> Column:
    """Chance of a correlation of n pairs at least as far from 0; null for fewer than three pairs, 0 for a perfect one."""
    r, n = _double(r), _double(n)
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(p_of_t(r * F.sqrt((n - 2) / (1 - r * r)), n - 2))
