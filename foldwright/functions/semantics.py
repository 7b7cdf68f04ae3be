"""Numeric rules shared by all operators.

Missing is NULL everywhere (NaN is turned into NULL on the way in), arithmetic
lets NULL through, and comparisons with NULL count as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGIT_EPS = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def stable(c: Column | str, digits: int = 6) -> Column:
    """A reduction's result without the noise of its summation order."""
    return round_even(c, digits)


def floor_mod(a: Column | str, b: float) -> Column:
    return F.pmod(col(a), F.lit(float(b)))


def ratio(num: Column | str, den: Column | str) -> Column:
    """Defined only where both are there and the denominator is positive."""
    return F.when(col(den) > 0, col(num) / col(den))


def skipna_sum(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0.0)) for c in cols])


def strict_sum(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [col(c) for c in cols])


def observed(*cols: Column | str) -> Column:
    """How many of the columns are there."""
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in cols])


def missing(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNull().cast("int") for c in cols])


def at_least(c: Column | str, low: float) -> Column:
    """Clip from below that keeps missing missing (greatest would skip it)."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(low)))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def logit(p: Column | str, eps: float = LOGIT_EPS) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column | str) -> Column:
    """Stable on both sides."""
    x = col(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def entropy(p: Column | str) -> Column:
    p = col(p)
    return F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).when(p.isNotNull(), F.lit(0.0))


def signed_square(x: Column | str) -> Column:
    x = col(x)
    return F.signum(x) * x * x


def quantize(x: Column | str, width: float) -> Column:
    """Index of the cell of that width."""
    return F.floor(F.rint(col(x) / width * 1e8) / 1e8)


def uniform(key: Column | str, salt: int) -> Column:
    """A repeatable number in [0, 1) from an integer key: partition-invariant, and
    good enough for masks and bootstrap weights (neighbouring keys are related).  The key is
    reduced first, so that no product leaves 64 bits."""
    m = F.lit(2147483648)
    return F.pmod(F.pmod(col(key), m) * 1103515245 + salt * 12345 % 2147483648, m) / 2147483648.0


def normal_quantile(p: Column | str) -> Column:
    """Inverse normal distribution by Acklam's rational approximation (its
    coefficients are fixed values; relative error below 1.2e-9)."""
    p = clip(p, 1e-12, 1 - 1e-12)
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]

    def poly(k: list[float], x: Column) -> Column:
        return reduce(lambda acc, v: acc * x + v, k[1:], F.lit(k[0]))

    q, tail = p - 0.5, F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    mid = q * poly(a, q * q) / poly(b, q * q)
    end = poly(c, tail) / poly(d, tail)
    return F.when(p < 0.02425, end).when(p > 1 - 0.02425, -end).otherwise(mid)


def hanley_mcneil(auc: Column | str, n_pos: Column | str, n_neg: Column | str) -> Column:
    """Standard deviation of an AUC."""
    a, m, n = col(auc), col(n_pos), col(n_neg)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    return F.sqrt((a * (1 - a) + (m - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (m * n))


def wilson(k: Column | str, n: Column | str, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share."""
    p, n = col(k) / col(n), col(n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pooled = (k1 + k2) / (n1 + n2)
    return (k1 / n1 - k2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))


def sanitize(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(name), "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
