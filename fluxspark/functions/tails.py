"""Distribution tails and quantiles as column expressions: rational approximations, series, and continued fractions folded over sequences."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fold(n: int | Column, start: Column, step) -> Column:
    """start after step(state, i) for i = 1..n."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n) if isinstance(n, int) else n), start, step)


def _let(values: dict[str, Column], then) -> Column:
    """``then`` of a struct of values that are computed once, though an expression may name them often."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


# W. J. Cody's rational approximations of the error function (Math. Comp. 23, 1969), numerator and denominator,
# highest power first: of erf(x) / x in x^2 up to 0.46875, of exp(x^2) erfc(x) in x up to 4, and of its remainder in 1 / x^2 beyond.
_NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(pair: tuple, x: Column) -> Column:
    value = lambda powers: reduce(lambda acc, c: acc * x + c, powers[1:], F.lit(powers[0]))
    return value(pair[0]) / value(pair[1])


def erfc(x: Column) -> Column:
    """Complementary error function."""
    a = F.abs(x)
    far = F.exp(-a * a) / a * (1 / math.sqrt(math.pi) - _ratio(_FAR, 1 / (a * a)) / (a * a))
    upper = F.when(a <= 4, F.exp(-a * a) * _ratio(_MIDDLE, a)).otherwise(far)
    return F.when(a <= 0.46875, 1 - x * _ratio(_NEAR, x * x)).when(x > 0, upper).otherwise(2 - upper)


def normal_cdf(z: Column) -> Column:
    return erfc(-z / math.sqrt(2.0)) / 2


def normal_p_value(z: Column) -> Column:
    """Two-sided."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def normal_quantile(p: Column) -> Column:
    """Value below which a standard normal falls with probability p; null outside (0, 1).

    Newton steps on the upper tail, which is convex there, from a start below the root.
    """

    def root(v: Column) -> Column:
        density = lambda x: F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        return _fold(8, v["start"], lambda x, _: x + (erfc(x / math.sqrt(2.0)) / 2 - v["q"]) / density(x))

    q = F.least(p, 1 - p)
    start = F.sqrt(F.greatest(-2 * F.ln(_safe(2 * q)) * (math.pi / 4), F.lit(0.0)))
    x = _let({"q": q, "start": start}, root)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -1.0).otherwise(1.0) * x)


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, less the logarithms of the ten factors."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    factors = x
    for i in range(1, 10):
        factors = factors * (x + i)
    return (z - 0.5) * F.ln(z) - z + math.log(2 * math.pi) / 2 + series - F.ln(factors)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function's continued fraction by the modified Lentz method; a step's factor joins at the next."""

    def step(s: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        num = F.when(i % 2 == 1, m * (b - m)).otherwise(-(a + m) * (a + b + m)) * x / ((a + i) * (a + i + 1))
        return F.struct(_safe(1 + num / s["c"]).alias("c"), (1 / _safe(1 + num * s["d"])).alias("d"), (s["h"] * s["c"] * s["d"]).alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), (1 / _safe(1 - (a + b) * x / (a + 1))).alias("d"), F.lit(1.0).alias("h"))
    last = _fold((60 + 3 * F.sqrt(F.greatest(a, b))).cast("int"), start, step)
    return _let({"s": last}, lambda v: v["s"]["h"] * v["s"]["c"] * v["s"]["d"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularized incomplete beta function for positive a and b."""
    inner = F.least(F.greatest(x, F.lit(1e-290)), F.lit(1 - 1e-16))

    def tail(v: Column) -> Column:
        front = F.exp(log_gamma(v["p"] + v["q"]) - log_gamma(v["p"]) - log_gamma(v["q"]) + v["p"] * F.ln(v["y"]) + v["q"] * F.ln(1 - v["y"]))
        part = front * _beta_fraction(v["p"], v["q"], v["y"]) / v["p"]
        return F.when(v["low"], part).otherwise(1 - part)

    def sided(v: Column) -> Column:
        low = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        pick = lambda yes, no: F.when(low, yes).otherwise(no)
        return _let({"low": low, "p": pick(v["a"], v["b"]), "q": pick(v["b"], v["a"]), "y": pick(v["x"], 1 - v["x"])}, tail)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_let({"a": a, "b": b, "x": inner}, sided))


def t_p_value(t: Column | str, df: Column) -> Column:
    """Two-sided tail of Student's t; null without a positive number of degrees."""
    t = F.col(t) if isinstance(t, str) else t
    sound = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(sound, beta_inc(df / 2, F.lit(0.5), df / (df + t * t)))


def t_quantile_two_sided(alpha: Column, df: Column) -> Column:
    """Value whose two-sided tail is alpha. The tail is convex, so Newton steps from the normal value rise to the root."""

    def root(v: Column) -> Column:
        d = v["d"]
        density = lambda t: v["front"] * F.exp(-(d + 1) / 2 * F.log1p(t * t / d))
        return _fold(14, v["start"], lambda t, _: t + (t_p_value(t, d) - v["alpha"]) / (2 * density(t)))

    front = F.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2)) / F.sqrt(df * math.pi)
    return F.when((df > 0) & alpha.isNotNull(), _let({"d": df, "alpha": alpha, "front": front, "start": normal_quantile(1 - alpha / 2)}, root))


def kolmogorov_p_value(x: Column) -> Column:
    """Limiting tail of the scaled Kolmogorov distance: one theta series for small values, the other for large."""
    at = F.greatest(x, F.lit(1e-3))
    v = F.exp(-(math.pi**2) / (8 * at * at))
    small = 1 - math.sqrt(2 * math.pi) / at * (v + v**9 + v**25 + v**49)
    large = 2 * _fold(50, F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * at * at))
    return F.when(x.isNull(), None).when(F.isnan(x) | (x <= 0), 1.0).when(x < 1.18, F.greatest(small, F.lit(0.0))).otherwise(F.least(large, F.lit(1.0)))


def sign_test_p_value(wins: Column, n: Column) -> Column:
    """Two-sided, of a fair coin: the binomial tail is an incomplete beta function at one half."""
    most = F.greatest(wins, n - wins).cast("double")
    count = n.cast("double")
    tail = beta_inc(F.greatest(most, F.lit(1.0)), count - most + 1, F.lit(0.5))
    return F.when(wins.isNotNull() & n.isNotNull(), F.when(most <= 0, 1.0).otherwise(F.least(2 * tail, F.lit(1.0))))
