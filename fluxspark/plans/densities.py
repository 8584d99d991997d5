"""SQL of distribution tails by integrating their densities, beside the column expressions of functions/tails.py."""

from __future__ import annotations


def _simpson(upper: str, density: str, n: int) -> str:
    """Integral of a density in x from 0 to ``upper``; n even."""
    x = f"(({upper}) * i_ / {n})"
    return f"(({upper}) / {n} / 3.0 * (SELECT sum(CASE WHEN i_ IN (0, {n}) THEN 1 WHEN i_ % 2 = 1 THEN 4 ELSE 2 END * {density.format(x=x)}) FROM range({n + 1}) points(i_)))"


def normal_cdf(z: str, n: int = 400) -> str:
    return f"(0.5 + {_simpson(f'greatest(least({z}, 8), -8)', 'exp(-0.5 * {x} * {x})', n)} / sqrt(2 * pi()))"


def normal_p(z: str, n: int = 2000) -> str:
    return f"(1 - 2 * {_simpson(f'least(abs({z}), 9)', 'exp(-0.5 * {x} * {x})', n)} / sqrt(2 * pi()))"


def t_front(df: str) -> str:
    return f"(exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi() * ({df})))"


def t_p(t: str, df: str, n: int = 4000) -> str:
    return f"(1 - 2 * {t_front(df)} * {_simpson(f'abs({t})', f'((1 + {{x}} * {{x}} / ({df})) ** (-(({df}) + 1) / 2.0))', n)})"


def kolmogorov_p(x: str) -> str:
    return f"(CASE WHEN {x} < 0.3 THEN 1 ELSE least(1, 2 * (SELECT sum(CASE WHEN j_ % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j_ * j_ * ({x}) * ({x}))) FROM range(1, 101) terms(j_))) END)"


def sign_test_p(wins: str, n: str) -> str:
    tail = f"(SELECT sum(exp(lgamma(({n}) + 1) - lgamma(j_ + 1) - lgamma(({n}) - j_ + 1) - ({n}) * ln(2))) FROM range(10000) heads(j_) WHERE j_ BETWEEN greatest({wins}, ({n}) - ({wins})) AND ({n}))"
    return f"least(1, 2 * {tail})"


def t_quantiles(source: str, alpha: float = 0.05, top: float = 6.0, steps: int = 12000) -> str:
    """(df, q) of every df in ``source``: the value whose two-sided tail is alpha, between two points of the cumulated density."""
    h = top / steps
    density = "(1 + x * x / df) ** (-(df + 1) / 2.0)"
    return f"""(SELECT df, min(x + {h} * (target - before) / (area - before)) AS q FROM (SELECT df, x, target, area, lead(area) OVER (PARTITION BY df ORDER BY x) AS next, area AS before FROM (
      SELECT df, x, {(1 - alpha) / 2} AS target, {t_front('df')} * sum({h} * (y0 + 4 * ym + y1) / 6) OVER (PARTITION BY df ORDER BY x ROWS UNBOUNDED PRECEDING) - {t_front('df')} * {h} * (y0 + 4 * ym + y1) / 6 AS area
      FROM (SELECT df, x, {density} AS y0, {density.replace('x * x', f'(x + {h / 2}) * (x + {h / 2})')} AS ym, {density.replace('x * x', f'(x + {h}) * (x + {h})')} AS y1
            FROM (SELECT DISTINCT CAST(df AS DOUBLE) AS df FROM {source}), (SELECT i * {h} AS x FROM range({steps}) grid(i))))) WHERE before <= target AND next > target GROUP BY df)""".replace("(area - before)", "(next - before)")


def normal_quantile_steps(source: str, columns: str, p: str = "p", steps: int = 6) -> str:
    """The rows of ``source`` with ``q``, the standard normal quantile of p, by Newton steps on the integrated density."""
    start = f"sign({p} - 0.5) * sqrt(-1.5707963 * ln(2 * least({p}, 1 - {p})))"
    out = f"(SELECT {columns}, {p}, {start} AS q FROM {source})"
    for _ in range(steps):
        out = f"(SELECT {columns}, {p}, q - ({normal_cdf('q')} - {p}) * sqrt(2 * pi()) * exp(0.5 * q * q) AS q FROM {out})"
    return out
