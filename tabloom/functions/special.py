"""Normal distribution functions as column expressions (Spark has none built in)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Abramowitz & Stegun 26.2.17 (normal cdf, absolute error below 7.5e-8).
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Acklam's rational approximation of the inverse normal.
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0)
PPF_LOW = 0.02425


def poly(coefficients, x: str) -> str:
    """Horner scheme over a column name, highest power first."""
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}D))"
    return out


def norm_cdf(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * ax)
    density = F.exp(-ax * ax / F.lit(2.0)) * F.lit(1.0 / math.sqrt(2.0 * math.pi))
    series = F.lit(CDF_B[-1])
    for c in reversed(CDF_B[:-1]):
        series = series * t + F.lit(c)
    upper = density * series * t
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def with_norm_ppf(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Add the inverse normal of probabilities strictly inside (0, 1).

    Shared terms are columns of their own step: written out in one expression they would repeat a dozen
    times and the generated code would outgrow the compiler's limit.
    """
    names = list(enumerate(outputs))
    steps = df.withColumns({f"_p{i}": outputs[out] for i, out in names})
    steps = steps.withColumns({f"_q{i}": F.expr(f"_p{i} - 0.5D") for i, _ in names})
    steps = steps.withColumns({
        **{f"_r{i}": F.expr(f"_q{i} * _q{i}") for i, _ in names},
        **{f"_t{i}": F.expr(f"if(abs(_q{i}) > {0.5 - PPF_LOW!r}D, sqrt(-2.0D * ln(least(_p{i}, 1.0D - _p{i}))), null)") for i, _ in names}})
    done = {
        out: F.expr(
            f"if(_t{i} is null, {poly(PPF_A, f'_r{i}')} * _q{i} / {poly(PPF_B, f'_r{i}')}, "
            f"if(_q{i} < 0, 1.0D, -1.0D) * {poly(PPF_C, f'_t{i}')} / {poly(PPF_D, f'_t{i}')})")
        for i, out in names}
    return steps.withColumns(done).drop(*[f"_{k}{i}" for i, _ in names for k in "pqrt"])


def kolmogorov_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided two-sample p-value by the series that converges fast on each side of 1/2."""
    x = d * F.sqrt(n1 * n2 / (n1 + n2))
    far = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x) for k in range(1, 8)), F.lit(0.0))
    near = sum((F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8.0) / (x * x)) for k in range(1, 4)), F.lit(0.0))
    p = F.when(x < 0.04, F.lit(1.0)).when(x < 0.5, F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / x * near).otherwise(far)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square for whole degrees of freedom by the closed finite sums.

    Even df: exp(-h) * sum h^j / j!; odd df: the two-sided normal tail plus half-integer powers
    (h = x / 2). Each term is the one before times h / (j + step).
    """
    h = x / F.lit(2.0)
    even = df % 2 == 0
    first = F.when(even, F.lit(1.0)).otherwise(F.sqrt(h) * F.lit(2.0 / math.sqrt(math.pi)))
    step = F.when(even, F.lit(0.0)).otherwise(F.lit(0.5))
    terms = F.floor(df / 2).cast("int")
    places = F.filter(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), lambda j: j <= terms)
    total = F.aggregate(
        places, F.struct(F.lit(0.0).alias("s"), first.alias("t")),
        lambda a, j: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * h / (j + step)).alias("t")), lambda a: a["s"])
    base = F.when(even, F.lit(0.0)).otherwise(F.lit(2.0) * (F.lit(1.0) - norm_cdf(F.sqrt(x))))
    return F.when(x <= 0, F.lit(1.0)).otherwise(base + F.exp(-h) * total)
