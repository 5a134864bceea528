"""Statistical expressions: EWMA fold over an ordered array, sample-size weight, z-score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scalars import c


def ewma(series: Column, alpha: float) -> Column:
    """struct(mu, sigma) of an ordered array<double>; starts at the first value with zero variance.

    The array holds one value per day, so its length is bounded by the calendar, not by the rows.
    """
    def step(state: Column, x: Column) -> Column:
        mu = F.lit(alpha) * x + F.lit(1.0 - alpha) * state["mu"]
        variance = F.lit(alpha) * F.pow(x - mu, F.lit(2.0)) + F.lit(1.0 - alpha) * state["variance"]
        return F.struct(mu.alias("mu"), variance.alias("variance"))

    start = F.struct(
        F.coalesce(F.get(series, F.lit(0)), F.lit(0.0)).alias("mu"), F.lit(0.0).alias("variance")
    )
    return F.aggregate(
        F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0))),
        start,
        step,
        lambda state: F.struct(
            state["mu"].alias("mu"),
            F.sqrt(F.greatest(F.lit(0.0), state["variance"])).alias("sigma"),
        ),
    )


def sample_weight(n: Column | str, n_min: int) -> Column:
    """1.0 from `n_min` samples on, else n/n_min but at least 0.10."""
    count = c(n)
    return F.when(count >= n_min, F.lit(1.0)).otherwise(
        F.round(F.greatest(F.lit(0.10), count.cast("double") / F.lit(float(n_min))), 4)
    )


def z_score(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    return F.round((c(value) - c(mean)) / F.greatest(c(std), F.lit(1e-4)), 4)


def entropy_from(n: Column, sum_c_log_c: Column) -> Column:
    """Shannon entropy in bits from n and sum(c*log2(c)): H = log2(n) - sum/n, one pass, no join."""
    return F.log2(n) - sum_c_log_c / n
