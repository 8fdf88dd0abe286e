"""Exact binomial intervals and bootstrap errors for aggregated tables (a few rows, so Python is fine here)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + up * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + up / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of I_x(a, b) in x, by bisection down to the last bit."""
    low, high = 0.0, 1.0
    while True:
        mid = (low + high) / 2
        if mid in (low, high):
            return mid
        if incomplete_beta(a, b, mid) < p:
            low = mid
        else:
            high = mid


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Exact two-sided interval of k successes in n; undefined for n = 0."""
    if not n:
        return None, None
    low = 0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)
    high = 1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k)
    return low, high


def interval_udf(alpha: float = 0.05) -> Callable:
    """Pandas UDF (k, n) -> struct<low, high> for aggregated rows."""

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), alpha) for a, b in zip(k, n)], columns=["low", "high"])

    return interval


def mad_of_counts(pred: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Mean over letters of |predicted share - gold share| in percent, for each row of counts; NaN where nothing is scored."""
    scored = pred.sum(axis=-1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(scored[..., 0] > 0, (100.0 * np.abs(pred - gold) / scored).mean(axis=-1), np.nan)


def exact_mad_bootstrap(gold: list[str], answers: list[str | None], resamples: int = 10_000, seed: int = 42) -> float | None:
    """Bootstrap deviation of the MAD over all rows in order, from the PCG64 stream of ``seed``; drawn in chunks of bounded size."""
    labels = sorted({x for x in [*gold, *answers] if x})
    n = len(gold)
    if not n or not labels:
        return None
    place = {x: i for i, x in enumerate(labels)}
    g = np.array([place.get(x, -1) for x in gold])
    a = np.array([place.get(x, -1) if x is not None else -2 for x in answers])
    cell = (g + 1) * (len(labels) + 2) + (a + 2)
    rng, out, step = np.random.default_rng(seed), [], max(1, 2_000_000 // n)
    for first in range(0, resamples, step):
        draw = cell[rng.integers(0, n, size=(min(step, resamples - first), n))]
        for row in draw:
            table = np.bincount(row, minlength=(len(labels) + 1) * (len(labels) + 2)).reshape(len(labels) + 1, len(labels) + 2)
            out.append(mad_of_counts(table[:, 2:].sum(axis=0), table[1:, 1:].sum(axis=1)))
    values = np.array(out, dtype=float)
    values = values[~np.isnan(values)]
    return float(values.std()) if len(values) else None


def counted_mad_bootstrap(counts: pd.DataFrame, resamples: int = 10_000, seed: int = 42) -> float | None:
    """The same deviation from the (gold, answer, n) table by multinomial resampling: its cost does not grow with the rows."""
    n = int(counts["n"].sum())
    labels = sorted({x for x in [*counts["gold"], *counts["answer"]] if isinstance(x, str) and x})
    if not n or not labels:
        return None
    drawn = np.random.default_rng(seed).multinomial(n, counts["n"].to_numpy() / n, size=resamples)
    answered = counts["answer"].map(lambda x: isinstance(x, str)).to_numpy()
    pred = np.stack([drawn[:, (counts["answer"] == x).to_numpy()].sum(axis=1) for x in labels], axis=1)
    gold = np.stack([drawn[:, (counts["gold"] == x).to_numpy() & answered].sum(axis=1) for x in labels], axis=1)
    values = mad_of_counts(pred, gold)
    values = values[~np.isnan(values)]
    return float(values.std()) if len(values) else None
