"""Linear models from Gram matrices: the rows are aggregated in the JVM, only (p + 1)^2 sums reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_sf2

CONST = "const"


@dataclass
class RegressionResult:
    kind: str
    terms: list[str]
    estimate: np.ndarray
    std_error: np.ndarray | None = None
    metrics: dict[str, float] = field(default_factory=dict)

    def coefficients(self) -> list[dict]:
        out = []
        for k, (t, b) in enumerate(zip(self.terms, self.estimate, strict=True)):
            row = {"term": t, "estimate": float(b)}
            if self.std_error is not None:
                se = float(self.std_error[k])
                z = float(b) / se if se else math.nan
                row |= {"std_error": se, "statistic": z, "p_value": float(normal_sf2(z)), "ci_low": float(b) - 1.959963984540054 * se, "ci_high": float(b) + 1.959963984540054 * se}
            out.append(row)
        return out

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.coefficients()], ", ".join(["term string", *(f"{k} double" for k in list(self.coefficients()[0])[1:])]))


def _design(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Doubles without nulls, NaN and infinities; duplicate features once."""
    cols = [target, *dict.fromkeys(features)]
    d = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(f"v{k}") for k, c in enumerate(cols)])
    for k in range(len(cols)):
        d = d.where(F.col(f"v{k}").isNotNull() & ~F.isnan(f"v{k}") & (F.abs(F.col(f"v{k}")) != float("inf")))
    return d


def _gram(d: DataFrame, p: int, const: bool) -> tuple[np.ndarray, np.ndarray, float, int, float]:
    xs = [*([F.lit(1.0)] if const else []), *[F.col(f"v{k}") for k in range(1, p + 1)]]
    aggs = [F.count("*"), F.sum(F.col("v0") * F.col("v0")), F.sum("v0")]
    aggs += [F.sum(a * F.col("v0")) for a in xs] + [F.sum(a * b) for i, a in enumerate(xs) for b in xs[i:]]
    n, yy, y1, *rest = d.agg(*aggs).first()
    m = len(xs)
    g, it = np.zeros((m, m)), iter(rest[m:])
    for i in range(m):
        for j in range(i, m):
            g[i, j] = g[j, i] = next(it)
    return g, np.array(rest[:m], float), yy, n, y1


def fit_ols(df: DataFrame, target: str, features: list[str], add_const: bool = True, robust: str | None = "HC3") -> RegressionResult:
    """Least squares; HC3 errors take one more pass for leverages and squared residuals."""
    features = list(dict.fromkeys(features))
    d = _design(df, target, features)
    g, xy, yy, n, y1 = _gram(d, len(features), add_const)
    inv = np.linalg.pinv(g)
    b = inv @ xy
    rss, tss = yy - 2 * b @ xy + b @ g @ b, yy - y1 * y1 / n if add_const else yy
    m = len(b)
    loglike = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 else math.inf
    r2 = 1 - rss / tss
    metrics = {"n": n, "r2": r2, "r2_adj": 1 - (1 - r2) * (n - (1 if add_const else 0)) / (n - m), "aic": -2 * loglike + 2 * m, "bic": -2 * loglike + m * math.log(n)}
    if robust == "HC3":
        xs = [*([F.lit(1.0)] if add_const else []), *[F.col(f"v{k}") for k in range(1, len(features) + 1)]]
        e = F.col("v0") - sum((float(c) * x for c, x in zip(b, xs, strict=True)), F.lit(0.0))
        h = sum((float(inv[i, j]) * xs[i] * xs[j] for i in range(m) for j in range(m)), F.lit(0.0))
        d = d.withColumn("u", F.pow(e / (1 - h), F.lit(2)))
        it, meat = iter(d.agg(*[F.sum(F.col("u") * xs[i] * xs[j]) for i in range(m) for j in range(i, m)]).first()), np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                meat[i, j] = meat[j, i] = next(it)
        cov = inv @ meat @ inv
    else:
        cov = inv * rss / (n - m)
    return RegressionResult("ols", [*([CONST] if add_const else []), *features], b, np.sqrt(np.maximum(np.diag(cov), 0)), metrics)


def fit_regularized_ols(df: DataFrame, target: str, features: list[str], alpha: float = 0.01, l1_wt: float = 0.05, standardize: bool = True, refit: bool = False) -> RegressionResult:
    """Elastic net on 0.5 RSS / n + alpha ((1 - l1) / 2 |b|^2 + l1 |b|_1), the constant penalised too, by coordinate descent on
    the Gram matrix from the least-squares start."""
    features = list(dict.fromkeys(features))
    d = _design(df, target, features)
    p = len(features)
    mean, scale = np.zeros(p), np.ones(p)
    if standardize and p:
        s = d.agg(*[F.avg(f"v{k}") for k in range(1, p + 1)], *[F.stddev_pop(f"v{k}") for k in range(1, p + 1)]).first()
        mean, scale = np.array(s[:p], float), np.array([v or 1.0 for v in s[p:]], float)
        d = d.select("v0", *[((F.col(f"v{k}") - float(mean[k - 1])) / float(scale[k - 1])).alias(f"v{k}") for k in range(1, p + 1)])
    g, xy, _, n, _ = _gram(d, p, True)
    g, xy = g / n, xy / n
    b = np.linalg.pinv(g) @ xy
    for _ in range(10_000):
        old = b.copy()
        for j in range(p + 1):
            r = xy[j] - g[j] @ b + g[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - alpha * l1_wt, 0) / (g[j, j] + alpha * (1 - l1_wt))
        if np.abs(b - old).max() < 1e-12:
            break
    if refit:
        keep = np.abs(b) > 1e-12
        b[keep] = np.linalg.pinv(g[np.ix_(keep, keep)]) @ xy[keep]
    kind = "ridge" if l1_wt == 0 else "lasso" if l1_wt == 1 else "elastic_net"
    return RegressionResult(kind, [CONST, *features], b, None, {"n": n, "n_nonzero": int((np.abs(b) > 1e-12).sum()), "feature_mean": mean.tolist(), "feature_scale": scale.tolist()})
