"""Count tests, false-discovery control, independence tests and map classes."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_sf, poisson_tail


def benjamini_hochberg(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """df with p_adjusted and significant (below alpha); null p take no part.

    Ranks come from counts of distinct p, so rows with equal p share the largest rank: the same adjusted values as ranking
    every row. The global order runs over distinct p only, after the aggregation.
    """
    # distinct p are dealt by range; running counts use the totals of the ranges before
    d = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("d_p")).agg(F.count("*").alias("d_n"))
    d = d.withColumn("bin", F.floor(F.col("d_p") * 1024))
    bins = d.groupBy("bin").agg(F.sum("d_n").alias("n"))
    upto = bins.selectExpr("bin as b_bin", "sum(n) over (order by bin rows between unbounded preceding and 1 preceding) as before", "sum(n) over () as m")  # 1,025 bins at most
    d = d.join(upto, F.col("bin") == F.col("b_bin"))
    d = d.withColumn("rank", F.expr("coalesce(before, 0) + sum(d_n) over (partition by bin order by d_p)")).withColumn("raw", F.expr("d_p * m / rank"))
    low = d.groupBy("bin").agg(F.min("raw").alias("low")).selectExpr("bin as l_bin", "min(low) over (order by bin desc rows between unbounded preceding and 1 preceding) as after")
    d = d.join(low, F.col("bin") == F.col("l_bin")).withColumn("p_adjusted", F.expr("least(1.0, coalesce(after, 1.0), min(raw) over (partition by bin order by d_p desc))"))
    return df.join(d.select("d_p", "p_adjusted"), F.col(p) == F.col("d_p"), "left").drop("d_p").withColumn("significant", F.col("p_adjusted") < alpha)


def poisson_excess(df: DataFrame, count: str, expected: Column | None = None, alpha: float = 0.05) -> DataFrame:
    """df with expected (the mean count unless given), p_value, p_adjusted and significant."""
    if expected is None:
        expected = F.lit(df.agg(F.avg(count)).first()[0])
    df = df.withColumn("expected", expected.cast("double"))
    return benjamini_hochberg(df.withColumn("p_value", poisson_tail(F.col(count).cast("double"), F.col("expected"))), alpha=alpha)


def poisson_rate(df: DataFrame, count: str, exposure: str, max_rate: float, alpha: float = 0.05) -> DataFrame:
    out = poisson_excess(df, count, F.col(exposure) * max_rate, alpha)
    return out.withColumn("observed_rate", F.when(F.col(exposure) > 0, F.col(count) / F.col(exposure)))


@dataclass
class ChiSquareResult:
    statistic: float
    p_value: float
    dof: int
    residuals: DataFrame
    low_expected: bool


def contingency(df: DataFrame, row: str, col: str, values: str | None = None) -> DataFrame:
    """Long table (r, c, observed, expected, residual) without empty rows and columns."""
    v = F.sum(F.col(values).cast("double")) if values else F.count("*").cast("double")
    cells = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(v.alias("observed"))
    rows = cells.groupBy("r").agg(F.sum("observed").alias("rt")).where("rt > 0")
    cols = cells.groupBy("c").agg(F.sum("observed").alias("ct")).where("ct > 0")
    n = cols.agg(F.sum("ct").alias("n"))
    full = rows.crossJoin(cols).crossJoin(F.broadcast(n))  # the table's own cells; n is one row
    out = full.join(cells, ["r", "c"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return out.withColumn("expected", F.expr("rt * ct / n")).withColumn("residual", F.expr("(observed - expected) / sqrt(expected)")).select("r", "c", "observed", "expected", "residual")


def chi_square(df: DataFrame, row: str, col: str, values: str | None = None, min_expected: float = 5) -> ChiSquareResult:
    t = contingency(df, row, col, values)
    s = t.agg(F.count_distinct("r"), F.count_distinct("c"), F.sum(F.expr("pow(observed - expected, 2) / expected")), F.sum(F.expr("pow(greatest(abs(observed - expected) - 0.5, 0), 2) / expected")), F.min("expected")).first()
    if s[0] < 2 or s[1] < 2:
        raise ValueError("the table needs two rows and two columns")
    dof = (s[0] - 1) * (s[1] - 1)
    stat = s[3] if dof == 1 else s[2]
    if low := s[4] < min_expected:
        warnings.warn(f"expected counts below {min_expected}", stacklevel=2)
    return ChiSquareResult(stat, float(chi2_sf(stat, dof)), dof, t, low)


SCHEMES = ("natural_breaks", "quantiles", "equal_interval", "fisher_jenks", "std_mean", "headtail")
#: Distinct values that the exact natural breaks take at most; more are binned by quantile first.
MOST_VALUES = 3000


def _optimal(values: np.ndarray, counts: np.ndarray, k: int) -> list[float]:
    """Upper bounds of the partition with the least squared deviation, by dynamic programming."""
    n = len(values)
    w, s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * values, counts * values**2))

    def cost(i, j):
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    best, cut = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)]), np.zeros((k + 1, n + 1), int)
    for c in range(2, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            tot = best[i] + cost(i, j)
            m = int(np.argmin(tot))
            new[j], cut[c, j] = tot[m], i[m]
        best = new
    out, j = [], n
    for c in range(k, 0, -1):
        out.append(float(values[j - 1]))
        j = cut[c, j] if c > 1 else 0
    return out[::-1]


def class_bounds(df: DataFrame, column: str, k: int = 3, scheme: str = "natural_breaks") -> list[float]:
    """Upper bounds of the classes. Only aggregates reach the driver."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    v = df.select(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v")).where("v is not null")
    lo, hi, n, mean, sd = v.agg(F.min("v"), F.max("v"), F.count_distinct("v"), F.avg("v"), F.stddev_samp("v")).first()
    if not n:
        return []
    k = min(k, n)
    if k == 1:
        return [hi]
    if scheme == "quantiles":
        return sorted(set(v.agg(F.percentile("v", F.array(*[F.lit(i / k) for i in range(1, k + 1)]))).first()[0]))
    if scheme == "equal_interval":
        return [lo + (hi - lo) * i / k for i in range(1, k)] + [hi]
    if scheme == "std_mean":
        return sorted({b for m in (-2, -1, 1, 2) if lo <= (b := mean + m * sd) < hi} | {hi})
    if scheme == "headtail":
        out, cut = [], v
        while True:
            a, c, d = cut.agg(F.avg("v"), F.count("v"), F.count_distinct("v")).first()
            if d < 2 or len(out) >= 50:
                return [*out, hi]
            out.append(a)
            head = v.where(F.col("v") > a)
            if head.count() > 0.4 * c and len(out) > 1:
                return [*out, hi]
            cut = head
    if n > MOST_VALUES:
        q = v.agg(F.percentile_approx("v", F.array(*[F.lit(i / MOST_VALUES) for i in range(1, MOST_VALUES + 1)]), 100_000)).first()[0]
        v = v.withColumn("v", F.array_min(F.filter(F.lit(sorted(set(q))), lambda b: b >= F.col("v")))).where("v is not null")
    hist = sorted((r.v, r["count"]) for r in v.groupBy("v").count().collect())  # MOST_VALUES rows at most
    return _optimal(np.array([a for a, _ in hist]), np.array([b for _, b in hist], float), min(k, len(hist)))


def class_index(v: Column, bounds: list[float]) -> Column:
    """The first class whose upper bound is not below v; -1 for null and NaN."""
    out = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        out = F.when(v <= bounds[i], i).otherwise(out)
    return F.when(v.isNull() | F.isnan(v.cast("double")), -1).otherwise(out).cast("int")


def risk_levels(df: DataFrame, column: str, k: int = 3, scheme: str = "natural_breaks", labels=("low", "medium", "high"), level: str = "risk_level", label: str = "risk_label", zero_is_lowest: bool = True) -> DataFrame:
    """df with an ordinal class and its label. With zero_is_lowest zeros and nulls are forced into class 0."""
    v = F.col(column).cast("double")
    bounds = class_bounds(df, column, k, scheme)
    cls = class_index(v, bounds) if bounds else F.lit(-1)
    if zero_is_lowest:
        cls = F.when(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) == 0, 0).otherwise(cls)
    names = list(labels) if len(bounds) <= len(labels) else [f"class_{i}" for i in range(len(bounds))]
    text = F.lit("no data")
    for i, s in enumerate(names):
        text = F.when(F.col(level) == i, s).otherwise(text)
    return df.withColumn(level, cls.cast("int")).withColumn(label, text)
