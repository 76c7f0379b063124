"""Model comparison, search and evaluation on Spark ML."""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name -> factory(rows, **params). A ridge penalty on the sum of squares is alpha / n on their mean.
REGRESSORS = {
    "linear": lambda n, **p: LinearRegression(**p),
    "ridge": lambda n, alpha=1.0, **p: LinearRegression(regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False, **p),
    "lasso": lambda n, alpha=0.01, **p: LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **p),
    "elastic_net": lambda n, alpha=0.01, l1_ratio=0.5, **p: LinearRegression(regParam=alpha, elasticNetParam=l1_ratio, standardization=False, **p),
    "random_forest": lambda n, trees=200, leaf=3, depth=10, **p: RandomForestRegressor(numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, seed=0, **p),
    "gradient_boosting": lambda n, iters=100, depth=3, step=0.1, **p: GBTRegressor(maxIter=iters, maxDepth=depth, stepSize=step, seed=0, **p),
}
#: Search spaces: parameter -> (kind, low, high).
SEARCH_SPACES = {
    "ridge": {"alpha": ("log", 1e-3, 1e3)},
    "lasso": {"alpha": ("log", 1e-4, 1e1)},
    "elastic_net": {"alpha": ("log", 1e-4, 1e1), "l1_ratio": ("uniform", 0.05, 0.95)},
    "random_forest": {"trees": ("int", 50, 300), "depth": ("int", 4, 16), "leaf": ("int", 1, 10)},
    "gradient_boosting": {"iters": ("int", 20, 150), "depth": ("int", 2, 6), "step": ("log", 0.01, 0.3)},
}


def build_pipeline(model: str, numeric: list[str], categorical: list[str] = (), target: str = "y", rows: int = 1, params: dict | None = None) -> Pipeline:
    """Median imputation and scaling of numbers, one-hot of categories (unknown ones get a column of their own), then the model."""
    if model not in REGRESSORS:
        raise ValueError(f"unknown model {model!r}")
    stages, parts = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__i" for c in numeric]), VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="__num"), StandardScaler(withMean=True, inputCol="__num", outputCol="__scaled")]
        parts.append("__scaled")
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__k", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__k", outputCol=f"{c}__v")]
        parts.append(f"{c}__v")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=[*stages, REGRESSORS[model](rows, **(params or {})).setLabelCol(target)])


def regression_metrics(df: DataFrame, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """One row: rmse, mae, r2, mape (zero targets are left out), bias, n. One aggregation."""
    o, p = F.col(observed), F.col(predicted)
    return df.agg(
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"), F.avg(F.abs(p - o)).alias("mae"), (1 - F.sum((p - o) * (p - o)) / F.nullif(F.var_pop(o) * F.count(o), F.lit(0.0))).alias("r2"),
        F.avg(F.when(o != 0, F.abs((p - o) / F.nullif(o.cast("double"), F.lit(0.0))))).alias("mape"), F.avg(p - o).alias("bias"), F.count("*").alias("n"),
    )


def residual_frame(df: DataFrame, target: str, prediction: str = "prediction", keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, F.col(target).alias("observed"), F.col(prediction).alias("predicted"), (F.col(target) - F.col(prediction)).alias("residual"))


def with_folds(df: DataFrame, keys: list[str], cv: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(cv)).cast("int"))


def _scores(model, df: DataFrame, target: str) -> dict:
    return regression_metrics(model.transform(df), target, "prediction").first().asDict()


def cross_validate(df: DataFrame, model: str, target: str, numeric, categorical=(), cv: int = 5, params: dict | None = None) -> dict:
    """Mean and spread of the scores over folds (column fold); preprocessing is fitted inside each fold."""
    cv_s, tr_s, t0, n = [], [], time.time(), df.count()
    for k in range(cv):
        train, test = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        fitted = build_pipeline(model, list(numeric), list(categorical), target, n * (cv - 1) // cv, params).fit(train)
        cv_s.append(_scores(fitted, test, target))
        tr_s.append(_scores(fitted, train, target))
    out = {"model": model, "fit_time_s": (time.time() - t0) / cv}
    for m in ("rmse", "mae", "r2"):
        v = [s[m] for s in cv_s]
        out |= {f"{m}_cv": float(np.mean(v)), f"{m}_cv_std": float(np.std(v)), f"{m}_train": float(np.mean([s[m] for s in tr_s]))}
    return out


#: Linear models: (penalty on the mean of squares as a function of rows and parameters, share of it that is on absolute values).
LINEAR = {
    "linear": lambda n: (0.0, 0.0), "ridge": lambda n, alpha=1.0: (alpha / max(n, 1), 0.0), "lasso": lambda n, alpha=0.01: (alpha, 1.0),
    "elastic_net": lambda n, alpha=0.01, l1_ratio=0.5: (alpha, l1_ratio),
}
#: Columns of a design whose products are summed; wider ones are fitted one by one with the same objective.
MAX_COLUMNS = 100


def _solve(g: np.ndarray, xy: np.ndarray, alpha: float, l1: float) -> np.ndarray:
    """Least 0.5 b'gb - b'xy + alpha ((1 - l1) / 2 |b|^2 + l1 |b|_1); the last coefficient, the constant, isn't penalised."""
    pen = np.append(np.full(len(xy) - 1, alpha), 0.0)
    b = np.linalg.pinv(g + np.diag(pen * (1 - l1)), hermitian=True) @ xy
    for _ in range(10_000 if l1 * alpha else 0):
        old = b.copy()
        for j in range(len(b)):
            if g[j, j] > 0:
                r = xy[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(r) * max(abs(r) - pen[j] * l1, 0) / (g[j, j] + pen[j] * (1 - l1))
        if np.abs(b - old).max() < 1e-9 * max(1.0, np.abs(b).max()):
            break
    return b


def linear_scores(df: DataFrame, target: str, numeric, categorical, models: dict[str, dict], cv: int) -> list[dict] | None:
    """Cross-validated scores of all linear models in three passes: medians of each fold's training rows, sums of products by fold (a
    training set is all folds less one, so one pass serves every fit), and the errors. None if the design is too wide."""
    t0, numeric, categorical = time.time(), list(numeric), list(categorical)
    levels = [(c, r[0]) for c in categorical for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(MAX_COLUMNS + 1).collect()]
    if 2 * len(numeric) + len(levels) > MAX_COLUMNS:
        return None
    d = df.select("fold", F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(numeric)], *[F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(categorical)]).where("y is not null")
    med = d.agg(F.count("*"), *[F.expr(f"percentile_approx(if(fold <> {k}, x{j}, null), 0.5, 10000)") for k in range(cv) for j in range(len(numeric))]).first()
    # a number is its value, 0 if null, and whether it is null: any imputation is a sum of the two
    cols = [e for j in range(len(numeric)) for e in (F.coalesce(F.col(f"x{j}"), F.lit(0.0)), F.col(f"x{j}").isNull().cast("double"))]
    cols += [F.coalesce((F.col(f"c{categorical.index(c)}") == v).cast("double"), F.lit(0.0)) for c, v in levels] + [F.lit(1.0)]
    m, folds = len(cols), {}
    every = [*cols, F.col("y")]
    for r in d.groupBy("fold").agg(*[F.sum(a * b).alias(f"s{i}_{i + k}") for i, a in enumerate(every) for k, b in enumerate(every[i:])]).collect():
        g = np.zeros((m + 1, m + 1))
        for i in range(m + 1):
            for j in range(i, m + 1):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        folds[r.fold] = g
    whole, fits, p = sum(folds.values()), {}, len(numeric)
    for k in folds:
        g = whole - folds[k]
        n = g[m - 1, m - 1]
        if n < 2:
            continue
        # numbers are imputed and scaled by the training rows, categories stay 0 and 1
        a = np.zeros((p + len(levels) + 1, m))
        for j in range(p):
            v = med[1 + k * p + j] or 0.0
            mean = (g[2 * j, m - 1] + v * g[2 * j + 1, m - 1]) / n
            square = g[2 * j, 2 * j] + v * v * g[2 * j + 1, 2 * j + 1]
            sd = math.sqrt(max(0.0, (square - n * mean * mean) / (n - 1)))
            if sd > 0:
                a[j, 2 * j], a[j, 2 * j + 1], a[j, m - 1] = 1 / sd, v / sd, -mean / sd
        for j in range(p, len(a)):
            a[j, p + j] = 1.0
        gz, xz = a @ g[:m, :m] @ a.T / n, a @ g[:m, m] / n
        for name, params in models.items():
            fits[name, k] = _solve(gz, xz, *LINEAR[name](n, **params)) @ a
    aggs = []
    for (_, k), w in fits.items():
        e = F.col("y") - sum((float(c) * x for c, x in zip(w, cols, strict=True)), F.lit(0.0))
        aggs += [F.sum(F.when(hit, v)) for hit in (F.col("fold") == k, F.col("fold") != k) for v in (e * e, F.abs(e))]
    got, out = iter(d.agg(*aggs).first()) if aggs else iter(()), {}
    for name, k in fits:
        for tag, g in (("cv", folds[k]), ("train", whole - folds[k])):
            n, sse, sae = g[m - 1, m - 1], next(got), next(got)
            tss = g[m, m] - g[m - 1, m] ** 2 / n
            for metric, v in (("rmse", math.sqrt(sse / n)), ("mae", sae / n), ("r2", 1 - sse / tss if tss > 0 else math.nan)):
                out.setdefault(name, {}).setdefault((metric, tag), []).append(v)
    took = (time.time() - t0) / max(1, len(fits))
    return [{"model": name, "fit_time_s": took} | {key: v for q in ("rmse", "mae", "r2") for key, v in ((f"{q}_cv", float(np.mean(s[q, "cv"]))), (f"{q}_cv_std", float(np.std(s[q, "cv"]))), (f"{q}_train", float(np.mean(s[q, "train"]))))} for name, s in out.items()]


def compare_models(df: DataFrame, target: str, numeric, categorical=(), models=tuple(REGRESSORS), keys=("key",), cv: int = 5, params: dict | None = None) -> DataFrame:
    """The leaderboard by cross-validated rmse."""
    df, params = with_folds(df, list(keys), cv).cache(), params or {}
    rows = linear_scores(df, target, numeric, categorical, {m: params.get(m) or {} for m in models if m in LINEAR}, cv) if set(models) & LINEAR.keys() else []
    done = {r["model"] for r in rows or []}
    rows = sorted([*(rows or []), *(cross_validate(df, m, target, numeric, categorical, cv, params.get(m)) for m in models if m not in done)], key=lambda r: r["rmse_cv"])
    df.unpersist()
    kinds = ", ".join(f"{k} {'string' if k == 'model' else 'double'}" for k in rows[0])
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], kinds)


def draw(space: dict, rng: np.random.Generator) -> dict:
    pick = {"log": lambda a, b: float(math.exp(rng.uniform(math.log(a), math.log(b)))), "uniform": lambda a, b: float(rng.uniform(a, b)), "int": lambda a, b: int(rng.integers(a, b + 1))}
    return {k: pick[kind](a, b) for k, (kind, a, b) in space.items()}


def tune_model(df: DataFrame, model: str, target: str, numeric, categorical=(), space: dict | None = None, n_iter: int = 25, cv: int = 5, keys=("key",), seed: int = 0, backend: str = "random"):
    """(fitted pipeline, results by rank): random search; a model without a space gets one row."""
    if backend != "random":
        raise ImportError(f"the {backend} backend isn't installed")
    space, rng = space if space is not None else SEARCH_SPACES.get(model, {}), np.random.default_rng(seed)
    df = with_folds(df, list(keys), cv).cache()
    rows = []
    for _ in range(n_iter if space else 1):
        p = draw(space, rng)
        rows.append(cross_validate(df, model, target, numeric, categorical, cv, p) | {"params": p})
    rows.sort(key=lambda r: r["rmse_cv"])
    best = build_pipeline(model, list(numeric), list(categorical), target, df.count(), rows[0]["params"]).fit(df)
    df.unpersist()
    frame = df.sparkSession.createDataFrame([(k + 1, str(r["params"]), r["rmse_cv"], r["rmse_cv_std"], r["r2_cv"]) for k, r in enumerate(rows)], "rank int, params string, rmse_cv double, rmse_cv_std double, r2_cv double")
    return best, frame


def permutation_importances(model, df: DataFrame, target: str, columns: list[str], n_repeats: int = 10, seed: int = 0) -> DataFrame:
    """(column, mean, std) of the rise in rmse when a column is shuffled. The shuffle is a hash order dealt into groups of about
    100,000 rows and rotated within them, so no global sort. Nulls are values like others."""
    groups = max(64, df.count() // 100_000)
    base = _scores(model, df, target)["rmse"]
    rows = []
    for c in columns:
        drops = []
        for k in range(n_repeats):
            h = F.xxhash64(*[F.col(x) for x in df.columns], F.lit(seed + k))
            mixed = df.withColumn("__g", F.pmod(F.xxhash64(h, F.lit(1)), F.lit(groups))).withColumn("__h", h)
            mixed = mixed.withColumn(c, F.expr(f"if(lead(true) over w, lead(`{c}`) over w, first(`{c}`) over w)".replace(" over w", " over (partition by __g order by __h)"))).drop("__g", "__h")
            drops.append(_scores(model, mixed, target)["rmse"] - base)
        rows.append((c, float(np.mean(drops)), float(np.std(drops))))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "column string, importance_mean double, importance_std double")


def holdout_split(df: DataFrame, time: str, keys: list[str], share: float = 0.2, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(earlier rows, the last max(int(n * share), least) rows by time and keys). The cut is found from counts per time, so
    no single task sorts all rows."""
    n = df.count()
    hold = max(int(n * share), least)
    per = df.groupBy(F.col(time).alias("w")).agg(F.count("*").alias("m"))
    late = per.selectExpr("w", "m", "coalesce(sum(m) over (order by w desc rows between unbounded preceding and 1 preceding), 0) as after")
    cut = late.where(F.col("after") < hold)
    edge = cut.orderBy("w").first()
    if edge is None:
        return df, df.limit(0)
    take = hold - edge.after
    at = df.where(F.col(time) == edge.w).withColumn("__r", F.expr(f"row_number() over (partition by {time} order by {', '.join(f'{k} desc' for k in keys)})"))
    test = df.where(F.col(time) > edge.w).unionByName(at.where(F.col("__r") <= take).drop("__r"))
    return df.where(F.col(time) < edge.w).unionByName(at.where(F.col("__r") > take).drop("__r")), test
