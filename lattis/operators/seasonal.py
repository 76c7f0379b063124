"""Seasonal and interannual covariates on long series (cell, year, doy, value)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeasonCalendar:
    """bounds: (season, first day, day after the last); the first that matches wins."""

    bounds: tuple[tuple[str, int, int], ...] = field(default=(("winter", 0, 104), ("summer", 104, 288), ("winter", 288, 367)))

    @classmethod
    def four_seasons(cls) -> SeasonCalendar:
        return cls((("winter", 0, 60), ("spring", 60, 152), ("summer", 152, 244), ("autumn", 244, 335), ("winter", 335, 367)))

    @property
    def seasons(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(s for s, _, _ in self.bounds))

    def season_for(self, doy: int) -> str:
        for s, a, b in self.bounds:
            if a <= doy < b:
                return s
        raise ValueError(f"no season for day {doy}")

    def column(self, doy: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no season for day "), doy.cast("string"))).cast("string")
        for s, a, b in reversed(self.bounds):
            out = F.when((doy >= a) & (doy < b), s).otherwise(out)
        return out


def parse_name(name: str, pattern: str = r"(\d{4})(\d{3})") -> tuple[int, int] | None:
    """(year, day) of the first match in a column or file name."""
    m = re.search(pattern, name)
    return (int(m[1]), int(m[2])) if m else None


def long_from_wide(df: DataFrame, id_columns: list[str], pattern: str = r"(\d{4})(\d{3})") -> DataFrame:
    """Wide columns <prefix>YYYYDDD to rows (ids, year, doy, value); other columns are left out."""
    cols = [c for c in df.columns if c not in id_columns and parse_name(c, pattern)]
    if not cols:
        raise ValueError("no acquisition columns")
    long = df.select(*id_columns, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in cols])
    long = long.unpivot(id_columns, [f"`{c}`" for c in cols], "name", "value")
    return long.withColumn("year", F.regexp_extract("name", pattern, 1).cast("int")).withColumn("doy", F.regexp_extract("name", pattern, 2).cast("int")).drop("name")


def year_season_means(series: DataFrame, ids: list[str], calendar: SeasonCalendar = SeasonCalendar()) -> DataFrame:
    s = series.withColumn("season", calendar.column(F.col("doy")))
    return s.groupBy(*ids, "year", "season").agg(F.avg("value").alias("mean"))


def seasonal_means(ys: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, season, mean) of year-season means, and season 'total' over all of them."""
    by = ys.groupBy(*ids, "season").agg(F.sum("mean").alias("s"), F.count("mean").alias("n"))
    total = by.groupBy(*ids).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("season", F.lit("total"))
    return by.unionByName(total).select(*ids, "season", F.expr("s / nullif(n, 0)").alias("mean"))


def year_over_year(ys: DataFrame, ids: list[str], relative: bool = True) -> DataFrame:
    """Change from the same season of the calendar year before; rows only where that year has one. One window, no self-join."""
    part = ", ".join([*ids, "season"])
    prev = F.expr(f"max(mean) over (partition by {part} order by year range between 1 preceding and 1 preceding)")
    had = F.expr(f"count(*) over (partition by {part} order by year range between 1 preceding and 1 preceding)")
    out = ys.withColumn("prev", prev).withColumn("had", had).where("had > 0")
    change = "(mean - prev) / nullif(prev, 0)" if relative else "mean - prev"
    return out.withColumn("change", F.expr(change)).drop("prev", "had", "mean")


def seasonal_variance(yoy: DataFrame, ids: list[str]) -> DataFrame:
    return yoy.groupBy(*ids, "season").agg(F.var_samp("change").alias("var"))


def interannual_variance(yoy: DataFrame, ids: list[str]) -> DataFrame:
    return yoy.groupBy(*ids, "year").agg(F.var_samp("change").alias("var"))


def missingness(df: DataFrame) -> DataFrame:
    """Share of nulls (and NaN) of each column, descending: one aggregation."""
    null = lambda c, k: F.col(c).isNull() | (F.isnan(c) if k in ("double", "float") else F.lit(False))
    one = df.agg(*[F.avg(null(c, k).cast("double")).alias(c) for c, k in df.dtypes])
    return one.unpivot([], one.columns, "column", "missing").orderBy(F.desc("missing"), "column")
