"""Column roles and one-hot encoding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_INTS, _FLOATS = ("int", "bigint", "smallint", "tinyint"), ("double", "float")


@dataclass
class ColumnTypes:
    target: str | None = None
    roles: dict[str, list[str]] = field(default_factory=dict)

    @property
    def predictors(self) -> list[str]:
        return [*self.roles.get("continuous", []), *self.roles.get("boolean", [])]

    def summary(self) -> list[tuple[str, str]]:
        return sorted((c, r) for r, cs in self.roles.items() for c in cs)


def role_frame(df: DataFrame, max_null_fraction: float = 0.9, category_limit: int = 20, float_category_limit: int = 8, text_min_chars: int = 30) -> DataFrame:
    """(column, role) of every column: exact distinct counts, null shares and mean lengths in one aggregation."""
    def null(c, k):
        return F.col(c).isNull() | F.isnan(c) if k in _FLOATS else F.col(c).isNull()

    kinds = dict(df.dtypes)
    parts = []
    for c, k in kinds.items():
        v = F.when(~null(c, k), F.col(c))
        length = F.avg(F.length(c)) if k == "string" else F.lit(0.0)
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count_distinct(v).alias("n"), F.avg(null(c, k).cast("double")).alias("nulls"), F.count("*").alias("rows"), length.cast("double").alias("length")).alias(f"c_{c}"))
    long = df.agg(*parts).select(F.explode(F.array(*[f"c_{c}" for c in kinds])).alias("x")).select("x.*")
    ints, floats = ", ".join(f"'{k}'" for k in _INTS), ", ".join(f"'{k}'" for k in _FLOATS)
    return long.select("column", F.expr(f"""case when n <= 1 or nulls >= {max_null_fraction} then 'drop' when n = 2 then 'boolean'
        when kind like 'timestamp%' or kind = 'date' then 'datetime'
        when kind = 'string' then case when n = rows then 'identifier' when length >= {text_min_chars} then 'text' else 'categorical' end
        when kind in ({ints}) then case when n = rows then 'identifier' when n <= {category_limit} then 'categorical' else 'continuous' end
        when kind in ({floats}) then if(n <= {float_category_limit}, 'categorical', 'continuous') else 'drop' end""").alias("role"))


def classify_columns(df: DataFrame, target: str | None = None, **limits) -> ColumnTypes:
    roles: dict[str, list[str]] = {}
    for r in role_frame(df.drop(target) if target else df, **limits).collect():  # a row a column
        roles.setdefault(r.role, []).append(r.column)
    return ColumnTypes(target, roles)


def one_hot_encode(df: DataFrame, columns: list[str], drop_first: bool = True, category_limit: int = 20) -> tuple[DataFrame, dict[str, list[str]]]:
    """0/1 columns <column>_<category>, sorted, the first left out; nulls stay null; columns with more categories stay as they are."""
    one = df.agg(*[F.array_sort(F.slice(F.collect_set(F.col(c).cast("string")), 1, category_limit + 1)).alias(c) for c in columns]).first() if columns else {}
    made = {}
    for c in columns:
        cats = list(one[c])
        if len(cats) > category_limit:
            continue
        kept = cats[1:] if drop_first and len(cats) > 1 else cats
        made[c] = [f"{c}_{v}" for v in kept]
        df = df.withColumns({f"{c}_{v}": F.when(F.col(c).isNotNull(), (F.col(c).cast("string") == v).cast("double")) for v in kept}).drop(c)
    return df, made


def select_model_columns(df: DataFrame, types: ColumnTypes, exclude: tuple[str, ...] = (), drop_all_zero: bool = True) -> list[str]:
    cols = [c for c in types.predictors if c not in exclude and c in df.columns]
    if drop_all_zero and cols:
        top = df.agg(*[F.max(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))).alias(c) for c in cols]).first()
        cols = [c for c in cols if top[c]]
    return cols
