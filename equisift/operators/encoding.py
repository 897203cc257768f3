"""Cleaning, label encoding and the partition into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def clean(df: DataFrame, drop: tuple[str, ...] = (), missing: str = "?") -> DataFrame:
    """Drops columns first, so that gaps in them cost no rows; then rows in which any cell is null or the missing mark."""
    kept = df.drop(*drop)
    text = [f.name for f in kept.schema.fields if f.dataType.typeName() == "string"]
    return kept.withColumns({c: F.nullif(F.col(c), F.lit(missing)) for c in text}).na.drop("any") if text else kept.na.drop("any")


def codes(fit: DataFrame, column: str) -> DataFrame:
    """(value, code): places of the distinct values in sorted order, from 0. Values are made distinct before they are ranked."""
    return fit.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)


def encode(df: DataFrame, columns: list[str], fit: DataFrame | None = None, unseen: int = -1) -> DataFrame:
    """Replaces text columns by codes fitted on `fit` (df itself if not given); other values get `unseen`. Spark broadcasts the codes where their size allows it."""
    for c in columns:
        table = codes(fit if fit is not None else df, c).withColumnsRenamed({"value": f"_{c}", "code": f"_{c}_code"})
        df = df.join(table, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(f"_{c}_code", F.lit(unseen))).drop(f"_{c}", f"_{c}_code")
    return df


def cells(df: DataFrame, z: str = "z", y: str = "y") -> DataFrame:
    """Rows with z and y in 0 and 1, with their cell sg: g10, g11, g00 or g01 (z, then y)."""
    return df.filter(F.col(z).isin(0, 1) & F.col(y).isin(0, 1)).withColumn("sg", F.concat(F.lit("g"), F.col(z), F.col(y)))


def features(df: DataFrame, leave_out: tuple[str, ...]) -> DataFrame:
    """df with `features`: all other columns as doubles, in order, unscaled."""
    return df.withColumn("features", F.array(*[F.col(c).cast("double") for c in df.columns if c not in leave_out]))
