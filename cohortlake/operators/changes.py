"""Keyed changes of a stored table: field updates, reports of them, deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"


def as_type(value: Column, kind: T.DataType) -> Column:
    """Text as a value of a column's type, null when it does not fit."""
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        return F.when(value.rlike(WHOLE), value).try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(value.rlike(NUMBER), value).try_cast(kind)
    return value.try_cast(kind)


def changeable(schema: T.StructType, key: str) -> dict[str, T.DataType]:
    """Columns a change may name: all simple ones but the key and the stamp."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return {
        f.name: f.dataType for f in schema.fields
        if f.name not in (key, "updated_at") and not isinstance(f.dataType, nested)
    }


def change_problem(field: Column, value: Column, kinds: dict[str, T.DataType]) -> Column:
    """Why a change cannot be applied, null when it can."""
    fits = reduce(
        lambda a, b: a | b,
        [(field == name) & as_type(value, kind).isNotNull() for name, kind in kinds.items()],
    )
    return F.when(~F.coalesce(field.isin(*kinds), F.lit(False)), "unknown field").when(
        ~F.coalesce(fits, F.lit(False)), "bad value"
    )


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "simulation_id",
                  order: tuple[str, ...] = ("changed_at", "change_id")) -> DataFrame:
    """The table after a batch of (key, field, value) changes.

    Of several good changes of one field the last counts; bad ones are left
    out (see :func:`change_report`). Changes shrink to one row per key before
    they meet the table, combined on the map side, so a key with many changes
    does not travel whole.
    """
    kinds = changeable(table.schema, key)
    good = changes.where(change_problem(F.col("field"), F.col("value"), kinds).isNull())
    at = F.struct(*order)
    latest = good.groupBy(key).agg(
        F.max(order[0]).alias("_at"),
        *[F.max_by("value", F.when(F.col("field") == name, at)).alias(f"_new_{name}") for name in kinds],
    )
    new = {
        name: F.coalesce(as_type(F.col(f"_new_{name}"), kind), F.col(name)) for name, kind in kinds.items()
    }
    if "updated_at" in table.columns:
        new["updated_at"] = F.greatest(F.col("_at").cast(table.schema["updated_at"].dataType), F.col("updated_at"))
    return table.join(latest, key, "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in table.columns]
    )


def change_report(table: DataFrame, changes: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Each change with its status: applied, not found, unknown field or bad value."""
    kinds = changeable(table.schema, key)
    known = table.select(key, F.lit(True).alias("_known"))
    problem = change_problem(F.col("field"), F.col("value"), kinds)
    return changes.join(known, key, "left").select(
        *changes.columns,
        F.when(F.col("_known").isNull(), "not found").otherwise(F.coalesce(problem, F.lit("applied"))).alias("status"),
    )


def updated_fields(report: DataFrame, key: str = "simulation_id") -> DataFrame:
    """Per key the names of the fields that were updated (at most one per column)."""
    done = report.where(F.col("status") == "applied")
    return done.groupBy(key).agg(F.sort_array(F.collect_set("field")).alias("updated_fields"))


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once in a table that should hold each once."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "simulation_id") -> DataFrame:
    """The table without the rows whose key is listed."""
    return table.join(keys.select(key), key, "left_anti")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
