"""Row selection: condition filters, children, key lookups, owners."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def filter_by(df: DataFrame, conditions: Mapping[str, object] | None) -> tuple[DataFrame, list[str]]:
    """Keep rows that meet all conditions; also return the keys that are no columns.

    A list means membership and a scalar equality. Both reach the Parquet scan
    as pushed filters. Unknown keys do not filter.
    """
    conditions = conditions or {}
    ignored = [k for k in conditions if k not in df.columns]
    tests = [_test(F.col(k), v) for k, v in conditions.items() if k in df.columns]
    return (df.where(reduce(lambda a, b: a & b, tests)) if tests else df), ignored


def _test(column: Column, wanted: object) -> Column:
    if isinstance(wanted, (list, tuple, set)):
        return column.isin(list(wanted))
    return column == F.lit(wanted)


def children_of(children: DataFrame, parent_id: str | None, key: str = "trial_id") -> DataFrame:
    """Rows of one parent, or all rows when no parent is named."""
    return children if parent_id is None else children.where(F.col(key) == parent_id)


def children_of_any(children: DataFrame, parents: DataFrame, key: str = "trial_id") -> DataFrame:
    """Rows whose parent is in a table of parents."""
    return children.join(parents.select(key), key, "left_semi")


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN and both infinities become null in every float column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    infinity = float("inf")

    def clean(name: str) -> Column:
        c = F.col(name)
        return F.when(~(F.isnan(c) | (F.abs(c) == infinity)), c).alias(name)

    return df.select(*[clean(n) if n in floats else F.col(n) for n in df.columns])


def lookup(requests: DataFrame, table: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """One row per requested key with the table's row, or nulls when it has none.

    The table's key is unique; ``found`` tells a missing row from null fields.
    """
    match = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    payload = clean_floats(table).withColumn("_match", match(F.col(key)))
    payload = payload.drop(key) if not ignore_case else payload.withColumnRenamed(key, f"stored_{key}")
    asked = requests.withColumn("_match", match(F.col(key)))
    joined = asked.join(payload.withColumn("found", F.lit(True)), "_match", "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False))).drop("_match")


def by_username_or_email(logins: DataFrame, users: DataFrame, login: str = "login") -> DataFrame:
    """Match a login text with a user name or an e-mail address, ignoring case.

    The user gives one row per name form, which keeps this a hash join. When
    both forms hit, the user that comes first by ``index`` wins.
    """
    forms = users.select(
        F.explode(F.array_distinct(F.array(F.lower("username"), F.lower("email")))).alias("_form"),
        F.struct(*users.columns).alias("_user"),
    )
    best = forms.groupBy("_form").agg(F.min_by("_user", "_user.index").alias("_user"))
    return (
        logins.withColumn("_form", F.lower(login))
        .join(best, "_form", "left")
        .select(*logins.columns, *[F.col(f"_user.{c}").alias(c) for c in users.columns])
    )


def owned_by(results: DataFrame, user_id: str, on_missing_owner: str = "refuse") -> DataFrame:
    """Results of one user.

    A table without ``user_id`` gives an error, or every row when
    ``on_missing_owner`` is ``"all"``.
    """
    if "user_id" in results.columns:
        return results.where(F.col("user_id") == F.lit(user_id).cast("string"))
    if on_missing_owner == "all":
        return results
    raise ValueError("the results have no user_id column")


def check_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``known`` and ``allowed`` to claims of (simulation_id, user_id)."""
    owners = results.select("simulation_id", F.col("user_id").alias("_owner"), F.lit(True).alias("_known"))
    return claims.join(owners, "simulation_id", "left").select(
        *claims.columns,
        F.coalesce("_known", F.lit(False)).alias("known"),
        F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False)).alias("allowed"),
    )
