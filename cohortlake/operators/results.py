"""Results analytics: dashboard figures, search, sorting, pages and text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake import fixed_values as V
from cohortlake.functions.scoring import mean
from cohortlake.functions.text import fill, matches_search
from cohortlake.operators.ordered import number_all_rows

PAGE_SIZE = 12
SEARCH_FIELDS = ["simulation_id", "trial_name", "drug_name", "indication", "phase"]
SORTS = {
    "date_desc": ("created_at", True), "date_asc": ("created_at", False),
    "success_desc": ("success_probability", True), "success_asc": ("success_probability", False),
    "patients_desc": ("patients_enrolled", True), "patients_asc": ("patients_enrolled", False),
}


def dashboard_stats(results: DataFrame, scale: int | None = None) -> DataFrame:
    """One row of figures in which a missing value counts as zero.

    ``scale`` states the decimals of the probabilities, for an exact sum.
    """
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        mean(F.coalesce("success_probability", F.lit(0.0)), scale).alias("avg_success"),
        F.avg(F.coalesce("patients_enrolled", F.lit(0))).alias("avg_patients"),
        F.count_if(F.col("patients_completed") > 0).alias("completed"),
    )


def search(results: DataFrame, term: str, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """Rows whose joined fields contain the term, ignoring case."""
    return results.where(matches_search(term, *[F.col(f) for f in fields if f in results.columns]))


def sort_columns(by: str) -> list[Column]:
    """One of the six orders; a missing value sorts as zero, the id breaks ties."""
    name, descending = SORTS[by]
    zero = F.to_timestamp(F.lit("1970-01-01 00:00:00")) if name == "created_at" else F.lit(0)
    value = F.coalesce(F.col(name), zero)
    return [value.desc() if descending else value.asc(), F.asc("simulation_id")]


def page(results: DataFrame, by: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page: each task keeps only the rows up to the end of the page."""
    return results.orderBy(*sort_columns(by)).offset((number - 1) * size).limit(size)


def all_pages(results: DataFrame, by: str, size: int = PAGE_SIZE) -> DataFrame:
    """Every row with its position and page in the whole sorted table; only key and sort value are sorted and pinned."""
    narrow = results.select("simulation_id", SORTS[by][0])
    numbered = number_all_rows(narrow, sort_columns(by), "position").select("simulation_id", "position")
    return results.join(numbered, "simulation_id").withColumn("page", F.floor((F.col("position") - 1) / size) + 1)


def page_count(results: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / size).alias("pages")
    )


def result_lines(results: DataFrame) -> DataFrame:
    """One text line per result with ``N/A`` for missing values.

    A user's list is the lines ordered by ``simulation_id``. Lines stay rows:
    a user may own any number of results, and one text could not hold them.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("N/A"))

    return results.select(
        "user_id",
        "simulation_id",
        fill(
            V.RESULT_LINE, id=F.col("simulation_id"), enrolled=shown("patients_enrolled"),
            completed=shown("patients_completed"), probability=shown("success_probability"),
            cost=shown("estimated_cost"),
        ).alias("line"),
    )


def row_counts(**tables: DataFrame) -> DataFrame:
    """Rows per named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
