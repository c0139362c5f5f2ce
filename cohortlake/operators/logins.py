"""Login audit: places by address or coordinates, latest logins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.access import client_ip, is_private, location_source
from cohortlake.operators.ordered import first_per_group
from cohortlake.schemas import LOGINS

ADDRESS_PLACE = ["country", "region", "city", "isp", "timezone", "latitude", "longitude"]
GPS_PLACE = ["country", "state", "region", "city", "town", "village"]


def with_address(logins: DataFrame) -> DataFrame:
    return logins.withColumn("ip_address", client_ip("x_forwarded_for", "x_real_ip", "peer"))


def placed_by_address(logins: DataFrame, places: DataFrame) -> DataFrame:
    """Logins with the columns of their address's ``place`` in ``(_key, place)``; defaults for private and unknown ones.

    Private addresses need no place. They get spread-out join keys so that a
    large share of them does not meet in one task.
    """
    private = is_private("ip_address")
    spread = F.concat(F.lit("private "), F.pmod(F.xxhash64("login_id"), F.lit(4096)).cast("string"))
    dim = places.select("_key", *[F.col(f"place.{c}").alias(f"_{c}") for c in ADDRESS_PLACE])

    def filled(name: str, default: str, local: str | None = None) -> Column:
        stored = F.coalesce(F.col(f"_{name}"), F.lit(default))
        return F.when(private, local or default).otherwise(stored).alias(name)

    def position(name: str) -> Column:
        return F.when(private, F.lit(0.0)).otherwise(F.coalesce(f"_{name}", F.lit(0.0))).alias(name)

    joined = logins.withColumn("_key", F.when(private, spread).otherwise(F.col("ip_address"))).join(dim, "_key", "left")
    kept = [c for c in logins.columns if c not in ADDRESS_PLACE]
    return joined.select(
        *kept,
        filled("country", "Unknown", "Localhost"), filled("region", "Unknown"),
        filled("city", "Unknown", "Local Machine"), position("latitude"), position("longitude"),
        filled("isp", "Unknown"), filled("timezone", "Unknown"),
    )


def place_by_address(logins: DataFrame, places: DataFrame) -> DataFrame:
    """Place columns from a table of addresses.

    Of several places of one address the first in the order of their columns
    counts, so a login stays one row.
    """
    one = places.groupBy(F.col("ip_address").alias("_key")).agg(F.min(F.struct(*ADDRESS_PLACE)).alias("place"))
    return placed_by_address(logins, one)


def placed_by_gps(logins: DataFrame, places: DataFrame, latitude: Column, longitude: Column) -> DataFrame:
    """Logins with the columns of the ``_place`` in ``(_lat, _lon, _place)`` whose keys equal the given ones.

    Logins without coordinates are labelled and kept; their join keys are
    spread out because they can never match.
    """
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    spread = -F.pmod(F.xxhash64("login_id"), F.lit(4096)) - F.lit(1_000_000_000)
    keyed = logins.withColumns(
        {"_lat": F.when(known, latitude).otherwise(spread), "_lon": F.when(known, longitude).otherwise(F.lit(0))}
    )
    unknown = F.lit("Unknown")
    place = lambda *names: F.coalesce(*[F.col(f"_place.{n}") for n in names], unknown)
    kept = [c for c in logins.columns if c not in ADDRESS_PLACE]
    return keyed.join(places, ["_lat", "_lon"], "left").select(
        *kept,
        place("country").alias("country"),
        place("state", "region").alias("region"),
        F.when(known, place("city", "town", "village")).otherwise("GPS Denied or Unavailable").alias("city"),
        F.when(known, F.col("latitude")).otherwise(F.lit(0.0)).alias("latitude"),
        F.when(known, F.col("longitude")).otherwise(F.lit(0.0)).alias("longitude"),
        location_source("latitude", "longitude", "accuracy").alias("isp"),
        unknown.alias("timezone"),
    )


def place_by_gps(logins: DataFrame, places: DataFrame, decimals: int = 2) -> DataFrame:
    """Place columns from a table of coordinates, compared after rounding.

    Of several places in one cell the first in the order of their columns
    counts, so a login stays one row. A place in another cell is not looked
    for; :func:`cohortlake.operators.places.nearest_place` finds it.
    """
    scale = 10 ** decimals

    def cell(name: str) -> Column:
        return F.floor(F.col(name) * scale + 0.5)

    one = places.groupBy(cell("latitude").alias("_lat"), cell("longitude").alias("_lon")).agg(
        F.min(F.struct(*GPS_PLACE)).alias("_place"))
    return placed_by_gps(logins, one, cell("latitude"), cell("longitude"))


def audit_rows(placed: DataFrame) -> DataFrame:
    """Placed logins in the stored form of the login history, ready to append."""
    present = set(placed.columns)
    return placed.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LOGINS.fields
        ]
    )


def _newest(tie: str) -> list[Column]:
    return [F.desc("timestamp"), F.desc(tie)]


def latest_logins(logins: DataFrame, limit: int = 100, user_id: str | None = None, tie: str = "login_id") -> DataFrame:
    """The newest ``limit`` logins, of one user when named."""
    if user_id:
        logins = logins.where(F.col("user_id") == F.lit(user_id))
    return logins.orderBy(*_newest(tie)).limit(limit)


def latest_logins_per_user(logins: DataFrame, limit: int, tie: str = "login_id") -> DataFrame:
    return first_per_group(logins, ["user_id"], _newest(tie), limit)
