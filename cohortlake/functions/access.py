"""Client addresses, place labels and pseudonyms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlake import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _filled(c) -> Column:
    return F.nullif(_col(c), F.lit(""))


def client_ip(forwarded, real_ip, peer) -> Column:
    """First forwarded address, else the proxy's, else the peer's, else ``unknown``."""
    first = F.trim(F.element_at(F.split(_filled(forwarded), ","), 1))
    return F.coalesce(first, _filled(real_ip), _filled(peer), F.lit("unknown"))


def is_private(address) -> Column:
    a = _col(address)
    return a.isin(V.LOCAL_ADDRESSES) | a.startswith(V.LOCAL_PREFIX)


def location_source(latitude, longitude, accuracy) -> Column:
    """Where the place came from: coordinates, with the accuracy when known, or nothing."""
    known = _col(latitude).isNotNull() & _col(longitude).isNotNull()
    metres = F.when(_col(accuracy) != 0, _col(accuracy)).try_cast("bigint")
    label = F.coalesce(
        F.concat(F.lit("GPS Location (±"), metres.cast("string"), F.lit("m)")), F.lit("GPS Location")
    )
    return F.when(known, label).otherwise("No GPS Data")


def pseudonym(value) -> Column:
    """SHA-256 in hex."""
    return F.sha2(_col(value), 256)
