"""Places of logins: the longest address block that holds an address, the nearest place of a coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortlake.functions.access import is_private
from cohortlake.operators.logins import ADDRESS_PLACE, GPS_PLACE, placed_by_address, placed_by_gps
from cohortlake.session import checkpointed

#: Blocks with prefixes up to this length are sent to all tasks: there are fewer than twice two to this power.
BROADCAST_BITS = 12
#: Sides of the cells that a nearest place is looked for in, on a globe of radius 1 (25 km to the whole globe).
CELL_SIDES = (0.004, 0.032, 0.256, 2.1)
#: Up to so many points, counted, are sent to all tasks with the 27 cells around each.
BROADCAST_POINTS = 2_000

_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def address_number(address: Column) -> Column:
    """An IPv4 address as a whole number, null for any other text."""
    parts = F.split(address, "[.]")
    value = sum((F.get(parts, i).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(parts, 0).try_cast("bigint") * (1 << 24))
    return F.when(address.rlike(f"^{_OCTET}([.]{_OCTET}){{3}}$"), value)


def masked(number: Column, bits: int) -> Column:
    return number.bitwiseAND(F.lit((1 << 32) - (1 << (32 - bits))))


def address_blocks(blocks: DataFrame, network: str = "network") -> DataFrame:
    """``(bits, base, place)`` of networks like ``10.0.0.0/8``; of repeated ones the first place, other texts are left out."""
    length = F.regexp_extract(network, "/([0-9]{1,2})$", 1).try_cast("int")
    known = blocks.select(length.alias("bits"), address_number(F.substring_index(network, "/", 1)).alias("number"),
                          F.struct(*ADDRESS_PLACE).alias("place")).where("number IS NOT NULL AND bits BETWEEN 0 AND 32")
    mask = F.lit(1 << 32) - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(32) - F.col("bits"))
    return known.groupBy("bits", F.col("number").bitwiseAND(mask).alias("base")).agg(F.min("place").alias("place"))


def place_by_range(logins: DataFrame, blocks: DataFrame, network: str = "network") -> DataFrame:
    """Place columns from a table of address blocks; of blocks inside each other the longest prefix counts.

    Each different address is masked to the prefix lengths that the table has
    (33 at most) and looked up by equality, so ranges need no comparing join.
    Short prefixes, a default block among them, hold many addresses each; they
    are few and go to all tasks. Logins join the places of their address;
    private addresses, and texts that are no IPv4 address, need none.
    """
    table = checkpointed(address_blocks(blocks, network))
    lengths = sorted(r.bits for r in table.select("bits").distinct().collect())  # 33 at most
    number = F.when(~is_private("ip_address"), address_number(F.col("ip_address")))
    addresses = logins.select(F.col("ip_address").alias("_key"), number.alias("_number")).where("_number IS NOT NULL").distinct()

    def found(some: list[int], send: bool) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), masked(F.col("_number"), b).alias("base")) for b in some]))
        own = table.where(F.col("bits").isin(some))
        return addresses.select("_key", keys.alias("k")).select("_key", "k.*").join(
            F.broadcast(own) if send else own, ["bits", "base"]).select("_key", "bits", "place")

    groups = [(some, send) for send in (True, False) if (some := [b for b in lengths if (b <= BROADCAST_BITS) == send])]
    if not groups:
        return placed_by_address(logins, table.select(F.lit("").alias("_key"), "place").limit(0))
    every = found(*groups[0])
    for group in groups[1:]:
        every = every.unionByName(found(*group))
    return placed_by_address(logins, every.groupBy("_key").agg(F.max_by("place", "bits").alias("place")))


def on_globe(latitude: Column, longitude: Column) -> list[Column]:
    """A coordinate as a point on a globe of radius 1: no seam at the date line, none at the poles."""
    a, b = F.radians(latitude), F.radians(longitude)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def in_cells(points: DataFrame, xyz: tuple[str, str, str], side: float, around: bool) -> DataFrame:
    """Points with the cell ``(_x, _y, _z)`` they lie in, or once for it and each of the 26 around it."""
    for name, c in zip(("_x", "_y", "_z"), xyz, strict=True):
        own = F.floor(F.col(c) / side)
        points = points.withColumn(name, F.explode(F.array(*[own + d for d in (-1, 0, 1)])) if around else own)
    return points


def near_pairs(asked: DataFrame, spots: DataFrame, side: float, few_spots: bool, send: bool) -> DataFrame:
    """Coordinates ``x, y, z`` with the spots ``px, py, pz`` within ``side`` of them, and ``_square`` of the distance.

    One side stands in all cells around its own, the spots if they are the
    fewer. Spark's size estimates do not know how often a row is repeated, so
    they must not pick a side to broadcast: a counted one goes to all tasks,
    or both are sorted by cell.
    """
    left, right = in_cells(asked, ("x", "y", "z"), side, not few_spots), in_cells(spots, ("px", "py", "pz"), side, few_spots)

    def sent(some: DataFrame) -> DataFrame:
        return F.broadcast(some) if send else some.hint("merge")

    pairs = left.join(sent(right), ["_x", "_y", "_z"]) if few_spots else sent(left).join(right, ["_x", "_y", "_z"])
    step = [F.col(c) - F.col(f"p{c}") for c in "xyz"]
    return pairs.withColumn("_square", step[0] * step[0] + step[1] * step[1] + step[2] * step[2]).where(F.col("_square") <= side * side)


def nearest_place(logins: DataFrame, places: DataFrame, sides: tuple[float, ...] = CELL_SIDES) -> DataFrame:
    """Place columns of the place with the least distance over the globe; every coordinate gets one.

    Places and different login coordinates are points on a globe cut into
    cubic cells. A coordinate meets the places of its own and the neighbouring
    cells; what lies in no neighbouring cell is further away than a cell's
    side, so a place found within the side is the nearest one. Coordinates
    without such a place go on to larger cells, the last of which hold the
    whole globe. Of places at one point, and of equally near ones, the first
    in the order of their coordinates and columns counts. Logins without
    coordinates are labelled and kept.

    The least distance of a coordinate is one number, so tasks keep no pairs
    for it; the pairs at that distance are then told by meeting once more.
    """
    if sides[-1] <= 2:
        raise ValueError("the last cells must hold the whole globe")
    point = ["latitude", "longitude"]
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    held = places.where(known).groupBy(*point).agg(F.min(F.struct(*GPS_PLACE)).alias("place"))
    held = checkpointed(held.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "place",
                                    *on_globe(F.col("latitude"), F.col("longitude"))))
    spots, number = held.select("_lat", "_lon", *[F.col(c).alias(f"p{c}") for c in "xyz"]), held.count()
    left = logins.where(known).select(*point).distinct().select(*point, *on_globe(F.col("latitude"), F.col("longitude")))
    left = checkpointed(left)
    asked, done = left.count(), None
    for side in sides:
        how = (side, number <= asked, min(number, asked) <= BROADCAST_POINTS)
        best = near_pairs(left, spots, *how).groupBy(*point, "x", "y", "z").agg(F.min("_square").alias("_best"))
        first = near_pairs(best, spots, *how).where("_square = _best").groupBy(*point).agg(F.min(F.struct("_lat", "_lon")).alias("_first"))
        found = checkpointed(first.select(*point, "_first.*"))
        done = found if done is None else done.unionByName(found)
        if side != sides[-1]:
            left = checkpointed(left.join(found.select(*point), point, "left_anti"))
            if (asked := left.count()) == 0:
                break
    named = held.select("_lat", "_lon", F.col("place").alias("_place"))
    named = done.join(F.broadcast(named) if number <= BROADCAST_POINTS else named.hint("merge"), ["_lat", "_lon"])
    return placed_by_gps(logins, named.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "_place"),
                         F.col("latitude"), F.col("longitude"))
