"""Address blocks and nearest places against plain rules."""

import ipaddress
import math
import random

import pytest

from cohortlake.operators import places as pl

BLOCKS = [("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten-one"), ("10.1.2.0/24", "ten-one-two"), ("10.1.2.128/25", "upper"),
          ("0.0.0.0/0", "all"), ("200.0.0.0/7", "two"), ("10.1.2.3/32", "one"), ("10.1.2.3/32", "another"),
          ("10.1.99.77/16", "zz not first"), ("bad", "x"), ("1.2.3.4/33", "x"), ("300.1.1.1/8", "x"), (None, "x")]


def block_table(spark, rows):
    return spark.createDataFrame(
        [(n, c, "r", "c", "i", "UTC", 1.0, 2.0) for n, c in rows],
        "network string, country string, region string, city string, isp string, timezone string, latitude double, longitude double")


def logins_of(spark, addresses):
    return spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "login_id long, ip_address string")


def longest(address, rows):
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return "Unknown"
    found = []
    for n, c in rows:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        if ip in net:
            found.append((-net.prefixlen, c))
    return min(found, default=(0, "Unknown"))[1]


ADDRESSES = ["10.1.2.3", "10.1.2.200", "10.1.2.4", "10.1.9.9", "10.9.9.9", "201.5.5.5", "199.255.255.255", "0.0.0.0",
             "255.255.255.255", "10.1.2", "not an address", "::1", "10.1.2.999"]


@pytest.mark.parametrize("rows", [BLOCKS, BLOCKS[:4], BLOCKS[9:]])
def test_longest_block_counts(spark, rows):
    r = random.Random(2)
    addresses = ADDRESSES + [".".join(str(r.randint(0, 255)) for _ in range(4)) for _ in range(50)] + ["10.1.2.3"] * 200
    got = pl.place_by_range(logins_of(spark, addresses), block_table(spark, rows))
    assert got.columns == ["login_id", "ip_address", "country", "region", "city", "latitude", "longitude", "isp", "timezone"]
    assert {x.login_id: x.country for x in got.collect()} == {i: longest(a, rows) for i, a in enumerate(addresses)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_private_addresses_need_no_block(spark):
    got = pl.place_by_range(logins_of(spark, ["192.168.1.1", "localhost", "127.0.0.1", None]), block_table(spark, BLOCKS))
    assert {x.login_id: x.country for x in got.collect()} == {0: "Localhost", 1: "Localhost", 2: "Localhost", 3: "Unknown"}


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
    return 2 * math.asin(min(1, math.sqrt(h)))


def place_table(spark, spots):
    return spark.createDataFrame([(a, b, f"c{i}", None, "r", "t", None, None) for i, (a, b) in enumerate(spots)],
                                 "latitude double, longitude double, country string, state string, region string, city string, town string, village string")


def coordinates(spark, spots):
    return spark.createDataFrame([(i, *s, 5.0) for i, s in enumerate(spots)], "login_id long, latitude double, longitude double, accuracy double")


def test_nearest_place_over_the_globe(spark):
    """Beside a cell's edge, over the date line, at the poles, in empty regions, and in a crowd of places."""
    r = random.Random(4)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)] + [(48 + r.uniform(0, 0.5), 11 + r.uniform(0, 0.5)) for _ in range(80)]
    spots += [(10.0, 179.99), (-10.0, -179.99), (89.9, 10.0), (-89.9, 100.0)]
    asked = [(10.001, -179.98), (-10.0, 179.97), (89.99, -170.0), (90.0, 0.0), (-90.0, 50.0), (0.5, 180.0), (0.1, -180.0)]
    asked += [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(100)] + [(48 + r.uniform(0, 0.5), 11 + r.uniform(0, 0.5)) for _ in range(100)]
    asked += spots[:5] + asked[:3]
    got = pl.nearest_place(coordinates(spark, asked), place_table(spark, spots))
    want = {i: f"c{min(range(len(spots)), key=lambda k: distance(a, spots[k]))}" for i, a in enumerate(asked)}
    assert {x.login_id: x.country for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_place_of_missing_coordinates_and_places(spark):
    asked = [(None, 1.0), (1.0, None), (5.0, 5.0)]
    got = {x.login_id: (x.country, x.city) for x in pl.nearest_place(coordinates(spark, asked), place_table(spark, [(6.0, 6.0), (6.0, 6.0)])).collect()}
    assert got == {0: ("Unknown", "GPS Denied or Unavailable"), 1: ("Unknown", "GPS Denied or Unavailable"), 2: ("c0", "t")}
    none = pl.nearest_place(coordinates(spark, asked), place_table(spark, [(6.0, 6.0)]).limit(0)).collect()
    assert {x.login_id: x.country for x in none} == {0: "Unknown", 1: "Unknown", 2: "Unknown"}
    with pytest.raises(ValueError):
        pl.nearest_place(coordinates(spark, asked), place_table(spark, [(6.0, 6.0)]), sides=(0.1, 1.0))


def broadcast_rows(node):
    """Rows of every broadcast in an executed plan."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return broadcast_rows(node.executedPlan())
    if "QueryStage" in name:
        return broadcast_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if name.startswith("BroadcastExchange") else []
    return own + [x for i in range(node.children().size()) for x in broadcast_rows(node.children().apply(i))]


@pytest.mark.parametrize("most", [pl.BROADCAST_POINTS, 10])
@pytest.mark.parametrize("n_spots, n_asked", [(40, 3000), (300, 30)])
def test_only_counted_points_are_broadcast(spark, tmp_path, monkeypatch, most, n_spots, n_asked):
    """Coordinates are small in files and many in cells; fewer places than coordinates, and more; few enough to be sent, and not."""
    r = random.Random(7)
    spots, asked = ([(r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(n)] for n in (n_spots, n_asked))
    coordinates(spark, asked).write.parquet(f"{tmp_path}/logins")
    kept, real = [], pl.checkpointed
    monkeypatch.setattr(pl, "checkpointed", lambda df: kept.append(df) or real(df))
    monkeypatch.setattr(pl, "BROADCAST_POINTS", most)
    rows = pl.nearest_place(spark.read.parquet(f"{tmp_path}/logins"), place_table(spark, spots))
    pairs = [df for df in kept if "explode" in df._jdf.queryExecution().analyzed().toString().lower()]
    sent = [n for df in pairs for n in broadcast_rows(df._jdf.queryExecution().executedPlan())]
    assert len(pairs) > 1 and max(sent, default=0) <= 27 * min(n_spots, n_asked)
    assert bool(sent) == (min(n_spots, n_asked) <= most)
    want = {i: f"c{min(range(n_spots), key=lambda k: distance(a, spots[k]))}" for i, a in enumerate(asked)}
    assert {x.login_id: x.country for x in rows.collect()} == want
