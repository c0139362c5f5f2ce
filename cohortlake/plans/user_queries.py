"""Users and login audit."""

import uuid

from pyspark.sql import functions as F

from cohortlake.functions import access as ac
from cohortlake.operators import filters as flt, logins as lg, places as pl, users as us
from cohortlake.plans.registry import query
from cohortlake.schemas import USERS
from cohortlake.session import shared_folder
from cohortlake.sources import tables as tb
from cohortlake.sources.adapters import loader, view, with_views

IP = """coalesce(trim(string_split(x_forwarded_for, ',')[1]), x_real_ip, peer, 'unknown')"""
PRIVATE = "(ip IN ('127.0.0.1', 'localhost', 'unknown') OR starts_with(ip, '192.168.'))"


@query(with_views("SELECT CAST(max(index) AS BIGINT) AS highest FROM users_v", "users_v"))
def highest_index(spark, sf_dir):
    return us.highest_index(view(spark, sf_dir, "users_v"))


@query(with_views("""
SELECT r.request_id, u.index, u.username FROM registrations_v r LEFT JOIN (
  SELECT lower(username) AS form, * FROM users_v UNION ALL SELECT lower(email), * FROM users_v) u
ON u.form = lower(CASE WHEN request_id % 2 = 0 THEN r.username ELSE r.email END)""", "registrations_v", "users_v"))
def login_match(spark, sf_dir):
    load = loader(spark, sf_dir)
    logins = load("registrations_v").select(
        "request_id", F.when(F.col("request_id") % 2 == 0, F.col("username")).otherwise(F.col("email")).alias("login")
    )
    return flt.by_username_or_email(logins, load("users_v")).select("request_id", "index", "username")


PROBLEMS = """
problems AS (SELECT r.*, CASE WHEN first_name = '' THEN 'All fields are required'
    WHEN lower(username) IN (SELECT lower(username) FROM users_v) THEN 'Username already exists'
    WHEN lower(email) IN (SELECT lower(email) FROM users_v) THEN 'Email already exists' END AS problem
  FROM registrations_v r)"""


@query(with_views(f""", {PROBLEMS}
SELECT request_id, username, email, problem FROM problems""", "registrations_v", "users_v"))
def registration_check(spark, sf_dir):
    load = loader(spark, sf_dir)
    return us.registration_problems(load("registrations_v"), load("users_v")).select(
        "request_id", "username", "email", "problem"
    )


@query(with_views(f""", {PROBLEMS},
ranked AS (SELECT *, CASE WHEN problem IS NULL THEN row_number() OVER (
             PARTITION BY problem, lower(username) ORDER BY request_id) END AS turn FROM problems),
numbered AS (SELECT request_id, lower(username) AS held_name, row_number() OVER (ORDER BY request_id) + (SELECT max(index) FROM users_v) AS new_index
             FROM ranked WHERE turn = 1)
SELECT k.request_id, n.new_index, CASE WHEN n.new_index IS NOT NULL THEN NULL
    WHEN problem = 'All fields are required' THEN problem
    WHEN problem = 'Username already exists' OR h.request_id < k.request_id THEN 'Username already exists'
    ELSE 'Email already exists' END AS problem
FROM ranked k LEFT JOIN numbered n ON k.request_id = n.request_id
LEFT JOIN numbered h ON h.held_name = lower(k.username)""", "registrations_v", "users_v"))
def register_users(spark, sf_dir):
    load = loader(spark, sf_dir)
    return us.register(load("registrations_v"), load("users_v")).select("request_id", "new_index", "problem")


@query(with_views(f""", {PROBLEMS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(username) ORDER BY request_id) AS turn
           FROM problems WHERE problem IS NULL)
SELECT index, first_name, username, email, 'unset' AS password FROM users_v
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY request_id) + (SELECT max(index) FROM users_v) AS INT), first_name, username, email,
       sha256(password) FROM ranked WHERE turn = 1""", "registrations_v", "users_v"))
def registered_users(spark, sf_dir):
    """The user table after the accepted registrations were appended, read back."""
    load = loader(spark, sf_dir)
    path = f"{shared_folder(spark)}/users-{uuid.uuid4().hex}"
    users = load("users_v").withColumn("password", F.lit("unset")).select(*[f.name for f in USERS])
    tb.create_if_absent(spark, path, USERS)
    tb.append(users, path)
    registered = us.register(load("registrations_v"), tb.read_table(spark, path, USERS))
    tb.append(us.new_users(registered), path)
    return tb.read_table(spark, path, USERS).select("index", "first_name", "username", "email", "password")


PROFILE_CHANGES = """
SELECT lower(username) AS key, arg_max(first_name, request_id) AS first_name,
       arg_max(email, request_id) AS email FROM registrations_v GROUP BY 1"""


@query(with_views(f"""
SELECT u.index, u.username, coalesce(n.first_name, u.first_name) AS first_name, coalesce(n.email, u.email) AS email
FROM users_v u LEFT JOIN ({PROFILE_CHANGES}) n ON n.key = lower(u.username)""", "registrations_v", "users_v"))
def profile_updates(spark, sf_dir):
    load = loader(spark, sf_dir)
    changes = load("registrations_v").select("request_id", "username", "first_name", "last_name", "email")
    return us.update_profiles(load("users_v"), changes, "request_id").select("index", "username", "first_name", "email")


@query(with_views("""
SELECT u.index, coalesce(n.hash, 'unset') AS password FROM users_v u LEFT JOIN (
  SELECT lower(email) AS key, sha256(arg_max(password, request_id)) AS hash FROM registrations_v GROUP BY 1) n
ON n.key = lower(u.email)""", "registrations_v", "users_v"))
def password_resets(spark, sf_dir):
    load = loader(spark, sf_dir)
    users = load("users_v").withColumn("password", F.lit("unset"))
    resets = load("registrations_v").select("request_id", "email", "password")
    return us.reset_passwords(users, resets, "request_id").select("index", "password")


@query(with_views("SELECT index, sha256(username) AS pseudonym FROM users_v", "users_v"))
def pseudonym(spark, sf_dir):
    return view(spark, sf_dir, "users_v").select("index", ac.pseudonym("username").alias("pseudonym"))


@query(with_views(f"""
SELECT login_id, ip, {PRIVATE} AS private FROM (SELECT login_id, {IP} AS ip FROM logins_v)""", "logins_v"))
def client_ip(spark, sf_dir):
    rows = lg.with_address(view(spark, sf_dir, "logins_v"))
    return rows.select("login_id", F.col("ip_address").alias("ip"), ac.is_private("ip_address").alias("private"))


@query(with_views(f"""
SELECT login_id, user_id, ip AS ip_address,
  CASE WHEN {PRIVATE} THEN 'Localhost' ELSE coalesce(country, 'Unknown') END AS country,
  CASE WHEN {PRIVATE} THEN 'Unknown' ELSE coalesce(region, 'Unknown') END AS region,
  CASE WHEN {PRIVATE} THEN 'Local Machine' ELSE coalesce(city, 'Unknown') END AS city,
  CASE WHEN {PRIVATE} THEN 0e0 ELSE coalesce(p.latitude, 0e0) END AS latitude,
  CASE WHEN {PRIVATE} THEN 'Unknown' ELSE coalesce(isp, 'Unknown') END AS isp,
  CASE WHEN {PRIVATE} THEN 'Unknown' ELSE coalesce(timezone, 'Unknown') END AS timezone
FROM (SELECT login_id, user_id, {IP} AS ip FROM logins_v) l LEFT JOIN address_places_v p ON p.ip_address = l.ip""",
                  "logins_v", "address_places_v"))
def login_places(spark, sf_dir):
    load = loader(spark, sf_dir)
    logins = lg.with_address(load("logins_v")).select("login_id", "user_id", "ip_address")
    return lg.place_by_address(logins, load("address_places_v")).drop("longitude")


@query(with_views("""
SELECT login_id, coalesce(country, 'Unknown') AS country, coalesce(state, region, 'Unknown') AS region,
  CASE WHEN l.latitude IS NULL THEN 'GPS Denied or Unavailable' ELSE coalesce(city, town, village, 'Unknown') END AS city,
  coalesce(l.latitude, 0e0) AS latitude, coalesce(l.longitude, 0e0) AS longitude,
  CASE WHEN l.latitude IS NULL THEN 'No GPS Data' WHEN coalesce(accuracy, 0) = 0 THEN 'GPS Location'
       ELSE concat('GPS Location (±', CAST(trunc(accuracy) AS BIGINT), 'm)') END AS isp
FROM logins_v l LEFT JOIN gps_places_v p ON p.latitude = l.latitude AND p.longitude = l.longitude""",
                  "logins_v", "gps_places_v"))
def login_gps_places(spark, sf_dir):
    load = loader(spark, sf_dir)
    logins = load("logins_v").select("login_id", "latitude", "longitude", "accuracy")
    return lg.place_by_gps(logins, load("gps_places_v")).drop("accuracy", "timezone")


NUMBER = "list_reduce(list_transform(string_split({a}, '.'), lambda x: x::BIGINT), lambda s, x: s * 256 + x)"


@query(with_views(f""",
blocks AS (SELECT *, {NUMBER.format(a="string_split(network, '/')[1]")} AS low, string_split(network, '/')[2]::INT AS bits FROM address_blocks_v),
addresses AS (SELECT DISTINCT ip, {NUMBER.format(a="ip")} AS n FROM (SELECT {IP} AS ip FROM logins_v) WHERE regexp_matches(ip, '^[0-9.]+$')),
best AS (SELECT ip, arg_max(b, bits) AS b FROM addresses JOIN blocks b ON n // (1::BIGINT << (32 - bits)) = low // (1::BIGINT << (32 - bits)) GROUP BY ip)
SELECT login_id, user_id, l.ip AS ip_address,
  CASE WHEN {PRIVATE.replace('ip ', 'l.ip ').replace('(ip,', '(l.ip,')} THEN 'Localhost' ELSE coalesce(b.country, 'Unknown') END AS country,
  CASE WHEN {PRIVATE.replace('ip ', 'l.ip ').replace('(ip,', '(l.ip,')} THEN 'Unknown' ELSE coalesce(b.region, 'Unknown') END AS region,
  CASE WHEN {PRIVATE.replace('ip ', 'l.ip ').replace('(ip,', '(l.ip,')} THEN 'Local Machine' ELSE coalesce(b.city, 'Unknown') END AS city,
  CASE WHEN {PRIVATE.replace('ip ', 'l.ip ').replace('(ip,', '(l.ip,')} THEN 0e0 ELSE coalesce(b.latitude, 0e0) END AS latitude,
  CASE WHEN {PRIVATE.replace('ip ', 'l.ip ').replace('(ip,', '(l.ip,')} THEN 'Unknown' ELSE coalesce(b.isp, 'Unknown') END AS isp
FROM (SELECT login_id, user_id, {IP} AS ip FROM logins_v) l LEFT JOIN best ON best.ip = l.ip""",
                  "logins_v", "address_blocks_v"))
def login_ranges(spark, sf_dir):
    load = loader(spark, sf_dir)
    logins = lg.with_address(load("logins_v")).select("login_id", "user_id", "ip_address")
    return pl.place_by_range(logins, load("address_blocks_v")).drop("longitude", "timezone")


# coordinates off the places' grid, so that no two places are equally near
@query(with_views("""
, moved AS (SELECT login_id, latitude + login_id % 101 * 371e-5 AS a, longitude + login_id % 89 * 1413e-5 AS b, accuracy FROM logins_v),
spots AS (SELECT *, radians(latitude) AS p, radians(longitude) AS q FROM gps_places_v),
asked AS (SELECT DISTINCT a, b, radians(a) AS p, radians(b) AS q FROM moved WHERE a IS NOT NULL),
best AS (
  SELECT a, b, arg_min(s, pow(sin((asked.p - s.p) / 2), 2) + cos(asked.p) * cos(s.p) * pow(sin((asked.q - s.q) / 2), 2)) AS s
  FROM asked CROSS JOIN spots s GROUP BY a, b)
SELECT login_id, coalesce(s.country, 'Unknown') AS country, coalesce(s.state, s.region, 'Unknown') AS region,
  CASE WHEN m.a IS NULL THEN 'GPS Denied or Unavailable' ELSE coalesce(s.city, s.town, s.village, 'Unknown') END AS city
FROM moved m LEFT JOIN best ON m.a = best.a AND m.b = best.b""", "logins_v", "gps_places_v"))
def login_nearest_places(spark, sf_dir):
    load = loader(spark, sf_dir)
    logins = load("logins_v").select(
        "login_id", (F.col("latitude") + F.col("login_id") % 101 * F.lit(371e-5)).alias("latitude"),
        (F.col("longitude") + F.col("login_id") % 89 * F.lit(1413e-5)).alias("longitude"), "accuracy")
    return pl.nearest_place(logins, load("gps_places_v")).select("login_id", "country", "region", "city")


@query(with_views("SELECT login_id, user_id FROM logins_v ORDER BY timestamp DESC, login_id DESC LIMIT 100", "logins_v"))
def latest_logins(spark, sf_dir):
    return lg.latest_logins(view(spark, sf_dir, "logins_v")).select("login_id", "user_id")


@query(with_views("""
SELECT login_id, user_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY timestamp DESC, login_id DESC) AS rank FROM logins_v) WHERE rank <= 10""", "logins_v"))
def latest_logins_per_user(spark, sf_dir):
    return lg.latest_logins_per_user(view(spark, sf_dir, "logins_v"), 10).select("login_id", "user_id", "rank")
