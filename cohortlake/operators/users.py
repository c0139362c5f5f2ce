"""The user table: next ids, clashes, registration and case-insensitive merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlake.functions.access import pseudonym
from cohortlake.operators.ordered import number_all_rows
from cohortlake.operators.portfolio import scalar
from cohortlake.session import checkpointed

INCOMPLETE = "All fields are required"
NAME_TAKEN = "Username already exists"
MAIL_TAKEN = "Email already exists"
REQUIRED = ["first_name", "last_name", "username", "email", "password"]


def highest_index(users: DataFrame) -> DataFrame:
    """Highest numeric user index; other texts are ignored, an empty table gives 0."""
    digits = F.when(F.col("index").cast("string").rlike("^[0-9]+$"), F.col("index").cast("string"))
    return users.agg(F.coalesce(F.max(digits.try_cast("bigint")), F.lit(0)).alias("highest"))


def registration_problems(registrations: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``problem``: missing field, username or email already stored, else null."""
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.coalesce(F.col(name) == "", F.lit(True))
    names = users.select(F.lower("username").alias("_name")).distinct()
    mails = users.select(F.lower("email").alias("_mail")).distinct()
    taken_name, taken_mail = names.withColumn("_has_name", F.lit(True)), mails.withColumn("_has_mail", F.lit(True))
    return (
        registrations.join(taken_name, F.lower("username") == F.col("_name"), "left")
        .join(taken_mail, F.lower("email") == F.col("_mail"), "left")
        .select(
            *registrations.columns,
            F.when(missing, INCOMPLETE)
            .when(F.col("_has_name"), NAME_TAKEN)
            .when(F.col("_has_mail"), MAIL_TAKEN)
            .alias("problem"),
        )
    )


#: Requests that one task settles one after the other; larger groups take further rounds.
COMPONENT_ROWS = 20_000


def first_ones(open_rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Requests that are the first left for both of their keys, and what stays open once they hold these keys."""
    # joined on the request id, which no two rows share
    first_of_name = open_rows.groupBy("_name").agg(F.min(order).alias(order)).select(order)
    first_of_mail = open_rows.groupBy("_mail").agg(F.min(order).alias(order)).select(order)
    winners = checkpointed(open_rows.join(first_of_name, order, "left_semi").join(first_of_mail, order, "left_semi"))
    left = open_rows.join(winners.select("_name"), "_name", "left_anti").join(winners.select("_mail"), "_mail", "left_anti")
    return winners, checkpointed(left)


def components(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``_label``: the first request that is reached by shared names and e-mails.

    In each round a request takes the least label of its name and its e-mail,
    hands it to the request its own label names, and then jumps to its label's
    label; so labels run along a chain in a number of rounds that grows with
    the logarithm of its length.
    """
    at = checkpointed(rows.select(order, "_name", "_mail", F.col(order).alias("_label")))
    while True:
        near = at
        for key in ("_name", "_mail"):
            least = at.groupBy(F.col(key).alias("_k")).agg(F.min("_label").alias(f"_of{key}"))
            near = near.join(least, F.col(key) == F.col("_k")).drop("_k")
        near = near.withColumn("_near", F.least("_of_name", "_of_mail"))
        handed = near.select(F.inline(F.array(
            F.struct(F.col(order).alias("_to"), F.col("_near")), F.struct(F.col("_label").alias("_to"), F.col("_near")),
        ))).groupBy("_to").agg(F.min("_near").alias("_near"))
        hooked = checkpointed(at.join(handed, F.col(order) == F.col("_to")).select(
            order, "_name", "_mail", F.col("_label").alias("_old"), F.least("_label", "_near").alias("_label")))
        ahead = hooked.select(F.col(order).alias("_of"), F.col("_label").alias("_next"))
        jumped = checkpointed(hooked.join(ahead, F.col("_label") == F.col("_of")).select(
            order, "_name", "_mail", F.col("_next").alias("_label"), (F.col("_next") < F.col("_old")).alias("_moved")))
        at = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return at


def settled(labelled: DataFrame, order: str) -> DataFrame:
    """Accepted requests of components that a task can hold: a fold over each in order."""
    requests = F.array_sort(F.collect_list(F.struct(F.col(order).alias("id"), F.col("_name").alias("name"), F.col("_mail").alias("mail"))))
    kind = labelled.schema[order].dataType.simpleString()
    strings = F.array().cast("array<string>")
    start = F.struct(strings.alias("names"), strings.alias("mails"), F.array().cast(f"array<{kind}>").alias("ids"))

    def take(held, x):
        clash = F.array_contains(held["names"], x["name"]) | F.array_contains(held["mails"], x["mail"])
        more = F.struct(
            F.concat(held["names"], F.array(x["name"])).alias("names"), F.concat(held["mails"], F.array(x["mail"])).alias("mails"),
            F.concat(held["ids"], F.array(x["id"])).alias("ids"),
        )
        return F.when(clash, held).otherwise(more)

    groups = labelled.groupBy("_label").agg(requests.alias("_requests"))
    accepted = groups.select(F.explode(F.aggregate("_requests", start, take)["ids"]).alias("_accepted"))
    return labelled.join(accepted, F.col(order) == F.col("_accepted")).select(order, "_name", "_mail")


def accepted_requests(open_rows: DataFrame, order: str, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Requests ``(order, _name, _mail)`` that no accepted earlier one keeps out.

    A first round settles keys of any number of requests. What is left falls
    into groups of requests that share keys; groups up to ``component_rows``
    are settled at once, one after the other inside a task, however long the
    chains in them are. Larger ones take another round and are labelled again.
    """
    accepted, left = first_ones(open_rows, order)
    while not left.isEmpty():
        labelled = components(left, order)
        sizes = labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
        small = sizes.where(F.col("_n") <= component_rows).select("_label")
        accepted = accepted.unionByName(checkpointed(settled(labelled.join(small, "_label", "left_semi"), order)))
        large = checkpointed(labelled.join(small, "_label", "left_anti").drop("_label"))
        if large.isEmpty():
            break
        winners, left = first_ones(large, order)
        accepted = accepted.unionByName(winners)
    return accepted


def register(registrations: DataFrame, users: DataFrame, order: str = "request_id",
             component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Outcome of every registration, taken in ``order``: new index or problem.

    A registration also fails when an accepted earlier one of the batch holds
    its user name or e-mail (see :func:`accepted_requests`).
    """
    checked = checkpointed(
        registrations.transform(registration_problems, users)
        .withColumns({"_name": F.lower("username"), "_mail": F.lower("email")})
    )
    open_rows = checked.where(F.col("problem").isNull()).select(order, "_name", "_mail")
    accepted = accepted_requests(open_rows, order, component_rows)
    numbered = number_all_rows(accepted, [F.asc(order)], "_number")
    start = scalar(highest_index(users))["highest"]
    given = numbered.select(order, (F.col("_number") + start).alias("new_index"))
    taken = accepted.select(F.col("_name"), F.col(order).alias("_taken_by"))
    held = (F.col("problem") == NAME_TAKEN) | (F.col("_taken_by") < F.col(order))
    reason = (
        F.when(F.col("new_index").isNotNull(), F.lit(None))
        .when(F.col("problem") == INCOMPLETE, INCOMPLETE)
        .when(held, NAME_TAKEN)
        .otherwise(MAIL_TAKEN)
    )
    return (
        checked.join(given, order, "left")
        .join(taken, "_name", "left")
        .withColumn("problem", reason)
        .select(*registrations.columns, "problem", "new_index")
    )


def new_users(registered: DataFrame) -> DataFrame:
    """Rows to append to the user table, passwords hashed."""
    return registered.where(F.col("new_index").isNotNull()).select(
        F.col("new_index").cast("int").alias("index"), "first_name", "last_name", "username", "email",
        pseudonym("password").alias("password"),
    )


def merge_ignoring_case(users: DataFrame, changes: DataFrame, key: str, columns: list[str],
                        order: str) -> DataFrame:
    """Users after changes of ``columns`` matched on ``lower(key)``; the last change counts.

    All users with the key change, as keys that differ only in case are one.
    """
    latest = changes.groupBy(F.lower(key).alias("_key")).agg(
        F.max_by(F.struct(*columns), order).alias("_new")
    )
    joined = users.withColumn("_key", F.lower(key)).join(latest, "_key", "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in columns else F.col(c)
            for c in users.columns
        ]
    )


def update_profiles(users: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Set names and e-mail of the users with a user name."""
    return merge_ignoring_case(users, changes, "username", ["first_name", "last_name", "email"], order)


def reset_passwords(users: DataFrame, resets: DataFrame, order: str) -> DataFrame:
    """Set the hash of a new password for the users with an e-mail."""
    hashed = resets.withColumn("password", pseudonym("password"))
    return merge_ignoring_case(users, hashed, "email", ["password"], order)
