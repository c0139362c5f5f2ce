"""Chat-log processing: mentions, carried context, update requests and their outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortlake.functions import text as tx
from cohortlake.operators.changes import as_type, change_problem, changeable
from cohortlake.operators.ordered import (
    HotKeys, OrderedRows, find_hot_keys, first_per_group, first_value, last_value,
)

ORDER = ["timestamp", "chat_id"]


def classify(messages: DataFrame) -> DataFrame:
    """Language, confirmation word, update intent and translation intent per message."""
    return messages.withColumns(
        {
            "detected_language": tx.message_language("message"),
            "word": tx.confirmation("message"),
            "intent": tx.update_intent("message"),
            "asks_translation": tx.asks_translation("message"),
            "translation_target": tx.translation_target("message"),
        }
    ).select(
        *messages.columns, "detected_language", "word", F.col("intent.named_id").alias("named_id"),
        F.col("intent.field").alias("field"), F.col("intent.new_value").alias("new_value"),
        "asks_translation", "translation_target",
    )


def find_ids(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Per message with any hit: ``mention`` and ``named_owner``.

    ``mention`` is the first of the sender's own simulations, by creation, that
    the text names as a whole token; ``named_owner`` owns the id after words
    like "simulation". Ids are looked up by equality on tokens taken out of
    the text, so no message is compared with every id, and only messages with
    a token leave the scan.
    """
    named = messages.select("chat_id", "user_id", "message", tx.named_simulation("message").alias("named_id"))
    tokens = F.array_distinct(F.array_compact(F.concat(tx.id_tokens("message"), F.array(F.lower("named_id")))))
    candidates = named.select("chat_id", "user_id", "named_id", F.explode(tokens).alias("_token"))
    owned = results.select(
        F.lower("simulation_id").alias("_token"), "simulation_id", F.col("user_id").alias("_owner"), "created_at"
    )
    own = (F.col("_owner") == F.col("user_id")) & F.col("_token").contains("_")
    first = F.when(own, F.struct("created_at", "simulation_id"))
    return candidates.join(owned, "_token").groupBy("chat_id").agg(
        F.min_by("simulation_id", first).alias("mention"),
        F.max(F.when(F.col("simulation_id") == F.col("named_id"), F.col("_owner"))).alias("named_owner"),
    )


def mentions(messages: DataFrame, results: DataFrame) -> DataFrame:
    """(chat_id, mention) for messages that name one of the sender's simulations."""
    return find_ids(messages, results).where(F.col("mention").isNotNull()).select("chat_id", "mention")


def only_simulation(results: DataFrame) -> DataFrame:
    """Users who own exactly one simulation, with its id."""
    owners = results.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("simulation_id").alias("only_id")
    )
    return owners.where(F.col("_n") == 1).select("user_id", "only_id")


def message_features(messages: DataFrame, results: DataFrame) -> DataFrame:
    """Per message what moves its session: language, words, request, the ids it names. The text stays behind."""
    if "forced_language" not in messages.columns:
        messages = messages.withColumn("forced_language", F.lit(None).cast("string"))
    found = classify(messages).drop("message").join(find_ids(messages, results), "chat_id", "left")
    # joined before large users are cut: a later join on the user alone would
    # bring their ranges back together
    return found.join(only_simulation(results), "user_id", "left")


def session_scan(rows: OrderedRows) -> OrderedRows:
    """Adds the session's language and the carried simulation id.

    The language is the first message's, until a forced language replaces it.
    """
    rows = rows.scan(
        current_id=last_value(F.col("mention")),
        _first_language=first_value(F.col("detected_language")),
        _forced=last_value(F.col("forced_language")),
    )
    language = F.coalesce("_forced", "_first_language")
    return rows.map(lambda df: df.withColumn("language", language).drop("_first_language", "_forced"))


def session_rows(messages: DataFrame, results: DataFrame, hot: HotKeys | None = None) -> OrderedRows:
    """Messages with the session's language, the carried and the only simulation id."""
    hot = hot or find_hot_keys(messages, ["user_id"])
    return session_scan(OrderedRows.of(message_features(messages, results), ["user_id"], ORDER, hot))


#: What a session remembers of its update request.
REQUEST = ("struct<state:string,request_id:bigint,target_id:string,field:string,new_value:string,problem:string,"
           "opened_at:timestamp>")


def request_steps(rows: OrderedRows, kinds: dict[str, T.DataType], pending_seconds: float | None = None,
                  carried: bool = False) -> OrderedRows:
    """Adds each message's action and the request it resolves to rows of :func:`session_scan`.

    A confirm or cancel word acts on the sender's open update request. A
    request opens when its simulation is known and owned by the sender, and
    replaces an older open one. A cancel closes it; a confirm executes and
    closes it unless the change itself cannot be applied, in which case it
    stays open. With ``pending_seconds`` a request is open for so long only.

    ``_event`` and ``_closing`` hold what a message asks for and what it leaves
    open or closed. With ``carried``, rows may bring both from an earlier part
    of the session as ``_carried_event`` and ``_carried_closing``.
    """
    rows = rows.map(lambda df: _with_target(df, kinds))
    opened = F.when(
        F.col("request_state") == "open",
        F.struct(F.lit("open").alias("state"), F.col("chat_id").cast("long").alias("request_id"), F.col("target_id"),
                 F.col("field"), F.col("new_value"), F.col("problem"), F.col("timestamp").cast("timestamp").alias("opened_at")),
    ).cast(REQUEST)
    closed = F.struct(F.lit("closed").alias("state"), *[F.lit(None)] * 6).cast(REQUEST)
    before = lambda name: [F.col(name)] if carried else []
    # last request or cancel before the row, confirms left aside: it tells
    # whether a confirm here can end anything
    asked = F.coalesce(*before("_carried_event"), opened, F.when(F.col("word") == "cancel", closed))
    rows = rows.map(lambda df: df.withColumn("_event", asked)).scan(_asked=last_value(F.col("_event"), with_current=False))

    def still(request: str) -> Column:
        is_open = F.col(f"{request}.state") == "open"
        if pending_seconds is None:
            return is_open
        age = F.col("timestamp").cast("timestamp").cast("double") - F.col(f"{request}.opened_at").cast("double")
        return is_open & (age <= F.lit(float(pending_seconds)))

    ends = (F.col("word") == "confirm") & still("_asked") & F.col("_asked.problem").isNull()
    closing = F.coalesce(*before("_carried_closing"), F.col("_event"), F.when(ends, closed))
    rows = rows.map(lambda df: df.withColumn("_closing", closing)).scan(
        _pending=last_value(F.col("_closing"), with_current=False))

    pending = still("_pending")
    action = (
        F.when(pending & (F.col("word") == "cancel"), "cancelled")
        .when(pending & (F.col("word") == "confirm"),
              F.when(F.col("_pending.problem").isNull(), "update_executed").otherwise("error"))
        .when(F.col("request_state") == "open", "update_request")
        .when(F.col("request_state") == "no target", "clarification")
        .when(F.col("request_state") == "refused", "error")
        .when(F.col("asks_translation"),
              F.when(F.col("translation_target").isNull(), "clarification").otherwise("translation"))
        .otherwise("chat")
    )
    acts = pending & F.col("word").isNotNull()
    resolved = lambda name: F.when(acts, F.col(f"_pending.{name}"))
    translated = F.when(F.col("action_type") == "translation", F.col("translation_target"))
    return rows.map(
        lambda df: df.withColumns(
            {
                "action_type": action,
                "resolves": resolved("request_id"),
                "_shown_id": F.coalesce(resolved("target_id"), "target_id", "current_id"),
                "_shown_field": F.coalesce(resolved("field"), "field"),
                "_shown_value": F.coalesce(resolved("new_value"), "new_value"),
            }
        ).withColumn("reply_language", F.coalesce(translated, "language"))
    )


OUTCOME = ["chat_id", "user_id", "timestamp", "language", "reply_language", "action_type", "simulation_id", "field",
           "new_value", "resolves"]


def outcome_columns() -> list[Column]:
    """The outcome of a message, in the columns of :func:`route`, from rows of :func:`request_steps`."""
    shown = {"simulation_id": "_shown_id", "field": "_shown_field", "new_value": "_shown_value"}
    return [F.col(shown.get(c, c)).alias(c) for c in OUTCOME]


def route(messages: DataFrame, results: DataFrame, hot: HotKeys | None = None,
          pending_seconds: float | None = None) -> DataFrame:
    """What happens to each message: its action, and the request it resolves (see :func:`request_steps`).

    All steps use one order per user. Texts do not travel with the sessions;
    who needs them joins the messages by ``chat_id``.
    """
    kinds = changeable(results.schema, "simulation_id")
    return request_steps(session_rows(messages, results, hot), kinds, pending_seconds).rows().select(*outcome_columns())


def _with_target(df: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """Target simulation of an update request and whether the request may open."""
    asks = F.col("field").isNotNull()
    named = F.when(F.col("named_owner").isNotNull(), F.col("named_id"))  # named_id is null in short forms
    target = F.when(asks, F.coalesce(named, "current_id", "only_id"))
    # a carried or only simulation is the sender's own
    allowed = F.when(named.isNotNull(), F.col("named_owner") == F.col("user_id")).otherwise(F.lit(True))
    state = F.when(asks, F.when(target.isNull(), "no target").when(allowed, "open").otherwise("refused"))
    return df.withColumns(
        {
            "target_id": target,
            "request_state": state,
            "problem": F.when(asks, change_problem(F.col("field"), F.col("new_value"), kinds)),
        }
    )


def executed_changes(routed: DataFrame) -> DataFrame:
    """Confirmed updates as rows for the change job."""
    return routed.where(F.col("action_type") == "update_executed").select(
        F.col("chat_id").alias("change_id"), "simulation_id", "field", F.col("new_value").alias("value"),
        F.col("timestamp").alias("changed_at"),
    )


def context_window(exchanges: DataFrame, value: Column, count: int = 5, hot: HotKeys | None = None) -> DataFrame:
    """The user's ``count`` exchanges before each exchange, oldest first."""
    return OrderedRows.of(exchanges, ["user_id"], ORDER, hot).last_values("context", value, count).rows()


def latest_messages(messages: DataFrame, count: int = 50) -> DataFrame:
    """Each user's newest ``count`` messages; ``rank`` 1 is the newest."""
    return first_per_group(messages, ["user_id"], [F.desc("timestamp"), F.desc("chat_id")], count)


def chat_history(messages: DataFrame, user_id: str, limit: int = 50) -> DataFrame:
    """One user's newest messages, oldest first."""
    own = messages.where(F.col("user_id") == F.lit(user_id))
    return own.orderBy(F.desc("timestamp"), F.desc("chat_id")).limit(limit).orderBy(*ORDER)


def with_old_values(outcome: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``old_value``: what a message's field held when the message came.

    That is the value of the last executed update of the same result and field
    before the message, else the stored one, as text. Each (result, field) is
    scanned in time order; one with many messages is cut into ranges like a
    large user.
    """
    kinds = changeable(results.schema, "simulation_id")
    asked = outcome.where(F.col("action_type").isin("update_request", "update_executed"))
    rows = asked.join(
        results.select(F.col("simulation_id").alias("_of"), *[F.col(c).cast("string").alias(f"_old_{c}") for c in kinds]),
        F.col("simulation_id") == F.col("_of"), "left")
    stored = F.coalesce(*[F.when(F.col("field") == c, F.col(f"_old_{c}")) for c in kinds])
    rows = rows.withColumn("_stored", stored).drop("_of", *[f"_old_{c}" for c in kinds])
    keys, order = ["simulation_id", "field"], ["timestamp", "chat_id"]
    ordered = OrderedRows.of(rows, keys, order, find_hot_keys(rows, keys))
    typed = F.coalesce(*[F.when(F.col("field") == c, as_type(F.col("new_value"), kind).cast("string")) for c, kind in kinds.items()])
    done = F.when(F.col("action_type") == "update_executed", typed)
    changed = ordered.scan(_changed=last_value(done, with_current=False)).rows()
    return changed.withColumn("old_value", F.coalesce("_changed", "_stored")).drop("_changed", "_stored")
