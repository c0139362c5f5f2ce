"""Chat log: language, intents, mentions, carried context, routing and updates."""

from pyspark.sql import functions as F

from cohortlake import fixed_values as V
from cohortlake.functions import text as tx
from cohortlake.operators import changes as chg, chat
from cohortlake.plans.registry import query
from cohortlake.sources.adapters import loader, table, view, with_views


def _group(pattern: str, of: str = "lower(message)", group: int = 1) -> str:
    return f"nullif(regexp_extract({of}, '{pattern}', {group}), '')"


def _words(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + ")"


def _listed(words: dict[str, list[str]]) -> str:
    return ", ".join(f"'{w}'" for ws in words.values() for w in ws)


SHORT = "coalesce(" + ", ".join(_group(p) for p in V.SHORT_UPDATE_PATTERNS) + ")"
ANY = [("(?i)" + p) for p in V.ANY_FIELD_PATTERNS]
FIELD = ("coalesce(" + ", ".join(f"CASE WHEN {_group(p)} IS NOT NULL THEN '{f}' END" for p, f in V.NAMED_FIELD_PATTERNS)
         + ", " + ", ".join(_group(p, "message") for p in ANY) + ")")
VALUE = ("coalesce(" + ", ".join(_group(p) for p, _ in V.NAMED_FIELD_PATTERNS)
         + ", " + ", ".join(_group(p, "message", 2) for p in ANY) + ")")
GATE = f"{_words(V.UPDATE_WORDS)} AND {FIELD} IS NOT NULL"
TARGET_LANGUAGE = "CASE " + " ".join(
    f"WHEN contains(lower(message), '{name}') THEN '{code}'" for name, code in V.LANGUAGE_NAMES) + " END"
SCRIPT = (f"CASE WHEN regexp_matches({{c}}, '{V.HINDI_SCRIPT}') THEN 'hi' "
          f"WHEN regexp_matches({{c}}, '{V.BENGALI_SCRIPT}') THEN 'bn' ELSE 'en' END")
CLASSIFIED = f"""
classified AS (
  SELECT *, {SCRIPT.format(c='message')} AS detected_language,
    CASE WHEN trim(lower(message)) IN ({_listed(V.CONFIRM_WORDS)}) THEN 'confirm'
         WHEN trim(lower(message)) IN ({_listed(V.CANCEL_WORDS)}) THEN 'cancel' END AS word,
    CASE WHEN {SHORT} IS NOT NULL THEN NULL WHEN {GATE} THEN {_group(V.ID_PATTERN, 'message')} END AS named_id,
    CASE WHEN {SHORT} IS NOT NULL THEN '{V.SHORT_UPDATE_FIELD}' WHEN {GATE} THEN {FIELD} END AS field,
    CASE WHEN {SHORT} IS NOT NULL THEN {SHORT} WHEN {GATE} THEN {VALUE} END AS new_value,
    {_words(V.TRANSLATE_WORDS)} AS asks_translation, {TARGET_LANGUAGE} AS translation_target
  FROM chat_v)"""
FOUND = """
tokens AS (
  SELECT DISTINCT chat_id, user_id, named_id, unnest(list_concat(
    list_filter(regexp_extract_all(lower(message), '[a-z0-9_]+'), lambda x: contains(x, '_')),
    CASE WHEN named_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [lower(named_id)] END)) AS token FROM classified),
found AS (
  SELECT t.chat_id,
         first(r.simulation_id ORDER BY r.created_at, r.simulation_id)
           FILTER (r.user_id = t.user_id AND contains(t.token, '_')) AS mention,
         max(CASE WHEN r.simulation_id = t.named_id THEN r.user_id END) AS named_owner
  FROM tokens t JOIN results_v r ON lower(r.simulation_id) = t.token GROUP BY t.chat_id)"""
SESSION = """
session_rows AS (
  SELECT c.*, f.mention, f.named_owner,
    last_value(f.mention IGNORE NULLS) OVER upto AS current_id,
    coalesce(last_value(c.forced_language IGNORE NULLS) OVER upto, first_value(c.detected_language) OVER upto) AS language
  FROM classified c LEFT JOIN found f ON c.chat_id = f.chat_id
  WINDOW upto AS (PARTITION BY c.user_id ORDER BY c.timestamp, c.chat_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PROBLEM = f"""CASE
  WHEN field IN ('patients_enrolled', 'patients_completed', 'actual_duration_days')
    THEN CASE WHEN regexp_matches({{v}}, '^[+-]?[0-9]+$') AND TRY_CAST({{v}} AS INT) IS NOT NULL THEN NULL ELSE 'bad value' END
  WHEN field IN ('dropout_rate', 'estimated_cost', 'success_probability')
    THEN CASE WHEN regexp_matches({{v}}, '{NUMBER}') THEN NULL ELSE 'bad value' END
  WHEN field IN ('trial_id', 'user_id', 'confidence_interval')
    THEN CASE WHEN {{v}} IS NOT NULL THEN NULL ELSE 'bad value' END
  WHEN field = 'created_at' THEN CASE WHEN TRY_CAST({{v}} AS TIMESTAMP) IS NOT NULL THEN NULL ELSE 'bad value' END
  ELSE 'unknown field' END"""
ROUTED = f"""
only_one AS (SELECT user_id, min(simulation_id) AS only_id FROM results_v GROUP BY user_id HAVING count(*) = 1),
targeted AS (
  SELECT s.*, CASE WHEN field IS NOT NULL
      THEN coalesce(CASE WHEN named_owner IS NOT NULL THEN named_id END, current_id, only_id) END AS target_id,
    CASE WHEN field IS NOT NULL THEN {PROBLEM.format(v='new_value')} END AS problem
  FROM session_rows s LEFT JOIN only_one o ON s.user_id = o.user_id),
stated AS (
  SELECT *, CASE WHEN field IS NULL THEN NULL WHEN target_id IS NULL THEN 'no target'
                 WHEN named_owner IS NULL OR named_owner = user_id THEN 'open' ELSE 'refused' END AS request_state
  FROM targeted),
asked AS (
  SELECT *, last_value(CASE WHEN request_state = 'open' THEN chat_id WHEN word = 'cancel' THEN -1 END IGNORE NULLS)
              OVER (PARTITION BY user_id ORDER BY timestamp, chat_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked_id
  FROM stated),
events_of AS (
  SELECT a.*, CASE WHEN a.request_state = 'open' THEN a.chat_id WHEN a.word = 'cancel' THEN -1
                   WHEN a.word = 'confirm' AND q.chat_id IS NOT NULL AND q.problem IS NULL THEN -1 END AS event
  FROM asked a LEFT JOIN stated q ON a.asked_id = q.chat_id),
pended AS (
  SELECT *, last_value(event IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY timestamp, chat_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending_id FROM events_of),
routed AS (
  SELECT p.chat_id, p.user_id, p.timestamp, p.message, p.language,
    CASE WHEN q.chat_id IS NOT NULL AND p.word = 'cancel' THEN 'cancelled'
         WHEN q.chat_id IS NOT NULL AND p.word = 'confirm'
           THEN CASE WHEN q.problem IS NULL THEN 'update_executed' ELSE 'error' END
         WHEN p.request_state = 'open' THEN 'update_request' WHEN p.request_state = 'no target' THEN 'clarification'
         WHEN p.request_state = 'refused' THEN 'error'
         WHEN p.asks_translation THEN CASE WHEN p.translation_target IS NULL THEN 'clarification' ELSE 'translation' END
         ELSE 'chat' END AS action_type,
    p.translation_target,
    CASE WHEN p.word IS NOT NULL THEN q.chat_id END AS resolves,
    coalesce(CASE WHEN p.word IS NOT NULL THEN q.target_id END, p.target_id, p.current_id) AS simulation_id,
    coalesce(CASE WHEN p.word IS NOT NULL THEN q.field END, p.field) AS field,
    coalesce(CASE WHEN p.word IS NOT NULL THEN q.new_value END, p.new_value) AS new_value
  FROM pended p LEFT JOIN stated q ON p.pending_id = q.chat_id)"""


def _chat_sql(body: str, *parts: str) -> str:
    return with_views(", " + ",\n".join(parts) + "\n" + body, "chat_v", "results_v")


@query(with_views(f"SELECT chat_id, {SCRIPT.format(c='message')} AS language FROM chat_v", "chat_v"))
def message_language(spark, sf_dir):
    return view(spark, sf_dir, "chat_v").select("chat_id", tx.message_language("message").alias("language"))


@query(f"SELECT conv_id, turn, {SCRIPT.format(c='text')} AS language FROM conversations")
def conversation_language(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.message_language("text").alias("language")
    )


@query(_chat_sql("""
SELECT chat_id, word, named_id, field, new_value, asks_translation, translation_target FROM classified""", CLASSIFIED))
def message_intents(spark, sf_dir):
    return chat.classify(view(spark, sf_dir, "chat_v")).select(
        "chat_id", "word", "named_id", "field", "new_value", "asks_translation", "translation_target"
    )


@query(_chat_sql("SELECT chat_id, mention FROM found WHERE mention IS NOT NULL", CLASSIFIED, FOUND))
def mention(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chat.mentions(load("chat_v"), load("results_v"))


@query(_chat_sql("SELECT chat_id, user_id, current_id, language FROM session_rows", CLASSIFIED, FOUND, SESSION))
def carry_forward(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chat.session_rows(load("chat_v"), load("results_v")).rows().select(
        "chat_id", "user_id", "current_id", "language"
    )


@query(_chat_sql("""
SELECT chat_id, user_id, language, action_type, simulation_id, field, new_value,
       CASE WHEN action_type = 'translation' THEN translation_target ELSE language END AS reply_language
FROM routed""", CLASSIFIED, FOUND, SESSION, ROUTED))
def message_route(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chat.route(load("chat_v"), load("results_v")).select(
        "chat_id", "user_id", "language", "action_type", "simulation_id", "field", "new_value", "reply_language"
    )


@query(_chat_sql("""
SELECT chat_id, user_id, action_type, resolves, simulation_id, field, new_value
FROM routed WHERE resolves IS NOT NULL""", CLASSIFIED, FOUND, SESSION, ROUTED))
def update_resolution(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chat.route(load("chat_v"), load("results_v")).where(F.col("resolves").isNotNull()).select(
        "chat_id", "user_id", "action_type", "resolves", "simulation_id", "field", "new_value"
    )


@query(_chat_sql("""
SELECT action_type, language, count(*) AS messages FROM routed GROUP BY action_type, language""",
                 CLASSIFIED, FOUND, SESSION, ROUTED))
def action_counts(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chat.route(load("chat_v"), load("results_v")).groupBy("action_type", "language").agg(
        F.count(F.lit(1)).alias("messages")
    )


@query(_chat_sql("""
SELECT chat_id, user_id, coalesce(array_to_string(list(message) OVER (
         PARTITION BY user_id ORDER BY timestamp, chat_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ' | '), '') AS context
FROM routed WHERE action_type = 'chat'""", CLASSIFIED, FOUND, SESSION, ROUTED))
def context_window(spark, sf_dir):
    load = loader(spark, sf_dir)
    # chat rows are a part of all messages, so their hot users are among these
    hot = chat.find_hot_keys(load("chat_v"), ["user_id"])
    routed = chat.route(load("chat_v"), load("results_v"), hot).where(F.col("action_type") == "chat")
    exchanges = routed.join(load("chat_v").select("chat_id", "message"), "chat_id")
    return chat.context_window(exchanges, F.col("message"), 5, hot).select(
        "chat_id", "user_id", F.array_join("context", " | ").alias("context")
    )


@query(with_views("""
SELECT user_id, chat_id, message, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, chat_id DESC) AS rank FROM chat_v)
WHERE rank <= 50""", "chat_v"))
def latest_messages(spark, sf_dir):
    return chat.latest_messages(view(spark, sf_dir, "chat_v"), 50).select("user_id", "chat_id", "message", "rank")


@query(with_views("""
SELECT chat_id, message FROM chat_v WHERE user_id = '7' ORDER BY timestamp DESC, chat_id DESC LIMIT 50""", "chat_v"))
def chat_history(spark, sf_dir):
    return chat.chat_history(view(spark, sf_dir, "chat_v"), "7").select("chat_id", "message")


@query(with_views("""
SELECT r.user_id, count(*) AS simulations, CASE WHEN count(*) = 1 THEN min(simulation_id) END AS default_id,
       CASE WHEN count(*) = 1 THEN 'default' ELSE 'clarification' END AS choice
FROM results_v r GROUP BY r.user_id""", "results_v"))
def default_target(spark, sf_dir):
    results = view(spark, sf_dir, "results_v")
    counts = results.groupBy("user_id").agg(F.count(F.lit(1)).alias("simulations"), F.min("simulation_id").alias("_least"))
    only = F.col("simulations") == 1
    return counts.select(
        "user_id", "simulations", F.when(only, F.col("_least")).alias("default_id"),
        F.when(only, "default").otherwise("clarification").alias("choice"),
    )


def _text_sql(templates: dict[str, str], old: str) -> str:
    parts = []
    for lang in ("hi", "bn", "en"):
        text = "'" + templates[lang].replace("'", "''") + "'"
        for name, value in (("id", "r.simulation_id"), ("field", "r.field"), ("old", old), ("new", "r.new_value")):
            text = f"replace({text}, '{{{name}}}', coalesce({value}, 'N/A'))"
        parts.append(text)
    return f"CASE r.language WHEN 'hi' THEN {parts[0]} WHEN 'bn' THEN {parts[1]} ELSE {parts[2]} END"


# the value before the request: of the last executed update of the same field, else the stored one
OLD = """coalesce(r.changed, CASE r.field WHEN 'patients_enrolled' THEN CAST(s.patients_enrolled AS VARCHAR)
 WHEN 'patients_completed' THEN CAST(s.patients_completed AS VARCHAR)
 WHEN 'dropout_rate' THEN CAST(s.dropout_rate AS VARCHAR) WHEN 'estimated_cost' THEN CAST(s.estimated_cost AS VARCHAR)
 WHEN 'success_probability' THEN CAST(s.success_probability AS VARCHAR)
 WHEN 'actual_duration_days' THEN CAST(s.actual_duration_days AS VARCHAR) WHEN 'confidence_interval' THEN s.confidence_interval WHEN 'trial_id' THEN s.trial_id
 WHEN 'user_id' THEN s.user_id END)"""
TYPED = """CASE WHEN field IN ('dropout_rate', 'estimated_cost', 'success_probability') THEN CAST(CAST(new_value AS DOUBLE) AS VARCHAR)
 WHEN field IN ('patients_enrolled', 'patients_completed', 'actual_duration_days') THEN CAST(CAST(new_value AS INT) AS VARCHAR) ELSE new_value END"""


@query(_chat_sql(f"""
SELECT r.chat_id, CASE r.action_type WHEN 'update_request' THEN {_text_sql(V.UPDATE_REQUEST_TEXT, OLD)}
       ELSE {_text_sql(V.UPDATE_DONE_TEXT, OLD)} END AS reply
FROM (SELECT *, last_value(CASE WHEN action_type = 'update_executed' THEN {TYPED} END IGNORE NULLS) OVER (
        PARTITION BY simulation_id, field ORDER BY timestamp, chat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS changed
      FROM routed WHERE action_type IN ('update_request', 'update_executed')) r
LEFT JOIN results_v s ON r.simulation_id = s.simulation_id""", CLASSIFIED, FOUND, SESSION, ROUTED))
def update_replies(spark, sf_dir):
    load = loader(spark, sf_dir)
    results = load("results_v")
    outcome = chat.with_old_values(chat.route(load("chat_v"), results), results)
    args = ("language", "simulation_id", "field", F.col("old_value"), "new_value")
    return outcome.select(
        "chat_id",
        F.when(F.col("action_type") == "update_request", tx.request_text(*args)).otherwise(tx.done_text(*args)).alias("reply"),
    )


CHANGED_COLUMNS = """
  last(CASE WHEN field = 'patients_enrolled' THEN value END ORDER BY changed_at, change_id)
    FILTER (field = 'patients_enrolled') AS n_enrolled,
  last(value ORDER BY changed_at, change_id) FILTER (field = 'dropout_rate') AS n_dropout,
  last(value ORDER BY changed_at, change_id) FILTER (field = 'estimated_cost') AS n_cost,
  last(value ORDER BY changed_at, change_id) FILTER (field = 'trial_id') AS n_trial,
  max(changed_at) AS n_at"""
CHANGED_OUT = """
SELECT r.simulation_id, coalesce(n_trial, r.trial_id) AS trial_id,
       coalesce(CAST(n_enrolled AS INT), r.patients_enrolled) AS patients_enrolled, r.patients_completed,
       coalesce(CAST(n_dropout AS DOUBLE), r.dropout_rate) AS dropout_rate,
       coalesce(CAST(n_cost AS DOUBLE), r.estimated_cost) AS estimated_cost, CAST(n_at AS VARCHAR) AS updated_at
FROM results_v r LEFT JOIN latest n ON r.simulation_id = n.simulation_id"""


def _updated(results, changes):
    stamped = results.withColumn("updated_at", F.lit(None).cast("timestamp"))
    return chg.apply_changes(stamped, changes).select(
        "simulation_id", "trial_id", "patients_enrolled", "patients_completed", "dropout_rate", "estimated_cost",
        F.col("updated_at").cast("string").alias("updated_at"),
    )


@query(with_views(f""",
latest AS (SELECT simulation_id, {CHANGED_COLUMNS}
           FROM changes_v WHERE {PROBLEM.format(v='value')} IS NULL GROUP BY simulation_id)
{CHANGED_OUT}""", "results_v", "changes_v"))
def apply_updates(spark, sf_dir):
    load = loader(spark, sf_dir)
    return _updated(load("results_v"), load("changes_v"))


@query(_chat_sql(f"""{CHANGED_OUT}""", CLASSIFIED, FOUND, SESSION, ROUTED, f"""
latest AS (SELECT simulation_id, {CHANGED_COLUMNS} FROM (
  SELECT chat_id AS change_id, simulation_id, field, new_value AS value, timestamp AS changed_at
  FROM routed WHERE action_type = 'update_executed') GROUP BY simulation_id)"""))
def apply_confirmed_updates(spark, sf_dir):
    load = loader(spark, sf_dir)
    results = load("results_v")
    return _updated(results, chat.executed_changes(chat.route(load("chat_v"), results)))


STATUS = f"""
SELECT c.change_id, c.simulation_id, c.field, CASE WHEN r.simulation_id IS NULL THEN 'not found'
       ELSE coalesce({PROBLEM.format(v='c.value').replace('WHEN field', 'WHEN c.field')}, 'applied') END AS status
FROM changes_v c LEFT JOIN results_v r ON c.simulation_id = r.simulation_id"""


@query(with_views(STATUS, "results_v", "changes_v"))
def change_report(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chg.change_report(load("results_v"), load("changes_v")).select(
        "change_id", "simulation_id", "field", "status"
    )


@query(with_views(f"""
SELECT simulation_id, string_agg(DISTINCT field, ',' ORDER BY field) AS updated_fields
FROM ({STATUS}) WHERE status = 'applied' GROUP BY simulation_id""", "results_v", "changes_v"))
def applied_fields(spark, sf_dir):
    load = loader(spark, sf_dir)
    report = chg.change_report(load("results_v"), load("changes_v"))
    return chg.updated_fields(report).select("simulation_id", F.array_join("updated_fields", ",").alias("updated_fields"))


@query(with_views("""
SELECT simulation_id, user_id, patients_enrolled FROM results_v
WHERE simulation_id NOT IN (SELECT simulation_id FROM claims_v)""", "results_v", "claims_v"))
def delete_keys(spark, sf_dir):
    load = loader(spark, sf_dir)
    return chg.delete_keys(load("results_v"), load("claims_v")).select("simulation_id", "user_id", "patients_enrolled")


@query(with_views("""
SELECT simulation_id, arg_max(field, change_id) AS field, arg_max(value, change_id) AS value, max(change_id) AS change_id
FROM changes_v GROUP BY simulation_id""", "changes_v"))
def last_change_per_key(spark, sf_dir):
    rows = view(spark, sf_dir, "changes_v").select("simulation_id", "field", "value", "change_id")
    return chg.last_per_key(rows, ["simulation_id"], ["change_id"])


@query(with_views("""
SELECT simulation_id, count(*) AS "rows" FROM changes_v GROUP BY simulation_id HAVING count(*) > 1""", "changes_v"))
def repeated_keys(spark, sf_dir):
    return chg.repeated_keys(view(spark, sf_dir, "changes_v"), "simulation_id")
