"""Text expressions: slugs, search text, number formats, chat language and intents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cohortlake import fixed_values as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(value, decimals: int) -> Column:
    """Number with a fixed count of decimals, rounding the exact binary value."""
    shape = "0" if decimals == 0 else "0." + "0" * decimals
    return F.call_function("format_number", _col(value).cast("double"), F.lit(shape))


def fill(template: str, **parts: Column) -> Column:
    """Put columns into the ``{name}`` places of a fixed text."""
    pieces, rest = [], template
    while rest:
        hits = [(rest.index("{" + n + "}"), n) for n in parts if "{" + n + "}" in rest]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(parts[name])
        rest = rest[at + len(name) + 2:]
    return F.concat(*pieces)


def any_word(text: Column, words: list[str]) -> Column:
    """True when one of the words (no pattern characters in them) occurs anywhere in the text."""
    return text.rlike("|".join(words))


def strip(text) -> Column:
    return F.trim(_col(text), F.lit(" \t\n\r\f\x0b"))


# ---------------------------------------------------------------- identifiers

def name_slug(name, words: int = 4) -> Column:
    """Lower-case words joined by ``_``, at most the first four."""
    plain = F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "_")
    return F.array_join(F.slice(F.split(F.trim(plain, F.lit("_")), "_"), 1, words), "_")


def readable_id(name, key) -> Column:
    """Slug plus a four-digit number that depends only on ``key``."""
    number = F.pmod(F.xxhash64(_col(key)), F.lit(9000)) + F.lit(1000)
    return F.concat_ws("_", name_slug(name), number.cast("string"))


def patient_id(simulation_id, number) -> Column:
    """``PAT-`` + eight characters of the simulation id + a number padded to four digits."""
    n = _col(number).cast("string")
    padded = F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0"))
    return F.concat_ws("-", F.lit("PAT"), F.substring(_col(simulation_id), 1, 8), padded)


def search_text(*columns) -> Column:
    """Lower-case fields joined by a blank; a missing field keeps its place."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]))


def matches_search(term: str, *columns) -> Column:
    """Case-insensitive substring search over the joined fields; a blank term matches all."""
    return F.lit(True) if not term else search_text(*columns).contains(term.lower())


# ------------------------------------------------------------------ chat text

def message_language(text) -> Column:
    """hi for Devanagari, else bn for Bengali script, else en."""
    t = _col(text)
    return F.when(t.rlike(V.HINDI_SCRIPT), "hi").when(t.rlike(V.BENGALI_SCRIPT), "bn").otherwise("en")


def confirmation(text) -> Column:
    """confirm, cancel or null for a whole message taken as one word."""
    classes = {w: "confirm" for words in V.CONFIRM_WORDS.values() for w in words}
    classes |= {w: "cancel" for words in V.CANCEL_WORDS.values() for w in words}
    table = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    return F.try_element_at(table, strip(F.lower(_col(text))))


def _first_hit(candidates: list[Column]) -> Column:
    """First struct whose ``new_value`` is not blank; each is worked out once."""
    return F.slice(F.filter(F.array(*candidates), lambda c: c["new_value"] != ""), 1, 1)


def _whole_word(pattern: str) -> str:
    """The same matches, but tried only at word starts and without giving letters back.

    A match inside a word could always be extended to the word's start, so the
    leftmost match is the same; long words no longer cost quadratic time.
    """
    word = "[A-Za-z0-9_]"
    return "(?i)" + pattern.replace(f"({word}+)", f"(?<!{word})({word}++)")


def named_simulation(text) -> Column:
    """The id after "simulation", "sim", "id" or "for", null when there is none."""
    return F.nullif(F.regexp_extract(_col(text), V.ID_PATTERN, 1), F.lit(""))


def update_intent(text) -> Column:
    """struct<named_id, field, new_value> of an update request, else null.

    Short forms ("set it to 40") come first and always mean the enrolled
    patients of the carried simulation. Other messages need an update word,
    then the first field pattern that matches decides. The ordered patterns
    run only on messages that pass one cheap test.
    """
    t = _col(text)
    low = F.lower(t)

    def hit(field: Column, value: Column) -> Column:
        return F.struct(field.alias("field"), value.alias("new_value"))

    short = [hit(F.lit(V.SHORT_UPDATE_FIELD), F.regexp_extract(low, p, 1)) for p in V.SHORT_UPDATE_PATTERNS]
    named = [hit(F.lit(field), F.regexp_extract(low, p, 1)) for p, field in V.NAMED_FIELD_PATTERNS]
    other = [hit(F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)) for p in map(_whole_word, V.ANY_FIELD_PATTERNS)]
    named_id = named_simulation(t)

    def with_id(found: Column, target: Column) -> Column:
        whole = F.transform(
            found, lambda c: F.struct(target.alias("named_id"), c["field"].alias("field"), c["new_value"].alias("new_value"))
        )
        return F.try_element_at(whole, F.lit(1))

    is_short = low.rlike("|".join(f"(?:{p})" for p in V.SHORT_UPDATE_PATTERNS))
    return F.when(is_short, with_id(_first_hit(short), F.lit(None).cast("string"))).when(
        any_word(low, V.UPDATE_WORDS),
        F.coalesce(with_id(_first_hit(named), named_id), with_id(_first_hit(other), named_id)),
    )


def asks_translation(text) -> Column:
    return any_word(F.lower(_col(text)), V.TRANSLATE_WORDS)


def translation_target(text) -> Column:
    """Language code of the first language name, in list order, found in the text."""
    low = F.lower(_col(text))
    return F.coalesce(*[F.when(low.contains(name), code) for name, code in V.LANGUAGE_NAMES])


def id_tokens(text) -> Column:
    """Distinct whole tokens of a message that can be an id, lower case."""
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda x: x.contains("_")))


def _reply(templates: dict[str, str], language, **parts) -> Column:
    filled = {name: F.coalesce(_col(c).cast("string"), F.lit("N/A")) for name, c in parts.items()}
    lang = _col(language)
    return (
        F.when(lang == "hi", fill(templates["hi"], **filled))
        .when(lang == "bn", fill(templates["bn"], **filled))
        .otherwise(fill(templates["en"], **filled))
    )


def request_text(language, simulation_id, field, old, new) -> Column:
    """Text that asks the user to confirm an update."""
    return _reply(V.UPDATE_REQUEST_TEXT, language, id=simulation_id, field=field, old=old, new=new)


def done_text(language, simulation_id, field, old, new) -> Column:
    """Text that tells the user an update was made."""
    return _reply(V.UPDATE_DONE_TEXT, language, id=simulation_id, field=field, old=old, new=new)


# -------------------------------------------------------------- tagged answers

_SHARE = r"^\s*%*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)%*(?!\S)"


def parse_answer(text) -> Column:
    """Probability, confidence, risk factors and explanation of a tagged answer.

    A missing or unreadable number keeps its default; both are cut to [0, 1].
    At most five risk factors are kept, trimmed and without blanks.
    """
    t = _col(text)

    def after(tag: str) -> Column:
        return F.try_element_at(F.split(t, tag + ":"), F.lit(2))

    def number(tag: str, default: float) -> Column:
        share = F.regexp_extract(after(tag), _SHARE, 1).try_cast("double") / F.lit(100.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(default))))

    section = F.element_at(F.split(after("RISK_FACTORS"), "EXPLANATION:"), 1)
    factors = F.filter(F.transform(F.split(section, ","), strip), lambda x: x != "")
    return F.struct(
        number("SUCCESS_PROBABILITY", V.ANSWER_DEFAULT_PROBABILITY).alias("success_probability"),
        number("CONFIDENCE", V.ANSWER_DEFAULT_CONFIDENCE).alias("confidence_score"),
        F.coalesce(F.slice(factors, 1, 5), F.array().cast("array<string>")).alias("risk_factors"),
        F.coalesce(strip(after("EXPLANATION")), F.lit(V.ANSWER_DEFAULT_EXPLANATION)).alias("explanation"),
    )


def parse_context(text) -> Column:
    """JSON context as a map of texts; unreadable text is kept under ``raw_context``."""
    t = _col(text)
    read = F.from_json(t, "map<string,string>")
    return F.when(t.isNull() | (F.trim(t) == ""), F.lit(None)).when(
        read.isNull(), F.create_map(F.lit("raw_context"), t)
    ).otherwise(read)
