"""Secret scans: a trigram index picks candidates for each rule, the rule's pattern confirms them."""

from __future__ import annotations

import re._constants as parts
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import as_row, stored
from cohortlake.llm.registry import query, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least length of a group of it."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# fixed values: the kinds in their order, their patterns and least lengths
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

#: Strings that a part of a pattern is spelt out to at most, and characters of a class.
MOST_STRINGS, MOST_CHARACTERS = 64, 6
#: Entries summed one by one when positions are added up.
CHUNK = 256

#: A query in trigrams: all clauses must hold, a clause if all trigrams of one of its sets stand in the text.
Query = list[frozenset[frozenset[str]]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def clause(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """One of the strings stands in the text; None if a string is too short to say so in trigrams."""
    sets = {trigrams(s) for s in strings}
    if not sets or frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(o < s for o in sets))


def spelt(node: tuple) -> set[str] | None:
    """All strings a part of a pattern can match, in lower case, or None if they are many."""
    op, value = node
    if op is parts.LITERAL:
        return {chr(value).lower()}
    if op is parts.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is parts.LITERAL:
                chars.add(chr(x).lower())
            elif kind is parts.RANGE and x[1] - x[0] < MOST_CHARACTERS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_CHARACTERS else None
    if op is parts.SUBPATTERN:
        return spelt_all(value[3])
    if op is parts.BRANCH:
        each = [spelt_all(b) for b in value[1]]
        return None if None in each else set().union(*each)
    if op is parts.MAX_REPEAT and value[:2] == (0, 1):
        inner = spelt_all(value[2])
        return None if inner is None else inner | {""}
    return None


def spelt_all(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        strings = spelt(node)
        if strings is None or len(out) * len(strings) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in strings}
    return out


def trigram_query(pattern: str) -> Query:
    """The trigrams without which the pattern cannot match; empty if it has no mandatory ones.

    Parts that can be spelt out are strung together; a part that cannot (a
    wide class, a repetition) ends the run, and each run gives a clause.
    """
    out, run = [], {""}

    def walk(nodes: list) -> None:
        nonlocal run
        for node in nodes:
            strings = spelt(node)
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            close()
            if strings is not None:
                run = set(strings)
            elif node[0] is parts.SUBPATTERN:
                walk(node[1][3])
                close()
            elif node[0] is parts.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
                close()

    def close() -> None:
        nonlocal run
        found = clause(run)
        if found:
            out.append(found)
        run = {""}

    walk(list(parser.parse(pattern)))
    close()
    return out


def trigram_numbers(rules: list[Rule]) -> dict[str, int]:
    every = {t for r in rules for c in trigram_query(r.pattern) for s in c for t in s}
    return {t: i for i, t in enumerate(sorted(every))}


def postings(docs: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The inverted index ``(trigram, _key)`` over all texts, for the trigrams that the rules ask for."""
    lower = F.lower(F.col(text))
    present = F.array_compact(F.array(*[F.when(F.contains("_lower", F.lit(t)), F.lit(n))
                                        for t, n in trigram_numbers(rules).items()]))
    rows = docs.select(F.col(key).alias("_key"), lower.alias("_lower")).where("_key is not null and _lower is not null")
    return rows.select("_key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(_key, _rules)``: the numbers of the rules whose trigram query a document's postings meet.

    Postings of a document meet as bits of its mask, 62 trigrams a word, so
    the lists intersect in one aggregate that combines before its shuffle.
    """
    numbers = trigram_numbers(rules)
    words = max(1, -(-len(numbers) // 62))
    masks = [
        F.bit_or(F.when(F.expr(f"trigram div 62 = {w}"), F.expr(f"shiftleft(1L, trigram - {62 * w})")).otherwise(F.lit(0).cast("long")))
        .alias(f"_m{w}") for w in range(words)
    ]

    def holds(s: frozenset[str]) -> Column:
        ok = F.lit(True)
        for w in range(words):
            bits = sum(1 << (numbers[t] - 62 * w) for t in s if numbers[t] // 62 == w)
            if bits:
                ok = ok & (F.col(f"_m{w}").bitwiseAND(F.lit(bits)) == F.lit(bits))
        return ok

    def asked(rule: Rule) -> Column:
        ok = F.lit(True)
        for c in trigram_query(rule.pattern):
            one = F.lit(False)
            for s in sorted(c, key=sorted):
                one = one | holds(s)
            ok = ok & one
        return ok

    met = [F.when(asked(r), F.lit(i)) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    if not met:
        return index.select("_key").distinct().select("_key", F.array().cast("array<int>").alias("_rules"))
    return index.groupBy("_key").agg(*masks).select("_key", F.array_compact(F.array(*met)).alias("_rules"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside a lambda an expression would be computed for each entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """For each entry of a bound array the sum of those before it; in chunks, so that long lists stay near linear."""
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
        lambda k: F.aggregate(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)), zero, add),
    )

    def each(chunks: Column) -> Column:
        return F.flatten(F.transform(
            chunks,
            lambda _, k: bound(F.aggregate(F.slice(chunks, F.lit(1), k), zero, add), lambda base: bound(
                F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK)),
                lambda part: F.transform(part, lambda _, i: base + F.aggregate(F.slice(part, F.lit(1), i), zero, add)),
            )),
        ))

    return bound(sums, each)


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Matches of a rule, leftmost and not overlapping, as ``(start, number, end)`` in code points."""
    pattern = rule.pattern
    if rule.kind == "hex":  # a run of the least length or more is found at its start: shorter ones need no match
        pattern = rf"[0-9a-f]{{{rule.least},}}"
    kind = "array<struct<start:bigint,number:int,end:bigint>>"
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("measured"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def spans(m: Column) -> Column:
        lengths = F.transform(m["whole"], lambda w, i: (F.length(F.get(m["gaps"], i)) + F.length(w)).cast("long"))
        return bound(lengths, lambda lengths: bound(sums_before(lengths), lambda before: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(before) - 1), lambda i: F.length(F.get(m["measured"], i)) >= rule.least),
            lambda i: F.struct(
                (F.get(before, i) + F.length(F.get(m["gaps"], i))).alias("start"), F.lit(number).alias("number"),
                (F.get(before, i) + F.get(lengths, i)).alias("end"),
            ),
        )))

    return F.when(text.rlike(pattern), bound(found, spans).cast(kind)).otherwise(F.array().cast(kind))


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None,
                 keep_row: bool = False) -> DataFrame:
    """``(key, spans)`` of every document: ``(kind, start, end)`` by start, then by the order of the rules.

    ``keep_row`` adds the input row as ``row``. The texts meet the candidates
    of the index by key; a rule without mandatory trigrams scans every text.
    Documents without a key cannot be looked up, so all rules scan them. Null
    text is empty. Repeated keys share candidates, which the patterns confirm.
    Texts are scanned whole, in time that grows with their matches; an empty
    table gives an empty result.
    """
    rules = rules or RULES
    found = candidates(stored(postings(docs, key, text, rules), "postings"), rules).withColumnRenamed("_key", "_of")
    rows = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *([as_row(docs)] if keep_row else [])
    )
    joined = rows.join(found, F.col("_key") == F.col("_of"), "left")
    arrays = []
    for i, rule in enumerate(rules):
        spans = rule_spans(F.col("_text"), rule, i)
        if trigram_query(rule.pattern):
            asked = F.col("_key").isNull() | F.coalesce(F.array_contains("_rules", i), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast("array<struct<start:bigint,number:int,end:bigint>>"))
        arrays.append(spans)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.transform(
        F.array_sort(F.concat(*arrays)),
        lambda s: F.struct(F.get(kinds, s["number"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return joined.select(F.col("_key").alias(key), ordered.alias("spans"), *(["row"] if keep_row else []))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _oracle() -> str:
    """Per rule its matches, the measured group and the text between matches; starts are sums of their lengths."""
    cut, lists = [], []
    for i, r in enumerate(RULES):
        # a run of hex digits that is long enough is the same whether shorter ones are matched or not
        p = "[0-9a-f]{32,}" if r.kind == "hex" else r.pattern.replace("'", "''")
        cut.append(f"regexp_extract_all(t, '{p}') AS m{i}, regexp_extract_all(t, '{p}', {r.group}) AS g{i}, "
                   f"string_split_regex(t, '{p}') AS s{i}")
        lists.append(f"""list_transform(range(len(m{i})), lambda i: struct_pack(
      s := list_sum(list_transform(s{i}[1:i + 1], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m{i}[1:i], lambda x: length(x))), 0),
      k := {i}, kind := '{r.kind}', e := length(m{i}[i + 1]), n := length(g{i}[i + 1]), least := {r.least}))""")
    every = "list_concat(" * (len(lists) - 1) + lists[0] + "".join(f", {x})" for x in lists[1:])
    joined = "array_to_string(list_transform({}, lambda x: x.kind || ':' || x.s::BIGINT || ':' || (x.s + x.e)::BIGINT), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, {", ".join(cut)} FROM d),
f AS (SELECT doc_id, list_sort(list_filter({every}, lambda x: x.n >= x.least)) AS a FROM c)
SELECT doc_id, len(list_filter(a, lambda x: x.k = 0))::BIGINT AS n_assign,
  len(list_filter(a, lambda x: x.k = 1))::BIGINT AS n_access, len(list_filter(a, lambda x: x.k = 2))::BIGINT AS n_hex,
  sha256({joined.format("list_filter(a, lambda x: x.k <= 2)")}) AS base_sha256, {joined.format("a")} AS spans
FROM f"""


@query(_oracle())
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    counts = [n_of(k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
