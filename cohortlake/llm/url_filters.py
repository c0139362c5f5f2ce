"""URL filters: longest listed rule by cascades of Bloom filters, exact over the keys of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import stored
from cohortlake.llm.registry import query, table

#: Rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
#: Bits per key and hash functions of a filter.
BITS_PER_KEY, HASHES = 10, 5
#: Listed keys of one part; its first filter then has about a megabyte and a quarter.
MOST_KEYS = 1_000_000
#: Levels after which a cascade would be at odds with its hash functions.
MOST_LEVELS = 60


def url_host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_keys(host: Column, path: Column, labels: Column, depth: Column) -> Column:
    """Every key under which a rule could be listed, longest first.

    A key is a suffix of the host at a dot, followed by a prefix of the path
    that ends in a slash; suffixes of up to ``labels`` labels and prefixes of
    up to ``depth`` slashes, the most that the list has.
    """
    parts, steps = F.split(host, r"\."), F.split(path, "/", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), labels)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(steps) - 1, depth)),
        lambda n: F.concat(F.array_join(F.slice(steps, F.lit(1), n), "/"), F.lit("/")),
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    usable = (F.size(steps) > 1) & (labels > 0) & (depth > 0)
    sized = F.transform(pairs, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.when(usable, F.transform(F.array_sort(sized), lambda x: x["k"])).otherwise(F.array().cast("array<string>"))


@dataclass
class Level:
    """One Bloom filter: its words as a value of the plan, and how many there are."""

    words: Column
    size: int

    def holds(self, key: Column, number: int) -> Column:
        """Whether all bits of the key are set."""
        ok = F.lit(True)
        for word, bit in places(key, number, self.size):
            ok = ok & (F.getbit(F.element_at(self.words, word + 1), bit) == 1)
        return ok


def places(key: Column, number: int, size: int) -> list[tuple[Column, Column]]:
    """Word and bit of each hash function of level ``number``."""
    hashes = [F.pmod(F.xxhash64(F.lit(number * HASHES + i), key), F.lit(size * 64)) for i in range(HASHES)]
    return [(F.shiftright(h, 6).cast("int"), F.pmod(h, F.lit(64)).cast("int")) for h in hashes]


def filter_level(keys: DataFrame, number: int, count: int) -> Level:
    """A Bloom filter over ``keys.key``; tasks OR their words before the shuffle.

    It has BITS_PER_KEY bits a key, so it grows with the keys given and not
    with the corpus, and it is one array of ``size`` words.
    """
    size = max(1, -(-count * BITS_PER_KEY // 64))
    set_bits = F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in places(F.col("key"), number, size)])
    words = (
        keys.select(F.explode(set_bits).alias("p"))
        .groupBy(F.col("p.word").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits"))
    )
    every = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    entry = F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    array = stored(every.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.col("e.bits").alias("bits")), "bloom")
    return Level(array.scalar(), size)


@dataclass
class Cascade:
    """Alternate filters of listed keys and of the keys that passed by mistake."""

    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Exact membership for every key of the universe the cascade was built over.

        A key leaves at the first level that does not hold it: an even level
        says it is not listed, an odd one that it is.
        """
        out = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            out = F.when(self.levels[number].holds(key, number), out).otherwise(F.lit(number % 2 == 1))
        return out


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Build filters until no key of the universe passes by mistake.

    ``universe`` is read once: the first filter lets few of its keys through,
    and only those are made distinct and kept. Every later level encodes what
    the level before let through wrongly, a shrinking set.
    """
    inside = stored(listed.select("key").distinct(), "listed")
    levels = [filter_level(inside, 0, inside.count())]
    outside = stored(
        universe.select("key").where(levels[0].holds(F.col("key"), 0)).distinct().join(inside, "key", "left_anti"),
        "passed",
    )
    while (count := outside.count()) and len(levels) < MOST_LEVELS:
        number = len(levels)
        levels.append(filter_level(outside, number, count))
        # of the other side, what this level holds by mistake is the next level's set
        inside, outside = outside, stored(inside.where(levels[number].holds(F.col("key"), number)), "passed")
    if len(levels) == MOST_LEVELS:
        raise RuntimeError("a cascade did not end; its keys collide in every hash function")
    return Cascade(levels)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict of every url.

    ``rules`` has host, path and verdict (``block`` or ``allow``); a path
    begins and ends with a slash. A rule fits its host and all subdomains if
    the path starts with the rule's; the longest fitting rule decides, and a
    url that no listed key fits is allowed. A rule listed for both blocks.
    Null or malformed urls have empty host and path and fit no rule. Repeated
    rows are judged one by one; empty tables give empty results or no rule.

    Membership is asked of two cascades, one per verdict, so no url is
    shuffled or joined. A list of more than MOST_KEYS keys is dealt into parts
    by hash, each with cascades of its own, and the parts judge in turn over a
    stored table.
    """
    wrong = ~(F.col("path").startswith("/") & F.col("path").endswith("/"))
    count, labels, depth, bad = rules.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("host", r"\."))), F.max(F.size(F.split("path", "/", -1)) - 1),
        F.coalesce(F.sum(wrong.cast("int")), F.lit(0)),
    ).first()
    if bad:
        raise ValueError("the path of a rule must begin and end with a slash")
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    parts = max(1, -(-count // MOST_KEYS))
    carried = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    out = pages.select(*carried, url_host(url).alias("host"), url_path(url).alias("path"))
    out = out.withColumn("_rule", F.lit(None).cast("string")).withColumn("_block", F.lit(False))
    keys = url_keys(F.col("host"), F.col("path"), F.lit(labels or 0), F.lit(depth or 0))
    for part in range(parts):
        own = listed.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        universe = out.select(F.explode(keys).alias("key"))
        block = cascade(own.where("verdict = 'block'"), universe)
        allow = cascade(own.where("verdict = 'allow'"), universe)
        out = out.withColumn("_keys", keys)
        # spelt out, as a lambda cannot hold the filters; there are no more keys than the list has labels times slashes
        nth = [F.get("_keys", F.lit(i)) for i in range((labels or 0) * (depth or 0))]
        fits = [F.when(block.lists(k) | allow.lists(k), k) for k in nth]
        out = out.withColumn("_fits", F.coalesce(F.lit(None).cast("string"), *fits)).drop("_keys")
        longer = F.length("_fits") > F.coalesce(F.length("_rule"), F.lit(0))
        out = out.withColumns({
            "_block": F.when(longer, block.lists(F.col("_fits"))).otherwise(F.col("_block")),
            "_rule": F.when(longer, F.col("_fits")).otherwise(F.col("_rule")),
        }).drop("_fits")
        if part < parts - 1:
            out = stored(out, "judged")
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])], "host", "path", F.col("_rule").alias("rule"),
        F.when(F.col("_block"), "block").otherwise("allow").alias("verdict"),
    )


@query("""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""")
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules, keep=["page_id"])
