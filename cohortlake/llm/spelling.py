"""Spelling variants: words one error apart, found by a bit-sliced index of letters at positions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import U64, fields, stored, text_slices
from cohortlake.llm.registry import query, table

#: Least letters of a word, least occurrences, how many times more frequent a form is, and what deletes a letter.
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, DELETE_EVERY = 7, 2, 10, 31
#: Words of a block on average; more words with the same ends are dealt into several blocks.
BLOCK_WORDS = 4096
#: Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000

_LETTERS = "[a-zÀ-ÿ]"  # after A-Z are lower-cased; fixed by the contract


def varied(run: str, key: bytes, every: int) -> str:
    """The run without one letter, if the checksum of ``key`` and run says so."""
    h = crc32(run.encode(), crc32(key))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT, every: int | None = DELETE_EVERY) -> DataFrame:
    """``(word, n)`` of the words of all whole texts, A-Z lower-cased.

    With ``every``, one letter of a run goes where the checksum of
    ``<key>:<run>`` is divisible by it. Null texts have no words, a null key
    is written as nothing; repeated rows count again; further columns are not
    read. Very long texts and words are taken whole.
    """
    runs = re.compile(f"{_LETTERS}{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        for batch in batches:
            for part, texts in text_slices(batch, 1):
                for k, t in zip(part.column(0).to_pylist(), texts, strict=True):
                    here = Counter(runs.findall(t.lower().decode())) if t else {}  # bytes lower A-Z only
                    prefix = f"{'' if k is None else k}:".encode()
                    for word, n in here.items():
                        if every is not None:
                            word = varied(word, prefix, every)
                            if len(word) < least_letters:
                                continue
                        total[word] += n
                if len(total) >= COUNTED_WORDS:
                    yield out()
        yield out()

    counted = docs.select(F.col(key).cast("string"), text).mapInArrow(run, fields(word=T.StringType(), n=T.LongType()))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters_of(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)


class PositionIndex:
    """For each position and letter the set of words that have it there, as bits of 64-bit lanes."""

    def __init__(self, bands: list[tuple[int, np.ndarray]]):
        """``bands`` are (length, letters of the words of that length), shortest first."""
        self.count = sum(len(b) for _, b in bands)
        self.lanes = -(-self.count // 64)
        codes, owners, self.sized, at = [], [], {}, 0
        for length, band in bands:
            codes.append((band + (np.arange(length) << 32)).ravel())
            owners.append(np.repeat(np.arange(at, at + len(band)), length))
            self.sized[length] = self.bits(np.arange(at, at + len(band)))
            at += len(band)
        self.codes, place = np.unique(np.concatenate(codes), return_inverse=True)
        owner = np.concatenate(owners)
        self.rows = np.zeros((len(self.codes) + 1, self.lanes), U64)  # the last row: nobody has the letter there
        np.bitwise_or.at(self.rows, (place, owner >> 6), U64(1) << (owner & 63).astype(U64))

    def bits(self, members: np.ndarray) -> np.ndarray:
        out = np.zeros(self.lanes, U64)
        np.bitwise_or.at(out, members >> 6, U64(1) << (members & 63).astype(U64))
        return out

    def places(self, asked: np.ndarray, shift: int) -> np.ndarray:
        """The row of each letter of the asked words, at its position moved by ``shift``."""
        code = asked + (np.arange(shift, shift + asked.shape[1]) << 32)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, at, len(self.codes))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked, held) of words one error apart, for asked words of one length.

        All held words move on together, letter by letter: ``zero`` are those
        without an error so far; ``other``, ``more`` and ``fewer`` those with
        one, where the held word has another letter, one more or one fewer, so
        that it is read at the same position, the next or the one before.
        """
        length = asked.shape[1]
        here, ahead, behind = (self.places(asked, s) for s in (0, 1, -1))
        zero = np.full((len(asked), self.lanes), U64(0xFFFFFFFFFFFFFFFF))
        other, more, fewer = (np.zeros_like(zero) for _ in range(3))
        for i in range(length):
            same = self.rows[here[:, i]]
            fewer &= self.rows[behind[:, i]]
            fewer |= zero
            more |= zero
            more &= self.rows[ahead[:, i]]
            other &= same
            other |= zero & ~same
            zero &= same
        more |= zero
        none = np.zeros(self.lanes, U64)
        found = ((other & self.sized.get(length, none)) | (more & self.sized.get(length + 1, none))
                 | (fewer & self.sized.get(length - 1, none)))
        query, lane = np.nonzero(found)
        each = np.unpackbits(found[query, lane].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(each)
        return query[row], lane[row] * 64 + bit


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def near_in_block(asked: list[str], held: list[str]) -> Iterator[tuple[int, int]]:
    """Numbers of the asked and held words that are one error apart; an index serves each length asked for."""
    lengths, queries = by_length(held), by_length(asked)
    letters = {n: letters_of([held[i] for i in at]) for n, at in lengths.items()}
    for n, wanted in sorted(queries.items()):
        band = [m for m in (n - 1, n, n + 1) if m in lengths]
        order = [i for m in band for i in lengths[m]]
        if not order or len(order) == 1 and len(wanted) == 1 and held[order[0]] == asked[wanted[0]]:
            continue
        index = PositionIndex([(m, letters[m]) for m in band])
        a, b = index.near(letters_of([asked[i] for i in wanted]))
        yield from ((wanted[x], order[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def word_blocks(words: DataFrame, width: int) -> DataFrame:
    """``(side, bucket, part, parts, words)``: each word with those that may share its first or its last letters.

    Two words one error apart have their first ``width`` letters in common or
    their last. Rare beginnings and ends share buckets; one with more than
    ``BLOCK_WORDS`` words has a bucket of its own, in several parts.
    """
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, width).alias("end")),
                   F.struct(F.lit(1).alias("side"), F.substring("word", -width, width).alias("end")))
    sides = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.side", "e.end")
    buckets = max(1, -(-words.count() // BLOCK_WORDS))
    # at most two sides times the letters to the power of width, whatever the number of words
    often = sides.groupBy("side", "end").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_WORDS)
    dealt = sides.join(F.broadcast(often), ["side", "end"], "left")
    parts = F.coalesce(F.ceil(F.col("_n") / BLOCK_WORDS), F.lit(1)).cast("int")
    few = F.concat(F.lit("#"), F.pmod(F.xxhash64("end"), F.lit(buckets)).cast("string"))
    dealt = dealt.select("side", F.when(F.col("_n").isNull(), few).otherwise(F.col("end")).alias("bucket"),
                         F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), parts.alias("parts"), "word", "n")
    return dealt.groupBy("side", "bucket", "part", "parts").agg(F.collect_list(F.struct("word", "n")).alias("words"))


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(word, near, near_n)`` for all words one inserted, deleted or replaced code point apart, both ways.

    ``words`` are different ``(word, n)`` of at least ``least_letters`` (three
    or more). A word has a bounded number of such neighbours, by its length
    and the alphabet, whatever the number of words.
    """
    width = (least_letters - 1) // 2
    if width < 1:
        raise ValueError("words need three letters at least")
    blocks = stored(word_blocks(words, width), "word-blocks")
    alone = blocks.where("parts = 1").select("side", F.col("words").alias("asked"), F.col("words").alias("held"))
    split = blocks.where("parts > 1")
    other = split.select("side", "bucket", F.col("part").alias("other"), F.col("words").alias("held"))
    grid = split.select("side", "bucket", F.col("words").alias("asked"),
                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = alone.unionByName(grid.join(other, ["side", "bucket", "other"]).select("side", "asked", "held"))
    schema = fields(word=T.StringType(), near=T.StringType(), near_n=T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                side, asked, held = (batch.column(n)[i] for n in ("side", "asked", "held"))
                a, b = asked.values.field("word").to_pylist(), held.values.field("word").to_pylist()
                counts = held.values.field("n").to_pylist()
                turned = side.as_py() == 1
                out: list[list] = [[], [], []]
                ways = ([w[::-1] for w in a], [w[::-1] for w in b]) if turned else (a, b)
                for x, y in near_in_block(*ways):
                    # a pair with the same beginning counts there, another at its end
                    if (a[x][:width] == b[y][:width]) != turned and (not turned or a[x][-width:] == b[y][-width:]):
                        for column, value in zip(out, (a[x], b[y], counts[y]), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["word", "near", "near_n"])

    return pairs.mapInArrow(run, schema)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the end of each word's forms, by doubling.

    Forms must not run in a circle; a form is more frequent than its word.
    """
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_of"), F.col("root").alias("_next"))
        moved = stored(at.join(ahead, F.col("root") == F.col("_of"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, times: int = FORM_TIMES, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n)``.

    The form is the near word of largest n (ties: the smallest by code
    points), if that is ``times`` the word's n or more, else null; the root
    the last form that follows, or the word itself. Words without near words
    are returned too; an empty vocabulary gives an empty result.
    """
    words = stored(words, "words")
    near = near_words(words, least_letters).groupBy(F.col("word").alias("_of")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("top"))
    often = -F.col("top.m") >= F.lit(times) * F.col("n")

    def if_often(value: Column) -> Column:
        return F.when(often, value)

    named = stored(words.join(near, F.col("word") == F.col("_of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        if_often(F.col("top.near")).alias("form"), if_often(-F.col("top.m")).alias("form_n")), "forms")
    ends = roots(named.where("form is not null")).withColumnRenamed("word", "_word")
    return named.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS w
    FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
bits AS (
  SELECT doc_id, w, n, list_transform(range(0, 4 * length(h)),
    lambda i: ((instr('0123456789ABCDEF', substr(h, ((i // 4) + 1 - 2 * ((i // 4) % 2) + 1)::INT, 1)) - 1) >> (i % 4)::INT) & 1) AS b
  FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS h FROM runs)),
sums AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]),
    lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295::BIGINT) AS h
  FROM bits),
varied AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n
  FROM sums),
v AS (SELECT word, sum(n)::BIGINT AS n FROM varied WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS head, substr(word, i::INT + 2) AS tail
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, head, tail) WHERE a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.head || cut.tail = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.head || cut.tail = v.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
    CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (
  SELECT word, form AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.step = forms.word WHERE forms.form IS NOT NULL),
ends AS (
  SELECT walk.word, step FROM walk JOIN forms ON walk.step = forms.word WHERE forms.form IS NULL)
SELECT word, form, coalesce(step, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))
