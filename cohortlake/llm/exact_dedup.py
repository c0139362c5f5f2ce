"""Exact dedup: later texts are looked up in a minimal perfect hash over the digests of earlier ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import U64, as_row, mixed, rows_back, stored
from cohortlake.llm.registry import query, table

#: Digests of a shard on average. Shards hold different digests, which are spread evenly, so none grows beyond that.
SHARD_DIGESTS = 4096
#: Bits a key in each level of a hash. Keys alone at their bit take it; the others go to the next level.
BITS_PER_KEY = 2
MOST_LEVELS = 64
#: Texts with over one row in so many, and so many rows at least, are joined by broadcast: they are this many at most.
HOT_TEXTS, HOT_ROWS = 10_000, 10_000

_STEP = 0x9E3779B97F4A7C15


def level_positions(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest (a row of four 64-bit words) in a level; all words count in the course of the levels."""
    seed = U64((level + 1) * _STEP % (1 << 64))
    h = mixed(digests[:, level % 4] + mixed(digests[:, (level + 1) % 4] ^ seed))
    return (h % U64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits that number n different digests from 0 to n - 1, and those numbers."""
    numbers = np.empty(len(digests), np.int64)
    left, levels, before = np.arange(len(digests)), [], 0
    while len(left):
        if len(levels) == MOST_LEVELS:
            raise ValueError("digests are not different")
        size = max(8, BITS_PER_KEY * len(left))
        at = level_positions(digests[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        numbers[left[mine]] = before + (np.cumsum(alone) - 1)[at[mine]]
        before += int(alone.sum())
        levels.append(alone)
        left = left[~mine]
    return levels, numbers


def hash_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest; one that was not hashed gets any slot, or -1."""
    slots = np.full(len(digests), -1, np.int64)
    left, before = np.arange(len(digests)), 0
    for level, bits in enumerate(levels):
        at = level_positions(digests[left], level, len(bits))
        mine = bits[at]
        slots[left[mine]] = before + (np.cumsum(bits) - 1)[at[mine]]
        before += int(bits.sum())
        left = left[~mine]
    return slots


def words_of(digests: pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").astype(U64).reshape(-1, 4)


def text_digest(text: str) -> Column:
    """SHA-256 of the UTF-8 text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def shard_of(digest: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 12), 16, 10).cast("long"), shards)


def best() -> Column:
    """The locator of the row that stays: the largest key; of equal keys the first row of the stored digests."""
    return F.max(F.struct(F.col("_key").alias("key"), (-F.col("_at")).alias("at")))


def digests_of(docs: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """``(_key, _at, _digest, ...)`` as a stored table, so that row numbers stay; texts are read once."""
    rows = docs.select(F.col(key).alias("_key"), text_digest(text).alias("_digest"), *[c.alias(n) for n, c in more.items()])
    return stored(rows.withColumn("_at", F.monotonically_increasing_id()), "digests")


def by_digest(rows: DataFrame) -> DataFrame:
    """One row ``(_digest, best, copies)`` per text; tasks combine copies before the shuffle."""
    return rows.groupBy("_digest").agg(best().alias("best"), F.count(F.lit(1)).alias("copies"))


def digest_index(groups: DataFrame) -> DataFrame:
    """The index over ``(_digest, best, copies)`` of different texts, a stored table with one row per shard.

    ``levels`` and ``bits`` are the shard's minimal perfect hash; ``digests``,
    ``best`` and ``copies`` stand in the order of its slots: the full digest,
    the locator of the winner and the number of rows. Every shard knows the
    number of all ``shards``. An empty table gives an empty index.
    """
    groups = stored(groups, "earlier")
    shards = max(1, -(-groups.count() // SHARD_DIGESTS))
    place = groups.schema["best"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("shards", T.LongType()),
        T.StructField("levels", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()),
        T.StructField("digests", T.BinaryType()), T.StructField("best", T.ArrayType(place)),
        T.StructField("copies", T.ArrayType(T.LongType())),
    ])

    def built(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        digests = words_of(shard["_digest"])
        levels, slots = perfect_hash(digests)
        order = pa.array(np.argsort(slots))
        ends = pa.array([0, len(slots)], pa.int32())
        bits = np.packbits(np.concatenate(levels))

        def listed(name: str) -> pa.Array:
            return pa.ListArray.from_arrays(ends, shard[name].take(order).combine_chunks())

        return pa.Table.from_arrays(
            [shard["shard"][:1], pa.array([shards]), pa.array([[len(x) for x in levels]]), pa.array([bits.tobytes()]),
             pa.array([digests[np.asarray(order)].astype("<u8").tobytes()]), listed("best"), listed("copies")],
            names=schema.names,
        )

    dealt = groups.select(shard_of(F.col("_digest"), F.lit(shards)).alias("shard"), "_digest", "best", "copies")
    return stored(dealt.groupBy("shard").applyInArrow(built, schema), "digest-index")


def looked_up(index: DataFrame, groups: DataFrame) -> DataFrame:
    """``(_digest, best, copies, shard, slot)`` of different texts: the slot that holds the very digest, else -1.

    Texts are dealt to the shard of their digest, in several blocks if there
    are more of them than indexed ones; each block meets one shard's row.
    """
    known = index.agg(F.max("shards")).first()[0]
    groups = stored(groups, "later")
    place = groups.schema["best"].dataType
    schema = T.StructType([
        groups.schema["_digest"], T.StructField("best", place), T.StructField("copies", T.LongType()),
        T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType()),
    ])
    if known is None:
        return groups.select("_digest", "best", "copies", F.lit(None).cast("long").alias("shard"),
                             F.lit(-1).cast("long").alias("slot"))
    parts = max(1, -(-groups.count() // (known * SHARD_DIGESTS)))
    blocks = groups.groupBy(
        shard_of(F.col("_digest"), F.lit(known)).alias("shard"), F.pmod(F.xxhash64("_digest"), F.lit(parts)).alias("part")
    ).agg(F.collect_list(F.struct("_digest", "best", "copies")).alias("asked"))
    meet = blocks.join(index.select("shard", "levels", "bits", "digests"), "shard", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                asked = row["asked"].values
                slots = np.full(len(asked), -1, np.int64)
                if row["digests"].is_valid:
                    slots = slots_of(row, words_of(asked.field("_digest")))
                yield pa.RecordBatch.from_arrays(
                    [asked.field("_digest"), asked.field("best"), asked.field("copies"),
                     pa.array(np.full(len(asked), row["shard"].as_py())), pa.array(slots)], names=schema.names)

    return meet.mapInArrow(run, schema)


def slots_of(shard: dict, digests: np.ndarray) -> np.ndarray:
    """Slots of a shard whose digest is the same in every byte, else -1."""
    sizes = shard["levels"].as_py()
    bits = np.unpackbits(np.frombuffer(shard["bits"].as_py(), np.uint8), count=sum(sizes)).astype(bool)
    slots = hash_slots(np.split(bits, np.cumsum(sizes)[:-1]), digests)
    held = np.frombuffer(shard["digests"].as_py(), "<u8").reshape(-1, 4)
    same = slots >= 0
    same[same] = (held[slots[same]] == digests[same]).all(1)
    return np.where(same, slots, -1)


def rank_of(place: dict) -> tuple:
    """Order of locators as the aggregates have it: null keys come first."""
    return place["key"] is not None, place["key"], place["at"]


def merged_slots(index: DataFrame, members: DataFrame) -> DataFrame:
    """``(_digest, best, copies)`` of every slot after ``(shard, slot, best, copies)`` of later rows came in.

    A slot gets one row at most, so the rows of a shard are no more than its slots.
    """
    came = members.groupBy(F.col("shard").alias("_shard")).agg(
        F.collect_list(F.struct("slot", "best", "copies")).alias("came"))
    both = index.select("shard", "digests", "best", "copies").join(came, F.col("shard") == F.col("_shard"), "left")
    schema = T.StructType([
        T.StructField("_digest", T.BinaryType()), T.StructField("best", index.schema["best"].dataType.elementType),
        T.StructField("copies", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                best, copies = row["best"].values, np.array(row["copies"].values)
                pick = np.arange(len(best))
                if row["came"].is_valid:
                    new = row["came"].values
                    slots = np.asarray(new.field("slot"))
                    copies[slots] += np.asarray(new.field("copies"))
                    old = best.take(pa.array(slots)).to_pylist()
                    later = [rank_of(a) < rank_of(b) for a, b in zip(old, new.field("best").to_pylist(), strict=True)]
                    pick[slots[later]] = len(best) + np.flatnonzero(later)
                    best = pa.concat_arrays([best, new.field("best")])
                digests = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(32), len(copies), [None, pa.py_buffer(row["digests"].as_py())])
                yield pa.RecordBatch.from_arrays(
                    [digests.cast(pa.binary()), best.take(pa.array(pick)), pa.array(copies)], names=schema.names)

    return both.mapInArrow(run, schema)


def decided(index: DataFrame, found: DataFrame) -> DataFrame:
    """``(_digest, best, copies)`` of all texts: the slots of the index with their repeats, and the nonmembers."""
    members = found.where("slot >= 0")
    return stored(merged_slots(index, members).unionByName(
        found.where("slot < 0").select("_digest", "best", "copies")), "decided")


def with_decision(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with ``best`` and ``copies`` of their text.

    Texts of very many rows, ``HOT_TEXTS`` at most, go to all tasks, so no
    task gets their rows together; the others meet by digest.
    """
    total = decisions.agg(F.sum("copies")).first()[0] or 0
    hot = max(HOT_ROWS, total // HOT_TEXTS)
    many = F.broadcast(decisions.where(F.col("copies") > hot))
    few = decisions.where(F.col("copies") <= hot)
    return rows.join(many, "_digest").unionByName(
        rows.join(many.select("_digest"), "_digest", "left_anti").join(few, "_digest"))


def exact_groups(docs: DataFrame, earlier: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_key, group_size, kept, text_sha256)`` of every document, dropped ones too.

    Documents for which ``earlier`` holds are the history that is indexed;
    all others are looked up. Texts are equal if their bytes are; null counts
    as empty, long texts are hashed whole. Of equal texts the row with the
    largest key stays (null is the smallest); of repeated rows with that key
    one stays. Further columns are not read. An empty table gives an empty result.
    """
    rows = digests_of(docs, key, text, _early=F.coalesce(earlier, F.lit(False)))
    index = digest_index(by_digest(rows.where("_early")))
    found = stored(looked_up(index, by_digest(rows.where("not _early"))), "looked-up")
    out = with_decision(rows.select("_key", "_at", "_digest"), decided(index, found))
    return out.select(
        F.col("_key").alias(key), F.col("best.key").alias("keep_key"), F.col("copies").alias("group_size"),
        (F.col("_at") == -F.col("best.at")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose text the index does not hold, one of each text, all columns kept.

    ``index`` comes from :func:`digest_index` over :func:`by_digest` of
    :func:`digests_of` earlier documents. The rules of :func:`exact_groups`
    hold for nulls, long texts, repeated rows and empty tables; names of
    further columns cannot clash.
    """
    rows = digests_of(docs, key, text, row=as_row(docs))
    found = looked_up(index, by_digest(rows))
    stays = found.where("slot < 0").select(F.col("_digest").alias("_of"), (-F.col("best.at")).alias("_stays"))
    return rows_back(rows.join(stays, (F.col("_at") == F.col("_stays")) & (F.col("_digest") == F.col("_of"))))


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids follow the order of arrival: the lower half of their range is the history."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    earlier = F.lit(False) if low is None else F.col("doc_id") <= (low + high) // 2
    return exact_groups(docs, earlier).withColumnRenamed("keep_key", "keep_id")
