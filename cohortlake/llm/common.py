"""Helpers of the text operators: stored tables, word hashes, packed texts."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.session import shared_folder

#: A word: any run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a task works on at a time.
SLICE_BYTES = 1 << 19

U64 = np.uint64
_MIX_1, _MIX_2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The table survives lost executors and cuts the lineage; unlike a
    checkpoint its columns can be pruned and its size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fields(**kinds: T.DataType) -> T.StructType:
    """A schema from name=type pairs, in the given order."""
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


def as_row(docs: DataFrame) -> Column:
    """The whole input row as one column, so that its names cannot clash with an operator's own."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]).alias("row")


def rows_back(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def without_text(docs: DataFrame, text: str) -> Column:
    """All columns but the text as one column ``rest``, for steps that hand the text on themselves, once."""
    others = [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns if c != text]
    return F.struct(*others, F.lit(True).alias("_")).alias("rest")  # never without a field


def text_back(df: DataFrame, docs: DataFrame, text: str, new: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` from ``rest`` and the given new ones."""
    return df.select(*[(new[c] if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def release_memory() -> None:
    """Give back what a finished partition has freed; an idle Python worker would hold it beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def as_bytes(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column; null gives None."""
    return column.cast(pa.binary()).to_pylist()


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in pieces of about ``most`` bytes of one column, at least a row each, with that column's bytes."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0))
    piece = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // most
    starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])).tolist()
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        part = batch.slice(a, b - a)
        yield part, as_bytes(part.column(column))


def map_batches(
    df: DataFrame, schema: T.StructType, run: Callable[[pa.RecordBatch], Iterator[dict] | None]
) -> DataFrame:
    """``mapInArrow`` whose function gives dicts of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for out in run(batch):
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v, pa.Array) else pa.array(v, kinds.field(k).type) for k, v in out.items()],
                    names=list(out),
                )
        release_memory()

    return df.mapInArrow(batches, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over their whole range."""
    h = h ^ (h >> U64(30))
    h = h * _MIX_1
    h = h ^ (h >> U64(27))
    h = h * _MIX_2
    return h ^ (h >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the i-th power and its inverse modulo 2**64, for i up to ``count``."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= count:
        size = max(count + 1, 1 << 16)
        up, down = np.full(size, U64(base)), np.full(size, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        known = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:  # a very long text: do not keep its tables
            del _powers[base]
    return known


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """Hash of each ``values[start:end]``; equal content gives equal hashes wherever it stands."""
    up, down = powers(base, len(values))
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``values[i:i + width]`` for every i."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, U64)
    h = np.zeros(count, U64)
    for j in range(width):
        h *= U64(_WORD_BASE)
        h += values[j : j + count]
    return mixed(h)


_bytes = mixed(np.arange(1, 257, dtype=U64) * U64(_BYTE_BASE))
_bytes_lower = _bytes.copy()
_bytes_lower[ord("A") : ord("Z") + 1] = _bytes[ord("a") : ord("z") + 1]
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_space_run = re.compile(rb"[\x20\x09-\x0D]")


def _piece_hashes(piece: bytes, table: np.ndarray) -> np.ndarray:
    data = np.frombuffer(piece, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_space[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return span_hashes(table[data], starts, ends, _BYTE_BASE)


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """One 64-bit hash per word of a text; ``lower`` takes A-Z as a-z.

    Long texts are worked on in pieces cut between words, so memory beside the
    text itself is eight bytes a word.
    """
    table = _bytes_lower if lower else _bytes
    if len(text) <= SLICE_BYTES:
        return _piece_hashes(text, table)
    out, at = [], 0
    while at < len(text):
        cut = _space_run.search(text, min(at + SLICE_BYTES, len(text)))
        end = cut.start() if cut else len(text)
        out.append(_piece_hashes(text[at:end], table))
        at = end
    return np.concatenate(out)


def words_of_many(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin (one more entry at the end)."""
    counts = np.zeros(len(texts) + 1, np.int64)
    if sum(len(t) for t in texts) > 2 * SLICE_BYTES:
        parts = [word_hashes(t, lower) for t in texts]
        counts[1:] = np.cumsum([len(p) for p in parts])
        return np.concatenate(parts) if parts else np.empty(0, U64), counts
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_space[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    table = _bytes_lower if lower else _bytes
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    counts[1:] = np.searchsorted(starts, np.cumsum(sizes) - 1, "left")
    return span_hashes(table[data], starts, ends, _BYTE_BASE), counts


def packed_text(docs: DataFrame, key: str, text: str, rest: list[str]) -> DataFrame:
    """``(key, packed, rest...)`` with the text compressed, for a shuffle that has to move texts."""
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType),
        T.StructField("packed", T.BinaryType()),
        *[T.StructField(c, docs.schema[c].dataType) for c in rest],
    ])

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = pa.Codec("zstd", 3)
        for part, texts in text_slices(batch, 1):
            out = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
            yield {"key": part.column(0), "packed": pa.array(out, pa.binary()),
                   **{c: part.column(i + 2) for i, c in enumerate(rest)}}

    return map_batches(docs.select(key, text, *rest), schema, pack)


def unpacked(packed: list) -> list:
    """The texts of packed ones; null gives None."""
    codec = pa.Codec("zstd")
    return [None if p is None else codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in packed]


def sha256_hex(value: bytes) -> str:
    import hashlib

    return hashlib.sha256(value).hexdigest()
