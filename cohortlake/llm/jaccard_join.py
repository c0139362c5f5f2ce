"""N-gram Jaccard join: components of documents whose shingle sets are highly similar, exactly.

Set relations save work twice. Index lists are skipped in blocks by the size
and position of their entries, and a set that is found similar to a leader
takes over the leader's answers: only its differences to other components are
searched any further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import (
    U64, as_row, fields, map_batches, mixed, packed_text, release_memory, run_hashes, span_hashes, stored, text_slices, unpacked,
    words_of_many,
)
from cohortlake.llm.registry import query, table

SHINGLE_WORDS, PERCENT = 3, 90
#: Counters that order the shingles by frequency; their number does not depend on the corpus.
COUNTERS = 1 << 18
#: Leaders that a set is compared with before its lists are searched in full.
LEADERS = 2
#: Words of 64 parity bits of a set.
PARITY_WORDS = 8
#: Bytes of packed texts that a step of a task unpacks.
PACKED_BYTES = 1 << 18
#: Entries of an index list that one cell of its grid takes from each side.
BLOCK = 1024
#: Entries that a task searches at once.
STEP_ENTRIES = 1 << 13

LONG, INT = T.LongType(), T.IntegerType()
LONGS = T.ArrayType(LONG)


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; the whole of a text that is shorter than one."""
    hashes, begin = words_of_many([t or b"" for t in texts], lower=True)
    grams, out = run_hashes(hashes, width), []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(span_hashes(hashes, np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, U64))
    return out


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(40)).astype(np.int64) % COUNTERS


def frequencies(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How often shingles of each slot occur, over all documents: a sketch of COUNTERS numbers.

    Any order of shingles gives right results; this one puts frequent ones
    last, so that they are not looked up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, 0):
                for s in shingle_sets(texts, width):
                    np.add.at(total, slot(s), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, fields(slot=LONG, n=LONG))
    found = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int64)
    out[np.asarray(found["slot"])] = np.asarray(found["n"])
    return out


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a similar set must hold one: all but the overlap less one."""
    return n - -(-percent * n // 100) + 1


def described(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``(key, n, digest, parity, wide, tokens)``: size, digest, parity bits and rarest shingles of each set."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text, width))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    schema = fields(key=source.schema["key"].dataType, n=LONG, digest=T.BinaryType(), parity=LONGS, wide=LONGS, tokens=LONGS)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        counts = order.value
        for part, texts in text_slices(batch, 1):
            sizes, digests, bits, wide, tokens = [], [], [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                bits.append(parity(s, PARITY_WORDS))
                wide.append(parity(s, wide_words(len(s))))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first = np.lexsort((s, counts[slot(s)]))[: prefix_length(len(s), percent)] if len(s) else []
                tokens.append(s[first].view(np.int64))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            bounds = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
            yield {"key": part.column(0), "n": sizes, "digest": pa.array(digests, pa.binary()), "parity": bits, "wide": wide,
                   "tokens": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))}

    return map_batches(source, schema, run)


def wide_words(n: int) -> int:
    """Words of the parity that grows with a set: a power of two, with one to two bits a member."""
    return max(PARITY_WORDS, 1 << max(0, (n - 1).bit_length() - 6))


def parity(s: np.ndarray, words: int) -> np.ndarray:
    """Bit i is set if an odd number of the set's hashes fall on i.

    Two sets differ in at least as many members as their parities do in bits.
    A parity of half the words is the exclusive or of both halves.
    """
    bits = np.bincount((s % U64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def whole_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(node, members)`` of the documents named in ``nodes``."""
    packed = packed_text(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()), key, text, [])
    joined = packed.join(nodes, F.col("key") == F.col("node")).select("node", "packed")
    schema = fields(node=joined.schema["node"].dataType, members=T.BinaryType())

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part, packed in text_slices(batch, 1, PACKED_BYTES):
            sets = [shingle_sets([t], width)[0] for t in unpacked(packed)]
            yield {"node": part.column(0), "members": pa.array([s.tobytes() for s in sets], pa.binary())}

    return map_batches(joined, schema, run)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide parities allow the overlap; they tell large sets apart before any set moves."""
    wide = classes.select("node", "n", "wide")
    both = pairs.join(wide.withColumnsRenamed({"node": "x", "n": "nx", "wide": "wx"}), "x").join(
        wide.withColumnsRenamed({"node": "y", "n": "ny", "wide": "wy"}), "y")
    fold = lambda w: F.zip_with(F.slice(w, F.lit(1), (F.size(w) / 2).cast("int")),
                                F.slice(w, (F.size(w) / 2 + 1).cast("int"), (F.size(w) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    # similar sets have sizes of one or of neighbouring powers of two
    wx = F.when(F.size("wx") > F.size("wy"), fold(F.col("wx"))).otherwise(F.col("wx"))
    wy = F.when(F.size("wy") > F.size("wx"), fold(F.col("wy"))).otherwise(F.col("wy"))
    differ = F.aggregate(F.zip_with(wx, wy, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    near = F.lit(100 + percent) * differ <= F.lit(100 - percent) * (F.col("nx") + F.col("ny"))
    return stored(both.where(near).select("x", "y").distinct(), "likely")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` whose sets are similar."""
    both = pairs.join(sets.withColumnsRenamed({"node": "x", "members": "mx"}), "x").join(
        sets.withColumnsRenamed({"node": "y", "members": "my"}), "y").select("x", "y", "mx", "my")
    schema = T.StructType([both.schema["x"], both.schema["y"]])

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        same = []
        for p, q in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
            both_have = int((t[np.searchsorted(t, s).clip(max=len(t) - 1)] == s).sum())
            same.append(100 * both_have >= percent * (len(s) + len(t) - both_have))
        yield {"x": batch.column(0).filter(pa.array(same)), "y": batch.column(1).filter(pa.array(same))}

    return stored(map_batches(both, schema, run).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each node's component, over the nodes of the edges ``(x, y)``.

    Rounds of smallest neighbour and pointer jumping; each is written, so its
    lineage is short.
    """
    both = stored(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label"))
                    .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        beside = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("of")).agg(F.min("label").alias("low"))
        lower = labels.join(beside, labels["node"] == beside["of"], "left").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        lower = stored(lower, "labels")
        up = lower.select(F.col("node").alias("of"), F.col("label").alias("higher"))
        jumped = stored(
            lower.join(up, lower["label"] == up["of"], "left")
            .select("node", F.least("label", "higher").alias("label"), (F.least("label", "higher") < F.col("old")).alias("moved")),
            "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels


def open_entries(listed: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of nodes that have a label, with it, in the lists that still hold several labels."""
    entries = stored(listed.join(labels, "node"), "entries")
    several = entries.groupBy("token").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("token")
    return entries.join(stored(several, "open"), "token")


def cells(entries: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Entries ``(token, node, pos, label)`` of index lists dealt into cells, with size and parity bits of their sets.

    A list is cut by powers of two of the set size; an entry goes to the cell
    of the next smaller or larger part only if a set there can be similar. A
    long list is a grid of blocks, so no task gets a list whole.
    """
    long = entries.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    blocks = stored(long.select(F.col("token").alias("_of"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")), "blocks")
    # few lists are long, so their table mostly is small enough for the planner to send around
    rows = entries.join(sizes, "node").join(blocks, F.col("token") == F.col("_of"), "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1)))
    part = F.length(F.bin("n")) - 1
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)

    def cell(p: Column, kind: int, side: int, i: Column, j: Column) -> Column:
        return F.struct(p.cast("int").alias("part"), F.lit(kind).alias("kind"), F.lit(side).alias("side"),
                        i.cast("int").alias("i"), j.cast("int").alias("j"))

    own = F.transform(every, lambda k: cell(part, 0, 0, F.least(block, k), F.greatest(block, k)))
    none = F.slice(own, 1, 0)
    up = F.when(F.lit(100) * F.col("n") >= F.lit(percent) * F.call_function("shiftleft", F.lit(2).cast("long"), part),
                F.transform(every, lambda k: cell(part, 1, 0, block, k))).otherwise(none)
    down = F.when(F.lit(percent) * F.col("n") < F.lit(100) * F.call_function("shiftleft", F.lit(1).cast("long"), part),
                  F.transform(every, lambda k: cell(part - 1, 1, 1, k, block))).otherwise(none)
    dealt = rows.select("token", "node", "n", "pos", "label", "parity", F.explode(F.concat(own, up, down)).alias("c"))
    return dealt.select("token", "c.part", "c.kind", "c.i", "c.j", "c.side", "n", "pos", "node", "label", "parity")


def searched(cells: DataFrame, percent: int, leaders: int | None = None) -> DataFrame:
    """Pairs ``(x, y)`` of different labels whose sizes, positions and parity bits all allow the overlap.

    Entries of a cell stand by size; for each, the block of those that are too
    large is skipped. With ``leaders``, rows ``(x, rank, h, y)`` instead: for
    each entry the partners that come first by so many seeded hashes, so a
    cell gives rows in proportion to its entries, not to its pairs.
    """
    keys = ["token", "part", "kind", "i", "j"]
    laid = cells.repartition(*keys).sortWithinPartitions(*keys, "n", "node")
    schema = fields(x=LONG, y=LONG) if leaders is None else fields(x=LONG, rank=LONG, h=LONG, y=LONG)

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Runs of whole cells, numbered in ``cell``; a cell may span batches."""
        held, many, number, last = [], 0, 0, None
        for batch in batches:
            cols = {n: np.asarray(batch.column(n)) for n in (*keys, "side", "n", "pos", "node", "label")}
            cols["parity"] = np.asarray(batch.column("parity").flatten()).view(U64).reshape(-1, PARITY_WORDS)
            ids = np.stack([cols.pop(k).astype(np.int64) for k in keys])
            cols["apart"] = ids[keys.index("kind")] == 1
            new = np.concatenate([[last is None or (ids[:, 0] != last).any()], (ids[:, 1:] != ids[:, :-1]).any(0)])
            cols["cell"] = number + np.cumsum(new)
            number, last = int(cols["cell"][-1]), ids[:, -1]
            held.append(cols)
            many += len(new)
            if many < STEP_ENTRIES:
                continue
            g = {k: np.concatenate([h[k] for h in held]) for k in cols}
            begin = int(np.searchsorted(g["cell"], number, "left"))  # of the last cell, which may go on
            if begin:
                yield {k: v[:begin] for k, v in g.items()}
            held, many = [{k: v[begin:] for k, v in g.items()}], many - begin
        if held:
            yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_cells(batches):
            x, y = cell_pairs(g, percent)
            if len(x):
                yield emitted([(np.minimum(x, y), np.maximum(x, y)) if leaders is None else first_partners(x, y, leaders)])
        release_memory()

    def emitted(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=schema.names)

    return laid.mapInArrow(run, schema)


def first_partners(x: np.ndarray, y: np.ndarray, leaders: int) -> tuple[np.ndarray, ...]:
    """For each node of the pairs and each seed the partner with the smallest hash."""
    a, b = np.concatenate([x, y]), np.concatenate([y, x])
    out = []
    for k in range(leaders):
        seed = U64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (mixed(b.astype(U64) + seed) >> U64(1)).astype(np.int64)
        order = np.lexsort((h, a))
        first = order[np.flatnonzero(np.concatenate([[True], np.diff(a[order]) != 0]))] if len(a) else order
        out.append((a[first], np.full(len(first), k), h[first], b[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cell_pairs(g: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs inside cells that may be similar and have different labels.

    Entries stand by cell and size. Each is compared with the k-th one after
    it, for all entries at once and k = 1, 2, ...; an entry whose k-th
    neighbour is in another cell or too large is done.
    """
    n, pos, cell, node = g["n"], g["pos"].astype(np.int64), g["cell"], g["node"]
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    i, k = np.arange(len(n)), 0
    while len(i):
        k += 1
        i = i[i + k < len(n)]
        i = i[(cell[i + k] == cell[i]) & (percent * n[i + k] <= 100 * n[i])]
        j = i + k
        ok = (g["label"][j] != g["label"][i]) & ~(g["apart"][i] & (g["side"][j] == g["side"][i]))
        a, b = i[ok], j[ok]
        both = n[a] + n[b]
        # |x| + |y| - 2 overlap <= (100 - percent) / (100 + percent) * (|x| + |y|)
        overlap = -(-percent * both // (100 + percent))
        most = np.minimum(n[a] - pos[a], n[b] - pos[b]) + np.minimum(pos[a], pos[b])
        a, b, both = (v[most >= overlap] for v in (a, b, both))
        differ = np.bitwise_count(g["parity"][a] ^ g["parity"][b]).sum(1, dtype=np.int64)
        near = (100 + percent) * differ <= (100 - percent) * both
        xs.append(node[a[near]])
        ys.append(node[b[near]])
    return np.concatenate(xs), np.concatenate(ys)


def led_pairs(listed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Each node with the leaders among its near partners, LEADERS at most.

    A leader has the smallest of a seeded hash; the members of a group of
    copies mostly agree on it. The pairs grow with the nodes and not with the
    size of the groups, and every node that has a near partner is in one.
    """
    own = listed.withColumn("label", F.col("node"))
    partners = searched(cells(own, sizes, percent), percent, LEADERS)
    first = partners.groupBy("x", "rank").agg(F.min(F.struct("h", "y")).alias("l"))
    return stored(first.select(F.least("x", "l.y").alias("x"), F.greatest("x", "l.y").alias("y")).distinct(), "led")


def prepared(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, ...]:
    """Ids with texts; size and digest of every row; one node per different set; the index lists; sizes and parities.

    Equal sets are one node, so a group of copies is one row after the first aggregate.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"percent must be 50 to 100, not {percent}")
    ids = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    each = described(ids, "_id", "_text", width, percent)
    rows = stored(each.select("key", "n", "digest"), "described")
    classes = stored(
        each.where("n > 0 and key is not null").groupBy("digest")
        .agg(F.min("key").alias("node"), *[F.first(c).alias(c) for c in ("n", "parity", "wide", "tokens")]), "classes")
    # from 0 in the order of the lists: what stands before a shingle can be shared too
    postings = classes.select("node", F.posexplode("tokens").alias("pos", "token"))
    tokens = stored(postings.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("token"), "tokens")
    listed = stored(postings.join(tokens, "token"), "listed")
    return ids, rows, classes, listed, classes.select("node", "n", "parity")


def similar_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                  percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, ``(x, y)`` with x < y, and ``(key, node)``: the class of each document.

    A class is named by its smallest key; documents of one class have equal
    sets and are linked with each other and with all documents of the classes
    that theirs links to. Every link is verified on whole sets and none is
    left out, so a cluster of n different near copies gives its n * n links:
    :func:`similar_components` does not need them. The rules for nulls, empty
    and long texts, repeated rows and empty tables are the same; documents
    with an empty set have no class, and rows that share a key are not linked
    for that.
    """
    ids, rows, classes, listed, sizes = prepared(docs, key, text, width, percent)
    own = listed.withColumn("label", F.col("node"))
    pairs = likely(stored(searched(cells(own, sizes, percent), percent).distinct(), "candidates"), classes, percent)
    sets = stored(whole_sets(ids, stored(nodes_of(pairs), "nodes"), "_id", "_text", width), "sets")
    member = rows.where("n > 0 and key is not null").join(classes.select("digest", "node"), "digest")
    return verified(pairs, sets, percent), member.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "node").distinct()


def link_counts(links: DataFrame, member: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_links)``: how many other documents each document of a class is linked with."""
    sizes = stored(member.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "class-sizes")
    both = links.union(links.select("y", "x")).toDF("node", "other")
    beside = both.join(sizes.withColumnsRenamed({"node": "_of", "size": "_size"}), F.col("other") == F.col("_of")).groupBy(
        F.col("node").alias("_node")).agg(F.sum("_size").alias("_others"))
    counted = sizes.join(beside, F.col("node") == F.col("_node"), "left").select(
        F.col("node").alias("_node"), (F.col("size") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"))
    return member.join(counted, F.col("node") == F.col("_node")).select(key, "n_links")


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row; the smallest key that its links reach.

    Keys are whole numbers. Sets link when ``100 * intersection >= percent *
    union``, exactly. Empty sets (null text, no word) link with nothing. Long
    texts give whole sets, an empty table an empty result, and further columns
    are not read. :func:`similar_links` gives the links themselves. Rows that share a key are one document and reach each other.
    Rows without a key are not linked and have no component. ``percent`` is 50
    to 100: below, sets that differ by more than a factor of two can link, and
    the cells hold only neighbouring powers of two of the size.
    """
    ids, rows, classes, listed, sizes = prepared(docs, key, text, width, percent)
    full = rows.where("n > 0 and key is not null")
    led = led_pairs(listed, sizes, percent)
    pairs = likely(led, classes, percent)
    sets = stored(whole_sets(ids, stored(nodes_of(pairs), "nodes"), "_id", "_text", width), "sets")

    member = full.select("key", "digest").join(classes.select("digest", "node"), "digest")
    several = member.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    same_key = member.join(several.select(F.col("key").alias("_k"), "x"), F.col("key") == F.col("_k")).where(
        "x < node").select("x", F.col("node").alias("y"))
    first_links = stored(verified(pairs, sets, percent).union(same_key), "links")
    nodes = nodes_of(led)  # every node that has a near partner
    known = components(first_links)
    labels = nodes.join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    more = stored(searched(cells(open_entries(listed, labels), sizes, percent), percent).distinct(), "candidates")
    rest = likely(more, classes, percent)
    missing = stored(nodes_of(rest).join(sets.select("node"), "node", "left_anti"), "nodes")
    if not missing.isEmpty():
        sets = stored(sets.union(whole_sets(ids, missing, "_id", "_text", width)), "sets")
    links = verified(rest, sets, percent)
    final = components(first_links.union(links))
    marked = classes.select(F.col("digest").alias("_digest"), "node").join(
        final.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    marked = stored(marked.select("_digest", F.coalesce("label", "node").alias("component")), "components")
    out = rows.select("key", "n", F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest")).join(
        marked, F.col("digest") == F.col("_digest"), "left")
    kind = docs.schema[key].dataType
    return out.select(F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that are the first of their component, all columns kept.

    Of rows that share a key all stay or go. Rows without a key stay.
    """
    found = similar_components(docs, key, text, **settings)
    gone = stored(found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias("_gone")).distinct(), "gone")
    rows = docs.select(as_row(docs), F.col(key).alias("_key"))
    return rows.join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("row.*")


@query()
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
