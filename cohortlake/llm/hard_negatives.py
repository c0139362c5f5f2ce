"""Hard-negative mining: windows of scores searched in a multiway hyperplane tree with distance ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.llm.common import fields, stored
from cohortlake.llm.registry import query, table

#: Split points of a node, rows that a leaf should hold, and rows of a block: a larger leaf has several blocks.
SPLITS, LEAF_ROWS, BLOCK_ROWS = 8, 1024, 4096
#: Levels of the tree; what is left below them stands in one leaf.
MOST_LEVELS = 12
#: Rows that the split points are chosen from; every row is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 16 << 20
#: Bytes of anchor vectors that one broadcast set holds; more anchors are searched in several rounds.
SET_BYTES = 16 << 20
#: Anchors whose scores with a block are in memory at a time.
STEP_ANCHORS = 256
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
#: Squared norms below this let a hundred times any score fit a long.
MOST_NORM = float(1 << 55)
#: Below this, sums of products are exact in doubles in any order.
EXACT_NORM = float(1 << 52)
NOTHING = -(1 << 62)

LONG = T.LongType()


def usable_rows(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(id, label, q)`` of the rows that take part, each once, with ``q`` the components times 256, rounded down."""
    x = F.col("_x")
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).cast("array<double>").alias("_x"))
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + (F.lit(256.0) * v) * (F.lit(256.0) * v))
    fine = rows.where("id IS NOT NULL AND label IS NOT NULL AND _x IS NOT NULL").where(
        ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & (norm < F.lit(MOST_NORM)))
    quantised = F.transform(x, lambda v: F.floor(F.lit(256.0) * v))
    return fine.select("id", "label", quantised.alias("q")).distinct()


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten()).astype(np.float64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


@dataclass
class Tree:
    """A multiway hyperplane tree over vectors that one further component lifts to equal norm.

    On that sphere the distance from an anchor falls as the inner product
    grows, so a window of scores is an annulus around the anchor. A row goes
    to the child of the nearest split point. ``points`` holds each node's
    split points, ``children`` the node or leaf (as -1 - leaf) below each.
    """

    top: float  # the largest squared norm of all rows
    points: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    #: Per node, ``[i, j]``: least and largest distance from split point i to the rows below child j.
    low: list[np.ndarray] | None = None
    high: list[np.ndarray] | None = None

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (1.0 + np.sqrt(self.top))

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (vectors * vectors).sum(1), 0))
        return np.concatenate([vectors, rest[:, None]], 1)

    def distances(self, node: int, lifted: np.ndarray) -> np.ndarray:
        """From each row to each split point of a node."""
        points = self.points[node]
        square = (lifted * lifted).sum(1)[:, None] + (points * points).sum(1) - 2 * (lifted @ points.T)
        return np.sqrt(np.maximum(square, 0))

    def path(self, leaf: int) -> list[tuple[int, int]]:
        return self.paths()[leaf]

    def paths(self) -> list[list[tuple[int, int]]]:
        """For each leaf the (node, child) steps that lead to it."""
        if not hasattr(self, "_paths"):
            self._paths = [[] for _ in range(self.leaves)]
            todo: list = [(0, [])] if self.points else []
            while todo:
                node, steps = todo.pop()
                for j, below in enumerate(self.children[node]):
                    if below < 0:
                        self._paths[-1 - below] = [*steps, (node, j)]
                    else:
                        todo.append((below, [*steps, (node, j)]))
        return self._paths

    def leaf_of(self, lifted: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lifted), np.int64)
        todo = [(0, np.arange(len(lifted)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            child = self.distances(node, lifted[rows]).argmin(1)
            for j, below in enumerate(self.children[node]):
                mine = rows[child == j]
                if len(mine) and below < 0:
                    out[mine] = -1 - below
                elif len(mine):
                    todo.append((below, mine))
        return out


def grown(sample: np.ndarray, top: float, leaves: int, splits: int = SPLITS) -> Tree:
    """A tree of about so many leaves; a node's split points are rows far from each other, taken one by one."""
    tree = Tree(top, [], [], 0)
    lifted = tree.lifted(sample)
    least = max(2 * splits, len(sample) // max(leaves, 1))

    def node(rows: np.ndarray, level: int = 1) -> int:
        here = lifted[rows]
        points = [here[0]]
        far = np.full(len(rows), np.inf)
        while len(points) < splits:
            far = np.minimum(far, ((here - points[-1]) ** 2).sum(1))
            if far.max() <= 1e-9 * (1 + top):
                break
            points.append(here[far.argmax()])
        number = len(tree.points)
        tree.points.append(np.array(points))
        tree.children.append([])
        nearest = tree.distances(number, here).argmin(1)
        for j in range(len(points)):
            mine = rows[nearest == j]
            if len(mine) > least and len(mine) < len(rows) and level < MOST_LEVELS:
                tree.children[number].append(node(mine, level + 1))
            else:
                tree.children[number].append(-1 - tree.leaves)
                tree.leaves += 1
        return number

    if leaves > 1 and len(sample) > least:
        node(np.arange(len(sample)))
    else:
        tree.leaves = 1
    return tree


def indexed(rows: DataFrame) -> tuple[DataFrame, Tree, int]:
    """The blocks of all leaves, the tree with its ranges, and the number of components.

    The split points come from a bounded sample (the rows that are first by a
    hash); every row is dealt to its leaf. Leaves of many rows have several
    blocks, dealt by hash. The ranges are least and largest distances, which
    tasks combine, over all rows.
    """
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, width, top = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(square)).first()
    width, top = width or 0, top or 0.0
    sample_rows = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * (width + 1))))
    # bounded by SAMPLE_ROWS and SAMPLE_BYTES
    sample = rows.select("q", F.xxhash64("id", "q").alias("h")).orderBy("h", "q").limit(sample_rows).toArrow()
    vectors = matrix_of(sample["q"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width))
    tree = grown(vectors, top, -(-n // LEAF_ROWS))
    shared = spark.sparkContext.broadcast(tree)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix_of(batch.column(2), width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shared.value.leaf_of(shared.value.lifted(q)))], names=["id", "label", "q", "leaf"])

    leaves = stored(rows.mapInArrow(leaf, fields(id=LONG, label=LONG, q=T.ArrayType(LONG), leaf=LONG)), "leaf-rows")
    # one row per leaf, and there are no more leaves than sampled rows
    parts = leaves.groupBy(F.col("leaf").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    dealt = leaves.join(F.broadcast(parts), F.col("leaf") == F.col("_of"))
    blocks = stored(dealt.groupBy("leaf", F.pmod(F.xxhash64("id", "q"), "parts").alias("part")).agg(
        F.collect_list(F.struct("id", "label", "q")).alias("rows")), "blocks")
    if tree.points:
        ranges(blocks, tree, width)
    return blocks, tree, width


def ranges(blocks: DataFrame, tree: Tree, width: int) -> None:
    """Fill the tree's distance ranges from all rows of all blocks; their number is bounded by the tree's size."""
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = shared.value, {}
        for batch in batches:
            for i in range(batch.num_rows):
                lifted = tree.lifted(matrix_of(batch.column(1)[i].values.field("q"), width))
                for step in tree.path(batch.column(0)[i].as_py()):
                    d = tree.distances(step[0], lifted)
                    low, high = seen.get(step, (np.inf, -np.inf))
                    seen[step] = np.minimum(low, d.min(0)), np.maximum(high, d.max(0))
        rows = [(*step, p, low[p], high[p]) for step, (low, high) in seen.items() for p in range(len(low))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5,
                                            [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)],
            names=["node", "child", "point", "low", "high"])

    double = T.DoubleType()
    found = blocks.select("leaf", "rows").mapInArrow(spans, fields(node=LONG, child=LONG, point=LONG, low=double, high=double))
    found = found.groupBy("node", "child", "point").agg(F.min("low"), F.max("high"))
    # a child that no row reached has an empty range, which meets no annulus
    tree.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    tree.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    for node, child, point, low, high in found.collect():
        tree.low[node][point, child], tree.high[node][point, child] = low, high


@dataclass
class Anchors:
    """A bounded set of anchors, and for each the windows of scores that are searched."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    leaves: np.ndarray
    #: Windows per anchor, ``[anchor, slot]``: scores from ``least`` to ``most``; empty if least > most.
    least: np.ndarray
    most: np.ndarray

    def annuli(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer distance of each window."""
        base = ((self.vectors**2).sum(1) + tree.top)[:, None]
        inner = np.sqrt(np.maximum(base - 2.0 * self.most, 0))
        outer = np.sqrt(np.maximum(base - 2.0 * self.least, 0))
        return inner - tree.slack, outer + tree.slack


def reached(tree: Tree, anchors: Anchors, annuli: tuple, node: int, alive: np.ndarray) -> np.ndarray:
    """``[anchor, child]``: a window's annulus meets the distance ranges of all split points to the child's rows."""
    inner, outer = (a[alive] for a in annuli)
    origin = np.concatenate([anchors.vectors[alive], np.zeros((len(alive), 1))], 1)
    far = tree.distances(node, origin)[:, :, None]  # anchor, split point, child
    low, high = far - tree.high[node], far + tree.high[node]
    low = np.maximum(low, tree.low[node] - far)  # the least distance that a row below the child can have
    meets = np.zeros((len(alive), far.shape[1]), bool)
    for s in range(inner.shape[1]):
        fits = (low <= outer[:, s, None, None]) & (high >= inner[:, s, None, None])
        meets |= fits.all(1) & (anchors.least[alive, s] <= anchors.most[alive, s])[:, None]
    return meets


def first_of(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, many: int) -> np.ndarray:
    """Positions of the first ``many`` entries of each owner, by score from the largest, then by id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(own)]])))
    return order[rank < many]


def scores_of(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; doubles hold them while the norms are small, else whole numbers are multiplied."""
    return a @ b.T if exact else a.astype(np.int64) @ b.astype(np.int64).T


def searched(blocks: DataFrame, tree: Tree, width: int, anchors: Anchors, same: bool, many: int, home: bool = False) -> DataFrame:
    """``(anchor, slot, id, score)``: the first rows of each window, of the anchor's label or of all others.

    Tasks go through blocks of leaves and hold, per window, the best rows so
    far; the last of them narrows the window for the next blocks. A task hands
    on ``many`` rows a window at most. ``home`` looks only at the anchor's own
    leaf, which narrows the windows of the search of all leaves.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((tree, anchors))
    exact = tree.top < EXACT_NORM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, anchors = shared.value
        slots = anchors.least.shape[1]
        search = Search(tree, anchors, same, many, exact)
        for batch in batches:
            for i in range(batch.num_rows):
                alive = search.alive(batch.column(0)[i].as_py(), home)
                if len(alive):
                    rows = batch.column(1)[i].values
                    search.block(alive, np.asarray(rows.field("id")), np.asarray(rows.field("label")),
                                 matrix_of(rows.field("q"), width))
        window, score, ids = search.best
        yield pa.RecordBatch.from_arrays(
            [pa.array(window // slots), pa.array(window % slots), pa.array(ids), pa.array(score)],
            names=["anchor", "slot", "id", "score"])

    return blocks.select("leaf", "rows").mapInArrow(run, fields(anchor=LONG, slot=LONG, id=LONG, score=LONG))


class Search:
    """What one task has found so far for the windows of a set of anchors."""

    def __init__(self, tree: Tree, anchors: Anchors, same: bool, many: int, exact: bool):
        self.tree, self.anchors, self.same, self.many, self.exact = tree, anchors, same, many, exact
        self.own = Anchors(anchors.ids, anchors.labels, anchors.vectors, anchors.leaves, anchors.least.copy(), anchors.most)
        self.best = tuple(np.empty(0, np.int64) for _ in range(3))

    def alive(self, leaf: int, home: bool) -> np.ndarray:
        """Anchors with a window that the leaf's rows can lie in."""
        alive = np.flatnonzero((self.own.least <= self.own.most).any(1))
        if home:
            return alive[self.anchors.leaves[alive] == leaf]
        if not self.tree.points:
            return alive
        annuli = self.own.annuli(self.tree)
        for node, child in self.tree.path(leaf):
            if len(alive):
                alive = alive[reached(self.tree, self.own, annuli, node, alive)[:, child]]
        return alive

    def block(self, alive: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """Exact scores of a block's rows with the anchors left; both stand by label if labels must agree."""
        if self.same:
            alive = alive[np.isin(self.anchors.labels[alive], labels)]
            alive = alive[np.argsort(self.anchors.labels[alive], kind="stable")]
            order = np.argsort(labels, kind="stable")
            ids, labels, rows = ids[order], labels[order], rows[order]
        found = [self.best]
        for at in range(0, len(alive), STEP_ANCHORS):
            some = alive[at : at + STEP_ANCHORS]
            mine = self.anchors.labels[some]
            low, high = 0, len(labels)
            if self.same:  # only the rows from the first to the last of these labels are multiplied
                low, high = np.searchsorted(labels, mine[0], "left"), np.searchsorted(labels, mine[-1], "right")
            score = scores_of(self.anchors.vectors[some], rows[low:high], self.exact)
            fits = (mine[:, None] == labels[low:high]) == self.same
            fits &= self.anchors.ids[some][:, None] != ids[low:high]
            for s in range(self.own.least.shape[1]):
                a, r = np.nonzero(fits & (score >= self.own.least[some, s, None]) & (score <= self.own.most[some, s, None]))
                window = some[a] * self.own.least.shape[1] + s
                values, names = score[a, r].astype(np.int64), ids[low:high][r]
                first = first_of(window, values, names, self.many)
                found.append((window[first], values[first], names[first]))
        if len(found) > 1:
            window, values, names = (np.concatenate(c) for c in zip(*found, strict=True))
            first = first_of(window, values, names, self.many)
            self.best = window[first], values[first], names[first]
            self.narrow()

    def narrow(self) -> None:
        """The last of the best rows of a full window is the least score that still counts."""
        window, values, _ = self.best
        if len(window) < self.many:
            return
        full = np.flatnonzero(window[self.many - 1 :] == window[: len(window) - self.many + 1])
        least = self.own.least.reshape(-1)
        least[window[full]] = np.maximum(least[window[full]], values[full + self.many - 1])


def firsts(found: DataFrame, many: int) -> DataFrame:
    """The first ``many`` rows of each window, over what all tasks found; ranked, and cut before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= many)


def percent_of(score: np.ndarray, percent: int) -> np.ndarray:
    """The least whole score that is ``percent`` of the given one or more."""
    return -((-percent * score) // 100)


def mined(rows: DataFrame, is_anchor: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", label: str = "label",
          positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of every anchor.

    ``is_anchor`` gives the condition on the key that makes a row an anchor. An anchor's positives are the
    first ``positives`` rows of its label, its negatives for each positive the
    first ``negatives`` rows of other labels with a score from
    ``least_percent`` of the positive's up to the positive's own; by integer
    inner product of the components times 256 rounded down, ties by key.

    Keys and labels are whole numbers. Rows with a null key, label, vector or
    component, with a component that is not finite, or with a quantised
    squared norm of 2**55 or more (whose scores a long could not hold) take no
    part. Rows repeated with key, label and vector count once; a row never
    meets one with its own key. Shorter vectors count as filled up with zeros,
    whatever their length. Further columns are not read. An empty table, and
    one without anchors, give an empty result.
    """
    spark = rows.sparkSession
    blocks, tree, width = indexed(usable_rows(rows, key, vector, label))
    asked = stored(blocks.select("leaf", F.inline("rows")).where(is_anchor(F.col("id"))), "anchors")
    per_set = max(1, SET_BYTES // (8 * (width + 8)))
    sets = max(1, -(-asked.count() // per_set))
    out = None
    for number in range(sets):
        # about per_set rows, dealt by hash
        some = asked.where(F.pmod(F.xxhash64("id", "label", "q"), F.lit(sets)) == number).orderBy("id", "label", "q").toArrow()
        if not some.num_rows:
            continue
        part = stored(mined_set(spark, blocks, tree, width, some, positives, negatives, least_percent), "negatives")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return spark.createDataFrame([], fields(**{k: LONG for k in kinds}, rank=T.IntegerType()))
    return out


def mined_set(spark: SparkSession, blocks: DataFrame, tree: Tree, width: int, some: pa.Table, positives: int,
              negatives: int, least_percent: int) -> DataFrame:
    """The triples of a bounded set of anchors: positives first, then the windows that their scores open."""
    n = some.num_rows
    vectors = matrix_of(some["q"].combine_chunks(), width)
    ids, labels = np.asarray(some["id"].combine_chunks()), np.asarray(some["label"].combine_chunks())
    anchors = Anchors(ids, labels, vectors, np.asarray(some["leaf"].combine_chunks()),
                      np.full((n, 1), NOTHING), np.full((n, 1), -NOTHING))

    def found(same: bool, many: int) -> DataFrame:
        near = firsts(searched(blocks, tree, width, anchors, same, many, home=True), many)
        for r in near.where(F.col("rank") == many).select("anchor", "slot", "score").collect():  # one row a window at most
            anchors.least[r.anchor, r.slot] = max(anchors.least[r.anchor, r.slot], r.score)
        return stored(firsts(searched(blocks, tree, width, anchors, same, many), many), "found")

    top = found(True, positives).select("anchor", "rank", "id", "score").toArrow()  # a few rows an anchor
    anchor, slot = np.asarray(top["anchor"].combine_chunks()), np.asarray(top["rank"].combine_chunks()) - 1
    score = np.asarray(top["score"].combine_chunks())
    anchors.least, anchors.most = np.full((n, positives), 1), np.full((n, positives), 0)
    anchors.least[anchor, slot], anchors.most[anchor, slot] = percent_of(score, least_percent), score
    chosen = spark.createDataFrame(pa.table({
        "anchor": anchor, "slot": slot.astype(np.int64), "anchor_id": ids[anchor],
        "positive_id": top["id"].combine_chunks(), "positive_score": score}))
    return found(False, negatives).join(chosen, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


@query("""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM r a CROSS JOIN r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    turned = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mined(rows.withColumn("label", turned), lambda key: key % 100 == 0)
