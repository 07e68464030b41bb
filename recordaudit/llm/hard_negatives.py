"""Hard negatives by a vertical scan of columnar blocks that stops early on bounds (BOND).

A block holds some thousand rows dimension by dimension. Per anchor the dimensions are read in the order of the
anchor's descending magnitudes; what the unread ones can still add lies between bounds from each dimension's minimum
and maximum in the block. Rows whose bounds can't reach the answer leave the candidate bitmap, until exact scores
remain. First come an anchor's positives (the best rows of its label), then, in a second scan, the rows of other
labels inside the score windows the positives define.

Anchors and blocks meet in a grid: anchors are dealt to groups, blocks to shards, and a task gets one group and one
shard, both of bounded size. Only the best few rows of a cell leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordaudit.llm.hashing import lean
from recordaudit.llm.vectors import block_rows, finite, matrix, packed, parts, usable
from recordaudit.session import ship, written

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between these percentages of the positive's.
WINDOW = (80, 100)
#: Components become floor(SCALE * x), so that scores are exact integers.
SCALE = 256
#: Anchors of a group.
GROUP = 1024
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Doubles add integers exactly below this.
EXACT = 2.0 ** 53

BLOCKS = "n long, ids array<long>, labels array<string>, columns binary"
ROWS = pa.schema([("anchor_key", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values * scale, -1e300, 1e300))


def _blocks(dims: int, scale: int) -> Callable:
    """Rows of a partition as vertical blocks, sorted by label, so that a label's rows are one slice."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by([("label", "ascending"), ("id", "ascending")])
            columns = whole(matrix(rows["vector"], dims), scale).T
            return pa.RecordBatch.from_arrays(
                [pa.array([len(rows)], pa.int64()), pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
                 pa.array([rows["label"].to_pylist()], pa.list_(pa.string())), pa.array([packed(columns)], pa.binary())],
                ["n", "ids", "labels", "columns"])

        held, n, most = [], 0, block_rows(dims)
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                if n and n + part.num_rows > most:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(held)

    return pack


class Block:
    """A vertical block: ``columns[d]`` is dimension d of all rows."""

    def __init__(self, ids: np.ndarray, labels: list[str], columns: np.ndarray):
        self.ids, self.columns = ids, columns
        self.low, self.high = (columns.min(axis=1), columns.max(axis=1)) if columns.size else (np.zeros(len(columns)),) * 2
        self.slices: dict[str, tuple[int, int]] = {}
        for i, label in enumerate(labels):
            self.slices[label] = (self.slices.get(label, (i, i))[0], i + 1)

    def same(self, label: str, own: int) -> np.ndarray:
        a, b = self.slices.get(label, (0, 0))
        rows = np.arange(a, b)
        return rows[self.ids[a:b] != own]

    def different(self, label: str) -> np.ndarray:
        a, b = self.slices.get(label, (0, 0))
        return np.concatenate([np.arange(a), np.arange(b, len(self.ids))])


def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, settle: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ``settle(lower, upper)`` keeps to the end, and their exact inner products with the anchor.

    ``alive`` is the candidate bitmap as row numbers. Scores are Python integers where doubles wouldn't be exact.
    """
    if float(np.abs(anchor) @ np.maximum(np.abs(block.low), np.abs(block.high))) >= EXACT:
        exact = [int(x) for x in anchor]
        score = np.array([sum(a * int(x) for a, x in zip(exact, block.columns[:, r])) for r in alive.tolist()], dtype=object)
        keep = settle(score, score)
        return alive[keep], score[keep]
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.low, anchor * block.high])[:, order]
    # What the dimensions from the k-th on can add at least and at most.
    rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0.0)
    rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0.0)
    score = np.zeros(len(alive))
    for k in range(0, len(order), STEP):
        read = order[k:k + STEP]
        all_rows = len(alive) * 2 > len(block.ids)
        score += (anchor[read] @ block.columns[read])[alive] if all_rows else anchor[read] @ block.columns[read[:, None], alive]
        at = min(k + STEP, len(order))
        keep = settle(score + rest_low[at], score + rest_high[at])
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if not len(alive):
            break
    return alive, score


def best_of(k: int) -> Callable:
    """Keeps what can be among the k highest scores; ties stay."""

    def settle(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return settle


def inside(spans: list[tuple[int, int]], k: int) -> Callable:
    """Keeps what can be among the k highest scores of any of the closed windows.

    Once k rows are surely inside a window, its lower end rises to the least they can have.
    """

    def settle(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(lower), bool)
        for low, high in spans:
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) > k:
                low = max(low, np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (upper >= low) & (lower <= high)
        return keep

    return settle


def first(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k highest scores, ties by smaller id."""
    order = np.lexsort((ids[rows], -score))[:k]
    top = 2 ** 63 - 1
    return [(int(ids[rows[i]]), max(-top - 1, min(top, int(score[i])))) for i in order]


def window_of(score: int, percent: tuple[int, int]) -> tuple[int, int]:
    """Integers n with percent[0] * score <= 100 * n <= percent[1] * score; empty if the first is the greater."""
    return -(-percent[0] * score // 100), percent[1] * score // 100


def _grid(anchors: DataFrame, blocks: DataFrame, groups: int, shards: int, dims: int, scale: int, search: Callable) -> DataFrame:
    """``search(anchor row, its integer vector, block)`` for every anchor and block; it yields (place, id, score)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("group", F.pmod(F.xxhash64("anchor_key"), F.lit(groups)).cast("int")).withColumn("shard", every(shards))
    right = blocks.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).withColumn("group", every(groups))

    def cell(own: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and there.num_rows:
            vectors = whole(matrix(own["vector"], dims), scale)
            rows = own.drop_columns(["vector"]).to_pylist()
            for ids, labels, columns in zip(there["ids"], there["labels"], there["columns"]):
                block = Block(np.asarray(ids.values), labels.as_py(), np.frombuffer(columns.as_py()).reshape(dims, len(ids)))
                for row, vector in zip(rows, vectors):
                    out += [(row["anchor_key"], *found) for found in search(row, vector, block)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, ROWS)], schema=ROWS)

    keys = ("group", "shard")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "anchor_key long, place int, id long, score long")


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = WINDOW, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the ``anchor`` rows.

    Scores are inner products of the components floor(scale * x). An anchor's positives are the ``positives`` best other
    rows of its label; for each, the ``negatives`` best rows of other labels whose score is between ``percent`` of the
    positive's. Higher scores come first, ties by smaller id. Rows with a null id, label or vector, or with a null or
    non-finite component take no part, nor do vectors of another length than the most common. A row is never its own
    positive, nor is another row with its id; rows that repeat an id are each an anchor and a candidate. An anchor
    without positives, or a positive without negatives, gives no row; an empty table gives none. Scores beyond a long
    are held at its ends. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    given, n, dims = usable(given, "vector", F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    if not n or not dims:
        return spark.createDataFrame([], StructType.fromDDL(
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    blocks = written(given.drop("is_anchor").repartition(parts(spark, n, block_rows(dims))).mapInArrow(lean(_blocks(dims, scale)), BLOCKS))
    anchors = written(given.filter("is_anchor").drop("is_anchor").withColumn("anchor_key", F.monotonically_increasing_id()))
    groups, shards = max(1, -(-anchors.count() // GROUP)), blocks.count()

    def positive(row: dict, vector: np.ndarray, block: Block) -> Iterator[tuple]:
        alive, score = scan(vector, block, block.same(row["label"], row["id"]), best_of(positives))
        return ((0, *found) for found in first(alive, score, block.ids, positives))

    near = _top(_grid(anchors, blocks, groups, shards, dims, scale, positive), ["anchor_key"], positives)
    near = written(near.select("anchor_key", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("wanted"))

    def negative(row: dict, vector: np.ndarray, block: Block) -> Iterator[tuple]:
        spans = {w["place"]: window_of(w["positive_score"], percent) for w in row["wanted"]}
        spans = {place: s for place, s in spans.items() if s[0] <= s[1]}
        if spans:
            alive, score = scan(vector, block, block.different(row["label"]), inside(list(spans.values()), negatives))
            for place, (low, high) in spans.items():
                fits = np.flatnonzero((score >= low) & (score <= high))
                yield from ((place, *found) for found in first(alive[fits], score[fits], block.ids, negatives))

    far = _top(_grid(anchors.join(wanted, "anchor_key"), blocks, groups, shards, dims, scale, negative), ["anchor_key", "place"], negatives)
    return far.join(near, ["anchor_key", "place"]).join(anchors.select("anchor_key", F.col("id").alias("anchor_id")), "anchor_key").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
